"""SimHash near-duplicates by anchor points of a covering code."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandkit.llm.common import checkpoint, connected_components, join_counted, labels_of_links, map_batches
from strandkit.llm.jaccard import similar_texts

SEED = 42
#: Length of the perfect Hamming code that gives the anchors of a half; its covering radius is 1.
CODE = 31


def fingerprint(text: bytes | None, width: int) -> int:
    """64-bit SimHash of the word shingles of a text; 0 if it has no words."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    hashes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(SEED))), np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        counts += np.unpackbits(hashes[at : at + 65_536], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int = 3) -> DataFrame:
    """Rows (id, fp), fp the fingerprint as a signed long: A-Z lower-cased, split at ASCII white space."""
    kind = dict(docs.dtypes)[id_col]

    def run(batch):
        fps = np.array([fingerprint(x, width) for x in batch.column(1).cast(pa.binary()).to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return map_batches(docs.select(F.col(id_col).alias("id"), text_col), run, f"id {kind}, fp long")


def dealt_to_anchors(distinct: DataFrame) -> DataFrame:
    """Rows (key, fp, home): each fingerprint at every anchor that it must visit, home at its nearest one.

    Of two fingerprints with at most three different bits, one half of 32 bits has at most one. So in that half the
    threshold is one, the covering radius is one, and a visit to every anchor within two bits meets all partners
    at their home. In the Hamming code of length 31 the syndrome of a word, the XOR of the numbers 1 to 31 of its set
    bits, is the number of the bit to flip for the nearest code word. The code words at distance two flip two bits
    whose numbers' XOR is the syndrome: 15 of them, or none for a code word.
    """

    def run(batch):
        fp = batch.column(0).to_numpy().view(np.uint64)
        keys, fps, homes = [], [], []
        for half in (0, 1):
            word = (fp >> np.uint64(32 * half)) & np.uint64(2**CODE - 1)
            syndrome = np.zeros(len(fp), np.uint64)
            for i in range(1, CODE + 1):
                syndrome ^= (word >> np.uint64(i - 1) & np.uint64(1)) * np.uint64(i)
            bit = lambda i: np.where(i > 0, np.uint64(1) << np.maximum(i, 1).astype(np.uint64) - np.uint64(1), np.uint64(0))
            tag = np.uint64(half << CODE)
            keys.append((word ^ bit(syndrome)) | tag)
            fps.append(fp)
            homes.append(np.ones(len(fp), bool))
            for i in range(1, CODE + 1):
                other = syndrome ^ np.uint64(i)
                ok = (other > i) & (syndrome > 0)
                keys.append(((word ^ bit(np.uint64(i)) ^ bit(other)) | tag)[ok])
                fps.append(fp[ok])
                homes.append(np.zeros(int(ok.sum()), bool))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(fps).view(np.int64)), pa.array(np.concatenate(homes))], names=["key", "fp", "home"])

    return map_batches(distinct.select("fp"), run, "key long, fp long, home boolean", rows=20_000)


def _links(key: np.ndarray, fp: np.ndarray, home: np.ndarray, bits: int, most: int = 1 << 22):
    """Links between rows of the same key of which the second is at home; rows sorted by key, homes first."""
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[new, len(key)])
    n_home = np.add.reduceat(home.astype(np.int64), new)
    useful = np.repeat((n_home > 0) & (sizes > 1), sizes)
    rows = np.flatnonzero(useful)
    first, times = np.repeat(new, sizes)[rows], np.repeat(n_home, sizes)[rows]
    ends = times.cumsum()
    at, found = 0, []
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        t = times[at:to]
        a = np.repeat(rows[at:to], t)
        b = np.repeat(first[at:to], t) + np.arange(len(a)) - np.repeat(t.cumsum() - t, t)
        x = fp[a] ^ fp[b]
        near = (np.bitwise_count(x) <= bits) & (x != 0)
        found.append(np.stack([fp[a[near]], fp[b[near]]]))
        at = to
    return np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.uint64)


def links(distinct: DataFrame, bits: int = 3, most_homes: int = 1024) -> DataFrame:
    """Links (src, dst) between distinct fingerprints whose components are those of all pairs within so many bits.

    The rows of an anchor are compared with those at home there. An anchor with over most_homes of them is dealt into
    blocks: homes by a hash, visitors by another, each pair of blocks a key of its own, so no task holds a whole hot
    anchor and no pair is lost. A task gives the spanning links of what it found, not all pairs.
    """
    if bits > 3:
        raise ValueError("two halves with a threshold of one each cover three bits at most")
    rows = dealt_to_anchors(distinct)
    hot = checkpoint(rows.where("home").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most_homes).select("key", F.ceil(F.col("n") / most_homes).cast("int").alias("blocks")))
    n_hot = hot.count()
    rows = rows.withColumn("block", F.lit(0).cast("long"))
    if n_hot:
        joined = rows.join(F.broadcast(hot) if n_hot <= 10_000 else hot, "key", "left")
        block = F.pmod(F.xxhash64("fp"), F.col("blocks"))
        every = F.sequence(F.lit(0), F.col("blocks") - 1)
        # as a visitor: own column, all rows of home blocks; as a home: own row, all columns
        visit = joined.where("blocks is not null").select("key", "fp", F.lit(False).alias("home"), F.explode(F.transform(every, lambda i: i * F.col("blocks") + block)).alias("block"))
        at_home = joined.where("blocks is not null and home").select("key", "fp", "home", F.explode(F.transform(every, lambda i: block * F.col("blocks") + i)).alias("block"))
        rows = joined.where("blocks is null").select("key", "fp", "home", "block").unionByName(visit).unionByName(at_home)
    rows = rows.select(F.struct("key", "block").alias("at"), "fp", "home").repartition("at").sortWithinPartitions("at", F.desc("home")).select(F.xxhash64("at").alias("key"), "fp", "home")

    def run(batches):
        key, fp, home = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)

        def spanning(pairs):
            nodes, index = np.unique(pairs, return_inverse=True)
            index = index.reshape(pairs.shape)
            label = labels_of_links(index[0], index[1], len(nodes))
            differ = label != np.arange(len(nodes))
            return pa.RecordBatch.from_arrays([pa.array(nodes[differ].view(np.int64)), pa.array(nodes[label[differ]].view(np.int64))], names=["src", "dst"])

        for batch in batches:
            key = np.r_[key, batch.column(0).to_numpy()]
            fp = np.r_[fp, batch.column(1).to_numpy().view(np.uint64)]
            home = np.r_[home, batch.column(2).to_numpy(zero_copy_only=False)]
            if len(key) < 100_000:
                continue
            last = int(np.flatnonzero(key == key[-1])[0])
            if last:
                yield spanning(_links(key[:last], fp[:last], home[:last], bits))
                key, fp, home = key[last:], fp[last:], home[last:]
            elif (n := int(home.sum())) < len(key):
                yield spanning(_links(key, fp, home, bits))
                key, fp, home = key[:n], fp[:n], home[:n]  # of an anchor with very many visitors the homes are enough
        if len(key):
            yield spanning(_links(key, fp, home, bits))

    return rows.mapInArrow(run, "src long, dst long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, bits: int = 3, similar: float | None = None, similar_width: int = 5) -> DataFrame:
    """Documents grouped by fingerprints that are linked, directly or over others, by at most so many different bits.

    If similar is given, texts whose shingles of similar_width words have at least this Jaccard similarity are linked as
    well: their fingerprints differ in some ten bits, more than any covering code reaches at a bearable number of visits.

    Returns the id, fingerprint (16 hexadecimal digits) and component_id, the smallest id in the group. Equal
    fingerprints are compared once, however many documents have them. A null, empty or blank text has the fingerprint
    zero and is linked like any other. A null id never names a group unless all of its ids are null; repeated rows
    are kept; an empty table gives no rows; other columns are not read.
    """
    if similar is None:
        each = checkpoint(fingerprints(docs, id_col, text_col, width))
    else:
        keyed = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash")).alias("row"), F.col(text_col).alias("text"))
        each = checkpoint(fingerprints(keyed, "row", "text", width).select("id.id", "id.text_hash", "fp"))
    distinct = checkpoint(each.groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("n")))
    edges = links(distinct, bits)
    if similar is not None:
        sets, pairs = similar_texts(docs, text_col, similar, similar_width)
        of_set = each.select("text_hash", "fp").distinct().join(sets, "text_hash").select("set", "fp").distinct()
        first = checkpoint(of_set.groupBy("set").agg(F.min("fp").alias("first")))
        same = of_set.join(first, "set").where("fp <> first").select(F.col("fp").alias("src"), F.col("first").alias("dst"))
        end = lambda side: first.select(F.col("set").alias(side), F.col("first").alias(f"{side}_fp"))
        pairs = pairs.join(end("src"), "src").join(end("dst"), "dst").select(F.col("src_fp").alias("src"), F.col("dst_fp").alias("dst"))
        edges = edges.unionByName(same).unionByName(pairs)
    groups = connected_components(edges)
    grouped = distinct.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lowest = grouped.groupBy("component").agg(F.min("low").alias("component_id"))
    named = checkpoint(grouped.join(lowest, "component").select("fp", "component_id", "n"))
    total = distinct.agg(F.sum("n")).first()[0] or 0
    return join_counted(each, named, "fp", "n", total).select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
