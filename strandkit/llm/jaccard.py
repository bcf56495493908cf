"""Near copies by the exact Jaccard similarity of word shingles; banded MinHash gives the candidates."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandkit.llm.common import checkpoint, connected_components, consecutive_groups, labels_of_links, map_batches

SEED = 43
#: A pair of similarity 0.8 agrees in some band of six of 30 with probability 0.9999, one of 0.3 with 0.02.
BANDS, ROWS = 30, 6

_RANDOM = np.random.Generator(np.random.PCG64(SEED)).integers(0, 1 << 63, (3, BANDS * ROWS), np.uint64)
_MASKS, _FACTORS, _JOIN = _RANDOM[0][:, None], (_RANDOM[1] * np.uint64(2) + np.uint64(1))[:, None], _RANDOM[2] * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ x >> np.uint64(29)


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of so many words; of all words if there are fewer; none without words."""
    words = text.lower().split() if text else []
    hashes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words, repeat(SEED))), ">u8").astype(np.uint64)
    if not len(hashes):
        return hashes
    length = min(width, len(hashes))
    n = len(hashes) - length + 1
    total = np.zeros(n, np.uint64)
    for i in range(length):
        total = _mixed(total + hashes[i : i + n])
    return np.unique(total)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One key for each band of the MinHash signature."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        x = (shingles[None, at : at + 1024] ^ _MASKS) * _FACTORS
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        low = np.minimum(low, x.min(1))
    return _mixed((low * _JOIN).reshape(BANDS, ROWS).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def signatures(docs: DataFrame, text_col: str, width: int) -> DataFrame:
    """Rows (text_hash, set, bands) of the texts with words; set is a hash of the shingle set."""

    def run(batch):
        hashes, texts = batch.column(0).to_numpy(), batch.column(1).cast(pa.binary()).to_pylist()
        rows = [(h, s) for h, s in zip(hashes.tolist(), (shingle_set(t, width) for t in texts)) if len(s)]
        sets = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for _, s in rows], np.uint64).view(np.int64)
        keys = np.concatenate([band_keys(s) for _, s in rows]).view(np.int64) if rows else np.zeros(0, np.int64)
        bands = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, BANDS, dtype=np.int32)), pa.array(keys))
        return pa.RecordBatch.from_arrays([pa.array([h for h, _ in rows], pa.int64()), pa.array(sets), bands], names=["text_hash", "set", "bands"])

    return map_batches(docs.select(F.xxhash64(text_col), text_col), run, "text_hash long, set long, bands array<long>")


def candidate_links(sets: DataFrame) -> DataFrame:
    """Links (src, dst) of the sets that agree in a band to one of them: a sort by key, nothing held of a hot key."""
    rows = sets.select(F.explode("bands").alias("key"), "set").repartition("key").sortWithinPartitions("key")

    def run(batches):
        last_key = last_set = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, own = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            new = np.r_[key[0] != last_key, key[1:] != key[:-1]]
            first = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            low = np.where(first < 0, own[0] if last_set is None else last_set, own[first])
            last_key, last_set = key[-1], low[-1]
            yield pa.RecordBatch.from_arrays([pa.array(own[own != low]), pa.array(low[own != low])], names=["src", "dst"])

    return rows.mapInArrow(run, "src long, dst long")


def similar_pairs(sets: list[np.ndarray], own: np.ndarray, across: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets with at least this similarity, by their places; if across, only of different blocks."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    size = np.array([len(sets[i]) for i in order])
    ends = size.cumsum()
    starts = ends - size
    index = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)[1].ravel()
    mark, a, b = np.zeros(index.max() + 1, bool), [], []
    for i in range(len(order) - 1):
        to = int(np.searchsorted(size, size[i] / threshold + 1e-9, "right"))
        if to <= i + 1:
            continue
        mark[index[starts[i] : ends[i]]] = True
        shared = np.add.reduceat(mark[index[starts[i + 1] : ends[to - 1]]].astype(np.int64), starts[i + 1 : to] - starts[i + 1])
        mark[index[starts[i] : ends[i]]] = False
        near = i + 1 + np.flatnonzero(shared >= threshold * (size[i] + size[i + 1 : to] - shared) - 1e-9)
        if across:
            near = near[own[order[near]] != own[order[i]]]
        a.append(np.full(len(near), order[i]))
        b.append(order[near])
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))


def verified_links(members: DataFrame, threshold: float, width: int, block: int, block_bytes: int) -> DataFrame:
    """Links (src, dst) that span the similar pairs among members(component, set, text) of the same component.

    A large component is dealt into blocks by a hash, bounded in members and in text, and each pair of blocks is compared by itself.
    """
    sizes = members.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum(F.octet_length("text").cast("long")) / block_bytes), F.lit(1)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int")
    every = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(F.least(i, F.col("own")).alias("low"), F.greatest(i, F.col("own")).alias("high")))
    rows = members.join(sizes, "component").withColumn("own", own).withColumn("pair", F.explode(every)).withColumn("group", F.xxhash64("component", "pair"))
    rows = rows.repartition("component", "pair").sortWithinPartitions("group", "component", "pair").select("group", "component", F.col("pair.low").alias("low"), F.col("pair.high").alias("high"), "own", "set", "text")

    def run(batches):
        for group in consecutive_groups(batches, 4):
            if group.num_rows < 2:
                continue
            sets = [shingle_set(t, width) for t in group.column(6).cast(pa.binary()).to_pylist()]
            a, b = similar_pairs(sets, group.column(4).to_numpy(), group.column(2)[0].as_py() != group.column(3)[0].as_py(), threshold)
            label, names = labels_of_links(a, b, len(sets)), group.column(5).to_numpy()
            differ = label != np.arange(len(label))
            yield pa.RecordBatch.from_arrays([pa.array(names[differ]), pa.array(names[label[differ]])], names=["src", "dst"])

    return rows.mapInArrow(run, "src long, dst long")


def similar_texts(docs: DataFrame, text_col: str, threshold: float = 0.8, width: int = 5, block: int = 512, block_bytes: int = 8 << 20) -> tuple[DataFrame, DataFrame]:
    """(sets, links): rows (text_hash, set) of the distinct texts with words, and links (src, dst) between sets.

    A set is that of a text's shingles of width words, A-Z lower-cased, split at ASCII white space; fewer words are one shingle.
    Sets that agree in a band of their MinHash signatures are candidates; within the groups that these form, all pairs are
    compared by their exact Jaccard similarity. The links span the pairs that reach the threshold. A pair of
    similarity 0.8 with no third text to lead to it is missed with probability 0.0001. Texts without words are in no row.
    """
    each = checkpoint(signatures(docs, text_col, width).dropDuplicates(["text_hash"]))
    distinct = each.select("set", "bands").dropDuplicates(["set"])
    groups = connected_components(candidate_links(distinct))
    sets = each.select("text_hash", "set")
    wanted = sets.groupBy("set").agg(F.min("text_hash").alias("text_hash")).join(groups.select(F.col("node").alias("set"), "component"), "set")
    texts = docs.select(F.col(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    members = checkpoint(texts.join(wanted, "text_hash").dropDuplicates(["set"]).select("component", "set", "text"))
    return sets, verified_links(members, threshold, width, block, block_bytes)
