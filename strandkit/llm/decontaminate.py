"""Benchmark decontamination as a prefix-filtered containment join."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandkit.llm.common import checkpoint, map_batches, scratch_path, sliced

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a text: runs of digits, letters and non-ASCII characters, A-Z lower-cased."""
    return WORD(text.lower()) if text else []


def windows_of(words: list[bytes], width: int) -> list[tuple[bytes, ...]]:
    """All runs of so many words; the whole text if it is shorter; none if it has no words."""
    if not words:
        return []
    return list(zip(*(words[i:] for i in range(width)))) if len(words) >= width else [tuple(words)]


def shingles_of(window, size: int) -> list[tuple[bytes, ...]]:
    return list(zip(*(window[i:] for i in range(min(size, len(window))))))


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()


#: Windows by their rarest shingle: (offset of the shingle, words, items).
Filed = dict[tuple[bytes, ...], list[tuple[int, list[bytes], frozenset[str]]]]


def file_windows(items: dict[tuple[bytes, ...], set[str]], counts: dict[tuple[bytes, ...], int], size: int) -> Filed:
    """The windows of a block of items, each under its rarest shingle.

    A window is contained in a document only if all of its shingles are, so the prefix that a join must look at
    is one shingle long; the rarest gives the fewest candidates. Windows of which no document has that are left out.
    """
    filed: Filed = {}
    for window, ids in items.items():
        count, shingle, offset = min((counts.get(x, 0), x, i) for i, x in enumerate(shingles_of(window, size)))
        if count:
            filed.setdefault(shingle, []).append((offset, list(window), frozenset(ids)))
    return filed


def search(filed: Filed, lengths: list[int], words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
    """Start and end word of each occurrence of a window, and their items; lengths are those of the shingles."""
    n, spans, found = len(words), [], set()
    for length in lengths:
        for at, shingle in enumerate(zip(*(words[i:] for i in range(length)))):
            if shingle not in filed:
                continue
            for offset, window, ids in filed[shingle]:
                start, end = at - offset, at - offset + len(window)
                if start >= 0 and end <= n and words[start:end] == window:  # positional and length bounds, then all words
                    spans.append((start, end))
                    found |= ids
    return spans, found


def _block_windows(benchmark: DataFrame, width: int) -> DataFrame:
    """Rows (item, window), window its words joined by spaces."""

    def run(batch):
        ids, texts = batch.column(0).to_pylist(), _texts(batch, 1)
        rows = [(i, b" ".join(w)) for i, t in zip(ids, texts) for w in set(windows_of(words_of(t), width))]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.string()), pa.array([x[1] for x in rows], pa.binary())], names=["item", "window"])

    return map_batches(benchmark, run, "item string, window binary")


def shingle_counts(docs: DataFrame, wanted: set[tuple[bytes, ...]]) -> dict[tuple[bytes, ...], int]:
    """How often each wanted shingle stands in all documents; wanted is bounded by the block of windows."""
    order = sorted(wanted)
    place = docs.sparkSession.sparkContext.broadcast({x: i for i, x in enumerate(order)})

    def run(batches):
        place_of, total = place.value, Counter()
        lengths = sorted({len(x) for x in place_of})
        for batch in sliced(batches):
            for text in _texts(batch, 0):
                words = words_of(text)
                for length in lengths:
                    total.update(filter(place_of.__contains__, zip(*(words[i:] for i in range(length)))))
        rows = [(place_of[x], n) for x, n in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int64())], names=["at", "n"])

    counted = docs.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    place.destroy()
    return {order[at]: n for at, n in zip(counted.column("at").to_pylist(), counted.column("n").to_pylist())}


def block_index(docs: DataFrame, windows: DataFrame, shingle: int):
    """The broadcast windows of a block, filed under their rarest shingles; docs has the texts alone."""
    of_block: dict[tuple[bytes, ...], set[str]] = {}
    block = windows.toArrow()
    for item, window in zip(block.column("item").to_pylist(), block.column("window").to_pylist()):
        of_block.setdefault(tuple(window.split(b" ")), set()).add(item)
    counts = shingle_counts(docs, {x for w in of_block for x in shingles_of(w, shingle)})
    return docs.sparkSession.sparkContext.broadcast(file_windows(of_block, counts, shingle))


def hits_of_blocks(docs: DataFrame, blocks: list[DataFrame], shingle: int) -> DataFrame:
    """Rows (key, spans, items): what each text of docs(key, text) with hits has of any block.

    The blocks come one after the other: a block's hits are written to the shared folder, and its index is taken from
    the executors, before the next one is built.
    """
    spark, paths = docs.sparkSession, []
    for windows in blocks:
        index = block_index(docs.select("text"), windows, shingle)

        def run(batch, index=index):
            lengths = sorted({len(x) for x in index.value})
            rows = [(key, *search(index.value, lengths, words_of(text))) for key, text in zip(batch.column(0).to_pylist(), _texts(batch, 1))]
            rows = [r for r in rows if r[1]]
            spans = pa.array([[{"start": a, "end": b} for a, b in sorted(set(r[1]))] for r in rows], SPANS)
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], batch.column(0).type), spans, pa.array([sorted(r[2]) for r in rows], pa.list_(pa.string()))], names=["key", "spans", "items"])

        paths.append(scratch_path(spark, "hits"))
        schema = f"key {docs.schema['key'].dataType.simpleString()}, spans array<struct<start:int,end:int>>, items array<string>"
        map_batches(docs, run, schema).dropDuplicates(["key"]).write.parquet(paths[-1])  # equal texts have equal hits
        index.destroy()
    joined = spark.read.parquet(*paths).groupBy("key")
    return joined.agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 10, shingle: int = 2, block_bytes: int = 12 << 20, carry: tuple[str, ...] = ()) -> DataFrame:
    """Documents with what they share with benchmark items, by windows of width consecutive words.

    An item with fewer words, but not none, is one window. The pairs of window and item are dealt by a hash into blocks of
    about block_bytes of text; a block is the unit that is sent to the executors, and one is there at a time: a larger
    benchmark takes more passes over the documents, never a larger broadcast. Within a block, shingles are ordered
    by how rare they are in all documents, each window is joined through its rarest shingle, bounded by the
    position in the window and the lengths, and verified word by word. The hits of one block are found in the pass
    that judges the documents; those of several are joined by hashes of the text.

    Returns the id, text, n_words, n_hit, n_items, items (sorted as strings), items_sha256 of them comma-joined,
    contaminated, and spans (start and end word of each run of hit words). A null or empty text has no words; a null
    item text has no windows; a null item id is written as null. Items of the same id count once. Repeated
    documents are judged one by one; empty tables give no rows, or no hits. Columns named in carry come along as the
    fields of a struct named carried, so no name can clash; others are not read.
    """
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(item_text_col).alias("text"))
    windows = checkpoint(_block_windows(items, width))
    size = windows.agg(F.sum(F.octet_length("window") + F.octet_length("item"))).first()[0] or 0
    n_blocks = max(1, -(-size // block_bytes))
    carried = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")] if carry else []
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *carried)
    index = None
    if n_blocks == 1:
        index = block_index(narrow.select("text"), windows, shingle)
        source = narrow.select("id", "text", F.lit(None).cast("array<struct<start:int,end:int>>").alias("spans"), F.lit(None).cast("array<string>").alias("items"), *(["carried"] if carry else []))
    else:
        key = F.struct(F.xxhash64(F.lit(1), "text").alias("a"), F.xxhash64(F.lit(2), "text").alias("b")).alias("key")
        blocks = [windows.where(F.pmod(F.xxhash64("window", "item"), F.lit(n_blocks)) == i) for i in range(n_blocks)]
        hits = hits_of_blocks(narrow.select(key, "text"), blocks, shingle)
        source = narrow.withColumn("key", key).join(hits, "key", "left").select("id", "text", "spans", "items", *(["carried"] if carry else []))

    def judge(batch):
        lengths = sorted({len(x) for x in index.value}) if index else []
        n_words, n_hits, founds, runs = [], [], [], []
        for text, spans, found in zip(_texts(batch, 1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            words = words_of(text)
            spans, found = search(index.value, lengths, words) if index else ([(x["start"], x["end"]) for x in spans or ()], found or ())
            hit = bytearray(len(words) if spans else 0)
            for start, end in spans:
                hit[start:end] = b"\1" * (end - start)
            n_words.append(len(words))
            n_hits.append(sum(hit))
            founds.append(sorted(found))
            runs.append([{"start": m.start(), "end": m.end()} for m in re.finditer(b"\1+", hit)])
        columns = {
            id_col: batch.column(0), text_col: batch.column(1), "n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hits, pa.int64()), "n_items": pa.array(map(len, founds), pa.int64()),
            "items": pa.array(founds, pa.list_(pa.string())), "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in founds]), "contaminated": pa.array([n > 0 for n in n_hits], pa.bool_()), "spans": pa.array(runs, SPANS),
        }
        return pa.RecordBatch.from_arrays([*columns.values(), *batch.columns[4:]], names=[*columns, *(["carried"] if carry else [])])

    kinds = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField(text_col, T.StringType())]
    kinds += T.StructType.fromDDL("n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, contaminated boolean, spans array<struct<start:int,end:int>>").fields
    return map_batches(source, judge, T.StructType([*kinds, *([narrow.schema["carried"]] if carry else [])]))
