"""Alignment of two tokenizers' tokens over the same texts, on Arrow tables inside tasks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandkit.llm.common import bound_batches, scratch_path, sliced
from strandkit.llm.encoders import ByteBpe, PieceBpe, held


class Vocabulary:
    """What each id of a tokenizer stands for, and how many bytes that has, as Arrow and NumPy arrays."""

    def __init__(self, kind: type, *args):
        self.encoder = held(kind, *args)
        tokens = self.encoder.token_bytes()
        self.bytes = pa.array(tokens, pa.large_binary())
        self.size = np.array([len(t) for t in tokens], np.int64)


def encoders(byte_file: str, piece_file: str) -> tuple[Vocabulary, Vocabulary]:
    """Of this worker: A, a byte-level vocabulary, special tokens' strings being plain text; B, pieces."""
    return held(Vocabulary, ByteBpe, byte_file, True, 300_000), held(Vocabulary, PieceBpe, piece_file)


def most_pairs(a: list[bytes], b: list[bytes]) -> int:
    """A bound on the different pairs of ids that can be linked, whatever the texts.

    Two tokens that end together share all bytes of the shorter one, so the longer one and the shorter one's length tell a
    pair but for ids with the same bytes.
    """
    same = lambda tokens: max(np.unique(np.array([hash(t) for t in tokens]), return_counts=True)[1], default=1)
    return int(same(b) * sum(map(len, a)) + same(a) * sum(map(len, b)))


def _lists(encoded: list[bytes]) -> pa.LargeListArray:
    counts = np.array([len(x) // 4 for x in encoded], np.int64)
    return pa.LargeListArray.from_arrays(pa.array(np.r_[0, counts.cumsum()]), pa.array(np.frombuffer(b"".join(encoded), "<u4").astype(np.int32)))


def _same_bytes(lists: pa.LargeListArray, vocabulary: Vocabulary, texts: list[bytes]) -> np.ndarray:
    """Which texts the bytes of their tokens, joined, are equal to."""
    taken = vocabulary.bytes.take(pc.list_flatten(lists))
    joined = memoryview(taken.buffers()[2] or b"").cast("B")
    ends = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1)[lists.offsets.to_numpy()].tolist()
    return np.array([joined[a:b] == text for a, b, text in zip(ends, ends[1:], texts)], bool)


def _ends(lists: pa.LargeListArray, vocabulary: Vocabulary, name: str) -> pa.Table:
    """For each token: its document, the byte where it ends, and its place among all tokens."""
    ids, doc = pc.list_flatten(lists), pc.list_parent_indices(lists)
    total = pc.cumulative_sum(pa.array(vocabulary.size[ids.to_numpy()]))
    before = np.r_[0, total.to_numpy()][lists.offsets.to_numpy()[:-1]]  # of the tokens of earlier documents
    end = pc.subtract(total, pa.array(before).take(doc))
    return pa.table({"doc": doc, "end": end, name: pa.array(np.arange(len(ids)))})


def align(texts: list[str], a: Vocabulary, b: Vocabulary) -> tuple[pa.LargeListArray, pa.LargeListArray, pa.LargeListArray, pa.LargeListArray]:
    """For each text: A's ids of it after a space, B's ids, and how many of either each group has.

    Groups end where a token of A and one of B end at the same byte, found by a hash join on document and end. A text that is empty, or
    that the tokens of either don't give back, has none.
    """
    spaced = [" " + t for t in texts]
    ours, theirs = _lists(a.encoder.encode(spaced)), _lists(b.encoder.encode(texts))
    raw = [t.encode() for t in spaced]
    good = np.array([len(t) > 1 for t in raw], bool) & _same_bytes(ours, a, raw) & _same_bytes(theirs, b, raw)
    if not good.all():
        keep = pa.array(np.where(good, np.arange(len(good)), -1), mask=~good)
        ours, theirs = (pc.fill_null(x.take(keep), pa.scalar([], x.type)) for x in (ours, theirs))
    left, right = _ends(ours, a, "i"), _ends(theirs, b, "j")
    common = left.join(right, keys=["doc", "end"], join_type="inner", use_threads=False).sort_by("i")
    i, j = common.column("i").to_numpy(), common.column("j").to_numpy()
    per_text = np.bincount(common.column("doc").to_numpy(), minlength=len(texts))
    offsets = pa.array(np.r_[0, per_text.cumsum()].astype(np.int64))
    # the last tokens of a text end together, so the groups are all tokens, and counts are steps between their ends
    counts = lambda x: pa.LargeListArray.from_arrays(offsets, pa.array(np.diff(x, prepend=-1).astype(np.int32)))
    return ours, theirs, counts(i), counts(j)


#: What align_tokens gives beside the id. JVM and files handle a text's ids as one value, not as so many numbers.
PACKED = "a binary, b binary, a_counts binary, b_counts binary, n_a int, n_b int, n_groups int"


def _packed(lists: pa.LargeListArray, kind: str) -> pa.Array:
    """The entries of each list as bytes."""
    values = np.ascontiguousarray(pc.list_flatten(lists).to_numpy(), dtype=kind)
    offsets = lists.offsets.to_numpy()
    offsets = pa.py_buffer((offsets - offsets[0]) * values.itemsize)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, offsets, pa.py_buffer(values)]).cast(pa.binary())


def _entries(column: pa.Array, sizes: np.ndarray) -> np.ndarray:
    """The entries of all rows, of two bytes each or, in a batch where those don't do, of four."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    data, n = column.buffers()[2], int(sizes.sum())
    if not n:
        return np.zeros(0, np.int64)
    lengths = np.diff(offsets)
    if (lengths == 2 * sizes).all():
        return np.frombuffer(data, "<u2", n, int(offsets[0])).astype(np.int64)
    parts = (np.frombuffer(data, "<u2" if length == 2 * k else "<u4", k, at) for at, length, k in zip(offsets[:-1].tolist(), lengths.tolist(), sizes.tolist()) if k)
    return np.concatenate([x.astype(np.int64) for x in parts])


def _unpacked(batch: pa.RecordBatch, at: int = 0) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The entries of a, b, a_counts and b_counts of all rows, and each row's n_a, n_b and n_groups, from the columns of PACKED."""
    sizes = [batch.column(at + 4 + i).to_numpy().astype(np.int64) for i in range(3)]
    return [_entries(batch.column(at + i), sizes[min(i, 2)]) for i in range(4)], sizes


def align_tokens(docs: DataFrame, byte_file: str, piece_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, a, b, a_counts, b_counts, n_a, n_b, n_groups): the ids of both tokenizers, how many of each make up group after group, and how many there are.

    A is a byte-level vocabulary of the tokenizers library, given a space and the text; B a model of the sentencepiece library,
    which adds that space. Strings of special tokens are plain text. Null and empty texts, and texts whose tokens, of A or
    B, don't join to the space and the text byte by byte, have none. The four lists are little-endian numbers of two bytes, or of four where
    a text has larger ones; as_arrays unpacks them. One narrow pass; null ids and repeated rows are kept, an empty table
    gives no rows, other columns are not read.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = encoders(byte_file, piece_file)
        kinds = ["<u2" if len(v.size) <= 1 << 16 else "<u4" for v in (a, b)]
        for batch in sliced(batches, 100):
            lists = align([t or "" for t in batch.column(1).to_pylist()], a, b)
            most = max((pc.max(pc.list_flatten(x)).as_py() or 0 for x in lists[2:]), default=0)
            packed = [_packed(x, kind) for x, kind in zip(lists, [*kinds, *["<u2" if most < 1 << 16 else "<u4"] * 2])]
            sizes = [pc.list_value_length(lists[i]).cast(pa.int32()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *packed, *sizes], names=["id", "a", "b", "a_counts", "b_counts", "n_a", "n_b", "n_groups"])
            del lists, packed
            pa.default_memory_pool().release_unused()

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"id {kind}, {PACKED}")
    return rows.withColumnRenamed("id", id_col)


def as_arrays(aligned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """align_tokens with a, b, a_counts and b_counts as arrays of integers."""
    names = ["a", "b", "a_counts", "b_counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 100):
            entries, sizes = _unpacked(batch, 1)
            lists = [pa.ListArray.from_arrays(pa.array(np.r_[0, sizes[min(i, 2)].cumsum()].astype(np.int32)), pa.array(x.astype(np.int32))) for i, x in enumerate(entries)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["id", *names])

    kind = aligned.schema[id_col].dataType.simpleString()
    rows = aligned.select(F.col(id_col).alias("id"), *names, "n_a", "n_b", "n_groups").mapInArrow(run, f"id {kind}, " + ", ".join(f"{c} array<int>" for c in names))
    return rows.withColumnRenamed("id", id_col)


def count_pairs(aligned: DataFrame) -> DataFrame:
    """(a, b, n): how often each pair of ids is linked, that is, ends a group of align_tokens together.

    A task sums the pairs of its batches in Arrow before they are shuffled; there are no more than the vocabularies allow (most_pairs).
    """
    bound_batches(aligned.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, waiting = [], 0
        summed = lambda tables: pa.concat_tables(tables).group_by(["a", "b"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["a", "b", "n"])
        for batch in batches:
            (a, b, a_counts, b_counts), _ = _unpacked(batch)
            linked = pa.table({"a": a[a_counts.cumsum() - 1].astype(np.int32), "b": b[b_counts.cumsum() - 1].astype(np.int32)})
            counted = linked.group_by(["a", "b"], use_threads=False).aggregate([([], "count_all")])
            whole.append(counted.rename_columns(["a", "b", "n"]))
            waiting += counted.num_rows
            if waiting > 1 << 20:
                whole = [summed(whole)]
                waiting = 0
        if whole:
            yield from summed(whole).to_batches(max_chunksize=1 << 16)

    names = [x.split()[0] for x in PACKED.split(", ")]
    return aligned.select(*names).mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


class GroupText:
    """Writes groups as `a1,a2|b1;a3|b2,b3` by taking ids with what follows them from a table of strings."""

    def __init__(self, n_a: int, n_b: int):
        self.n_a = n_a
        self.table = pa.array([f"{i}{s}" for i in range(n_a) for s in ",|"] + [f"{i}{s}" for i in range(n_b) for s in (",", ";", "")], pa.large_string())

    def of(self, a: np.ndarray, b: np.ndarray, a_counts: np.ndarray, b_counts: np.ndarray, groups: np.ndarray) -> Iterator[memoryview]:
        """The text of each document, from flat arrays of all and the number of each document's groups."""
        a_ends, b_ends = a_counts.cumsum(), b_counts.cumsum()
        place_a = np.arange(len(a)) + np.repeat(b_ends - b_counts, a_counts)
        place_b = np.arange(len(b)) + np.repeat(a_ends, b_counts)
        a_code, b_code = a.astype(np.int64) * 2, b.astype(np.int64) * 3 + 2 * self.n_a
        a_code[a_ends - 1] += 1
        b_code[b_ends - 1] += 1
        last = groups.cumsum()
        final = last[groups > 0] - 1  # each document's last group
        b_code[b_ends[final] - 1] += 1
        codes = np.empty(len(a) + len(b), np.int64)
        codes[place_a], codes[place_b] = a_code, b_code
        taken = self.table.take(pa.array(codes))
        data = memoryview(taken.buffers()[2] or b"").cast("B")
        ends = np.r_[0, a_ends + b_ends][np.r_[0, last]]
        cuts = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1)[ends].tolist() if len(taken) else [0] * len(ends)
        return (data[x:y] for x, y in zip(cuts, cuts[1:]))


def alignment_digest(aligned: DataFrame, pairs: DataFrame, byte_file: str, piece_file: str, id_col: str = "doc_id") -> DataFrame:
    """For each document of align_tokens: n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256, with counts from count_pairs.

    A link is a token of A and one of B that end together, so there is one for each group. n_best counts the links whose pair is linked
    as often as any with the same id of B; count_sum adds up how often each link's pair is. The pairs are sent to all workers, as
    the vocabularies bound their number.
    """
    a_vocabulary, b_vocabulary = encoders(byte_file, piece_file)
    bound = most_pairs(a_vocabulary.bytes.to_pylist(), b_vocabulary.bytes.to_pylist())
    table = pairs.limit(bound + 1).toArrow()
    if table.num_rows > bound:
        raise ValueError("more pairs than the vocabularies allow: these are not their tokens")
    key = table.column("a").to_numpy().astype(np.int64) << 32 | table.column("b").to_numpy()
    order = key.argsort()
    n = table.column("n").to_numpy()[order]
    best = np.zeros(len(b_vocabulary.size), np.int64)
    np.maximum.at(best, table.column("b").to_numpy()[order], n)
    sent = aligned.sparkSession.sparkContext.broadcast((key[order], n, best))
    n_a, n_b = len(a_vocabulary.size), len(b_vocabulary.size)
    bound_batches(aligned.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, highest = sent.value
        writer = held(GroupText, n_a, n_b)
        for batch in sliced(batches, 100):
            (a, b, a_counts, b_counts), sizes = _unpacked(batch, 1)
            link_a, link_b = a[a_counts.cumsum() - 1], b[b_counts.cumsum() - 1]
            often = counts[np.searchsorted(keys, link_a << 32 | link_b)] if len(link_a) else np.zeros(0, np.int64)
            ends = np.r_[0, sizes[2].cumsum()]
            per_doc = lambda x: np.diff(np.r_[0, x.cumsum()][ends])
            best_of = per_doc((often == highest[link_b]).astype(np.int64))
            digests = [hashlib.sha256(t).hexdigest() if k else "" for t, k in zip(writer.of(a, b, a_counts, b_counts, sizes[2]), sizes[2].tolist())]
            numbers = [sizes[0], sizes[1], sizes[2], sizes[2], best_of, per_doc(often)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x.astype(np.int64)) for x in numbers], pa.array(digests, pa.string())], names=["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    kind = aligned.schema[id_col].dataType.simpleString()
    rows = aligned.select(F.col(id_col).alias("id"), *[x.split()[0] for x in PACKED.split(", ")])
    done = rows.mapInArrow(run, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return done.withColumnRenamed("id", id_col)


def aligned_documents(docs: DataFrame, byte_file: str, piece_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """align_tokens, kept in the shared folder, since it is read for the counts and for the digests; then alignment_digest."""
    spark = docs.sparkSession
    path = scratch_path(spark, "aligned")
    align_tokens(docs, byte_file, piece_file, id_col, text_col).write.option("compression", "zstd").parquet(path)
    aligned = spark.read.parquet(path)
    return alignment_digest(aligned, count_pairs(aligned), byte_file, piece_file, id_col)
