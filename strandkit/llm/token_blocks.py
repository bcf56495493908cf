"""Token ids in binary files of patched frame-of-reference blocks."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandkit.llm.common import checkpoint, repeated, scratch_path, sliced
from strandkit.llm.encoders import ByteBpe, held

BLOCK = 1024
#: A block is packed at the width that is smallest in all among those that hold these parts of its values.
PERCENTILES = (0.8, 0.9, 0.95, 0.98, 1.0)

# A file is a run of segments, each followed by a line feed; it holds whole documents. A segment, little-endian:
#   header      HEAD: mark, bytes of the segment, crc32 of what follows, part, number in the part, ids before it in the part,
#               ids, documents, ids of the first document that earlier segments hold, whether the last one goes on
#   documents   for each: where it begins (u4), its id (i8), whether it has one (u1)
#   index       for each block of 1,024 ids: word where its packed values begin (u4), its first exception (u4), its minimum (u4), its width (u1)
#   values      each less the block's minimum, its lower `width` bits, packed into words of 32 bits
#   exceptions  values that need more bits: place in the block (u2) of all, then their upper bits (u4) of all
HEAD = "<4sQIIIQIIQB"
HEAD_BYTES = struct.calcsize(HEAD)
MARK = b"PFR1"


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """Blocks of values below 2^width, a row each, as rows of 32-bit words."""
    v = values.reshape(-1, 32)
    words = np.zeros((len(v), width), np.uint32)
    for i in range(32 if width else 0):
        word, shift = divmod(i * width, 32)
        words[:, word] |= v[:, i] << np.uint32(shift)
        if shift + width > 32:
            words[:, word + 1] |= v[:, i] >> np.uint32(32 - shift)
    return words.reshape(len(values), -1)


def _unpacked(words: np.ndarray, width: int) -> np.ndarray:
    """The reverse: rows of BLOCK values."""
    if not width:
        return np.zeros((len(words), BLOCK), np.uint32)
    w = words.reshape(-1, width)
    out = np.empty((len(w), 32), np.uint32)
    mask = np.uint32((1 << width) - 1)
    for i in range(32):
        word, shift = divmod(i * width, 32)
        value = w[:, word] >> np.uint32(shift)
        if shift + width > 32:
            value = value | w[:, word + 1] << np.uint32(32 - shift)
        out[:, i] = value & mask
    return out.reshape(len(words), BLOCK)


def packed_blocks(ids: np.ndarray) -> bytes:
    """Index, values and exceptions of ids below 2^32."""
    n = -(-len(ids) // BLOCK)
    full = np.full(n * BLOCK, ids[-1] if len(ids) else 0, np.uint32)
    full[: len(ids)] = ids
    full = full.reshape(n, BLOCK)
    base = full.min(axis=1) if n else np.zeros(0, np.uint32)
    rest = full - base[:, None]
    bits = np.frexp(rest.astype(np.float64))[1].astype(np.uint8)  # how many each value needs
    ordered = np.sort(bits, axis=1)
    widths = ordered[:, [int(np.ceil(q * BLOCK)) - 1 for q in PERCENTILES]]
    cost = np.stack([widths[:, j].astype(np.int64) * BLOCK + 48 * (bits > widths[:, j : j + 1]).sum(axis=1) for j in range(len(PERCENTILES))], axis=1) if n else np.zeros((0, 1), np.int64)
    width = widths[np.arange(n), cost.argmin(axis=1)]
    beyond = bits > width[:, None]
    exceptions = beyond.sum(axis=1)
    size = BLOCK // 32 * width.astype(np.int64)
    at = np.r_[0, size.cumsum()]
    words = np.zeros(at[-1], "<u4")
    for w in np.unique(width):
        mine = np.flatnonzero(width == w)
        low = rest[mine] & np.uint32((1 << int(w)) - 1)
        words[at[mine][:, None] + np.arange(BLOCK // 32 * int(w))] = _packed(low, int(w))
    block, place = np.nonzero(beyond)
    high = rest[block, place] >> width[block].astype(np.uint32)
    first = np.r_[0, exceptions.cumsum()]
    index = [at[:-1].astype("<u4"), first[:-1].astype("<u4"), base.astype("<u4"), width.astype("u1")]
    return b"".join([struct.pack("<II", len(words), len(place)), *[x.tobytes() for x in index], words.tobytes(), place.astype("<u2").tobytes(), high.astype("<u4").tobytes()])


def unpacked_blocks(packed: memoryview | bytes, n_ids: int, start: int = 0, stop: int | None = None) -> np.ndarray:
    """The ids from start to stop of n_ids; only the blocks that hold them are read."""
    stop = n_ids if stop is None else min(stop, n_ids)
    n_words, n_exceptions = struct.unpack_from("<II", packed)
    n, at = -(-n_ids // BLOCK), 8
    read = lambda kind, k, shift: np.frombuffer(packed, kind, k, shift)
    offset, first, base, width = (read(kind, n, at + shift * n) for kind, shift in (("<u4", 0), ("<u4", 4), ("<u4", 8), ("u1", 12)))
    words = read("<u4", n_words, at + 13 * n)
    place = read("<u2", n_exceptions, at + 13 * n + 4 * n_words)
    high = read("<u4", n_exceptions, at + 13 * n + 4 * n_words + 2 * n_exceptions)
    if start >= stop:
        return np.zeros(0, np.uint32)
    b0, b1 = start // BLOCK, -(-stop // BLOCK)
    out = np.empty((b1 - b0, BLOCK), np.uint32)
    for w in np.unique(width[b0:b1]):
        mine = np.flatnonzero(width[b0:b1] == w)
        out[mine] = _unpacked(words[offset[b0:b1][mine].astype(np.int64)[:, None] + np.arange(BLOCK // 32 * int(w))], int(w))
    e0, e1 = int(first[b0]), int(first[b1]) if b1 < n else n_exceptions
    counts = np.diff(np.r_[first[b0:b1], e1].astype(np.int64))
    block = np.repeat(np.arange(b1 - b0), counts)
    out[block, place[e0:e1]] |= high[e0:e1] << width[b0:b1][block].astype(np.uint32)
    out += base[b0:b1, None]
    return out.reshape(-1)[start - b0 * BLOCK : stop - b0 * BLOCK]


class FileWriter:
    """Gathers the documents of a part into segments of at most so many ids, over several of which a longer document goes, and these into files."""

    def __init__(self, part: int, most: int, per_file: int):
        self.part, self.most, self.per_file, self.number, self.before = part, most, per_file, 0, 0
        self.done: list[bytes] = []
        self._begin(0)

    def _begin(self, prior: int) -> None:
        self.prior, self.ids, self.n, self.starts, self.names = prior, [], 0, [], []

    def _end(self, goes_on: bool) -> None:
        ids = np.concatenate(self.ids) if self.ids else np.zeros(0, np.uint32)
        names = np.array([0 if x is None else x for x in self.names], "<i8")
        body = b"".join([np.array(self.starts, "<u4").tobytes(), names.tobytes(), np.array([x is not None for x in self.names], "u1").tobytes(), packed_blocks(ids)])
        head = struct.pack(HEAD, MARK, HEAD_BYTES + len(body), zlib.crc32(body), self.part, self.number, self.before, len(ids), len(names), self.prior, goes_on)
        self.done.append(head + body)
        self.number, self.before = self.number + 1, self.before + len(ids)

    def _file(self) -> bytes:
        content, self.done = b"\n".join(self.done), []
        return content

    def add(self, name: int | None, ids: np.ndarray) -> Iterator[bytes]:
        """Take a document; gives the file that is full before it."""
        if self.n and self.n + len(ids) > self.most:
            self._end(False)
            self._begin(0)
            if len(self.done) >= self.per_file:
                yield self._file()
        done = 0
        while True:
            self.starts.append(self.n)
            self.names.append(name)
            piece = ids[done : done + self.most]
            self.ids.append(piece)
            self.n, done = self.n + len(piece), done + len(piece)
            if done == len(ids):
                return
            self._end(True)
            self._begin(done)

    def rest(self) -> Iterator[bytes]:
        if self.names:
            self._end(False)
        if self.done:
            yield self._file()


def segments(content: bytes) -> Iterator[tuple[dict, memoryview]]:
    """The headers and bodies of a file's segments. ValueError if it is damaged."""
    at, view = 0, memoryview(content)
    while at < len(content):
        if len(content) - at < HEAD_BYTES:
            raise ValueError("token file cut off")
        head = dict(zip(("mark", "size", "crc", "part", "number", "before", "n_ids", "n_docs", "prior", "goes_on"), struct.unpack_from(HEAD, content, at)))
        body = view[at + HEAD_BYTES : at + head["size"]]
        if head["mark"] != MARK or len(body) != head["size"] - HEAD_BYTES or zlib.crc32(body) != head["crc"]:
            raise ValueError("token file damaged")
        yield head, body
        at += head["size"] + 1


def segment_ids(head: dict, body: memoryview, start: int = 0, stop: int | None = None) -> np.ndarray:
    """A segment's ids from start to stop, by its index of blocks."""
    return unpacked_blocks(body[13 * head["n_docs"] :], head["n_ids"], start, stop)


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int | None = 2, part_bytes: int = 32 << 20, segment_ids: int = 1 << 20, segments_per_file: int = 8) -> None:
    """Encode whole texts and write their ids, documents in ascending order of their ids, to binary files below path.

    Texts are dealt to parts by ranges of the id, about part_bytes of text in each, sorted, encoded with the tokenizers library
    by a byte-level vocabulary file, each followed by end_id if there is one, and packed into segments. A task holds a file of about
    segments_per_file of them at a time; a document isn't cut over files. Rows with equal ids are in order of a hash of the text; where equal rows alone would fill a part, they are
    counted and numbered first, so they are dealt over parts, too.

    The id must be an integer; null ids come first. A null text is empty, which leaves the end id only. Special tokens' strings in
    a text are what the library makes of them by default. An empty table gives no segments; other columns are not read.
    """
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    size = F.octet_length("text").cast("long") + 16
    hashed = base.withColumn("hash", F.xxhash64("text"))
    of_equal = hashed.groupBy("id", "hash").agg(F.sum(size).alias("n"))
    totals = of_equal.agg(F.sum("n").alias("all"), F.max("n").alias("most")).first()
    n_parts = max(1, -(-(totals["all"] or 0) // part_bytes))
    rows = hashed.withColumn("copy", F.lit(0).cast("long"))
    if (totals["most"] or 0) > part_bytes:
        rows = repeated(hashed.groupBy("id", "text", "hash").agg(F.count("*").alias("times")), "times", "copy").select(*rows.columns)
    order = ["id", "hash", "copy"]
    dealt = rows.repartitionByRange(n_parts, *order).sortWithinPartitions(*order).select("id", "text", F.spark_partition_id().alias("part"))
    tail = np.array([end_id] if end_id is not None else [], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer = held(ByteBpe, vocabulary), None
        one = lambda payload: pa.RecordBatch.from_arrays([pa.array([payload], pa.binary())], names=["content"])
        for batch in sliced(batches, 200):
            if not batch.num_rows:
                continue
            writer = writer or FileWriter(batch.column(2)[0].as_py(), segment_ids, segments_per_file)
            for name, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist())):
                for payload in writer.add(name, np.concatenate([np.frombuffer(ids, "<u4"), tail])):
                    yield one(payload)
        if writer:
            for payload in writer.rest():
                yield one(payload)

    if vocabulary is None:
        from strandkit.llm.encoders import vocabulary_path

        vocabulary = vocabulary_path("byte_bpe_50k.json")
    made = dealt.mapInArrow(run, "content binary").select(F.col("content").cast("string").alias("value"))
    made.write.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(path)


def _documents(content: bytes) -> Iterator[pa.RecordBatch]:
    """The documents of a file: (id, part, place, ids), those over several segments put together."""
    held, held_place = [], 0  # the pieces so far of a document that goes on
    for head, body in segments(content):
        n = head["n_docs"]
        starts, names, has = np.frombuffer(body, "<u4", n), np.frombuffer(body, "<i8", n, 4 * n), np.frombuffer(body, "u1", n, 12 * n)
        ids = memoryview(segment_ids(head, body).astype("<u4", copy=False)).cast("B")
        cuts = np.r_[starts, head["n_ids"]].astype(np.int64)
        places, first, front = head["before"] + cuts[:-1], 0, []
        if head["prior"] or head["goes_on"]:
            if head["prior"]:
                held.append(bytes(ids[: 4 * int(cuts[1])]))
            if n > 1 or not head["goes_on"]:
                front, first = ([(b"".join(held), held_place)], 1) if head["prior"] else ([], 0)
                held = []
            if head["goes_on"] and not (head["prior"] and n == 1):
                held, held_place = [bytes(ids[4 * int(cuts[n - 1]) :])], int(places[n - 1])
            last = n - bool(head["goes_on"])
        else:
            last = n
        for whole, place in front:
            yield pa.RecordBatch.from_arrays([pa.array(names[:1], pa.int64(), mask=has[:1] == 0), pa.array([head["part"]], pa.int32()), pa.array([place], pa.int64()), pa.array([whole], pa.binary())], names=["id", "part", "place", "ids"])
        if first < last:
            own = slice(first, last)
            binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), last - first, [None, pa.py_buffer(4 * cuts[first : last + 1]), pa.py_buffer(ids)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(names[own], pa.int64(), mask=has[own] == 0), pa.array(np.full(last - first, head["part"], np.int32)), pa.array(places[own]), binary], names=["id", "part", "place", "ids"])


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """The documents of token files: rows (id, part, place, n_tokens, ids), in one narrow pass.

    ids are little-endian unsigned 32-bit integers; place is the number of ids before the document in its part. No files, no rows; a damaged file is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield from sliced(_documents(content.as_py()))

    read = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "id long, part int, place long, ids binary")
    return read.select(F.col("id").alias(id_col), "part", "place", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


def with_starts(rows: DataFrame) -> DataFrame:
    """rows of read_tokens, with any columns beside part, place and n_tokens, with start: the ids of all documents before. part and place go.

    Give rows without ids, settled by a checkpoint: they are read twice. Only the totals of parts, a row for each, are added up, in ranges of 1,024 parts first.
    """
    parts = rows.groupBy("part").agg(F.max(F.col("place") + F.col("n_tokens")).alias("n")).withColumn("range", F.floor(F.col("part") / 1024))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = parts.groupBy("range").agg(F.sum("n").alias("n")).select("range", before(Window.orderBy("range")).alias("outside"))  # a row for 32 GB of text
    starts = parts.select("part", "range", before(Window.partitionBy("range").orderBy("part")).alias("inside")).join(ranges, "range")
    out = rows.join(starts.select("part", (F.col("inside") + F.col("outside")).alias("before_part")), "part")
    return out.withColumn("start", F.col("before_part") + F.col("place")).drop("part", "place", "before_part")


def token_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int | None = 2, **more) -> DataFrame:
    """Write the token files of docs below the shared folder, read them back, and tell for each document its id, start, n_tokens and ids_crc32."""
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    write_tokens(docs, path, id_col, text_col, vocabulary, end_id, **more)
    back = read_tokens(spark, path, id_col).select(id_col, "part", "place", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return with_starts(checkpoint(back)).select(id_col, "start", "n_tokens", "ids_crc32")
