"""FASTA files read by ranges of bytes, so that a chromosome is never one row or one task."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A header line has fewer bytes than that.
HEADER_BYTES = 1 << 16
#: The first bytes of each block of a blocked gzip file, up to its size: gzip with one extra field named BC.
BLOCK_MARK = b"\x1f\x8b\x08\x04"
BLOCK_FIELD = b"BC\x02\x00"


class PlainBytes:
    """A range of an uncompressed file."""

    def __init__(self, file, start: int, stop: int, length: int):
        self.file, self.start, self.stop, self.length = file, start, stop, length

    def _read(self, start: int, stop: int) -> bytes:
        self.file.seek(start)
        return self.file.read(stop - start)

    def before(self) -> bytes:
        """The bytes before the range, as many as a header may have."""
        return self._read(max(0, self.start - HEADER_BYTES), self.start)

    def chunks(self, size: int = 1 << 20) -> Iterator[tuple[bytes, bool]]:
        """The bytes of the range, then those behind it, each with whether they are its own."""
        for first, end, own in ((self.start, self.stop, True), (self.stop, self.length, False)):
            for at in range(first, end, size):
                yield self._read(at, min(at + size, end)), own


class BlockedBytes:
    """What the blocks hold that begin in a range of a blocked gzip file. A block has at most 64 KB, packed or not."""

    def __init__(self, file, start: int, stop: int, length: int):
        self.file, self.length = file, length
        self.start, self.stop = self._next(start), self._next(stop)

    def _size(self, at: int) -> int:
        """Bytes of the block at this place; 0 if none begins there."""
        self.file.seek(at)
        head = self.file.read(18)
        if len(head) < 18 or head[:4] != BLOCK_MARK or head[12:16] != BLOCK_FIELD:
            return 0
        return int.from_bytes(head[16:18], "little") + 1

    def _chain(self, at: int, links: int = 3) -> bool:
        """Whether blocks follow one another from here: chance hits of the mark don't."""
        for _ in range(links):
            size = self._size(at)
            if not size:
                return False
            at += size
            if at == self.length:
                return True
        return True

    def _next(self, at: int) -> int:
        """Where the first block begins at or after this place."""
        if at >= self.length:
            return self.length
        self.file.seek(at)
        window, found = self.file.read(HEADER_BYTES + 18), -1
        while (found := window.find(BLOCK_MARK, found + 1)) >= 0:
            if self._chain(at + found):
                return at + found
        return self.length

    def _blocks(self, start: int, stop: int) -> Iterator[bytes]:
        while start < stop:
            size = self._size(start)
            if not size:
                raise ValueError("blocked gzip file damaged")
            self.file.seek(start)
            yield zlib.decompress(self.file.read(size), 31)
            start += size

    def before(self) -> bytes:
        low = max(0, self.start - 4 * HEADER_BYTES)
        at = self._next(low)
        return b"".join(self._blocks(at, self.start))[-HEADER_BYTES:] if self.start and at < self.start else b""

    def chunks(self) -> Iterator[tuple[bytes, bool]]:
        for first, end, own in ((self.start, self.stop, True), (self.stop, self.length, False)):
            for data in self._blocks(first, end):
                yield data, own


class GzipBytes:
    """A gzip file that only can be read from its start, of one member or several."""

    def __init__(self, file):
        self.file = file

    def before(self) -> bytes:
        return b""

    def chunks(self, size: int = 1 << 20) -> Iterator[tuple[bytes, bool]]:
        stream, data = zlib.decompressobj(31), self.file.read(size)
        while data:
            yield stream.decompress(data, 4 * size), True
            data = stream.unconsumed_tail
            if stream.eof:
                data = stream.unused_data or self.file.read(size)
                stream = zlib.decompressobj(31)
            else:
                data = data or self.file.read(size)


def parsed(source) -> Iterator[tuple[bytes | None, bytes, bool]]:
    """(header line, b"", own) for each header that begins in a range, (null, letters, own) for what stands between; then those behind it, not own.

    The rest of a header that began before is passed over.
    """
    before = source.before()
    line = before[before.rfind(b"\n") + 1 :]  # what stands before the range in its first line
    passing = line.startswith(b">") and (len(line) < HEADER_BYTES or b"\n" in before)
    line_start, header, of_own = not line, None, True
    for data, own in source.chunks():
        at = 0
        while at < len(data):
            if passing or header is not None:
                end = data.find(b"\n", at)
                piece = data[at : end if end >= 0 else len(data)]
                if header is not None:
                    header += piece
                if end < 0:
                    break
                if header is not None:
                    yield header, b"", of_own
                passing, header, line_start, at = False, None, True, end + 1
            elif line_start and data[at : at + 1] == b">":
                header, of_own, at = b"", own, at + 1
            else:
                end = data.find(b"\n>", at)
                end = len(data) if end < 0 else end + 1
                yield None, data[at:end].translate(None, b"\r\n"), own
                line_start, at = data[end - 1 : end] == b"\n", end
    if header is not None:
        yield header, b"", of_own


def _file(uri: str):
    """A file that can be read from any place."""
    from pyarrow import fs

    place, path = (fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")) if uri.startswith("file:") else fs.FileSystem.from_uri(uri)
    return place.open_input_file(path)


def _opened(uri: str, packing: str, start: int, stop: int, length: int):
    file = _file(uri)
    return GzipBytes(file) if packing == "gzip" else BlockedBytes(file, start, stop, length) if packing == "blocks" else PlainBytes(file, start, stop, length)


def _packing(uri: str) -> str:
    with _file(uri) as file:
        head = file.read(18)
    return "plain" if head[:2] != b"\x1f\x8b" else "blocks" if head[:4] == BLOCK_MARK and head[12:16] == BLOCK_FIELD else "gzip"


def _named(header: bytes) -> tuple[str, str]:
    """Name and description in a header line."""
    text = header.decode("utf-8", "replace").rstrip("\r")
    name = text.split(None, 1)[0] if text.strip() and not text[0].isspace() else ""
    return name, text[len(name) :].strip()


def byte_ranges(spark: SparkSession, path: str, range_bytes: int) -> DataFrame:
    """(file, length, packing, no, start, stop) for ranges of the files below path; a plain gzip file is one range.

    Spark lists the files without reading them; a task looks at the first bytes of each.
    """
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([_packing(x) for x in batch.column(0).to_pylist()], pa.string())], names=["file", "length", "packing"])

    known = files.mapInArrow(run, "file string, length long, packing string")
    n = F.when(F.col("packing") == "gzip", 1).otherwise(F.ceil(F.col("length") / range_bytes))
    each = known.withColumn("no", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)))
    stop = F.when(F.col("packing") == "gzip", F.col("length")).otherwise(F.least((F.col("no") + 1) * range_bytes, "length"))
    return each.withColumn("start", F.col("no") * range_bytes).withColumn("stop", stop)


def _carried(ranges: DataFrame) -> DataFrame:
    """ranges with what each begins in: name, record (its number in the file) and offset, the letters that the record has before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                heads, total, tail, name = 0, 0, 0, None
                for header, letters, own in parsed(_opened(row["file"], row["packing"], row["start"], row["stop"], row["length"])):
                    if not own:
                        break
                    if header is not None:
                        heads, tail, name = heads + 1, 0, _named(header)[0]
                    total, tail = total + len(letters), tail + len(letters)
                rows.append((heads, total, tail, name))
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "heads", "letters", "tail", "last_name"])

    kinds = "file string, length long, packing string, no long, start long, stop long"
    found = ranges.mapInArrow(run, f"{kinds}, heads long, letters long, tail long, last_name string")
    earlier = Window.partitionBy("file").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a file
    until = Window.partitionBy("file").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    begun = F.when(F.col("heads") > 0, F.sum("letters").over(until) - F.col("tail"))
    placed = found.withColumn("begun", begun)
    letters_before = F.coalesce(F.sum("letters").over(earlier), F.lit(0))
    offset = letters_before - F.coalesce(F.last("begun", True).over(earlier), F.lit(0))
    return placed.select(*[x.split()[0] for x in kinds.split(", ")], F.last("last_name", True).over(earlier).alias("name"), offset.alias("offset"))


def _tiles_of(row: dict, tile: int) -> Iterator[tuple[str, int, str]]:
    """(name, tile_no, letters) of the tiles that begin in a range; the last one is read to its end behind the range."""
    name, offset, held = row["name"], row["offset"], bytearray()
    skip = -offset % tile  # letters of a tile that began before

    def cut(rest: bool) -> Iterator[tuple[str, int, str]]:
        nonlocal offset
        while len(held) >= tile or rest and held:
            yield name, offset // tile, bytes(held[:tile]).decode("ascii", "replace")
            offset += len(held[:tile])
            del held[:tile]

    for header, letters, own in parsed(_opened(row["file"], row["packing"], row["start"], row["stop"], row["length"])):
        if not own and (not held or header is not None):
            break
        if header is not None:
            if name is not None:
                yield from cut(True)
                if not offset:
                    yield name, 0, ""
            name, offset, skip = _named(header)[0], 0, 0
        elif name is not None:  # letters before the first header belong to no record
            offset += min(skip, len(letters))
            held += letters[skip:] if own else letters[: tile - len(held)]
            skip -= min(skip, len(letters))
            yield from cut(False)
    if name is not None:
        if row["stop"] >= row["length"] and not held and not offset:
            yield name, 0, ""
        yield from cut(True)


def read_fasta_tiles(spark: SparkSession, path: str, tile: int, range_bytes: int = 32 << 20) -> DataFrame:
    """(chrom, tile_no, seq) of the FASTA files below path, each record cut into tiles of so many letters.

    Ranges of bytes are read by tasks of their own, twice: once to learn in which record each begins and how many letters of it
    stand before, which makes a row for each range; then for the tiles that begin in it, the last of which is read to its end behind the range. Nothing but
    these rows is shuffled. So no row is larger than a tile and no task than a range and a tile, whether the letters stand in
    lines or in one. Blocked gzip files are cut between their blocks; other gzip files are one range each, read as a stream.

    A record without letters has one empty tile. Letters before the first header are left out. Records with the same name give tiles
    with the same numbers. Headers must be shorter than 64 KB. The files must be in a place that Arrow's file systems reach from all executors.
    """
    n = 8 * max(1, spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.int64(), pa.string()))], names=["chrom", "tile_no", "seq"])

        for batch in batches:
            for row in batch.to_pylist():
                rows, size = [], 0
                for x in _tiles_of(row, tile):
                    rows.append(x)
                    size += len(x[2]) + 64
                    if size > 4 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                yield batch_of(rows)

    ranges = _carried(byte_ranges(spark, path, range_bytes).repartition(n))
    return ranges.repartition(n).mapInArrow(run, "chrom string, tile_no long, seq string")
