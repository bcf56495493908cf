"""WARC archives: writing pages as segmented records, reading them back and reassembling the segments."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandkit.llm.common import checkpoint, freed_shuffles, left_join_counted, map_batches

VERSION = b"WARC/1.1"
DATE = b"2024-01-01T00:00:00Z"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
REVISIT = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: object, digest: str) -> str:
    """A record's identifier, from its page and payload, so that whoever refers to it can name it."""
    return f"<urn:uuid:{uuid.UUID(hashlib.sha256(f'{page_id}|{digest}'.encode()).hexdigest()[:32])}>"


def chunked(payload: bytes, size: int) -> bytes:
    """Chunked transfer framing of a payload."""
    parts = [b"%x\r\n%b\r\n" % (len(part), part) for at in range(0, len(payload), size) if (part := payload[at : at + size])]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload in a chunked body; chunk extensions and trailers are passed over. ValueError if it is malformed."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("no chunk size")
        size = int(body[at:end].split(b";")[0].strip() or b"x", 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if size < 0 or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk not closed")
        out.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response as it was sent: without the head, and without chunked framing."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("no end of the HTTP head")
    return unchunked(body) if re.search(rb"(?im)^transfer-encoding:.*\bchunked\s*$", head.replace(b"\r", b"")) else body


def _record(kind: bytes, ident: str, fields: list[tuple[bytes, bytes | None]], block: bytes) -> bytes:
    lines = [VERSION, b"WARC-Type: " + kind, b"WARC-Record-ID: " + ident.encode(), b"WARC-Date: " + DATE]
    lines += [name + b": " + re.sub(rb"[\x00-\x1f\x7f]", b" ", value) for name, value in fields if value is not None]
    return b"\r\n".join([*lines, b"Content-Length: %d" % len(block), b"", block])


def mark_revisits(pages: DataFrame, total: int, least_bytes: int = 100, most_broadcast: int = 250_000) -> DataFrame:
    """pages(page_id, url, payload) with digest and refers_to: the smallest page of an equal payload of at least that size, else null.

    Only digests are shuffled to be counted. Up to most_broadcast digests that several pages share, some 20 MB, are broadcast, so payloads
    stay where they are; with more of them pages are shuffled with their payloads, and only a payload that very many pages share is joined by broadcast.
    """
    digested = pages.withColumn("digest", F.sha2("payload", 256)).withColumn("long_enough", F.length("payload") >= least_bytes)
    shared = checkpoint(digested.where("long_enough").groupBy("digest").agg(F.min("page_id").alias("first_page"), F.count("*").alias("n")).where("n > 1"))
    if shared.count() <= most_broadcast:
        joined = digested.join(F.broadcast(shared.drop("n")), "digest", "left")
    else:
        joined = left_join_counted(digested, shared, "digest", ["first_page"], "n", total, F.coalesce(F.col("page_id").cast("string"), F.col("url")))
    refers = F.when(F.col("long_enough") & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first_page"))), F.col("first_page"))
    return joined.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write_pages(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 100, segment_bytes: int = 4096, chunk_bytes: int = 1500, file_bytes: int = 8 << 20) -> None:
    """Write a record per page to gzipped archives below path.

    The payload is the page in UTF-8, null as empty, sent in chunks of chunk_bytes. Of pages with equal payloads of at least
    least_bytes the one with the smallest id is a response; others are revisits of it without a payload; a page with a
    null id is a revisit if one with an id has the payload. Shorter ones are all responses. A response whose block exceeds
    segment_bytes is cut: the first segment is the response record, the others are continuation records with the origin's
    identifier and their number, the last one with the total length. An archive has about file_bytes, and what follows
    lies in the next one, so the segments of a record may be in several archives. Repeated rows give repeated records, an
    empty table gives no archives; other columns, whatever their names, are not read.
    """
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    size = base.agg(F.sum(F.length("payload") + 600).alias("total"), F.count("*").alias("n")).first()
    per_file = max(1, file_bytes * size.n // max(1, size.total or 0))

    def run(batch):
        out = []
        for page, url, payload, digest, refers in zip(*(column.to_pylist() for column in batch.columns)):
            ident = record_id(page, digest)
            fields = [(b"WARC-Target-URI", url.encode() if url is not None else None), (b"X-Page-ID", str(page).encode() if page is not None else None), (b"WARC-Payload-Digest", b"sha256:" + digest.encode()), (b"Content-Type", b"application/http; msgtype=response")]
            if refers is not None:
                first = record_id(refers, digest)
                out.append(_record(b"revisit", ident, [*fields, (b"WARC-Profile", REVISIT), (b"WARC-Refers-To", first.encode())], b""))
                continue
            block = HTTP_HEAD + chunked(payload, chunk_bytes)
            segments = [block[at : at + segment_bytes] for at in range(0, len(block), segment_bytes)]
            for number, segment in enumerate(segments, 1):
                if len(segments) == 1:
                    more = []
                elif number == 1:
                    more = [(b"WARC-Segment-Number", b"1")]
                else:
                    more = [(b"WARC-Segment-Number", b"%d" % number), (b"WARC-Segment-Origin-ID", ident.encode())]
                    if number == len(segments):
                        more.append((b"WARC-Segment-Total-Length", b"%d" % len(block)))
                if number == 1:
                    out.append(_record(b"response", ident, [*fields, *more], segment))
                else:
                    out.append(_record(b"continuation", record_id(f"{page}#{number}", digest), more, segment))
        return pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    records = map_batches(mark_revisits(base, size.n, least_bytes), run, "record binary").select(F.col("record").cast("string").alias("value"))
    with freed_shuffles(pages.sparkSession):
        records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def _inflated(content: bytes) -> tuple[bytes, bool]:
    """The content of an archive, whether plain, one gzip member, or a member per record, and whether it is whole."""
    if content[:2] != b"\x1f\x8b":
        return content, True
    out = []
    while content:
        stream = zlib.decompressobj(wbits=31)
        try:
            out.append(stream.decompress(content))
        except zlib.error:
            return b"".join(out), False
        if not stream.eof:
            return b"".join(out), False
        content = stream.unused_data
    return b"".join(out), True


def parsed(archive: bytes, whole: bool = True) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """The header fields, names in lower case, and blocks of the records of an archive, each with a problem or null.

    After a record whose end can't be told, because its length is missing or no number or the archive ends before, nothing
    more is read; an archive that is not whole ends in a record with a problem.
    """
    at, told = 0, False
    while (at := archive.find(b"WARC/", at)) >= 0 and not told:
        end = archive.find(b"\r\n\r\n", at)
        if end < 0:
            yield {}, b"", "archive"
            told = True
            break
        lines = archive[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
        length = fields.get("content-length", "")
        if not (length.isascii() and length.isdigit()):
            yield fields, b"", "content length"
            told = True
        else:
            at = end + 4 + int(length)
            told = at > len(archive)
            yield fields, archive[end + 4 : at], "archive" if told else None
    if not whole and not told:
        yield {}, b"", "archive"


RECORDS = "record_id string, type string, url string, page_id string, digest string, refers_to string, origin string, segment int, total_length long, block binary, problem string"


def _number(text: str | None, most: int) -> tuple[int | None, bool]:
    """A number in a header field, null if there is none, and whether it can be read."""
    if text is None:
        return None, True
    if text.isascii() and text.isdigit() and int(text) <= most:
        return int(text), True
    return None, False


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below path, plain or gzipped, one row each. An archive is read by one task.

    A record that can't be read has a problem: `archive` where its archive is cut or damaged, `content length` or
    `segment` where a number is missing or none. What the archive has after the first two is lost.
    """

    def batch_of(rows):
        kinds = [pa.string()] * 7 + [pa.int32(), pa.int64(), pa.binary(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["record_id", "type", "url", "page_id", "digest", "refers_to", "origin", "segment", "total_length", "block", "problem"])

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for f, block, problem in parsed(*_inflated(content.as_py())):
                    ident, digest = f.get("warc-record-id"), f.get("warc-payload-digest")
                    number, plain = _number(f.get("warc-segment-number"), (1 << 31) - 1)
                    total, sure = _number(f.get("warc-segment-total-length"), (1 << 63) - 1)
                    if not (plain and sure):
                        problem = problem or "segment"
                    rows.append((ident, f.get("warc-type"), f.get("warc-target-uri"), f.get("x-page-id"), digest.removeprefix("sha256:") if digest else None, f.get("warc-refers-to"), f.get("warc-segment-origin-id", ident), number, total, block, problem))
                    size += len(block)
                    if size > 4 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                yield batch_of(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORDS)


def reassemble(records: DataFrame) -> DataFrame:
    """Whole records from records as read: segments joined in order of their numbers, chunked framing decoded.

    Only segmented records are shuffled, grouped by the identifier of their origin; those with neither origin nor identifier
    are not, and each comes back by itself with the problem `missing segment`. Returns record_id, type, url, page_id,
    digest, refers_to, payload and problem: null, that of reading, or `missing segment`, `total length`, `framing` or
    `digest` for what doesn't hold; its payload is then null. A record that was written several times, with equal pages and payloads,
    comes back as often. Continuations without their origin come back with the problem `missing segment`.
    No records give no rows; other columns are not read.
    """
    head = F.col("segment").isNull() | (F.col("segment") == 1)
    fields = ["type", "url", "page_id", "digest", "refers_to"]
    whole = records.where("segment is null").select("record_id", *fields, "block", "problem")
    nameless = records.where("segment is not null and origin is null").select("record_id", *fields, F.array("block").alias("blocks"), F.lit("missing segment").alias("problem"))
    parts = records.where("segment is not null and origin is not null").groupBy("origin").agg(
        *[F.max(F.when(head, F.col(c))).alias(c) for c in fields],
        F.sort_array(F.collect_set(F.struct("segment", "block"))).alias("segments"), F.max("total_length").alias("total_length"), F.count_if(head).alias("times"), F.max("problem").alias("of_reading"),
    )
    blocks = F.transform("segments", lambda s: s["block"])  # joined where they are decoded, so each byte is copied once
    length = F.aggregate("segments", F.lit(0).cast("long"), lambda n, s: n + F.length(s["block"]))
    n = F.size("segments")
    complete = (F.element_at("segments", 1)["segment"] == 1) & (F.element_at("segments", -1)["segment"] == n) & F.col("total_length").isNotNull()
    problem = F.when(F.col("of_reading").isNotNull(), F.col("of_reading")).when(~complete, "missing segment").when(length != F.col("total_length"), "total length")
    joined = parts.withColumn("blocks", blocks).withColumn("problem", problem)
    joined = joined.withColumn("again", F.explode(F.array_repeat(F.lit(1), F.greatest(F.col("times"), F.lit(1)).cast("int"))))
    both = whole.withColumn("blocks", F.array("block")).drop("block").select("record_id", *fields, "blocks", "problem").unionByName(joined.select(F.col("origin").alias("record_id"), *fields, "blocks", "problem")).unionByName(nameless)

    def run(batch):
        payloads, problems = [], []
        for kind, digest, blocks, problem in zip(*(batch.column(i).to_pylist() for i in (1, 4, 6, 7))):
            payload = None
            if problem is None and kind == "response":
                try:
                    payload = payload_of(b"".join(blocks))
                except ValueError:
                    problem = "framing"
                if payload is not None and digest and hashlib.sha256(payload).hexdigest() != digest:
                    payload, problem = None, "digest"
            payloads.append(payload)
            problems.append(problem)
        return pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(payloads, pa.binary()), pa.array(problems, pa.string())], names=["record_id", *fields, "payload", "problem"])

    return map_batches(both, run, "record_id string, type string, url string, page_id string, digest string, refers_to string, payload binary, problem string")


def resolve_revisits(whole: DataFrame) -> DataFrame:
    """Whole records with refers_to_page, payload_bytes and payload_digest of the full payload, a revisit's from its response.

    The digests of responses are recomputed from the payload. A revisit without its response, or that refers to nothing, has nulls. Records of other
    types are left out; no records give no rows. A response that very many records revisit is joined by broadcast.
    """
    measured = checkpoint(whole.select("record_id", "type", "url", "page_id", "refers_to", "problem", F.length("payload").cast("long").alias("n"), F.sha2("payload", 256).alias("d")))
    revisits = measured.where("type = 'revisit'")
    wanted = revisits.where("refers_to is not null").groupBy("refers_to").agg(F.count("*").alias("times"))
    responses = measured.where("type = 'response'").groupBy(F.col("record_id").alias("refers_to")).agg(F.max("page_id").alias("refers_to_page"), F.max("n").alias("payload_bytes"), F.max("d").alias("payload_digest"))
    responses = wanted.join(responses, "refers_to", "left").select("refers_to", "refers_to_page", "payload_bytes", "payload_digest", "times")
    responses = checkpoint(responses)  # also the keys that are missing, so that their revisits are spread, too
    joined = left_join_counted(revisits.where("refers_to is not null"), responses, "refers_to", ["refers_to_page", "payload_bytes", "payload_digest"], "times", measured.count(), F.col("record_id"))
    out = ["record_id", "type", "url", "page_id", "problem"]
    own = measured.where("type = 'response'").select(*out, F.lit(None).cast("string").alias("refers_to_page"), F.col("n").alias("payload_bytes"), F.col("d").alias("payload_digest"))
    lost = revisits.where("refers_to is null").select(*out, *[F.lit(None).cast(kind).alias(c) for c, kind in (("refers_to_page", "string"), ("payload_bytes", "long"), ("payload_digest", "string"))])
    return own.unionByName(joined.select(*own.columns)).unionByName(lost)
