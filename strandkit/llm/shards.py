"""Sharding by a two-pass external shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandkit.llm.common import checkpoint, repeated, scratch_path

#: Ranges of buckets whose sizes are added up in one place; within a range they are added up by itself.
RANGES = 1024


def _offsets(base: DataFrame, bucket: Column, n_buckets: int) -> DataFrame:
    """Rows (bucket, before, total, most): the records in the buckets before, of all buckets, and the copies of the row with most.

    Only hashes are shuffled. Sizes are summed first over ranges of buckets, then within each.
    """
    copies = repeated(base.groupBy("hash").agg(F.count("*").alias("times")), "times", "copy")
    sizes = copies.select(bucket.alias("bucket"), "times").groupBy("bucket").agg(F.count("*").alias("n"), F.max("times").alias("most")).withColumn("range", F.floor(F.col("bucket") * RANGES / n_buckets))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = sizes.select("bucket", "range", before(Window.partitionBy("range").orderBy("bucket")).alias("inside"))
    ranges = sizes.groupBy("range").agg(F.sum("n").alias("n"), F.max("most").alias("most"))  # RANGES rows at most
    ranges = ranges.select("range", before(Window.orderBy("range")).alias("outside"), *[f(c).over(Window.partitionBy()).alias(name) for f, c, name in ((F.sum, "n", "total"), (F.max, "most", "most"))])
    return within.join(F.broadcast(ranges), "range").select("bucket", (F.col("inside") + F.col("outside")).alias("before"), "total", "most")


def shard_of(place: np.ndarray, total: int, n_shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of each place: runs of places, the first total % n_shards of them one longer than the others."""
    size, longer = divmod(total, n_shards)
    cut = longer * (size + 1)
    late = np.maximum(place - cut, 0)
    shard = np.where(place < cut, place // (size + 1), longer + late // max(size, 1))
    return shard, np.where(place < cut, place % (size + 1), late % max(size, 1))


def permutation(seed: int, bucket: int, n: int) -> np.ndarray:
    """The Fisher-Yates shuffle of a bucket's n records."""
    order = np.arange(n)
    np.random.Generator(np.random.PCG64([seed, bucket])).shuffle(order)
    return order


def write_shards(docs: DataFrame, path: str, text_col: str = "text", n_shards: int = 24, seed: int = 2024, bucket_bytes: int = 8 << 20) -> DataFrame:
    """Write all documents in a seeded random order to shards whose counts differ by one at most, and read them back.

    First pass: a seeded hash of the row and of its copy number scatters the records uniformly over buckets of about
    bucket_bytes of text, so that one fits in the memory of a task whatever the corpus. Rows that are equal in all columns are
    interchangeable: where there are any, equal ones are counted first (a task sends one for all of its own) and
    numbered anew, so they are scattered like others. Second pass: each bucket is put in order of its hashes, Fisher-Yates
    shuffled with a seed of its own and written below path/shard=N. A record's place in the corpus is its place in the
    bucket plus the sizes of the buckets before it; a shard is a run of places. The order depends on the rows, the seed
    and bucket_bytes only, not on files, partitions or retries.

    Returns the columns of docs, less any that clash, with size (UTF-8 bytes of the text, null as empty, plus 8),
    slot and shard, as read from the files. Nulls, in any column, are values like others. Repeated rows are all kept. Fewer documents than shards leave the last shards empty; an empty table gives no rows.
    Columns of a map type are not supported.
    """
    given = [c for c in docs.columns if c.lower() not in ("size", "shard", "slot")]
    text = F.col(f"`{text_col}`")
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in given]).alias("row"), (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"))
    base = base.withColumn("hash", F.struct(F.xxhash64(F.lit(seed), "row").alias("a"), F.xxhash64(F.lit(seed + 1), "row").alias("b")))
    n_buckets = max(1, -(-(base.agg(F.sum("size").alias("n")).first().n or 0) // bucket_bytes))
    spread = F.xxhash64("hash", "copy")
    bucket = F.pmod(spread, F.lit(n_buckets))
    offsets = checkpoint(_offsets(base.select("hash"), bucket, n_buckets))
    if (offsets.agg(F.max("most")).first()[0] or 0) > 1:
        each = repeated(base.groupBy("row", "size", "hash").agg(F.count("*").alias("times")), "times", "copy")
    else:
        each = base.withColumn("copy", F.lit(0).cast("long"))
    scattered = each.select("row", "size", spread.alias("spread"), bucket.alias("bucket"))

    def permuted(key, records, place):
        records = records.sort_by("spread")
        order = permutation(seed, int(key[0].as_py()), records.num_rows)
        shard, slot = shard_of(place.column("before")[0].as_py() + np.arange(records.num_rows), place.column("total")[0].as_py(), n_shards)
        records = records.take(pa.array(order))
        return pa.Table.from_arrays([records.column("row"), records.column("size"), pa.array(slot, pa.int64()), pa.array(shard.astype(np.int32))], names=["row", "size", "slot", "shard"])

    schema = T.StructType([base.schema["row"], T.StructField("size", T.LongType()), T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])
    second = scattered.groupBy("bucket").cogroup(offsets.groupBy("bucket")).applyInArrow(permuted, schema)
    out = second.select(*[F.col(f"row.`{c}`") for c in given], "size", "slot", "shard")
    out.write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)


def shuffle_into_shards(docs: DataFrame, **more) -> DataFrame:
    """write_shards to a new path below the shared folder."""
    return write_shards(docs, scratch_path(docs.sparkSession, "shards"), **more)
