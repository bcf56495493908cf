"""Helpers that several of the corpus operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandkit.functions.batches import bound_batches
from strandkit.operators.numbering import shared_dir


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Actions inside remove their shuffle files when they end; for results that are written, and so don't need them again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder; the shuffle files that made it go at once."""
    bound_batches(df.sparkSession)
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    with freed_shuffles(df.sparkSession):
        return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    bound_batches(spark)
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of so many rows, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType, rows: int = 500) -> DataFrame:
    """mapInArrow with a function of a batch of so many rows at most."""

    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, rows):
            if (out := function(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def repeated(df: DataFrame, n: str, number: str, block: int = 65_536) -> DataFrame:
    """Each row as often as its column n says, numbered from 0; two steps, so no array has more than block or n / block entries."""
    blocks = df.where(F.col(n) > 0).withColumn("block_of_copies", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / block).cast("long"))))
    first = F.col("block_of_copies") * block
    return blocks.withColumn(number, F.explode(F.sequence(first, F.least(first + block, F.col(n).cast("long")) - 1))).drop("block_of_copies")


def with_times(rows: DataFrame, id_col: str, text_col: str, most_bytes: int) -> tuple[DataFrame, bool]:
    """rows with key, what deals them out, times, how often each stands for itself, and hot; and whether any is hot.

    The key is a hash of the id, or of the text where that is null. If the rows of a key have more than most_bytes in all,
    they are hot: equal ones are counted and become one, and the key is a hash of id and text, so others are spread.
    """
    key = F.when(F.col(id_col).isNull(), F.xxhash64(F.lit(1), text_col)).otherwise(F.xxhash64(F.lit(2), id_col))
    keyed = rows.withColumn("key", key)
    sizes = keyed.groupBy("key").agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 16).alias("n"), F.count("*").alias("times"))
    large = checkpoint(sizes.where((F.col("n") > most_bytes) & (F.col("times") > 1)).select("key"))
    plain = lambda df: df.withColumns({"times": F.lit(1).cast("long"), "hot": F.lit(False)})
    if not (n := large.count()):
        return plain(keyed), False
    large = F.broadcast(large) if n <= 100_000 else large  # keys of eight bytes
    many = keyed.join(large, "key", "left_semi").withColumn("key", F.xxhash64(F.lit(3), id_col, text_col)).groupBy(*keyed.columns).agg(F.count("*").alias("times"))
    return plain(keyed.join(large, "key", "left_anti")).unionByName(many.withColumn("hot", F.lit(True))), True


def labels_of_links(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0..n-1 linked by a[i]-b[i]: the smallest node reachable from each."""
    label = np.arange(n)
    while len(a):
        left, right = label[a], label[b]  # roots, which alone are hooked, so no tree is torn
        low = np.minimum(left, right)
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
        differ = label[a] != label[b]
        a, b = a[differ], b[differ]
    return label


def join_counted(left: DataFrame, right: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Inner join by key; right's keys are distinct and n says how many rows left has of each, of total at most.

    Keys with more than a 5,000th of all rows, 5,000 at most, are broadcast; of the others none fills a task.
    """
    most = max(100, total // 5000)
    hot, rest = right.where(F.col(n) > most).drop(n), right.where(F.col(n) <= most).drop(n)
    return left.join(F.broadcast(hot), key).unionByName(left.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key))


def left_join_counted(left: DataFrame, right: DataFrame, key: str, values: list[str], n: str, total: int, spread: Column) -> DataFrame:
    """left with right's values by key, null where right has none; n says how many rows left has of each key, of total.

    Keys with more than a 5,000th of all rows are joined by broadcast; their rows are then spread by a hash of spread.
    """
    most = max(100, total // 5000)
    hot, rest = right.where(F.col(n) > most).select(key, *values, F.lit(True).alias("is_hot")), right.where(F.col(n) <= most)
    first = left.join(F.broadcast(hot), key, "left")
    place = F.when(F.col("is_hot"), F.concat_ws("#", key, F.pmod(F.xxhash64(spread), F.lit(1000)))).otherwise(F.col(key))
    second = first.withColumn("place", place).join(rest.select(F.col(key).alias("place"), *[F.col(c).alias(f"{c}_of_rest") for c in values]), "place", "left")
    return second.select(*left.columns, *[F.coalesce(c, f"{c}_of_rest").alias(c) for c in values])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph given as edges(src, dst): rows (node, component), component the smallest node.

    Alternates the large-star and small-star steps until the edges no longer change. Each round is two
    aggregations and joins over the edges, with a reliable checkpoint after each step, so that the driver only plans small
    ones; no node's neighbours are ever gathered in one place, and where there are large stars their centres are broadcast, so
    their edges stay where they are. Null ends and loops are left out, repeated edges count once; no edges give no rows.
    """
    both = lambda e: e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    current = checkpoint(edges.select("src", "dst").where("src <> dst").distinct())
    count, state = current.count(), None

    def moved(rows: DataFrame, low: DataFrame, total: int) -> DataFrame:
        """rows(src, dst) with dst and the low of src in its place; low(src, low, n) says how many rows src has."""
        hot = (low.agg(F.max("n")).first()[0] or 0) > max(100, total // 5000)
        joined = join_counted(rows, low, "src", "n", total) if hot else rows.join(low.drop("n"), "src")
        return joined.select(F.col("dst").alias("src"), F.col("low").alias("dst"))

    def settled(df: DataFrame) -> DataFrame:
        """A checkpoint in no more files than the edges need, so that rounds over few of them are few small tasks."""
        return checkpoint(df.coalesce(max(1, count // 20_000)))

    for _ in range(max_rounds):
        around = both(current)
        low = settled(around.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low"), F.count("*").alias("n")))
        # large star: what is above a node moves to the lowest of its neighbours
        large = settled(moved(around.where("dst > src"), low, 2 * count).where("src <> dst").distinct())
        # small star: what is below a node moves to the lowest of those
        low = settled(large.groupBy("src").agg(F.min("dst").alias("low"), F.count("*").alias("n")))
        current = settled(moved(large, low, 2 * count).unionByName(low.select("src", F.col("low").alias("dst"))).where("src <> dst").distinct())
        now = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("h")).first()
        if state == tuple(now):
            break
        count, state = now.n, tuple(now)
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(current.select(F.col("dst").alias("node"), F.col("dst").alias("component"))).distinct()


def consecutive_groups(batches: Iterator[pa.RecordBatch], key_columns: int = 1) -> Iterator[pa.Table]:
    """The runs of rows that agree in the first columns, from batches sorted by them."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        new = np.zeros(rest.num_rows, bool)
        for i in range(key_columns):
            column = rest.column(i).combine_chunks().to_numpy(zero_copy_only=False)
            new[1:] |= column[1:] != column[:-1]
        cuts = [0, *np.flatnonzero(new).tolist()]
        for start, end in zip(cuts, cuts[1:]):
            yield rest.slice(start, end - start)
        rest = rest.slice(cuts[-1])
    if rest is not None:
        yield rest
