"""Mixing sources to target weights by Poisson replication, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandkit.llm.common import checkpoint, repeated

#: Mean of the largest Poisson distribution that is tabulated; a larger rate is the sum of equal parts.
MOST_RATE = 65_536
#: Bytes of the tabulated distributions up to which they are broadcast, and the parts of a hot source beyond.
MOST_BROADCAST, SALTS = 8 << 20, 64
ADDED = ("copy", "n_copies", "shuffle_key")


def hash_uniform(text: Column) -> Column:
    """A number in [0, 1) from the MD5 of a text, the same in any engine and partitioning."""
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(1 << 48)


def source_rates(docs: DataFrame, weights: dict[str, float] | None, text_col: str, source_col: str, size: float, default_weight: float) -> DataFrame:
    """Rows (source, rate): how often a document of the source is to be repeated on average.

    rate = weight's share x size x bytes of all sources / bytes of the source. Bytes are summed per task before
    the shuffle, so a hot source is one row of each task.
    """
    sums = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")).alias("bytes"))
    weight = F.lit(float(default_weight))
    for name, w in (weights or {}).items():
        weight = F.when(F.col("source") == name, F.lit(float(w))).otherwise(weight)
    sums = sums.withColumn("weight", F.when(F.col("bytes") > 0, weight).otherwise(F.lit(0.0)))
    total = sums.agg(F.sum("weight").alias("all_weight"), F.sum("bytes").alias("all_bytes"))
    share = F.when(F.col("all_weight") > 0, F.col("weight") / F.when(F.col("all_weight") > 0, F.col("all_weight"))).otherwise(0.0)
    rate = F.when(F.col("bytes") > 0, share * F.lit(float(size)) * F.col("all_bytes") / F.when(F.col("bytes") > 0, F.col("bytes"))).otherwise(0.0)
    return sums.join(F.broadcast(total)).select("source", rate.alias("rate"))  # the total is one row


def poisson_tables(rates: DataFrame, most_rate: float = MOST_RATE) -> DataFrame:
    """Rows (source, rate, parts, low, steps): the cumulative Poisson distribution with the mean rate / parts, from low on.

    A table holds the values within 12 standard deviations and 30 of the mean, so it has 24 sqrt(most_rate) rows and
    some at most, whatever the rate; what lies beyond can't be told from none. Terms are products of mean / k
    from the lowest value on, added up by a window over the rows of a source and divided by their sum.
    """
    parts = F.greatest(F.ceil(F.col("rate") / float(most_rate)), F.lit(1)).cast("long")
    spread = 12 * F.sqrt("mean") + 30
    low, high = F.greatest(F.floor(F.col("mean") - spread), F.lit(0)).cast("long"), F.when(F.col("mean") > 0, F.ceil(F.col("mean") + spread)).otherwise(0).cast("long")
    rows = rates.withColumn("parts", parts).withColumn("mean", F.col("rate") / F.col("parts")).withColumn("low", low).withColumn("k", F.explode(F.sequence("low", high)))
    upwards = Window.partitionBy("source").orderBy("k")
    factor = F.when(F.col("k") > F.col("low"), F.log(F.when(F.col("mean") > 0, F.col("mean"))) - F.log(F.col("k").cast("double"))).otherwise(0.0)
    terms = rows.withColumn("log", F.sum(factor).over(upwards)).withColumn("upto", F.sum(F.exp("log")).over(upwards))
    gathered = terms.groupBy("source", "rate", "parts", "low").agg(F.sort_array(F.collect_list("upto")).alias("sums"))
    return gathered.select("source", "rate", "parts", "low", F.transform("sums", lambda x: x / F.element_at("sums", -1)).alias("steps"))


def poisson_count(seed: int, ident: Column, parts: Column, low: Column, steps: Column) -> Column:
    """The inverse of the distribution at a hashed uniform number, found by halving the sorted table; the sum over the parts, each with a number of its own."""

    def halved(at, u):
        middle = F.floor((at["low"] + at["high"]) / 2).cast("int")
        below = (at["low"] < at["high"]) & (F.get(steps, middle) <= u)
        return F.struct(F.when(below, middle + 1).otherwise(at["low"]).alias("low"), F.when(below, at["high"]).otherwise(F.least(middle, at["high"])).alias("high"))

    def of_part(part):
        u = hash_uniform(F.concat_ws(":", F.lit(str(seed)), ident, F.when(part > 0, part.cast("string"))))
        rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(steps) + F.lit(1))).cast("int"))
        return low + F.aggregate(rounds, F.struct(F.lit(0).alias("low"), F.size(steps).alias("high")), lambda at, _: halved(at, u), lambda at: at["low"])

    return F.aggregate(F.sequence(F.lit(0).cast("long"), parts - 1), F.lit(0).cast("long"), lambda n, part: n + of_part(part))


def with_counts(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size: float = 1.0, default_weight: float = 1.0, seed: int = 17, most_rate: float = MOST_RATE, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Rows (given_0, given_1, ..., ident, n_copies): the documents' columns by number, so that no name can clash, what identifies each in hashes, and its number of copies."""
    ident = F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    given = [F.col(f"`{c}`").alias(f"given_{i}") for i, c in enumerate(docs.columns)]
    base = docs.select(*given, ident.alias("ident"), F.col(source_col).alias("of_source"))
    tables = checkpoint(poisson_tables(source_rates(docs, weights, text_col, source_col, size, default_weight), most_rate))
    held = tables.agg(F.sum(8 * F.size("steps") + 64 + F.coalesce(F.octet_length(F.col("source").cast("string")), F.lit(0))).alias("n")).first().n or 0
    if held <= most_broadcast:
        joined = base.join(F.broadcast(tables), F.col("of_source").eqNullSafe(F.col("source")))
    else:  # the join is by source and salt, so a hot source is spread
        salted = tables.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = base.withColumn("pick", F.pmod(F.xxhash64("ident"), F.lit(SALTS)).cast("int")).join(salted, F.col("of_source").eqNullSafe(F.col("source")) & (F.col("pick") == F.col("salt")))
    n_copies = poisson_count(seed, F.col("ident"), F.col("parts"), F.col("low"), F.col("steps"))
    return joined.select(*[f"given_{i}" for i in range(len(given))], "ident", n_copies.alias("n_copies"))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size: float = 1.0, default_weight: float = 1.0, seed: int = 17, added: bool = True, **more) -> DataFrame:
    """Documents repeated so that the bytes of the sources follow the weights, in a random global order.

    A document's count is the inverse of the Poisson distribution with its source's rate at a uniform number hashed
    from the seed and the id: the number of cumulative values up to it. A rate above most_rate is the sum of equal parts
    of that size at most, which is Poisson distributed as well, so no table grows with the rate. Each copy gets a
    shuffle_key hashed from seed, id and copy; copies are dealt to partitions by that key and sorted by it, one
    shuffle in all. size is the expected size of the mixture relative to the input; sources without a weight have
    default_weight.

    Returns the columns of docs, less any that clash, with copy (from 0), n_copies and shuffle_key; or, if added is
    false, the columns of docs as they are. A null source is a source of its own. A null or empty text has no bytes; a
    source with none at all has the rate 0. A null id is hashed with its text; repeated rows have equal counts. An
    empty table gives no rows.
    """
    each = repeated(with_counts(docs, weights, id_col, text_col, source_col, size, default_weight, seed, **more), "n_copies", "copy")
    keyed = each.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(f"order{seed}"), "ident", F.col("copy").cast("string"))))
    mixed = keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
    names = {f"given_{i}": c for i, c in enumerate(docs.columns) if not added or c.lower() not in ADDED}
    return mixed.select(*[F.col(n).alias(c) for n, c in names.items()], *(ADDED if added else ()))
