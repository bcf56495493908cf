"""Embeddings, logits and predictions: pooling, lookups, selection and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandkit.functions.outputs import argmax, log_prob
from strandkit.operators.numbering import settled
from strandkit.operators.vectors import mean_vectors, vector_sums


def strip_special(df: DataFrame, length: str, first: int = 1) -> DataFrame:
    """Positions from first up to the sequence's length: without what stands in front, and without pads."""
    return df.where((F.col("pos") >= first) & (F.col("pos") <= F.col(length)))


def zero_padded(df: DataFrame, values: str, real: str) -> DataFrame:
    """values as zeros where real is false."""
    return df.withColumn(values, F.when(F.col(real), F.col(values)).otherwise(F.transform(values, lambda x: (x * 0))))


def mean_embedding(emb: DataFrame, key: str, v: str = "v") -> DataFrame:
    """(key, dim, mean) over the rows given, in double precision, from mean_vectors: vectors become rows after the last shuffle."""
    return mean_vectors(emb, [key], v).select(key, F.posexplode("mean").alias("dim", "mean"))


def sum_embeddings(parts: list[DataFrame], keys: list[str], v: str = "v") -> DataFrame:
    """(keys, dim, total) of several embeddings per place, null where none has a value."""
    both = parts[0].select(*keys, v)
    for p in parts[1:]:
        both = both.unionByName(p.select(*keys, v))
    total = F.transform(F.arrays_zip("sums", "counts"), lambda x: F.when(x["counts"] > 0, x["sums"]))
    return vector_sums(both, keys, v).select(*keys, F.posexplode(total).alias("dim", "total"))


def lookup_embedding(tokens: DataFrame, key: str, ids: str, table: DataFrame) -> DataFrame:
    """(key, pos, token_id, v) from table(token_id, v)."""
    used = tokens.select(F.explode(ids).alias("token_id")).distinct()
    return tokens.select(key, F.posexplode(ids).alias("pos", "token_id")).join(_vectors_of(used, table), "token_id")


def lookup_counts(tokens: DataFrame, key: str, ids: str, table: DataFrame) -> DataFrame:
    """(key, token_id, n, v): lookup_embedding with one row for each different token of a key, and how often it has it.

    Tokens are counted in each task before anything is shuffled or joined, so rows grow with the different tokens, not with the places.
    """
    counted = settled(tokens.select(key, F.explode(ids).alias("token_id")).groupBy(key, "token_id").agg(F.count("*").alias("n")))
    return counted.join(_vectors_of(counted.select("token_id").distinct(), table), "token_id").select(key, "token_id", "n", "v")


def _vectors_of(used: DataFrame, table: DataFrame, most_bytes: int = 64 << 20) -> DataFrame:
    """The rows of table(token_id, v) for used(token_id), which are few where vocabularies are; broadcast if they are of bounded size.

    A frequent token is most of a join's rows, so where these vectors fit, the rows that look them up stay where they are.
    """
    vectors = settled(table.join(used, "token_id", "left_semi").select("token_id", "v"))
    size = vectors.agg(F.sum(F.coalesce(F.size("v"), F.lit(0)) * 8 + 32)).first()[0] or 0
    return F.broadcast(vectors) if size <= most_bytes else vectors


def tokens_to_nucleotides(df: DataFrame, key: str, values: str, k: int, n_features: int) -> DataFrame:
    """(key, pos, feature, logits): each token's values are k positions x features x 2; the first token is dropped."""
    width = k * n_features
    start = lambda: F.col("__j") * 2 + 1
    rows = df.where("pos >= 1").select(key, F.col("pos").alias("__t"), values, F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("__j"))
    place = (F.col("__t") - 1) * k + F.floor(F.col("__j") / n_features)
    return rows.select(key, place.cast("long").alias("pos"), (F.col("__j") % n_features).alias("feature"), F.slice(values, start(), F.lit(2)).alias("logits"))


def select_features(df: DataFrame, features: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of df(feature) for wanted(name, rank), with name and rank, and the wanted names that do not exist."""
    named = wanted.join(features.select("name", F.col("idx").alias("feature")), "name")
    return df.join(named, "feature"), wanted.join(features, "name", "left_anti").select("name")


def masked_pairs(truth: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, truth, pred) where truth's masked holds."""
    return truth.where("masked").select(*keys, "truth").join(pred.select(*keys, "pred"), keys)


def confusion(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("truth", "pred").agg(F.count("*").alias("n"))


def mcc(pairs: DataFrame) -> DataFrame:
    """Multi-class Matthews correlation over all pairs: one row; 0 where it is undefined."""
    cells = confusion(pairs)
    whole = cells.agg(F.sum("n").cast("double").alias("s"), F.coalesce(F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n"))), F.lit(0)).cast("double").alias("c"))
    sums = cells.select(F.explode(F.array(F.struct(F.col("truth").alias("k"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p")), F.struct(F.col("pred").alias("k"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p")))).alias("x"))
    per_class = sums.groupBy("x.k").agg(F.sum("x.t").cast("double").alias("t"), F.sum("x.p").cast("double").alias("p"))
    dots = per_class.agg(F.sum(F.col("t") * F.col("p")).alias("pt"), F.sum(F.col("t") * F.col("t")).alias("tt"), F.sum(F.col("p") * F.col("p")).alias("pp"))
    s2 = F.col("s") * F.col("s")
    below = F.sqrt((s2 - F.col("pp")) * (s2 - F.col("tt")))
    return whole.join(F.broadcast(dots)).select(F.when(below > 0, (F.col("c") * F.col("s") - F.col("pt")) / F.when(below > 0, below)).otherwise(0.0).alias("mcc"))


def mlm_metrics(df: DataFrame, logits: str, label: str) -> DataFrame:
    """Reconstruction accuracy and perplexity over all rows."""
    return df.agg(F.avg((argmax(F.col(logits)) == F.col(label)).cast("double")).alias("accuracy"), F.exp(-F.avg(log_prob(F.col(logits), F.col(label)))).alias("perplexity"))
