"""A corpus pipeline: language ID, near-duplicates, decontamination, mixing, sharding.

Every stage but the last returns the columns of its documents as they are, whatever their names. Nulls in the columns
that a stage doesn't read, and columns that it doesn't know, pass through it; an empty table stays empty. Repeated rows
are judged alike, one of them outlives the near-duplicate stage, and mixing repeats it as often as its source is to be.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandkit.llm import decontaminate, language_id, mixing, shards, simhash
from strandkit.llm.common import scratch_path
from strandkit.llm.queries import WEIGHTS

#: A document stays if its best language has at least this share of the probability.
LEAST_SCORE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, null and empty texts among them, and those whose language can't be told, go.

    The model is learned from the documents' own labels; a null language or text is not learned from.
    """
    model = language_id.learn(docs, "doc_id", "text", "lang")
    found = language_id.predicted(docs, model)
    return found.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, by SimHash or by 0.8 of the five-word shingles, one row stays.

    It is the row with the smallest id, null ids last; of rows with the same id, or none, the one with the smallest
    hash of its text, then of all its columns. Of equal rows one stays. Texts without words are one group.
    """
    kind, columns = docs.schema["doc_id"].dataType, [F.col(f"`{c}`") for c in docs.columns]
    rank = F.struct(F.col("doc_id").isNull().cast("int").alias("no_id"), F.coalesce("doc_id", F.lit(0).cast(kind)).alias("id"), F.xxhash64("text").alias("of_text"), F.xxhash64(*columns).alias("of_row"))
    ranked = docs.select(F.struct(*columns).alias("row"), rank.alias("rank"), "text")
    groups = simhash.near_duplicates(ranked.select("rank", "text"), id_col="rank", width=3, bits=3, similar=0.8)
    first = groups.select(F.col("component_id").alias("rank")).distinct()
    return ranked.select("row", "rank").join(first, "rank", "left_semi").dropDuplicates(["rank"]).select("row.*")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. A document or item without words holds none."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.find_contamination(docs, benchmark, width=10, carry=tuple(docs.columns))
    return found.where("not contaminated").select("carried.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that the sources follow the weights. A null source is one; a null id is hashed by its text."""
    return mixing.mix_sources(docs, WEIGHTS, added=False)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, in a random order, written to 24 shards and read back, with size, slot and shard.

    Columns of these names are replaced. Copies are numbered, so they are spread like other rows.
    """
    return shards.shuffle_into_shards(docs, n_shards=24)


STAGES = [
    ("language_id", known_language),
    ("simhash_near_dedup", one_of_each_group),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: Hashing, the language model and the seeded shuffle have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
