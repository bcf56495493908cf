"""Vocabularies as small tables."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandkit.functions import batches
from strandkit.functions.arrays import let

#: The special tokens and their order.
SPECIALS = ["<unk>", "<pad>", "<mask>", "<cls>", "<eos>", "<bos>"]
LETTERS = ["A", "T", "C", "G", "N"]


def kmer_vocab(spark: SparkSession, k: int) -> DataFrame:
    """All k-mers over A, T, C, G in product order: (token, token_id)."""
    digits = F.lpad(F.conv(F.col("id").cast("string"), 10, 4), k, "0")
    return spark.range(4**k).select(F.translate(digits, "0123", "ATCG").alias("token"), F.col("id").cast("int").alias("token_id"))


def _listed(spark: SparkSession, tokens: list[str], first: int, kind: str) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(t).alias("token"), F.lit(first + i).alias("token_id"), F.lit(kind).alias("kind")) for i, t in enumerate(tokens)]))
    return spark.range(1).select(pairs.alias("x")).select("x.*")


def vocab_layout(spark: SparkSession, k: int, layout: str) -> DataFrame:
    """(token, token_id, kind) of a layout.

    v1: four specials, k-mers, letters, then <eos> and <bos>. v2: six specials, k-mers, letters. letters: six
    specials, letters. With k = 1 the letters stand twice, and the later id holds.
    """
    if layout == "letters":
        return _listed(spark, SPECIALS, 0, "special").unionByName(_listed(spark, LETTERS, 6, "standard"))
    if layout not in ("v1", "v2"):
        raise ValueError(f"no layout {layout}")
    first = 4 if layout == "v1" else 6
    kmers = kmer_vocab(spark, k).select("token", (F.col("token_id") + first).alias("token_id"), F.lit("standard").alias("kind"))
    out = _listed(spark, SPECIALS[:first], 0, "special").unionByName(kmers).unionByName(_listed(spark, LETTERS, first + 4**k, "standard"))
    if layout == "v1":
        out = out.unionByName(_listed(spark, SPECIALS[4:], first + 4**k + 5, "special"))
    return out.groupBy("token").agg(F.max("token_id").alias("token_id"), F.max("kind").alias("kind"))


def layout_tokens(k: int, layout: str) -> list[str]:
    """The tokens of a layout in the order of their ids, as they stand in it; for patterns, which are built on the driver."""
    kmers = ["".join(t) for t in product("ATCG", repeat=k)] if layout != "letters" else []
    first = SPECIALS[:4] if layout == "v1" else SPECIALS
    return [*first, *kmers, *LETTERS, *(SPECIALS[4:] if layout == "v1" else [])]


def omics_vocab(spark: SparkSession, n_bins: int, cls: bool = True) -> DataFrame:
    """Bins 0 to n_bins - 1 as tokens, then the specials."""
    bins = spark.range(n_bins).select(F.col("id").cast("string").alias("token"), F.col("id").cast("int").alias("token_id"), F.lit("standard").alias("kind"))
    return bins.unionByName(_listed(spark, ["<cls>"] * cls + ["<pad>", "<mask>"], n_bins, "special"))


def check_vocab(given: DataFrame, expected: DataFrame) -> DataFrame:
    """Violations (problem, item) of a given vocabulary: missing or unknown tokens, and ids that are not 0 to n - 1."""
    sides = given.select("token", F.lit(True).alias("g")).join(expected.select("token", F.lit(True).alias("e")), "token", "full_outer")
    tokens = sides.where("g is null or e is null").select(F.when(F.col("g").isNull(), "missing token").otherwise("unknown token").alias("problem"), F.col("token").alias("item"))
    ids = given.agg(F.count("*").alias("n")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n") - 1, F.lit(0)))).alias("token_id"))
    gaps = ids.join(given.select(F.col("token_id").cast("long").alias("token_id")), "token_id", "left_anti")
    return tokens.unionByName(gaps.select(F.lit("missing id").alias("problem"), F.col("token_id").cast("string").alias("item")))


def add_tokens(vocab: DataFrame, new: DataFrame, kind: str = "standard") -> DataFrame:
    """The vocabulary with the distinct new tokens that it lacks; they get the next ids in the order of the tokens."""
    last = vocab.agg(F.coalesce(F.max("token_id"), F.lit(-1)).alias("last"))
    fresh = new.select("token").distinct().join(vocab, "token", "left_anti")
    rank = F.row_number().over(Window.orderBy("token"))  # a vocabulary is small
    numbered = fresh.withColumn("rank", rank).join(F.broadcast(last)).select("token", (F.col("last") + F.col("rank")).cast("int").alias("token_id"), F.lit(kind).alias("kind"))
    return vocab.select("token", "token_id", "kind").unionByName(numbered)


class Lookup:
    """A vocabulary that workers hold, for looking up tokens and ids inside arrays, without a join.

    A batch's tokens are looked up at once in Arrow's hash table, ids by their place, so a lookup costs a hash, whatever the
    size. Vocabularies of up to most tokens are taken: they are sent along with the plan.
    """

    def __init__(self, vocab: DataFrame, most: int = 1 << 17):
        rows = vocab.select("token", F.col("token_id").cast("int").alias("id")).limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"a vocabulary of more than {most} tokens is looked up by joins")
        if len({r.token for r in rows}) < len(rows):
            raise ValueError("a token has several ids")
        self.tokens = {r.id: r.token for r in rows}
        self.names, self.numbers = [r.token for r in rows], [r.id for r in rows]

    def ids(self, tokens: Column, unk: int | None = None, on_error: str = "raise") -> Column:
        """The ids of an array of tokens; an unknown one gives unk, or else an error or null."""
        found = batches.looked_up(tokens, self.names, self.numbers, unk)
        return found if unk is not None or on_error != "raise" else _all_found(found, "token not in the vocabulary")

    def tokens_of(self, ids: Column, on_error: str = "raise") -> Column:
        """The tokens of an array of ids; an unknown one gives an error or null. Ids must be 0 to n - 1."""
        if sorted(self.tokens) != list(range(len(self.tokens))):
            raise ValueError("ids are not 0 to n - 1")
        found = batches.names_of(ids, [self.tokens[i] for i in range(len(self.tokens))])
        return found if on_error != "raise" else _all_found(found, "id not in the vocabulary")


def _all_found(found: Column, message: str) -> Column:
    return let(found, lambda own: F.when(F.exists(own, lambda x: x.isNull()), F.raise_error(F.lit(message))).otherwise(own))


def encode_tokens(df: DataFrame, key: str, tokens: str, vocab: DataFrame, unk: int | None = None, on_error: str = "raise") -> DataFrame:
    """Long form (key, pos, token, token_id) of a token array; an unknown token gives unk, or else an error or null."""
    long = df.select(key, F.posexplode(tokens).alias("pos", "token")).join(vocab.select("token", "token_id"), "token", "left")
    missing = F.lit(unk) if unk is not None else F.raise_error(F.lit("token not in the vocabulary")).cast("int") if on_error == "raise" else F.lit(None).cast("int")
    return long.select(key, "pos", "token", F.coalesce("token_id", missing).alias("token_id"))


def decode_ids(df: DataFrame, key: str, ids: str, vocab: DataFrame, on_error: str = "raise") -> DataFrame:
    """Long form (key, pos, token_id, token) of an id array."""
    long = df.select(key, F.posexplode(ids).alias("pos", "token_id")).join(vocab.select("token", "token_id"), "token_id", "left")
    missing = F.raise_error(F.lit("id not in the vocabulary")).cast("string") if on_error == "raise" else F.lit(None).cast("string")
    return long.select(key, "pos", "token_id", F.coalesce("token", missing).alias("token"))
