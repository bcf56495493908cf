"""Operators on rows of token ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandkit.functions import tokens as T


def pad_to_batch_max(df: DataFrame, ids: str, batch: str, pad: int = T.PAD) -> DataFrame:
    """Ids padded to the longest of their batch. A batch is a partition of the window, so it should be a bounded number of rows."""
    longest = F.max(F.size(ids)).over(Window.partitionBy(batch))
    return df.withColumn(ids, T.pad_to(F.col(ids), longest, F.lit(pad)))


def pad_all(df: DataFrame, ids: str, pad: int = T.PAD) -> DataFrame:
    """Ids padded to the longest of all rows: one number from an aggregate, no window."""
    longest = df.agg(F.max(F.size(ids)).alias("__longest"))
    return df.join(F.broadcast(longest)).withColumn(ids, T.pad_to(F.col(ids), F.col("__longest"), F.lit(pad))).drop("__longest")


def batch_tokenize(df: DataFrame, seq: str, k: int, fixed_length: int | None = None, batch: str | None = None, cls: bool = True) -> DataFrame:
    """df with tokens and token_ids of k-mers in the second layout, padded to fixed_length, the batch, or all rows."""
    out = df.withColumn("tokens", T.tokenize_kmers(F.col(seq), k))
    out = out.withColumn("token_ids", T.add_special(T.kmer_ids(F.col("tokens"), k, 6), cls=T.CLS if cls else None))
    if fixed_length is not None:
        return out.withColumn("token_ids", T.pad_fixed(F.col("token_ids"), fixed_length))
    return pad_to_batch_max(out, "token_ids", batch) if batch else pad_all(out, "token_ids")


def tokenize_multimodal(df: DataFrame, dna: str, rna: str, protein: str, amino_acids: list[str], k: int = 6) -> DataFrame:
    """df with dna_ids, rna_ids and protein_tokens of one record, in one projection."""
    ids = lambda c: T.add_special(T.kmer_ids(T.tokenize_kmers(F.col(c), k), k, 6), cls=T.CLS)
    return df.withColumns({"dna_ids": ids(dna), "rna_ids": ids(rna), "protein_tokens": T.tokenize_regex(F.col(protein), amino_acids)})


def position_ids(df: DataFrame, key: str, ids: str, pad: int = T.PAD) -> DataFrame:
    """Long form (key, pos, token_id, position): non-pads counted from pad + 1, pads have pad. Nothing is shuffled."""
    both = F.arrays_zip(F.col(ids).alias("token_id"), T.position_ids(F.col(ids), pad).alias("position"))
    return df.select(key, F.posexplode(both).alias("pos", "x")).select(key, "pos", "x.token_id", "x.position")


def mlm_rows(df: DataFrame, key: str, ids: str, seed: int, vocab_size: int, n_special: int, rate: float = 0.15, split: tuple[float, float] = (0.8, 0.1)) -> DataFrame:
    """(key, ids, labels) for masked language modelling."""
    both = df.select(key, T.mlm_arrays(F.col(key), F.col(ids), seed, vocab_size, n_special, rate, split).alias("x"))
    return both.select(key, "x.ids", "x.labels")


def rescale_masked(emb: DataFrame, tokens: DataFrame, key: str, ids: str, ratio: float, prob: float, mask: int = T.MASK, pad: int = T.PAD) -> DataFrame:
    """emb(key, pos, v) with zeros at mask tokens, all scaled by (1 - ratio * prob) / (1 - observed ratio)."""
    observed = F.coalesce(T.mask_ratio(F.col(ids), mask, pad), F.lit(0.0))
    long = tokens.select(key, observed.alias("observed"), F.posexplode(ids).alias("pos", "token_id"))
    factor = F.when(F.col("token_id") == mask, 0.0).otherwise((1 - ratio * prob) / F.when(F.col("observed") < 1, 1 - F.col("observed")))
    return emb.join(long, [key, "pos"]).select(key, "pos", F.transform("v", lambda x: x.cast("double") * factor).alias("v"))


def check_max_length(df: DataFrame, ids: str, n: int, on_error: str = "raise") -> DataFrame:
    """Rows whose ids a model with that limit takes; longer ones are an error, or go."""
    ok: Column = F.size(ids) <= n
    if on_error == "filter":
        return df.where(ok)
    return df.withColumn(ids, T.fail_unless(ok, F.col(ids), f"longer than {n} tokens"))
