"""Arriving sequences made ready for a model, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandkit.functions import sequence as S
from strandkit.functions import tokens as T


def prepare(rows: DataFrame, seq: str = "seq", k: int = 6, n_tokens: int = 128) -> DataFrame:
    """rows with token_ids: sanitized, cut into k-mers after <cls>, truncated and padded, and mask. Works on streams and tables.

    The tokens that are kept lie within the first k letters for each, so no more of a sequence is looked at.
    """
    looked_at = F.substring(seq, 1, k * (n_tokens - 1))
    ids = T.add_special(T.kmer_ids(T.tokenize_kmers(S.sanitize_dna(looked_at), k), k, 6), cls=T.CLS)
    out = rows.withColumn("token_ids", T.truncate_pad(ids, n_tokens))
    return out.withColumn("mask", T.padding_mask(F.col("token_ids")))


def write_prepared(stream: DataFrame, path: str, checkpoint: str):
    """Start the query that appends what arrives to Parquet files; it ends when all that is there has been read."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
