"""Prompts with sequence placeholders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandkit.functions import tokens as T


def render_prompt(turns: DataFrame, preamble: str, key: str = "conv_id", role: str = "role", text: str = "text", turn: str = "turn") -> DataFrame:
    """(key, prompt): the preamble, then the turns in order as `USER: ...` and `ASSISTANT: ...`, then `ASSISTANT:` for the answer."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct(turn, role, text))), lambda s: F.concat(F.upper(s[role]), F.lit(": "), F.coalesce(s[text], F.lit(""))))
    return turns.groupBy(key).agg(F.concat(F.lit(preamble), F.lit(" "), F.array_join(lines, " "), F.lit(" ASSISTANT:")).alias("prompt"))


def placeholder_violations(prompts: DataFrame, text: str, n_seqs: str, placeholder: str = "<DNA>") -> DataFrame:
    """Prompts whose placeholders are not as many as their sequences, with the number found."""
    found = ((F.length(text) - F.length(F.replace(F.col(text), F.lit(placeholder), F.lit("")))) / len(placeholder)).cast("int")
    return prompts.withColumn("found", found).where(F.col("found") != F.col(n_seqs))


def stack_sequences(prompts: DataFrame, seqs: str, n: int, k: int = 6) -> DataFrame:
    """prompts with stacked: each sequence's k-mer ids after <cls>, cut and padded to n."""
    one = lambda s: T.truncate_pad(T.add_special(T.first_kmer_ids(s, k, n, 6), cls=T.CLS), n)
    return prompts.withColumn("stacked", F.transform(seqs, one))
