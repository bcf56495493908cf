"""Readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, description, seq) of FASTA files, plain or gzipped. A gzipped file is one task, so use a file per chromosome."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("value")).where(F.trim("value") != "")
    head = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"[\r\n]", "")
    return raw.select(F.regexp_extract(head, r"^(\S*)", 1).alias("name"), F.trim(F.regexp_replace(head, r"^\S*", "")).alias("description"), body.alias("seq"))


def read_expression_csv(spark: SparkSession, path: str, id_cols: list[str], omic: str) -> DataFrame:
    """(id_cols, omic, gene, value) of a wide file with one column per gene."""
    wide = spark.read.csv(path, header=True)
    genes = [c for c in wide.columns if c not in id_cols]
    if not genes:
        raise ValueError("no gene columns")
    long = wide.unpivot([F.col(f"`{c}`") for c in id_cols], [F.col(f"`{g}`") for g in genes], "gene", "value")
    return long.select(*id_cols, F.lit(omic).alias("omic"), "gene", F.col("value").cast("double").alias("value"))


def read_counts(spark: SparkSession, counts: str, var: str, obs: str | None = None) -> dict[str, DataFrame]:
    """Single-cell tables: counts(cell_id, gene_idx, value), var(gene_idx, gene_id) and obs(cell_id, ...)."""
    out = {
        "counts": spark.read.parquet(counts).select(F.col("cell_id").cast("long"), F.col("gene_idx").cast("int"), F.col("value").cast("double")),
        "var": spark.read.parquet(var).select(F.col("gene_idx").cast("int"), F.col("gene_id").cast("string")),
    }
    return out | ({"obs": spark.read.parquet(obs)} if obs else {})


def read_json_lookup(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a JSON object of integers."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,int>")).alias("key", "value"))


def write_gene_list(genes: DataFrame, path: str, gene: str, position: str, per_file: int = 10_000) -> None:
    """Write genes in order of their positions, which are consecutive from 0, a gene per line, in files of so many below path/block=N."""
    rows = genes.select(F.col(gene).alias("value"), F.col(position).alias("at"), F.floor(F.col(position) / per_file).alias("block"))
    rows.repartition("block").sortWithinPartitions("block", "at").select("value", "block").write.partitionBy("block").text(path)


def read_gene_list(spark: SparkSession, path: str, per_file: int = 10_000) -> DataFrame:
    """(gene, gene_pos) of a file with a gene per line, or of files of so many as write_gene_list makes them; blank lines are passed over."""
    lines = F.filter(F.transform(F.split("value", r"\r?\n"), lambda g: F.trim(g)), lambda g: g != "")
    block = F.coalesce(F.nullif(F.regexp_extract("_metadata.file_path", r"/block=(\d+)/[^/]*$", 1), F.lit("")).cast("int"), F.lit(0))
    listed = spark.read.text(path, wholetext=True).select(block.alias("of_block"), F.posexplode(lines).alias("at", "gene"))
    return listed.select("gene", (F.col("of_block") * per_file + F.col("at")).alias("gene_pos"))


def read_transcripts(spark: SparkSession, path: str, split: str, seq_len: int) -> DataFrame:
    """(dna, rna, protein) of a split, those whose DNA has exactly that length."""
    return spark.read.parquet(path).where((F.col("split") == split) & (F.length("dna") == seq_len)).select("dna", "rna", "protein")
