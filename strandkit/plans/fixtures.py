"""Sequences, counts, logits and windows that the registered queries derive from the given tables, in Spark and in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandkit.functions.batches import bound_batches, joined_md5, translated
from strandkit.functions.sequence import sanitize_dna
from strandkit.functions.tokens import tokenize_letters
from strandkit.operators.numbering import number_rows, shared_dir

LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share; it stays until whoever set that folder clears it."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: A base for each letter of the alphabet.
BASES = "ACGT" * 6 + "AC"


def letters_dna(c) -> F.Column:
    """The letters a to z of a whole text, in either case, as bases; all else goes."""
    table = bytes.maketrans((LOWER + UPPER).encode(), (BASES * 2).encode())
    return translated(c, table, bytes(b for b in range(256) if chr(b) not in LOWER + UPPER))


def letters_dna_sql(c: str) -> str:
    return f"translate(regexp_replace(translate({c}, '{UPPER}', '{LOWER}'), '[^a-z]', '', 'g'), '{LOWER}', '{BASES}')"


def seqs(spark, d):
    """(seq_id, seq): the whole text of each document as bases."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("seq_id"), letters_dna(F.col("text")).alias("seq"))


SEQS = f"s AS (SELECT doc_id AS seq_id, {letters_dna_sql('text')} AS seq FROM documents)"


def hashed(array) -> F.Column:
    """MD5 of an array's entries, comma-joined."""
    return joined_md5(array)


def hashed_sql(c: str) -> str:
    return f"md5(array_to_string(list_transform({c}, lambda z: CAST(z AS VARCHAR)), ','))"


#: The id of a 6-mer or single letter t in the second layout.
TOKEN_ID = "CASE WHEN length(t) = 1 THEN 4101 + instr('ATCGN', t) ELSE 6 + CAST(list_sum(list_transform(range(1, 7), lambda j: (instr('ATCG', substr(t, j, 1)) - 1) * CAST(power(4, 6 - j) AS BIGINT))) AS BIGINT) END"
SIXMERS = "regexp_extract_all({}, '[ACGT]{{6}}|[ACGTN]')"


def texts_as_dna(spark, d):
    """(seq_id, seq): whole texts with all but ACGTN as N."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("seq_id"), sanitize_dna(F.col("text")).alias("seq"))


TEXTS = f"s AS (SELECT doc_id AS seq_id, regexp_replace(translate(text, '{LOWER}', '{UPPER}'), '[^ACGTN]', 'N', 'g') AS seq FROM documents)"


def pads() -> F.Column:
    """0 to 31 pads, by the row's id."""
    return F.array_repeat(F.lit(1), F.col("seq_id").cast("int") % 32)


def id_rows(spark, d):
    """(seq_id, ids): letter ids of whole sequences, then 0 to 31 pads."""
    return seqs(spark, d).select("seq_id", F.concat(tokenize_letters(F.col("seq")), pads()).alias("ids"))


IDS = SEQS + """,
    t AS (SELECT seq_id, CASE WHEN seq = '' THEN [] ELSE list_transform(string_split(seq, ''), lambda c: CASE c WHEN 'A' THEN 6 WHEN 'T' THEN 7 WHEN 'C' THEN 8 ELSE 9 END) END AS u FROM s),
    r AS (SELECT seq_id, list_concat(u, list_transform(range(0, seq_id % 32), lambda i: 1)) AS ids FROM t)"""


def windows(spark, d, length: int = 4096):
    """(window_id, chrom, start, end) on the documents as chromosomes; one of fifty is empty."""
    start = F.floor(F.col("value") * 20).cast("long")
    end = start + F.when(F.col("event_id") % 50 == 0, 0).otherwise(length)
    return table(spark, d, "events").select(F.col("event_id").alias("window_id"), F.col("user_id").alias("chrom"), start.alias("start"), end.alias("end"))


WINDOWS = """windows AS (SELECT event_id AS window_id, user_id AS chrom, CAST(floor(value * 20) AS BIGINT) AS "start", CAST(floor(value * 20) AS BIGINT) + CASE WHEN event_id % 50 = 0 THEN 0 ELSE 4096 END AS "end" FROM events)"""


def counts(spark, d):
    """(cell_id, gene_idx, value)."""
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("cell_id"), F.col("l_partkey").alias("gene_idx")).agg(F.sum("l_quantity").cast("double").alias("value"))


COUNTS = "counts AS (SELECT l_suppkey AS cell_id, l_partkey AS gene_idx, CAST(sum(l_quantity) AS DOUBLE) AS value FROM lineitem GROUP BY ALL)"


def gene_positions(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("gene_idx"), F.when(F.col("p_size") < 30, F.expr("p_partkey div 3")).otherwise(-1).cast("long").alias("pos"))


POSITIONS = "positions AS (SELECT p_partkey AS gene_idx, CASE WHEN p_size < 30 THEN p_partkey // 3 ELSE -1 END AS pos FROM part)"


def expression(spark, d):
    """(sample_id, omic, gene, value); methylation only for even samples."""
    joined = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    keys = [F.col("o_custkey").alias("sample_id"), (F.col("l_partkey") % 100).alias("gene")]
    rna = joined.groupBy(*keys).agg(F.sum("l_quantity").cast("double").alias("value")).withColumn("omic", F.lit("rna"))
    methylation = joined.where("o_custkey % 2 = 0").groupBy(*keys).agg((F.round(F.avg("l_discount").cast("double"), 9) * 10).alias("value")).withColumn("omic", F.lit("methylation"))
    return rna.unionByName(methylation)


def both_modalities(spark, d):
    """The rows of expression from one join and one aggregation."""
    joined = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    keys = [F.col("o_custkey").alias("sample_id"), (F.col("l_partkey") % 100).alias("gene")]
    summed = joined.groupBy(*keys).agg(F.sum("l_quantity").cast("double").alias("rna"), (F.round(F.avg("l_discount").cast("double"), 9) * 10).alias("methylation"))
    kinds = F.when(F.col("sample_id") % 2 == 0, F.array(F.lit("rna"), F.lit("methylation"))).otherwise(F.array(F.lit("rna")))
    long = summed.withColumn("omic", F.explode(kinds))
    return long.select("sample_id", "gene", F.when(F.col("omic") == "rna", F.col("rna")).otherwise(F.col("methylation")).alias("value"), "omic")


EXPRESSION = """j AS (SELECT o_custkey AS sample_id, l_partkey % 100 AS gene, l_quantity, l_discount FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    expr AS (SELECT sample_id, gene, CAST(sum(l_quantity) AS DOUBLE) AS value, 'rna' AS omic FROM j GROUP BY ALL
             UNION ALL SELECT sample_id, gene, round(avg(CAST(l_discount AS DOUBLE)), 9) * 10 AS value, 'methylation' AS omic FROM j WHERE sample_id % 2 = 0 GROUP BY ALL)"""


def logits(spark, d):
    """(row, logits, truth)."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("row"), F.col("embedding").cast("array<double>").alias("logits"), F.col("label").alias("truth"))


LOGITS = "l AS (SELECT vec_id AS row, CAST(embedding AS DOUBLE[]) AS logits, label AS truth FROM embeddings)"


def embeddings(spark, d):
    """(seq_id, pos, v): eight positions per sequence."""
    return table(spark, d, "embeddings").select(F.expr("vec_id div 8").alias("seq_id"), (F.col("vec_id") % 8).cast("int").alias("pos"), F.col("embedding").alias("v"))


EMB = "e AS (SELECT vec_id // 8 AS seq_id, CAST(vec_id % 8 AS INTEGER) AS pos, embedding AS v FROM embeddings)"


def points(spark, d):
    """(chrom, pos, y)."""
    return number_rows(table(spark, d, "events"), ["ts", "event_id"], "pos", by=["event_type"]).select(F.col("event_type").alias("chrom"), "pos", F.col("value").alias("y"))


POINTS = "p AS (SELECT event_type AS chrom, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS pos, value AS y FROM events)"


def species_tracks(spark, d):
    """(species, token_id, track), ragged."""
    joined = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.where("n_nationkey % 7 <> 0").select(F.col("r_name").alias("species"), (6 + F.col("r_regionkey")).cast("int").alias("token_id"), F.col("n_name").alias("track"))


TRACKS = "tr AS (SELECT r_name AS species, CAST(6 + r_regionkey AS INTEGER) AS token_id, n_name AS track FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 7 <> 0)"
