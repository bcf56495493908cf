"""Queries of the readers and of streaming: files that Spark writes from the given tables are read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandkit.operators.numbering import number_rows
from strandkit.plans import fixtures as X
from strandkit.plans.registry import query
from strandkit.sources import fasta, files
from strandkit.streaming import bags as ST_bags
from strandkit.streaming import prepare as ST


def wrapped(c, width: int = 60):
    """A sequence in lines."""
    return F.regexp_replace(c, f"(.{{{width}}})", "$1\n")


@query("src1_fasta", f"WITH {X.SEQS} SELECT 'seq' || CAST(seq_id AS VARCHAR) AS name, 'from documents' AS description, seq FROM s")
def src1(spark, d):
    path = X.scratch(spark, "fasta")
    record = F.concat(F.lit(">seq"), F.col("seq_id").cast("string"), F.lit(" from documents\n"), wrapped(F.col("seq")))
    X.seqs(spark, d).select(record.alias("value")).write.option("compression", "gzip").text(path)
    return files.read_fasta(spark, path)


@query("src1_fasta_tiles", f"WITH {X.SEQS} SELECT 'seq' || CAST(seq_id AS VARCHAR) AS chrom, i AS tile_no, substr(seq, i * 500 + 1, 500) AS seq FROM (SELECT seq_id, seq, unnest(range(0, greatest(CAST(ceil(length(seq) / 500.0) AS BIGINT), 1))) AS i FROM s)")
def src1_tiles(spark, d):
    """Plain files, read by ranges that end anywhere in lines, headers and tiles."""
    path = X.scratch(spark, "fasta")
    record = F.concat(F.lit(">seq"), F.col("seq_id").cast("string"), F.lit(" from documents\n"), wrapped(F.col("seq")))
    X.seqs(spark, d).select(record.alias("value")).write.text(path)
    return fasta.read_fasta_tiles(spark, path, 500, range_bytes=4 << 20)


@query("src2_expression_csv", """WITH g AS (SELECT o_custkey AS sample_id, l_partkey % 5 AS gene, sum(l_quantity) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL), x AS (SELECT sample_id, unnest(range(0, 5)) AS gene FROM (SELECT DISTINCT sample_id FROM g))
    SELECT CAST(x.sample_id AS VARCHAR) AS sample_id, 'rna' AS omic, 'gene' || CAST(x.gene AS VARCHAR) AS gene, CAST(value AS DOUBLE) AS value FROM x LEFT JOIN g ON x.sample_id = g.sample_id AND x.gene = g.gene""")
def src2(spark, d):
    path = X.scratch(spark, "expression")
    expr = X.table(spark, d, "lineitem").join(X.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).withColumn("gene", F.concat(F.lit("gene"), (F.col("l_partkey") % 5).cast("string")))
    wide = expr.groupBy(F.col("o_custkey").alias("sample_id")).pivot("gene", [f"gene{i}" for i in range(5)]).agg(F.sum("l_quantity"))
    wide.write.csv(path, header=True)
    return files.read_expression_csv(spark, path, ["sample_id"], "rna")


@query("src3_counts", f"WITH {X.COUNTS} SELECT cell_id, CAST(counts.gene_idx AS INTEGER) AS gene_idx, value, p_name AS gene_id FROM counts JOIN part ON p_partkey = counts.gene_idx")
def src3(spark, d):
    counts, var = X.scratch(spark, "counts"), X.scratch(spark, "var")
    X.counts(spark, d).write.parquet(counts)
    X.table(spark, d, "part").select(F.col("p_partkey").alias("gene_idx"), F.col("p_name").alias("gene_id")).write.parquet(var)
    tables = files.read_counts(spark, counts, var)
    return tables["counts"].join(tables["var"], "gene_idx").select("cell_id", "gene_idx", "value", "gene_id")


@query("src4_json_lookup", "SELECT 'g' || CAST(p_partkey AS VARCHAR) AS key, CAST(p_size AS INTEGER) AS value FROM part")
def src4(spark, d):
    path = X.scratch(spark, "lookup")
    entry = F.struct(F.concat(F.lit("g"), F.col("p_partkey").cast("string")), "p_size")
    objects = X.table(spark, d, "part").groupBy(F.expr("p_partkey div 1000").alias("file")).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
    objects.write.partitionBy("file").text(path)  # an object per file
    return files.read_json_lookup(spark, path).select("key", "value")


@query("src5_gene_list", "SELECT p_name || '-' || p_partkey AS gene, CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS INTEGER) AS gene_pos FROM part")
def src5(spark, d):
    path = X.scratch(spark, "genes")
    names = X.table(spark, d, "part").select("p_partkey", F.concat_ws("-", "p_name", "p_partkey").alias("value"))
    files.write_gene_list(number_rows(names, ["p_partkey"]), path, "value", "rn")
    return files.read_gene_list(spark, path)


@query("src6_transcripts", f"WITH {X.SEQS}, p AS (SELECT seq_id, CASE WHEN length(seq) < 4096 THEN rpad(seq, 4096, 'A') ELSE seq END AS seq FROM s) SELECT seq AS dna, replace(seq, 'T', 'U') AS rna, translate(seq, 'ACGT', 'MKLV') AS protein FROM p WHERE seq_id % 4 = 0 AND seq_id % 3 <> 0 AND length(seq) = 4096")
def src6(spark, d):
    path = X.scratch(spark, "transcripts")
    padded = X.seqs(spark, d).withColumn("seq", F.when(F.length("seq") < 4096, F.rpad("seq", 4096, "A")).otherwise(F.col("seq")))
    rows = padded.select(F.when(F.col("seq_id") % 4 == 0, "test").otherwise("train").alias("split"), F.when(F.col("seq_id") % 3 == 0, F.concat("seq", F.lit("A"))).otherwise(F.col("seq")).alias("dna"), F.regexp_replace("seq", "T", "U").alias("rna"), F.translate("seq", "ACGT", "MKLV").alias("protein"))
    for split in ("test", "train"):  # a folder each: to write both at once, a task sorts all of its rows by split first
        rows.where(F.col("split") == split).drop("split").write.parquet(f"{path}/split={split}")
    return files.read_transcripts(spark, path, "test", 4096)


@query("str1_prepare_stream", f"""WITH {X.TEXTS}, u AS (SELECT seq_id, regexp_extract_all(seq, '[ACGT]{{6}}|[ACGTN]') AS w FROM s),
    x AS (SELECT seq_id, list_transform(w, lambda t: CASE WHEN length(t) = 1 THEN 4101 + instr('ATCGN', t) ELSE 6 + CAST(list_sum(list_transform(range(1, 7), lambda j: (instr('ATCG', substr(t, j, 1)) - 1) * CAST(power(4, 6 - j) AS BIGINT))) AS BIGINT) END)[1:511] AS ids FROM u)
    SELECT seq_id, '3' || CASE WHEN len(ids) > 0 THEN ',' ELSE '' END || array_to_string(list_transform(ids, lambda z: CAST(z AS VARCHAR)), ',') || repeat(',1', CAST(511 - len(ids) AS INTEGER)) AS ids, CAST(len(ids) + 1 AS INTEGER) AS n_real FROM x""")
def str1(spark, d):
    source, out, state = (X.scratch(spark, x) for x in ("arriving", "prepared", "state"))
    X.table(spark, d, "documents").select(F.col("doc_id").alias("seq_id"), F.col("text").alias("seq")).write.parquet(source)
    stream = spark.readStream.schema("seq_id long, seq string").parquet(source)
    ST.write_prepared(ST.prepare(stream, "seq", 6, 512), out, state).awaitTermination()
    done = spark.read.parquet(out)
    return done.select("seq_id", F.array_join(F.col("token_ids").cast("array<string>"), ",").alias("ids"), F.size(F.filter("mask", lambda m: m)).alias("n_real"))


@query("str2_bag_stream", """WITH c AS (SELECT c_nationkey AS key, c_custkey AS cell_id, [CAST(c_custkey % 64 AS INTEGER), CAST(floor(c_acctbal) AS INTEGER), c_nationkey] AS v FROM customer WHERE c_custkey % 17 <> 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY cell_id) - 1 AS rn, count(*) OVER (PARTITION BY key) AS n FROM c)
    SELECT key, rn // 4 AS bag_no, string_agg(CAST(cell_id AS VARCHAR), ',' ORDER BY rn) AS cells, string_agg(array_to_string(list_transform(v, lambda z: CAST(z AS VARCHAR)), ','), ',' ORDER BY rn) AS vals, 0 AS malformed FROM r WHERE rn // 4 < n // 4 GROUP BY key, rn // 4
    UNION ALL SELECT c_nationkey, -1, CAST(c_custkey AS VARCHAR), 'a value is null', 1 FROM customer WHERE c_custkey % 17 = 0""")
def str2(spark, d):
    """Customers as cells, in one arrival; of every seventeenth a value is missing."""
    source, out, side, state = (X.scratch(spark, x) for x in ("cells", "bags", "malformed", "state"))
    values = F.array((F.col("c_custkey") % 64).cast("int"), F.floor("c_acctbal").cast("int"), F.when(F.col("c_custkey") % 17 != 0, F.col("c_nationkey").cast("int")))
    X.table(spark, d, "customer").select(F.col("c_nationkey").alias("key"), F.col("c_custkey").alias("cell_id"), values.alias("values")).write.parquet(source)
    cells = spark.readStream.schema("key int, cell_id long, values array<int>").parquet(source)
    for q in ST_bags.write_bags(cells, 4, out, side, state):
        q.awaitTermination()
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    bags = spark.read.parquet(out).select("key", "bag_no", joined("cell_ids").alias("cells"), joined("values").alias("vals"), F.lit(0).alias("malformed"))
    bad = spark.read.schema("key int, cell_id long, problem string").parquet(side)
    return bags.unionByName(bad.select("key", F.lit(-1).cast("long").alias("bag_no"), F.col("cell_id").cast("string").alias("cells"), F.col("problem").alias("vals"), F.lit(1).alias("malformed")))
