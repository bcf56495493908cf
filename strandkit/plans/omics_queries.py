"""Queries of the bulk-omics and single-cell operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandkit.functions.outputs import spatial_features
from strandkit.operators import omics as O
from strandkit.plans import fixtures as X
from strandkit.plans.registry import query

LOW, HIGH, BINS = 0.0, 100.0, 64
#: The edges of the fixed bins, computed the same way on both sides.
EDGES = ", ".join(repr(e) for e in O.edges(LOW, HIGH, BINS))
N_GENES = 100


def genes(spark):
    return spark.range(N_GENES).select(F.col("id").alias("gene"), F.col("id").cast("int").alias("gene_pos"))


def packed(spark, d, omic):
    expr = X.expression(spark, d).where(F.col("omic") == omic)
    return O.pack_genes(expr, genes(spark), ["sample_id"])


def csv(values):
    return F.array_join(values.cast("array<string>"), ",")


def mapping(spark, d):
    return X.gene_positions(spark, d)


def kept(spark, d):
    return O.keep_mapped(O.expressed(X.counts(spark, d)), mapping(spark, d))


KEPT = f"{X.COUNTS}, {X.POSITIONS}, kept AS (SELECT cell_id, counts.gene_idx, value, pos FROM counts JOIN positions ON counts.gene_idx = positions.gene_idx WHERE value > 0 AND pos <> -1)"
CELL_BIN = """CASE WHEN lo = hi THEN 1 ELSE len(list_filter(list_transform(range(0, 8), lambda i: CASE WHEN i = 7 THEN hi + 0.01::DOUBLE ELSE lo + i * ((hi - lo) / 7) END), lambda e: e <= value)) END"""
BINNED = KEPT + f""", ext AS (SELECT cell_id, min(value) AS lo, max(value) AS hi FROM kept GROUP BY cell_id),
    binned AS (SELECT kept.*, CAST({CELL_BIN} AS INTEGER) AS bin FROM kept JOIN ext USING (cell_id))"""


@query("omx1_log_normalize", f"WITH {X.EXPRESSION} SELECT sample_id, gene, round(log10(1 + value), 6) + 0.0 AS x FROM expr WHERE omic = 'rna'")
def omx1(spark, d):
    return X.expression(spark, d).where("omic = 'rna'").select("sample_id", "gene", F.round(O.log_normalize(F.col("value")), 6).alias("x"))


@query("omx2_max_normalize", f"WITH {X.EXPRESSION} SELECT sample_id, gene, round(value / 5.547176906585117, 6) + 0.0 AS x FROM expr WHERE omic = 'rna'")
def omx2(spark, d):
    return X.expression(spark, d).where("omic = 'rna'").select("sample_id", "gene", F.round(O.max_normalize(F.col("value"), 5.547176906585117), 6).alias("x"))


@query("omx3_bin_fixed", f"WITH {X.EXPRESSION} SELECT sample_id, gene, CAST(CASE WHEN value = 0 THEN 0 ELSE len(list_filter([{EDGES}]::DOUBLE[], lambda e: e <= value)) END AS INTEGER) AS bin, CAST(CASE WHEN value = 0 THEN 0 ELSE least(len(list_filter([{EDGES}]::DOUBLE[], lambda e: e <= value)), {BINS - 1}) END AS INTEGER) AS clipped FROM expr WHERE omic = 'rna'")
def omx3(spark, d):
    rows = X.expression(spark, d).where("omic = 'rna'")
    return rows.select("sample_id", "gene", O.bin_fixed(F.col("value"), LOW, HIGH, BINS).alias("bin"), O.bin_fixed(F.col("value"), LOW, HIGH, BINS, clip=True).alias("clipped"))


PACKED = f"""{X.EXPRESSION}, grid AS (SELECT DISTINCT sample_id, omic, unnest(range(0, {N_GENES})) AS gene FROM expr),
    full_ AS (SELECT grid.sample_id, grid.omic, grid.gene, coalesce(value, 0) AS value, value IS NOT NULL AS got FROM grid LEFT JOIN expr ON grid.sample_id = expr.sample_id AND grid.omic = expr.omic AND grid.gene = expr.gene)"""
IDS_OF = "string_agg(CAST(CASE WHEN value = 0 THEN 0 ELSE CAST(floor(value) AS INTEGER) % 64 END AS VARCHAR), ',' ORDER BY gene)"


def ids_of(values):
    return F.transform(values, lambda x: F.floor(x).cast("int") % 64)


@query("omx4_fill_missing", f"""WITH {PACKED}, a AS (SELECT sample_id, {IDS_OF} FILTER (omic = 'rna') AS rna, {IDS_OF} FILTER (omic = 'methylation') AS methylation FROM full_ GROUP BY sample_id)
    SELECT sample_id, rna, coalesce(methylation, '66' || repeat(',66', 99)) AS methylation FROM a""")
def omx4(spark, d):
    both = O.pair_omics(packed(spark, d, "rna"), packed(spark, d, "methylation"), "sample_id", ("rna", "methylation"))
    fill = lambda c: csv(O.fill_missing_modality(ids_of(F.col(c)), N_GENES, 66)).alias(c)
    return both.select("sample_id", fill("rna"), fill("methylation"))


@query("omx5_pad", f"WITH {PACKED} SELECT sample_id, '64,' || {IDS_OF} || repeat(',65', 11) AS ids FROM full_ WHERE omic = 'rna' GROUP BY sample_id")
def omx5(spark, d):
    return packed(spark, d, "rna").select("sample_id", csv(O.pad_omics(ids_of(F.col("values")), N_GENES, 4, 65, cls=64)).alias("ids"))


@query("omx6_pack", f"WITH {PACKED} SELECT sample_id, string_agg(CAST(CAST(value AS BIGINT) AS VARCHAR), ',' ORDER BY gene) AS vals, bool_and(got) AS complete FROM full_ WHERE omic = 'rna' GROUP BY sample_id")
def omx6(spark, d):
    return packed(spark, d, "rna").select("sample_id", csv(F.transform("values", lambda x: x.cast("long"))).alias("vals"), "complete")


@query("omx7_tokenize", f"""WITH {X.EXPRESSION}, st AS (SELECT 'rna' AS omic, 0.0::DOUBLE AS low, 2.5::DOUBLE AS high, 16 AS n, 1.0::DOUBLE AS factor, true AS lg UNION ALL SELECT 'methylation', 0.0, 1.0, 8, 2.0, false),
    y AS (SELECT sample_id, gene, expr.omic, CASE WHEN lg THEN log10(1 + value) ELSE value END / factor AS x, low, high, n FROM expr JOIN st ON expr.omic = st.omic)
    SELECT sample_id, omic, gene, CAST(CASE WHEN x = 0 THEN 0 ELSE len(list_filter(list_transform(range(0, n), lambda i: CASE WHEN i = n - 1 THEN high ELSE low + i * ((high - low) / (n - 1)) END), lambda e: e <= x)) END AS INTEGER) AS bin FROM y""")
def omx7(spark, d):
    settings = spark.createDataFrame([("rna", 0.0, 2.5, 16, 1.0, True), ("methylation", 0.0, 1.0, 8, 2.0, False)], "omic string, low double, high double, n_bins int, factor double, log boolean")
    return O.tokenize_omics(X.both_modalities(spark, d), settings).select("sample_id", "omic", "gene", "bin")


@query("omx8_pair", f"""WITH {X.EXPRESSION}, a AS (SELECT sample_id, round(sum(value), 4) AS r FROM expr WHERE omic = 'rna' AND sample_id % 5 <> 0 GROUP BY 1), b AS (SELECT sample_id, round(sum(value), 4) AS m FROM expr WHERE omic = 'methylation' GROUP BY 1)
    SELECT coalesce(a.sample_id, b.sample_id) AS sample_id, r, m FROM a FULL JOIN b ON a.sample_id = b.sample_id""")
def omx8(spark, d):
    both = O.pair_omics(packed(spark, d, "rna").where("sample_id % 5 <> 0"), packed(spark, d, "methylation"), "sample_id", ("r", "m"))
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 4).alias(c)
    return both.select("sample_id", total("r"), total("m"))


@query("omx9_map_genes", "SELECT p_partkey AS gene_idx, p_name || '-' || p_partkey AS gene_id, CASE WHEN p_size < 30 THEN p_partkey // 3 ELSE -1 END AS pos FROM part")
def omx9(spark, d):
    part = X.table(spark, d, "part").withColumn("gene", F.concat_ws("-", "p_name", "p_partkey"))
    var = part.select(F.col("p_partkey").alias("gene_idx"), F.col("gene").alias("gene_id"))
    known = part.where("p_size < 30")
    return O.map_genes(var, known.select(F.col("gene").alias("gene_id"), (F.col("p_partkey") + 7).alias("vocab_idx")), known.select((F.col("p_partkey") + 7).alias("vocab_idx"), F.expr("p_partkey div 3").alias("pos")))


@query("omx10_expressed", f"WITH {X.COUNTS} SELECT cell_id, gene_idx, value - 30 AS value FROM counts WHERE value - 30 > 0")
def omx10(spark, d):
    return O.expressed(X.counts(spark, d).withColumn("value", F.col("value") - 30))


@query("omx11_keep_mapped", f"WITH {KEPT} SELECT cell_id, gene_idx, value, pos FROM kept UNION ALL SELECT DISTINCT cell_id, CAST(-1 AS BIGINT), CAST(0 AS DOUBLE), CAST(-1 AS BIGINT) FROM counts WHERE cell_id NOT IN (SELECT cell_id FROM kept)")
def omx11(spark, d):
    k = kept(spark, d).select("cell_id", "gene_idx", "value", "pos")
    dropped = O.cells_dropped(X.counts(spark, d), k).select("cell_id", F.lit(-1).cast("long").alias("gene_idx"), F.lit(0.0).alias("value"), F.lit(-1).cast("long").alias("pos"))
    return k.unionByName(dropped)


@query("omx12_bin_per_cell", f"WITH {BINNED} SELECT cell_id, gene_idx, bin FROM binned")
def omx12(spark, d):
    return O.bin_per_cell(kept(spark, d), 8).select("cell_id", "gene_idx", "bin")


DENSE = BINNED + """, last AS (SELECT cell_id, pos, arg_max(bin, gene_idx) AS bin FROM binned GROUP BY cell_id, pos),
    grid AS (SELECT cell_id, unnest(range(0, (SELECT max(p_partkey) // 3 + 1 FROM part))) AS pos FROM (SELECT DISTINCT cell_id FROM kept)),
    dense AS (SELECT grid.cell_id, grid.pos, coalesce(bin, 0) AS bin FROM grid LEFT JOIN last ON grid.cell_id = last.cell_id AND grid.pos = last.pos)"""


def n_positions(spark, d):
    return X.table(spark, d, "part").agg(F.expr("max(p_partkey) div 3 + 1")).first()[0]


@query("omx13_densify", f"WITH {DENSE} SELECT cell_id, string_agg(CAST(bin AS VARCHAR), ',' ORDER BY pos) AS vals FROM dense GROUP BY cell_id")
def omx13(spark, d):
    return O.densify_text(O.bin_per_cell(kept(spark, d), 8), n_positions(spark, d)).select("cell_id", F.col("values").alias("vals"))


@query("omx14_pad_dense", f"WITH {DENSE} SELECT cell_id, string_agg(CAST(bin AS VARCHAR), ',' ORDER BY pos) || repeat(',9', 16) AS vals FROM dense GROUP BY cell_id")
def omx14(spark, d):
    n = n_positions(spark, d)
    return O.densify_text(O.bin_per_cell(kept(spark, d), 8), n, pad=9, length=n + 16).select("cell_id", F.col("values").alias("vals"))


def small_cells(spark, d):
    return X.table(spark, d, "customer").select(F.col("c_custkey").alias("cell_id"), F.array(F.col("c_custkey") % 7, F.col("c_nationkey").cast("long")).alias("values"))


CELLS = "c AS (SELECT c_custkey AS cell_id, CAST(c_custkey % 7 AS VARCHAR) || ',' || CAST(c_nationkey AS VARCHAR) AS vals, row_number() OVER (ORDER BY c_custkey) - 1 AS rn, count(*) OVER () AS n FROM customer)"


@query("omx15_bag_cells", f"WITH {CELLS} SELECT rn // 16 AS bag_id, string_agg(CAST(cell_id AS VARCHAR), ',' ORDER BY rn) AS cells, string_agg(vals, ',' ORDER BY rn) AS vals FROM c GROUP BY 1 HAVING count(*) = 16")
def omx15(spark, d):
    return O.bag_cells(small_cells(spark, d), 16).select("bag_id", csv(F.col("cell_ids")).alias("cells"), csv(F.col("values")).alias("vals"))


@query("omx16_batches", f"WITH {CELLS} SELECT cell_id, rn // 100 AS batch FROM c")
def omx16(spark, d):
    return O.batch_rows(small_cells(spark, d), "cell_id", 100).select("cell_id", "batch")


@query("omx17_epochs", f"WITH {CELLS}, e AS (SELECT cell_id, rn + epoch * n AS rn FROM c, range(0, 2) t(epoch)) SELECT rn // 16 AS bag_id, string_agg(CAST(cell_id AS VARCHAR), ',' ORDER BY rn) AS cells FROM e GROUP BY 1 HAVING count(*) = 16")
def omx17(spark, d):
    return O.bag_cells(small_cells(spark, d), 16, epochs=2).select("bag_id", csv(F.col("cell_ids")).alias("cells"))


@query("omx18_spatial", """WITH t AS (SELECT c_custkey AS cell_id, c_acctbal AS x, CAST(c_custkey AS DOUBLE) AS y, s FROM customer, range(0, 4) r(s)),
    u AS (SELECT cell_id, s, x, y, 1.0::DOUBLE * power(10.0::DOUBLE, (1.0::DOUBLE + 9.0::DOUBLE * s / 3) / 3) AS c FROM t)
    SELECT cell_id, s AS scale, round(cos(x / c), 6) + 0.0 AS cos_x, round(sin(y / c), 6) + 0.0 AS sin_y FROM u""")
def omx18(spark, d):
    rows = X.table(spark, d, "customer").select(F.col("c_custkey").alias("cell_id"), spatial_features(F.col("c_acctbal"), F.col("c_custkey").cast("double"), 1.0, 10.0, 4).alias("f"))
    long = rows.select("cell_id", "f", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("scale"))
    at = lambda i: F.round(F.get("f", (2 * F.col("scale") + i).cast("int")), 6)
    return long.select("cell_id", "scale", at(0).alias("cos_x"), at(1).alias("sin_y"))
