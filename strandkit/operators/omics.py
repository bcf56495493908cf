"""Bulk expression and single-cell counts: normalizing, binning, pairing, mapping, packing and bagging."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandkit.functions.arrays import dense, dense_text
from strandkit.functions.tokens import pad_to
from strandkit.operators.numbering import number_rows


def log_normalize(x: Column) -> Column:
    return F.log10(1 + x)


def max_normalize(x: Column, factor: float, on: bool = True) -> Column:
    return x / factor if on else x


def edges(low: float, high: float, n: int) -> list[float]:
    """n edges from low to high, evenly spaced."""
    step = (high - low) / (n - 1)
    return [low + i * step for i in range(n - 1)] + [high]


def _near(x: Column, low: Column, step: Column, n: Column) -> Column:
    """The number of edges up to x by division, which is rounded and so may be one off."""
    near = F.when(step > 0, F.floor((x - low) / F.when(step > 0, step))).otherwise(F.when(x >= low, n).otherwise(0))
    return F.greatest(F.lit(0), F.least(near + 1, n.cast("long")))


def _edge(i: Column, low: Column, step: Column, last: Column, n: Column) -> Column:
    return F.when(i >= n - 1, last).otherwise(low + i * step)


def _put_right(x: Column, near: Column, below: Column, above: Column, last: Column, n: Column) -> Column:
    """near, or its neighbour, by the edges below and above; edges ascend, so at most one of the two steps is taken, and they are added up."""
    down = F.when((near > 0) & (below > x), -1).otherwise(0)
    up = F.when((near < n) & (above <= x), 1).otherwise(0)
    return F.when(F.isnan(x) | (x >= last), n).otherwise(near + down + up).cast("int")


def count_edges(x: Column, low: Column, step: Column, last: Column, n: Column) -> Column:
    """How many of n edges low, low + step, ... up to the last one, which is given, are at most x.

    The step that x falls into tells, and is put right by looking at the edges next to it, as divisions are rounded; so
    the work doesn't grow with n. NaN is above all edges; null stays null.
    """
    near = _near(x, low, step, n)
    return _put_right(x, near, _edge(near - 1, low, step, last, n), _edge(near, low, step, last, n), last, n)


def with_edges_counted(df: DataFrame, name: str, x: Column, low: Column, step: Column, last: Column, n: Column) -> DataFrame:
    """df with count_edges as a column, in steps: where all but n vary by row one expression is too long a method for the JVM to compile."""
    steps = df.withColumns({"__x": x, "__low": low, "__step": step, "__last": last}).withColumn("__near", _near(F.col("__x"), F.col("__low"), F.col("__step"), n))
    at = lambda i: _edge(i, F.col("__low"), F.col("__step"), F.col("__last"), n)
    steps = steps.withColumns({"__below": at(F.col("__near") - 1), "__above": at(F.col("__near"))})
    found = _put_right(F.col("__x"), F.col("__near"), F.col("__below"), F.col("__above"), F.col("__last"), n)
    return steps.withColumn(name, found).drop("__x", "__low", "__step", "__last", "__near", "__below", "__above")


def bin_fixed(x: Column, low: float, high: float, n: int, clip: bool = False) -> Column:
    """Number of the n edges from low to high up to x; 0 for exactly 0. At or above high it is n, or n - 1 with clip. Null stays null."""
    found = count_edges(x, F.lit(float(low)), F.lit((high - low) / (n - 1)), F.lit(float(high)), F.lit(n))
    found = F.least(found, F.lit(n - 1)) if clip else found
    return F.when(x == 0, 0).when(x.isNotNull(), found)


def padded_length(n: int, n_halvings: int) -> int:
    """The nearest upper multiple of 2^n_halvings."""
    return math.ceil(n / 2**n_halvings) * 2**n_halvings


def pad_omics(ids: Column, n: int, n_halvings: int, pad: int, cls: int | None = None) -> Column:
    """Ids, after cls, padded to the length for n of them."""
    ids = ids if cls is None else F.concat(F.array(F.lit(cls)), ids)
    return pad_to(ids, padded_length(n + (cls is not None), n_halvings), F.lit(pad))


def fill_missing_modality(ids: Column, n: int, mask: int) -> Column:
    return F.coalesce(ids, F.array_repeat(F.lit(mask), n))


def pack_genes(expr: DataFrame, genes: DataFrame, by: list[str]) -> DataFrame:
    """(by, values, complete): expression in the order of genes(gene, gene_pos), zero where a sample lacks the gene.

    Of a gene given twice the greatest value counts. complete tells whether the sample had all genes. The pairs are collected per sample, as many as there are genes.
    """
    n = genes.agg(F.count("*").alias("n_genes"))
    got = expr.join(genes.select("gene", "gene_pos"), "gene").groupBy(*by).agg(F.collect_list(F.struct(F.col("gene_pos").alias("pos"), "value")).alias("entries"))
    return got.join(F.broadcast(n)).select(*by, dense(F.col("entries"), F.col("n_genes"), F.lit(0.0)).alias("values"), (F.size(F.array_distinct(F.transform("entries", lambda x: x["pos"]))) == F.col("n_genes")).alias("complete"))


def tokenize_omics(expr: DataFrame, settings: DataFrame) -> DataFrame:
    """expr with bin, by settings(omic, low, high, n_bins, factor, log) of its modality.

    Settings are a row a modality, and are broadcast: dealt by modality, all values would be one task for each.
    """
    joined = expr.join(F.broadcast(settings), "omic")
    x = F.when(F.col("log"), F.log10(1 + F.col("value"))).otherwise(F.col("value")) / F.col("factor")
    joined = joined.withColumn("x", x)
    step = (F.col("high") - F.col("low")) / (F.col("n_bins") - 1)
    counted = with_edges_counted(joined, "__bin", F.col("x"), F.col("low"), step, F.col("high"), F.col("n_bins"))
    return counted.withColumn("bin", F.when(F.col("x") == 0, 0).when(F.col("x").isNull(), 0).otherwise(F.col("__bin"))).drop("__bin", "low", "high", "n_bins", "factor", "log")


def pair_omics(first: DataFrame, second: DataFrame, key: str, names: tuple[str, str]) -> DataFrame:
    """Samples of either modality, with null where one is missing. Inputs are (key, values)."""
    a = first.select(key, F.col("values").alias(names[0]))
    b = second.select(key, F.col("values").alias(names[1]))
    return a.join(b, key, "full_outer")


def map_genes(var: DataFrame, vocab: DataFrame, coding: DataFrame) -> DataFrame:
    """var(gene_idx, gene_id) with pos: gene id to vocabulary index to coding position; -1 if either lacks it."""
    through = var.join(vocab.select("gene_id", "vocab_idx"), "gene_id", "left").join(coding.select("vocab_idx", "pos"), "vocab_idx", "left")
    return through.select("gene_idx", "gene_id", F.coalesce("pos", F.lit(-1)).alias("pos"))


def expressed(counts: DataFrame) -> DataFrame:
    return counts.where("value > 0")


def keep_mapped(counts: DataFrame, mapping: DataFrame) -> DataFrame:
    """Entries of mapped genes, with their position. Cells without any vanish."""
    return counts.join(mapping.where("pos <> -1").select("gene_idx", "pos"), "gene_idx")


def cells_dropped(counts: DataFrame, kept: DataFrame) -> DataFrame:
    return counts.select("cell_id").distinct().join(kept.select("cell_id").distinct(), "cell_id", "left_anti")


def cell_edges(low: Column, high: Column, n: int) -> Column:
    """n edges from a cell's least to its greatest value, the last 0.01 higher; two around the value of a constant cell."""
    step = (high - low) / (n - 1)
    grid = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == n - 1, high + 0.01).otherwise(low + i * step))
    return F.when(low == high, F.array(low - 0.1, high + 0.1)).otherwise(grid)


def bin_per_cell(counts: DataFrame, n: int) -> DataFrame:
    """counts with bin: how many of the cell_edges are up to the value, counted without making them; 1 in a constant cell.

    The extremes are aggregated, with partial results before the shuffle, and joined back; no cell is one group.
    """
    extremes = counts.groupBy("cell_id").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    joined = counts.join(extremes, "cell_id")
    counted = with_edges_counted(joined, "__bin", F.col("value"), F.col("low"), (F.col("high") - F.col("low")) / (n - 1), F.col("high") + 0.01, F.lit(n))
    return counted.withColumn("bin", F.when(F.col("low") == F.col("high"), 1).otherwise(F.col("__bin"))).drop("__bin", "low", "high")


def _entries(binned: DataFrame, value: str) -> DataFrame:
    """(cell_id, entries): a cell's values by position, of genes at the same one that of the last."""
    last = binned.groupBy("cell_id", "pos").agg(F.max_by(value, "gene_idx").alias("value"))
    return last.groupBy("cell_id").agg(F.collect_list(F.struct("pos", "value")).alias("entries"))


def densify(binned: DataFrame, n_genes: int, value: str = "bin", pad: int | None = None, length: int | None = None) -> DataFrame:
    """(cell_id, values): a dense vector per cell; of genes at the same position the last one holds; zero elsewhere."""
    packed = _entries(binned, value)
    values = dense(F.col("entries"), F.lit(n_genes), F.lit(0))
    return packed.select("cell_id", (values if pad is None else pad_to(values, length, F.lit(pad))).alias("values"))


def densify_text(binned: DataFrame, n_genes: int, value: str = "bin", pad: int | None = None, length: int | None = None) -> DataFrame:
    """(cell_id, values): the vectors of densify as comma-joined text, for writing. Of cells times genes only the text grows, no array or object."""
    after = None if pad is None else (str(pad), F.lit(max(length - n_genes, 0)))
    return _entries(binned, value).select("cell_id", dense_text(F.col("entries"), F.lit(n_genes), "0", after).alias("values"))


def batch_rows(df: DataFrame, key: str, n: int, name: str = "batch") -> DataFrame:
    """df with the number of its batch of n rows, in the order of the key."""
    return number_rows(df, [key], "__rn").withColumn(name, F.floor(F.col("__rn") / n)).drop("__rn")


def repeat_epochs(df: DataFrame, n: int) -> DataFrame:
    """All rows once per epoch."""
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def bag_cells(cells: DataFrame, num_cells: int, epochs: int = 1) -> DataFrame:
    """(bag_id, cell_ids, values): num_cells consecutive cells of (cell_id, values) each; an incomplete last bag is dropped.

    With several epochs the cells are cycled through, so a bag may hold the end of one and the start of the next.
    """
    n = cells.agg(F.count("*").alias("n_cells"))
    numbered = repeat_epochs(number_rows(cells, ["cell_id"], "rn"), epochs).join(F.broadcast(n)).withColumn("rn", F.col("rn") + F.col("epoch") * F.col("n_cells"))
    bags = numbered.withColumn("bag_id", F.floor(F.col("rn") / num_cells)).groupBy("bag_id").agg(F.sort_array(F.collect_list(F.struct("rn", "cell_id", "values"))).alias("x"))
    return bags.where(F.size("x") == num_cells).select("bag_id", F.transform("x", lambda s: s["cell_id"]).alias("cell_ids"), F.flatten(F.transform("x", lambda s: s["values"])).alias("values"))
