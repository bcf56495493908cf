"""Genome tiles, windows over them, and tracks along them."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandkit.functions.arrays import dense
from strandkit.functions.sequence import sanitize_dna
from strandkit.operators.numbering import running_sums


def tile_genome(records: DataFrame, tile: int, name: str = "name", seq: str = "seq") -> DataFrame:
    """Records cut into tiles (chrom, tile_no, seq) in one pass; one without letters has an empty tile.

    For records that fit in a row. Chromosomes are better read in tiles to begin with (sources.fasta.read_fasta_tiles).
    """
    pieces = F.regexp_extract_all(seq, F.lit(f"(?s)(.{{1,{tile}}})"), 1)
    cut = records.select(F.col(name).alias("chrom"), F.posexplode(F.when(F.length(seq) > 0, pieces).otherwise(F.array(F.lit("")))).alias("tile_no", "seq"))
    return cut.select("chrom", F.col("tile_no").cast("long").alias("tile_no"), "seq")


#: Tiles of a block: those of a window are mostly in one.
BLOCK_TILES = 64


def save_tiles(tiles: DataFrame, table: str, buckets: int, path: str | None = None) -> None:
    """Keep tiles as a table bucketed by chromosome and block of BLOCK_TILES tiles, so that fetching windows doesn't shuffle the genome.

    One shuffle deals each bucket to one task, which writes one file. path names the table's folder, if it isn't to be in the warehouse.
    """
    blocked = tiles.withColumn("block", _block(F.col("tile_no")))
    writer = blocked.repartition(buckets, "chrom", "block").write.format("parquet").bucketBy(buckets, "chrom", "block").sortBy("chrom", "block")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def _block(tile_no: Column) -> Column:
    return F.floor(tile_no / BLOCK_TILES)


def fetch_windows(tiles: DataFrame, windows: DataFrame, tile: int, sanitize: bool = True) -> DataFrame:
    """(window_id, chrom, start, end, seq, complete) of windows [start, end); complete if the chromosome covers it all.

    A window is joined to the blocks of tiles that it touches by chromosome and block, an equi-join, and cut from the block's tiles there; so a window is a row
    a block, mostly one, not a row a tile, and its pieces are put together in order. A window past the end gets what there is; one that ends
    where it starts, or before, is empty and complete.
    """
    whole = tile * BLOCK_TILES
    first = F.floor(F.col("start") / whole)
    last = F.greatest(first, F.floor((F.col("end") - 1) / whole))
    touched = windows.select("window_id", "chrom", "start", "end", F.explode(F.sequence(first, last)).alias("block"))
    held = tiles if "block" in tiles.columns else tiles.withColumn("block", _block(F.col("tile_no")))
    blocks = held.groupBy("chrom", "block").agg(F.sort_array(F.collect_list(F.struct("tile_no", "seq"))).alias("tiles"))
    own = F.filter("tiles", lambda t: ((t["tile_no"] + 1) * tile > F.col("start")) & (t["tile_no"] * tile < F.col("end")))

    def cut(t):
        begin, stop = F.greatest(F.col("start"), t["tile_no"] * tile), F.least(F.col("end"), (t["tile_no"] + 1) * tile)
        return F.substring(t["seq"], (begin - t["tile_no"] * tile + 1).cast("int"), F.greatest(stop - begin, F.lit(0)).cast("int"))

    piece = F.array_join(F.transform(own, cut), "")
    pieces = touched.join(blocks, ["chrom", "block"], "left").withColumn("piece", F.coalesce(piece, F.lit(""))).drop("tiles")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "piece"))), lambda s: s["piece"]), "")
    out = pieces.groupBy("window_id", "chrom", "start", "end").agg(joined.alias("seq"))
    return out.select("window_id", "chrom", "start", "end", (sanitize_dna(F.col("seq")) if sanitize else F.col("seq")).alias("seq"), (F.length("seq") == F.greatest(F.col("end") - F.col("start"), F.lit(0))).alias("complete"))


def select_tracks(tracks: DataFrame, species_tracks: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of tracks for wanted(species, track), and the wanted ones that the species lacks."""
    available = wanted.join(species_tracks.select("species", "track"), ["species", "track"], "left_semi")
    return tracks.join(available, ["species", "track"]), wanted.join(species_tracks, ["species", "track"], "left_anti")


def align_tracks(species_tracks: DataFrame) -> DataFrame:
    """(species, names, padding): each species' tracks in order and how many zero tracks fill it up to the widest."""
    names = species_tracks.groupBy("species").agg(F.sort_array(F.collect_list("track")).alias("names"))
    widest = names.agg(F.max(F.size("names")).alias("widest"))
    return names.join(F.broadcast(widest)).select("species", "names", (F.col("widest") - F.size("names")).alias("padding"))


def pick_tracks(outputs: DataFrame, rows: DataFrame, species_tracks: DataFrame, key: str = "row", value: str = "value") -> DataFrame:
    """(key, species, values): of all heads' outputs(key, species, track, value) those of the row's own species.

    Values are in the order of the species' tracks, zero where there is no output, with zeros up to the widest species. Of a track
    that a row has twice the greatest value counts. Outputs are joined to the places of their tracks, and a row's are put in order once, so a row's
    work grows with its tracks. A row of rows(key, species) whose species has no tracks has zeros only; a null species has none of them.
    """
    aligned = align_tracks(species_tracks)
    widest = aligned.agg(F.coalesce(F.max(F.size("names") + F.col("padding")), F.lit(0)).alias("widest"))
    places = aligned.select("species", F.posexplode("names").alias("pos", "track"))
    placed = outputs.join(places, ["species", "track"]).select(key, "species", "pos", F.col(value).cast("double").alias("value"))
    entries = F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce("value", F.lit(0.0)).alias("value"))))
    own = rows.join(placed, [key, "species"], "left").groupBy(key, "species").agg(entries.alias("entries"))
    return own.join(F.broadcast(widest)).select(key, "species", dense(F.col("entries"), F.col("widest"), F.lit(0.0)).alias("values"))


def encode_species(df: DataFrame, species: DataFrame, on_error: str = "raise") -> DataFrame:
    """df with token_id of its species; an unknown one is an error, or null."""
    joined = df.join(species.select("species", F.col("token_id").alias("__id")), "species", "left")
    missing = F.raise_error(F.lit("unknown species")).cast("int") if on_error == "raise" else F.lit(None).cast("int")
    return joined.withColumn("token_id", F.coalesce("__id", missing)).drop("__id")


def list_species(species: DataFrame) -> DataFrame:
    """Names of species, without specials, sorted."""
    return species.where("species not like '<%>'").select("species").distinct().orderBy("species")


def species_head(df: DataFrame, reserved: int = 6, on_error: str = "raise") -> DataFrame:
    """df with head, the number of its species' head; a reserved id is an error, or the row goes if on_error is `filter`."""
    if on_error == "filter":
        return df.where(F.col("token_id") >= reserved).withColumn("head", F.col("token_id") - reserved)
    head = F.when(F.col("token_id") >= reserved, F.col("token_id") - reserved).otherwise(F.raise_error(F.lit("reserved species id")).cast("int"))
    return df.withColumn("head", head)


def value_range(df: DataFrame, value: str, low: float, high: float, by: list[str], exact: bool = True) -> DataFrame:
    """(by, low, high): two percentiles of the values per group, interpolated between the two values around their rank; null without any value.

    Equal values are counted first, so a frequent one is one row; running counts, by ranges of the values, tell each value's
    ranks; and the four values wanted of a group are picked by them. No group is held in one task. Unless exact, percentiles come
    from sketches in one pass: values of the data whose rank is off by a ten-thousandth of the group at most.
    """
    if not exact:
        return df.groupBy(*by).agg(F.percentile_approx(value, F.lit(low)).alias("low"), F.percentile_approx(value, F.lit(high)).alias("high"))
    counted = df.groupBy(*by, F.col(value).alias("__value")).agg(F.count(F.col(value)).alias("__n"))
    ranked = running_sums(counted, ["__value"], "__n", "__until", by)  # values with ranks from until - n to until - 1
    totals = counted.groupBy(*by).agg(F.sum("__n").alias("__total"))
    same = [ranked[c].eqNullSafe(totals[c]) for c in by]
    joined = (ranked.join(totals, reduce(and_, same)) if same else ranked.join(F.broadcast(totals))).select(*[ranked[c] for c in by], "__value", "__n", "__until", "__total")
    picks, out = [], []
    for name, q in (("low", low), ("high", high)):
        rank = (F.col("__total") - 1) * F.lit(q)
        at = lambda r: F.max(F.when((F.col("__until") > r) & (F.col("__until") - F.col("__n") <= r), F.col("__value"))).cast("double")
        picks += [at(F.floor(rank)).alias(f"__{name}"), at(F.ceil(rank)).alias(f"__{name}_next"), F.max(rank - F.floor(rank)).alias(f"__{name}_part")]
        out.append((F.col(f"__{name}") + F.col(f"__{name}_part") * (F.col(f"__{name}_next") - F.col(f"__{name}"))).alias(name))
    return joined.groupBy(*by).agg(*picks).select(*by, *out)


def pack_tracks(points: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """One array of values per group, in order."""
    return points.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct(*order, value))), lambda s: s[value]).alias("values"))
