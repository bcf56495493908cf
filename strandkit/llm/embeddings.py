"""Near-duplicate vectors by sorted passes over random projections."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandkit.llm.common import checkpoint, connected_components, consecutive_groups, join_counted, labels_of_links, map_batches


def _matrix(column) -> np.ndarray:
    """Unit rows in double precision from a column of equally long arrays."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _keys(unit: np.ndarray, number: int, seed: int) -> np.ndarray:
    """64 sign hashes of each row, concatenated to one number; another set for each pass."""
    planes = np.random.Generator(np.random.PCG64([seed, number, unit.shape[1]])).standard_normal((unit.shape[1], 64))
    return np.packbits(unit @ planes > 0, axis=1).view(">u8")[:, 0].astype(np.uint64) ^ np.uint64(1 << 63)  # ordered as signed


#: Share of isolated pairs at the threshold that the passes may miss.
MISS = 0.001


def centres(vectors: DataFrame, threshold: float, passes: int, window: int) -> DataFrame:
    """Rows (label, dim, centre, passes, exact): the mean of the unit vectors of a label, and how many passes it needs.

    Keys are taken about the centre, so a direction that all vectors share doesn't make them alike. Two vectors at the
    threshold differ by sqrt(2 - 2 threshold); seen from the centre, at whose distance s = sqrt(1 - |centre|^2) they lie,
    that is an angle of 2 arcsin(difference / 2s), and angle / pi is the share of sign bits that differ. They are neighbours
    in a pass if they agree in the first log2(n / window) bits. So many passes are made, at least those given, that a
    pair is missed with probability MISS. A label that needs more than n / window, with which as many pairs are compared as
    there are, is exact: its pairs are all compared in blocks instead.
    """
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    long = vectors.select("label", F.size("v").alias("dim"), "v", size.alias("norm")).select("label", "dim", "norm", F.posexplode("v").alias("pos", "x"))
    means = long.groupBy("label", "dim", "pos").agg(F.avg(F.col("x").cast("double") / F.col("norm")).alias("mean"), F.count("*").alias("n"))
    whole = means.groupBy("label", "dim").agg(F.sort_array(F.collect_list(F.struct("pos", "mean"))).alias("parts"), F.max("n").alias("n"))
    centre = F.transform("parts", lambda s: s["mean"])
    inside = F.aggregate("parts", F.lit(0.0), lambda a, s: a + s["mean"] * s["mean"])
    half = F.lit(float(np.sqrt(2 - 2 * threshold) / 2)) / F.sqrt(F.greatest(1 - inside, F.lit(1e-12)))
    differ = F.least(2 * F.asin(F.least(half, F.lit(1.0))) / float(np.pi), F.lit(0.5))
    met = F.pow(1 - differ, F.log2(F.greatest(F.col("n") / window, F.lit(2.0))))
    wanted = F.ceil(F.lit(float(np.log(MISS))) / F.log1p(-F.least(met, F.lit(1 - 1e-9))))
    needed = F.greatest(wanted, F.lit(passes))
    exact = needed > F.greatest(F.ceil(F.col("n") / window), F.lit(passes))
    return whole.select("label", "dim", centre.alias("centre"), F.when(exact, 0).otherwise(needed).cast("int").alias("passes"), exact.alias("exact"))


def labelled(vectors: DataFrame) -> DataFrame:
    return vectors.select("rep", F.col("label").cast("string").alias("label"), "v", F.size("v").alias("dim"))


def projected(vectors: DataFrame, about: DataFrame, seed: int) -> DataFrame:
    """Rows (pass, label, dim, key, rep) of vectors(rep, label, v, m), with the centres and passes about labels."""

    def run(batch):
        out = []
        lengths = np.diff(batch.column(2).offsets.to_numpy())
        for dim in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == dim)
            own = batch.take(pa.array(at))
            about = _matrix(own.column(2)) - own.column(3).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)
            n_passes = own.column(4).to_numpy()
            for number in range(int(n_passes.max())):
                rows = np.flatnonzero(n_passes > number)
                part = own.take(pa.array(rows))
                out.append((np.full(len(rows), number, np.int32), part.column(1), np.full(len(rows), dim, np.int32), _keys(about[rows], number, seed).view(np.int64), part.column(0)))
        columns = [pa.concat_arrays([pa.array(x[i]) for x in out]) for i in range(5)]
        return pa.RecordBatch.from_arrays(columns, names=["pass", "label", "dim", "key", "rep"])

    rows = labelled(vectors).join(about.where("not exact"), ["label", "dim"]).select("rep", "label", "v", "centre", "passes")
    return map_batches(rows, run, "pass int, label string, dim int, key long, rep long", rows=4096)


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with rank, their place in the given order, from 0: a range sort, then one offset per partition."""

    def run(batches):
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))], names=[*batch.schema.names, "part", "at"])
            at += n

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    n_parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = checkpoint(rows.repartitionByRange(n_parts, *order).sortWithinPartitions(*order).mapInArrow(run, f"{schema}, part int, at long"))
    sizes, before, offsets = dict(placed.groupBy("part").count().collect()), 0, []  # one number per partition
    for part in sorted(sizes):
        offsets.append((part, before))
        before += sizes[part]
    offsets = rows.sparkSession.createDataFrame(offsets, "part int, before long")
    return placed.join(F.broadcast(offsets), "part").withColumn("rank", F.col("before") + F.col("at")).drop("part", "at", "before")


def neighbour_links(vectors: DataFrame, about: DataFrame, threshold: float, window: int, block: int, seed: int) -> DataFrame:
    """Links (src, dst) that span what the passes find among vectors of the same label and length.

    A block has the vectors of so many ranks and, so that no window is cut, the last ones of the block before.
    """
    placed = ranked(projected(vectors, about, seed), ["pass", "label", "dim", "key", "rep"])
    own = F.floor(F.col("rank") / block)
    halo = F.when(F.col("rank") % block >= block - window, F.array(own, own + 1)).otherwise(F.array(own))
    rows = placed.withColumn("block", F.explode(halo)).join(vectors.select("rep", "v"), "rep")
    rows = rows.repartition("block").sortWithinPartitions("block", "rank").select("block", "pass", F.xxhash64("label", "dim", "pass").alias("kind"), "rank", "rep", "v")

    def run(batches):
        for group in consecutive_groups(batches):
            kind, rank = group.column(2).to_numpy(), group.column(3).to_numpy()
            first = group.column(0)[0].as_py() * block
            a, b = [], []
            for value in np.unique(kind):
                at = np.flatnonzero(kind == value)
                unit = _matrix(group.take(pa.array(at)).column(5))
                for step in range(1, min(window, len(at) - 1) + 1):
                    near = np.flatnonzero(np.einsum("ij,ij->i", unit[:-step], unit[step:]) >= threshold)
                    near = near[rank[at[near + step]] >= first]
                    a.append(at[near])
                    b.append(at[near + step])
            a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
            label, rep = labels_of_links(a, b, group.num_rows), group.column(4).to_numpy()
            differ = label != np.arange(len(label))
            yield pa.RecordBatch.from_arrays([pa.array(rep[differ]), pa.array(rep[label[differ]])], names=["src", "dst"])

    return rows.mapInArrow(run, "src long, dst long")


def in_pairs_of_blocks(members: DataFrame, block: int) -> DataFrame:
    """members(component, rep, v, m) dealt out so that any two of a component meet: sorted runs (group, component, low, high) of a pair of blocks.

    A large component is dealt into blocks of members by a hash, and each pair of blocks is compared by itself, so
    neither a task nor a row count grows with a component's square.
    """
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    placed = members.join(sizes, "component").withColumn("own", own)
    every = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(F.least(i, F.col("own")).alias("low"), F.greatest(i, F.col("own")).alias("high")))
    rows = placed.withColumn("pair", F.explode(every)).select("component", "pair", "own", "rep", "m", "v", F.xxhash64("component", "pair").alias("group"))
    return rows.repartition("component", "pair").sortWithinPartitions("group", "component", "pair", "rep").select("group", "component", F.col("pair.low").alias("low"), F.col("pair.high").alias("high"), "own", "rep", "m", "v")


def exact_links(members: DataFrame, threshold: float, block: int) -> DataFrame:
    """Links (src, dst) that span all pairs of members(component, rep, v, m) within the threshold, compared in pairs of blocks."""

    def run(batches):
        for group in consecutive_groups(batches, 4):
            own, rep, unit = group.column(4).to_numpy(), group.column(5).to_numpy(), _matrix(group.column(7))
            low, high = group.column(2)[0].as_py(), group.column(3)[0].as_py()
            rows, columns = np.flatnonzero(own == low), np.flatnonzero(own == high)
            a, b = np.nonzero(unit[rows] @ unit[columns].T >= threshold)
            label = labels_of_links(rows[a], columns[b], len(rep))
            differ = label != np.arange(len(label))
            yield pa.RecordBatch.from_arrays([pa.array(rep[differ]), pa.array(rep[label[differ]])], names=["src", "dst"])

    return in_pairs_of_blocks(members, block).mapInArrow(run, "src long, dst long")


def count_links(members: DataFrame, threshold: float, block: int) -> DataFrame:
    """Rows (rep, linked): for members(component, rep, v, m), the copies of others in the component within the threshold."""
    rows = in_pairs_of_blocks(members, block)

    def run(batches):
        for group in consecutive_groups(batches, 4):
            low, high = group.column(2)[0].as_py(), group.column(3)[0].as_py()
            own, rep, m = (group.column(i).to_numpy() for i in (4, 5, 6))
            unit = _matrix(group.column(7))
            if low == high:
                near = unit @ unit.T >= threshold
                np.fill_diagonal(near, False)
                total = near @ m
            else:
                a, b = own == low, own == high
                near = unit[a] @ unit[b].T >= threshold
                total = np.zeros(len(rep), np.int64)
                total[a], total[b] = near @ m[b], near.T @ m[a]
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(total.astype(np.int64))], names=["rep", "linked"])

    return rows.mapInArrow(run, "rep long, linked long").groupBy("rep").agg(F.sum("linked").alias("linked"))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, passes: int = 16, window: int = 64, block: int = 1024, seed: int = 7) -> DataFrame:
    """Vectors with the number of others of the same label and length that have at least this cosine, and their group.

    Equal vectors of a label are one class, compared once. Classes are sorted by 64 sign hashes of random projections about
    the label's centre, anew in each pass, and compared with the next `window` classes; verified pairs of all passes are
    united. passes is the least number; a label gets more if it has so many vectors, or vectors so close together, that the
    windows would else miss more than one in a thousand pairs at the threshold; one for which even that would be as much as
    comparing all pairs has them compared in blocks. Within the groups found so, all pairs are
    then verified in double precision, so the counts of dense groups don't depend on the window. A pair can only be
    missed if no chain of found pairs joins it.

    Returns the id, n_links, component_id (the smallest id in the group) and kept (it is the id itself). Null and zero
    vectors, those with a null or non-finite component, and null labels are linked with nothing. Null ids
    never name a group unless all ids in it are null; repeated rows are kept and linked to each other; an empty table
    gives no rows; other columns are not read.
    """
    v = F.col(vector_col)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    usable = F.col(label_col).isNotNull() & F.coalesce(F.forall(v, finite) & F.exists(v, lambda x: x != 0), F.lit(False))
    base = vectors.select(F.col(id_col).alias("id"), v.alias("v"), F.col(label_col).alias("label"), usable.alias("usable"))
    usable = base.where("usable").withColumn("class", F.sha2(F.concat_ws("|", F.col("label").cast("string"), F.array_join("v", ",")), 256))
    classes = usable.groupBy("class").agg(F.min("id").alias("low"), F.count("*").alias("m"), F.first("v").alias("v"), F.first("label").alias("label"))
    classes = checkpoint(classes.withColumn("rep", F.monotonically_increasing_id()))  # a number of its own, fixed by the checkpoint
    about = checkpoint(centres(labelled(classes), threshold, passes, window).withColumn("number", F.monotonically_increasing_id()))
    edges = neighbour_links(classes, about, threshold, window, block, seed)
    if about.where("exact").limit(1).count():
        members = labelled(classes).join(about.where("exact"), ["label", "dim"]).select(F.col("number").alias("component"), "rep", "v", F.lit(1).cast("long").alias("m"))
        edges = edges.unionByName(exact_links(members, threshold, block))
    linked = connected_components(edges)
    members = checkpoint(classes.join(linked.withColumnRenamed("node", "rep"), "rep"))
    counts = count_links(members.select("component", "rep", "v", "m"), threshold, block)
    lowest = members.groupBy("component").agg(F.min("low").alias("lowest"))
    of_class = members.select("class", "rep", "component").join(counts, "rep").join(lowest, "component").select("class", "linked", "lowest")
    of_class = classes.select("class", "low", "m").join(of_class, "class", "left")
    of_class = checkpoint(of_class.select("class", "m", (F.coalesce("linked", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.least("low", "lowest").alias("component_id")))
    total = of_class.agg(F.sum("m")).first()[0] or 0
    found = join_counted(usable.select("id", "class"), of_class, "class", "m", total).select("id", "n_links", "component_id")
    out = found.unionByName(base.where("not usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"), F.col("id").eqNullSafe(F.coalesce("component_id", "id")).alias("kept"))
