"""Readers, scans, sums and look-ups that must hold for large inputs, against plain versions."""

import gzip
import random
import re
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandkit.functions import batches
from strandkit.functions import outputs as P
from strandkit.functions import tokens as T
from strandkit.operators import genome, model_outputs, omics, scoring, vectors, vocab
from strandkit.sources import fasta
from strandkit.streaming import bags

# ---- FASTA ---------------------------------------------------------------------------------------------------------


def blocked(data: bytes, size: int) -> bytes:
    """A blocked gzip file."""
    out = b""
    for part in [*(data[i : i + size] for i in range(0, len(data), size)), b""]:
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        packed = c.compress(part) + c.flush()
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(packed) + 25) + packed + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def some_fasta(rng) -> tuple[list[tuple[str, str]], bytes]:
    records, body = [], "ACGT\n" if rng.random() < 0.1 else ""
    for k in range(rng.randint(1, 6)):
        seq = "".join(rng.choice("ACGTN") for _ in range(rng.choice([0, 0, 1, 5, 37, 100, 400])))
        width, end = rng.choice([7, 60, 10**9]), rng.choice(["\n", "\r\n"])
        records.append((f"r{k}", seq))
        body += f">r{k}" + rng.choice(["", " some text > here", "\ttab"]) + end + "".join(seq[i : i + width] + end for i in range(0, len(seq), width))
    return records, (body.rstrip("\n") if rng.random() < 0.3 else body).encode()


def tiles(records, tile):
    return sorted((name, i, seq[i * tile : (i + 1) * tile]) for name, seq in records for i in range(max(1, -(-len(seq) // tile))))


@pytest.mark.parametrize("packing", ["plain", "blocks", "gzip"])
def test_ranges_of_a_file_give_each_tile_once(tmp_path, packing):
    rng = random.Random(packing)
    for _ in range(25):
        records, body = some_fasta(rng)
        data = {"plain": body, "gzip": gzip.compress(body), "blocks": blocked(body, rng.choice([3, 20, 100]))}[packing]
        (tmp_path / "x").write_bytes(data)
        uri, n, tile, step = f"file://{tmp_path}/x", len(data), rng.choice([1, 10, 64, 1000]), rng.choice([17, 50, 200, 10**6])
        assert fasta._packing(uri) == packing
        name, offset, found = None, 0, []
        for start in [0] if packing == "gzip" else range(0, n, step):
            stop = n if packing == "gzip" else min(start + step, n)
            found += fasta._tiles_of({"file": uri, "packing": packing, "start": start, "stop": stop, "length": n, "name": name, "offset": offset}, tile)
            for header, letters, own in fasta.parsed(fasta._opened(uri, packing, start, stop, n)):
                if own and header is not None:
                    name, offset = fasta._named(header)[0], 0
                elif own and name is not None:
                    offset += len(letters)
        assert sorted(found) == tiles(records, tile)


def test_read_fasta_tiles_of_several_files(spark, tmp_path):
    rng = random.Random(3)
    want = []
    for i, pack in enumerate((bytes, lambda b: blocked(b, 50), gzip.compress)):
        records, body = some_fasta(rng)
        (tmp_path / f"{i}.fa").write_bytes(pack(body.replace(b">r", f">f{i}r".encode())))
        want += [(f"f{i}{name}", no, seq) for name, no, seq in tiles(records, 30)]
    (tmp_path / "empty.fa").write_bytes(b"")
    found = fasta.read_fasta_tiles(spark, str(tmp_path), 30, range_bytes=100)
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_one_long_record_is_read_by_several_tasks_in_pieces(spark, tmp_path):
    unit = b"ACGTTGCA" * 7 + b"ACGT\n"  # lines of 60
    with open(tmp_path / "chr.fa", "wb") as f:
        f.write(b">chr1 long\n")
        for _ in range(50):
            f.write(unit * 16_667)
    letters = 60 * 16_667 * 50
    found = fasta.read_fasta_tiles(spark, str(tmp_path), 131_072, range_bytes=4 << 20).withColumn("task", F.spark_partition_id())
    got = found.agg(F.count("*").alias("n"), F.sum(F.length("seq")).alias("letters"), F.max(F.length("seq")).alias("longest"), F.countDistinct("tile_no").alias("tiles"), F.countDistinct("task").alias("tasks")).first()
    assert (got.n, got.letters, got.longest, got.tiles) == (-(-letters // 131_072), letters, 131_072, got.n) and got.tasks > 3
    assert "Exchange" not in found.select("seq")._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]


def test_tiling_a_record_takes_linear_time(spark):
    def seconds(n):
        records = spark.range(1).select(F.lit("c").alias("name"), F.repeat(F.lit("ACGTA"), n // 5).alias("seq"))
        began = time.time()
        assert genome.tile_genome(records, 512).agg(F.sum(F.length("seq"))).first()[0] == n
        return time.time() - began

    seconds(1_000_000)
    assert seconds(16_000_000) < 15  # cutting each tile from the start of the record took minutes


def test_windows_of_bucketed_tiles_do_not_shuffle_the_genome(spark, tmp_path):
    records = spark.range(40).select(F.concat(F.lit("c"), "id").alias("name"), F.repeat(F.lit("ACGTTGCAAC"), 500).alias("seq"))
    genome.save_tiles(genome.tile_genome(records, 512), "tiles_in_buckets", 8, str(tmp_path / "tiles"))
    windows = spark.range(300).select(F.col("id").alias("window_id"), F.concat(F.lit("c"), F.col("id") % 41).alias("chrom"), (F.col("id") * 17).alias("start"), (F.col("id") * 17 + F.col("id") % 1500).alias("end"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = genome.fetch_windows(spark.table("tiles_in_buckets"), windows, 512)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2, plan  # windows to buckets, pieces to windows
        for r in found.collect():
            whole = "ACGTTGCAAC" * 500 if r.chrom != "c40" else ""
            assert r.seq == whole[r.start : r.end] and r.complete == (len(r.seq) == r.end - r.start)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE tiles_in_buckets")


# ---- tokens --------------------------------------------------------------------------------------------------------


def plain_tokens(text, vocabulary, boundaries):
    edge = r"\b" if boundaries else ""
    pattern = "|".join(f"{edge}{re.escape(t)}{edge}" for t in vocabulary) + r"|\S"
    return [t if t in vocabulary else "<unk>" for t in re.findall(pattern, text, re.ASCII)]


@pytest.mark.parametrize("boundaries", [False, True])
def test_the_tree_finds_what_the_alternation_finds(spark, boundaries):
    rng = random.Random(int(boundaries))
    for _ in range(12):
        vocabulary = list(dict.fromkeys("".join(rng.choice("ACG<m>-.[") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 25))))
        texts = ["".join(rng.choice("ACG<m>-.[ x") for _ in range(rng.randint(0, 30))) for _ in range(40)]
        df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.tokenize_regex(F.col("t"), vocabulary, boundaries).alias("found"))
        for r in df.collect():
            assert r.found == plain_tokens(r.t, vocabulary, boundaries), (vocabulary, r.t)


def test_the_whole_layout_is_one_short_pattern(spark):
    assert len(T.vocabulary_pattern(vocab.layout_tokens(6, "v2"))) < 400
    text = "ACGTACGTN <mask>AC-GGGGGGA"
    layouts = {k: vocab.layout_tokens(k, "v2") for k in (1, 6)}
    row = spark.createDataFrame([(text,)], "t string").select(*[T.tokenize_regex(F.col("t"), v).alias(f"k{k}") for k, v in layouts.items()]).first()
    for k, v in layouts.items():
        assert row[f"k{k}"] == plain_tokens(text, v, False)
    assert T.vocabulary_pattern([]) == "" and T.reachable(["A", "AC", "A"]) == ["A"] and T.reachable(["A", "AC"], True) == ["A", "AC"]


def test_position_ids_of_any_arrays(spark):
    rows = [([5, 6, 1, 1, 7, 1],), ([],), (None,), ([1, 1],), ([9],), ([3, None, 3],)]
    df = spark.createDataFrame(rows, "ids array<int>").coalesce(1)
    assert [r[0] for r in df.select(T.position_ids(F.col("ids"))).collect()] == [[2, 3, 1, 1, 4, 1], [], None, [1, 1], [2], [2, 1, 3]]
    long = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(9_999_999)), lambda i: F.when(i % 4 == 0, 1).otherwise(7)).alias("ids"))
    placed = long.select(T.position_ids(F.col("ids")).alias("p"))
    assert "Exchange" not in placed._jdf.queryExecution().executedPlan().toString()
    assert placed.select(F.array_max("p"), F.size("p"), F.get("p", F.lit(4)), F.get("p", F.lit(5))).first() == (7_500_001, 10_000_000, 1, 5)


def test_masked_rows_take_one_hash_a_position(spark):
    df = spark.range(200).select(F.col("id").alias("k"), F.transform(F.sequence(F.lit(0), F.lit(299)), lambda i: (i % 10).cast("int")).alias("ids"))
    rows = df.select("k", T.mlm_ids(F.col("k"), F.col("ids"), 5, 11, 6).alias("x"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1
    cells = rows.select(F.posexplode("x").alias("pos", "x")).select((F.col("pos") % 10).alias("was"), "x.id", "x.label")
    n, picked, masked, kept, specials = cells.agg(
        F.count_if(F.col("was") >= 6), F.count_if(F.col("label") >= 0), F.count_if((F.col("label") >= 0) & (F.col("id") == 2)), F.count_if((F.col("label") >= 0) & (F.col("id") == F.col("was"))), F.count_if((F.col("was") < 6) & ((F.col("label") >= 0) | (F.col("id") != F.col("was")))),
    ).first()
    assert abs(picked / n - 0.15) < 0.01 and abs(masked / picked - 0.8) < 0.03 and abs(kept / picked - 0.1) < 0.03 and specials == 0
    assert cells.where("label >= 0 and label <> was or id < 0 or id > 10").count() == 0


@pytest.mark.parametrize("k", [1, 3, 6])
def test_lookup_inside_arrays(spark, k):
    table = vocab.vocab_layout(spark, k, "v2")
    lookup = vocab.Lookup(table)
    rows = table.agg(F.sort_array(F.collect_list(F.struct("token_id", "token"))).alias("x")).select(F.col("x.token").alias("tokens"), F.col("x.token_id").alias("ids"))
    encoded = rows.select("tokens", "ids", lookup.ids(F.col("tokens")).alias("found"))
    assert encoded.where("found = ids").count() == 1
    if k > 1:
        assert encoded.select(lookup.tokens_of(F.col("found")).alias("t"), "tokens").where("t = tokens").count() == 1
    assert "Exchange" not in rows.limit(1).select(lookup.ids(F.col("tokens")))._jdf.queryExecution().executedPlan().toString().split("Aggregate")[0]
    odd = spark.createDataFrame([(["A", "nope", "", None],)], "tokens array<string>")
    assert odd.select(lookup.ids(F.col("tokens"), unk=0)).first()[0][1:3] == [0, 0]
    assert odd.select(lookup.ids(F.col("tokens"), on_error="null")).first()[0][1:] == [None, None, None]
    with pytest.raises(Exception, match="not in the vocabulary"):
        odd.select(lookup.ids(F.col("tokens"))).collect()
    with pytest.raises(ValueError):
        vocab.Lookup(table, most=5)


# ---- sums, percentiles, bins, tracks -------------------------------------------------------------------------------


def test_vector_sums_of_ragged_and_missing_vectors(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice(["a", None]), rng.choice([None, [], [1.5], [1.0, None, 2.0], [rng.random() for _ in range(5)]])) for _ in range(500)]
    df = spark.createDataFrame(rows, "k int, j string, v array<double>").repartition(5)
    for held in (64 << 20, 100):  # passing sums on all the time gives the same
        found = {(r.k, r.j): (r.sums, r.counts) for r in vectors.vector_sums(df, ["k", "j"], held_bytes=held).collect()}
        assert found.keys() == {(k, j) for k, j, _ in rows}
        for key, (sums, counts) in found.items():
            own = [v for k, j, v in rows if (k, j) == key and v]
            longest = max(map(len, own), default=0)
            want = [[x[i] for x in own if len(x) > i and x[i] is not None] for i in range(longest)]
            assert counts == [len(x) for x in want] and np.allclose(sums, [sum(x) for x in want])
    assert vectors.vector_sums(df.limit(0), ["k"]).count() == 0


def test_a_key_and_task_give_one_row_to_the_shuffle(spark):
    df = spark.range(4000).select((F.col("id") % 3).alias("key"), F.array_repeat(F.col("id").cast("double"), 64).alias("v")).repartition(4)
    means = model_outputs.mean_embedding(df, "key")
    assert means.count() == 3 * 64
    plan = vectors.vector_sums(df, ["key"])
    partial = spark.sparkContext.statusTracker()  # the plan has one shuffle of sums beside the repartition given
    assert partial is not None and plan._jdf.queryExecution().executedPlan().toString().count("Exchange") == 2
    assert {r.key: r.mean for r in means.where("dim = 7").collect()} == {k: np.mean(np.arange(k, 4000, 3)) for k in range(3)}


def test_exact_percentiles(spark):
    rng = np.random.default_rng(2)
    groups = {"a": rng.normal(size=30_001), "b": np.r_[np.full(20_000, 3.0), rng.random(99)], "c": np.array([5.0]), None: np.array([1.0, 2.0])}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("a", None), ("only nulls", None)]
    df = spark.createDataFrame(rows, "g string, y double").repartition(7)
    found = {r.g: (r.low, r.high) for r in genome.value_range(df, "y", 0.05, 0.999, ["g"]).collect()}
    for k, v in groups.items():
        assert np.allclose(found[k], np.quantile(v, [0.05, 0.999]), rtol=1e-12), k
    assert found["only nulls"] == (None, None)
    whole = genome.value_range(df, "y", 0.0, 1.0, []).first()
    everything = np.concatenate(list(groups.values()))
    assert (whole.low, whole.high) == (everything.min(), everything.max())
    sketch = {r.g: r.low for r in genome.value_range(df, "y", 0.05, 0.999, ["g"], exact=False).collect()}
    assert abs(sketch["a"] - np.quantile(groups["a"], 0.05)) < 0.01


@pytest.mark.parametrize("low, high, n", [(0.0, 1.0, 64), (-3.7, 11.1, 7), (0.1, 0.7, 1024), (0.0, 2.4e-7, 2)])
def test_bins_count_the_edges_up_to_a_value(spark, low, high, n):
    edges = omics.edges(low, high, n)
    values = [*edges, *np.nextafter(edges, -np.inf), *np.nextafter(edges, np.inf), *np.random.default_rng(n).uniform(low - 1, high + 1, 500), 0.0, float("inf"), float("-inf"), 1e300]
    rows = spark.createDataFrame([(float(x),) for x in values] + [(None,)], "x double").select("x", omics.bin_fixed(F.col("x"), low, high, n).alias("bin")).collect()
    for r in rows:
        assert r.bin == (None if r.x is None else 0 if r.x == 0 else sum(e <= r.x for e in edges)), r
    assert spark.createDataFrame([(float("nan"),)], "x double").select(omics.bin_fixed(F.col("x"), low, high, n)).first()[0] == n


def test_many_tracks_and_repeated_ones(spark):
    n = 16_000
    names = spark.range(n).select(F.lit("s").alias("species"), F.format_string("t%05d", "id").alias("track"))
    outputs = names.select(F.explode(F.array(*[F.lit(i).cast("long") for i in range(4)])).alias("row"), "species", "track", F.substring("track", 2, 5).cast("double").alias("value"))
    rows = spark.createDataFrame([(0, "s"), (1, "s"), (2, "s"), (3, "s"), (4, "s"), (5, None), (6, "other")], "row long, species string")
    began = time.time()
    found = {r.row: r.values for r in genome.pick_tracks(outputs.unionByName(outputs.where("row = 1 and value < 3").withColumn("value", F.col("value") + 0.5)), rows, names).collect()}
    assert time.time() - began < 60
    assert found[0] == found[3] == list(map(float, range(n)))
    assert found[1][:5] == [0.5, 1.5, 2.5, 3.0, 4.0]  # of a repeated track the greatest value
    assert all(set(found[i]) == {0.0} and len(found[i]) == n for i in (4, 5, 6))


def test_placeholders_are_taken_out_in_turn(spark):
    rng = random.Random(4)
    rows = [([rng.choice([8, 0, 0, 1]) for _ in range(rng.randint(0, 40))], rng.choice([1, 2, 4])) for _ in range(60)]
    for r in (1, 2, 4):
        mine = [ids for ids, x in rows if x == r]
        df = spark.createDataFrame([(ids,) for ids in mine], "ids array<int>").coalesce(1)
        values = F.transform("ids", lambda x, i: (i + 1).cast("double"))
        for ids, (got,) in zip(mine, df.select(P.compact_outputs(values, F.col("ids"), 8, r)).collect()):
            left = [float(i + 1) for i in range(len(ids))]
            for at in [i for i, x in enumerate(ids) if x == 8]:  # one by one, as positions then stand
                left = (left[: at + 1] + left[at + 1 + r :] + [0.0] * len(ids))[: len(ids)]
            assert got == left


# ---- scoring and streams -------------------------------------------------------------------------------------------


def test_batches_of_near_length_have_less_padding():
    lengths = np.random.default_rng(1).integers(1, 5000, 4096)
    arrival = [lengths[i : i + 64] for i in range(0, 4096, 64)]
    near = [lengths[b] for b in scoring.length_batches(lengths, 64, 1 << 18)]
    assert sum(map(len, near)) == 4096 and scoring.padded_share(near) < 0.05 < 0.4 < scoring.padded_share(arrival)
    assert all(len(b) <= 64 and (len(b) == 1 or len(b) * b.max() <= 1 << 18) for b in near)
    assert list(scoring.length_batches(np.zeros(0, np.int64), 5)) == [] and scoring.padded_share([]) == 0


def test_scores_by_length_and_one_load_a_worker(spark, tmp_path):
    loads = str(tmp_path / "loads")

    def load():
        import os

        with open(f"{loads}-{os.getpid()}", "a") as f:
            f.write("x")
        return lambda frame: {"total": [int(v.sum()) if v is not None else None for v in frame["ids"]], "rows": [len(frame)] * len(frame)}

    df = spark.range(3000).select("id", F.when(F.col("id") % 100 != 7, F.sequence(F.lit(0).cast("long"), F.col("id") % 90)).alias("ids")).repartition(16)
    found = scoring.score_batches(df, load, ["id", "ids"], {"total": "long", "rows": "int"}, 32, length="ids", most_values=600, keep_as="counting", chunk_rows=50)
    for r in found.collect():
        assert r.total == (None if r.ids is None else sum(r.ids)) and r.rows <= 32 and (r.rows == 1 or r.rows * len(r.ids or []) <= 600 + 32 * 91)
    assert found.count() == 3000
    assert all(p.read_text() == "x" for p in tmp_path.glob("loads-*"))  # 32 tasks, but once in each process


def test_bags_over_arrivals_and_a_restart_are_those_of_the_table(spark, tmp_path):
    source, out, side, state = (str(tmp_path / x) for x in ("cells", "bags", "side", "state"))
    cells = [(f"k{i % 3}", i, [i, i % 5]) for i in range(100)]
    odd = [(None, 1000, [1]), ("k0", None, [1]), ("k0", 1001, None), ("k1", 1002, [1, None])]
    schema = "key string, cell_id long, values array<int>"

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        for q in bags.write_bags(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), 4, out, side, state):
            q.awaitTermination()

    arrive(cells[:37] + odd[:2])
    arrive(cells[37:38] + odd[2:])
    arrive(cells[38:])
    found = sorted(map(tuple, spark.read.parquet(out).collect()))
    want = []
    for k in range(3):
        own = [c for c in cells if c[0] == f"k{k}"]
        want += [(f"k{k}", i, [c[1] for c in own[4 * i : 4 * i + 4]], [x for c in own[4 * i : 4 * i + 4] for x in c[2]]) for i in range(len(own) // 4)]
    assert found == want
    assert sorted(r.problem for r in spark.read.parquet(side).collect()) == ["a value is null", "no cell", "no key", "no values"]


# ---- round 3 -------------------------------------------------------------------------------------------------------


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dense_text_is_the_joined_dense_vector(spark):
    rng = random.Random(3)
    rows = [(c, rng.randint(-1, 12), g, rng.choice([0, 1, 7, 12])) for c in range(60) for g in range(rng.randint(1, 12))] + [(99, 50, 1, 3), (98, 2, 1, None), (98, 4, 2, 5)]
    binned = spark.createDataFrame(rows, "cell_id int, pos long, gene_idx int, bin int")
    for pad, length in ((None, None), (9, 14)):
        arrays = omics.densify(binned, 11, pad=pad, length=length).select("cell_id", F.array_join(F.col("values").cast("array<string>"), ",").alias("values"))
        assert sorted(arrays.collect()) == sorted(omics.densify_text(binned, 11, pad=pad, length=length).collect())


def test_wide_cells_are_text_at_once(spark):
    """400 cells of a million genes: 0.8 GB of text, which took an object a gene before."""
    binned = spark.range(1200).select((F.col("id") % 400).alias("cell_id"), (F.col("id") * 833).alias("pos"), F.col("id").alias("gene_idx"), F.lit(5).alias("bin"))
    began = time.time()
    assert omics.densify_text(binned, 1_000_000).agg(F.min(F.length("values")), F.max(F.length("values"))).first() == (1_999_999, 1_999_999)
    assert time.time() - began < 40


def test_lookups_count_tokens_before_the_join(spark):
    tokens = spark.createDataFrame([(1, [6, 6, 7, 99]), (2, [6]), (2, [6, 8]), (3, []), (4, None)], "k int, ids array<int>")
    table = spark.createDataFrame([(i, [float(i)]) for i in range(6, 9)] + [(8, [80.0]), (500, [1.0])], "token_id int, v array<float>")
    found = model_outputs.lookup_counts(tokens, "k", "ids", table)
    assert sorted((r.k, r.token_id, r.n, r.v[0]) for r in found.collect()) == [(1, 6, 2, 6.0), (1, 7, 1, 7.0), (2, 6, 2, 6.0), (2, 8, 1, 8.0), (2, 8, 1, 80.0)]
    long = model_outputs.lookup_embedding(tokens, "k", "ids", table)
    assert sorted((r.k, r.pos, r.token_id, r.v[0]) for r in long.collect()) == [(1, 0, 6, 6.0), (1, 1, 6, 6.0), (1, 2, 7, 7.0), (2, 0, 6, 6.0), (2, 0, 6, 6.0), (2, 1, 8, 8.0), (2, 1, 8, 80.0)]
    large = table.unionByName(spark.range(1000, 200_000).select(F.col("id").cast("int").alias("token_id"), F.array_repeat(F.lit(1.0).cast("float"), 64).alias("v")))
    for found in (model_outputs.lookup_counts(tokens, "k", "ids", large), model_outputs.lookup_embedding(tokens, "k", "ids", large)):
        assert "SortMergeJoin" not in plan_of(found)  # a frequent token is no task of its own


def test_modalities_are_no_tasks(spark):
    expr = spark.createDataFrame([("rna", 9.0), ("rna", 0.0), ("rna", None), ("methylation", 0.5), ("other", 1.0)], "omic string, value double")
    rows = [("rna", 0.0, 2.5, 16, 1.0, True), ("methylation", 0.0, 1.0, 8, 2.0, False)]
    settings = spark.createDataFrame(spark.sparkContext.parallelize(rows), "omic string, low double, high double, n_bins int, factor double, log boolean")
    binned = omics.tokenize_omics(expr, settings)
    assert "SortMergeJoin" not in plan_of(binned)
    assert sorted((r.omic, r.bin) for r in binned.collect()) == [("methylation", 2), ("rna", 0), ("rna", 0), ("rna", 7)]


def random_texts(rng, letters, n=300):
    return ["", "A", "N", "NN", None, "ACGTACGTACGT", *("".join(rng.choice(letters) for _ in range(rng.choice([1, 5, 6, 7, 40, 300]))) for _ in range(n))]


def test_kmers_of_whole_batches(spark):
    rng = random.Random(1)
    texts = random_texts(rng, "ACGTACGTACGTN")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    rows = df.select("t", T.tokenize_kmers(F.col("t"), 3).alias("k"), T.overlapping_kmers(F.col("t"), 3).alias("o"), T.kmer_ids(T.tokenize_kmers(F.col("t"), 3), 3, 6).alias("ids"))
    for r in rows.collect():
        if r.t is None:
            assert r.k is r.o is r.ids is None
            continue
        assert r.k == re.findall("[ACGT]{3}|[ACGTN]", r.t) and r.o == [r.t[i : i + 3] for i in range(len(r.t) - 2)]
        assert r.ids == [70 + "ATCGN".index(k) if len(k) == 1 else 6 + sum("ATCG".index(c) * 4 ** (2 - i) for i, c in enumerate(k)) for k in r.k]
    assert "transform" not in plan_of(df.select(T.overlapping_kmers(F.col("t"), 3)))  # no step of an expression for each letter
    odd = spark.createDataFrame([("AC-",), ("ä",), ("ACG",), (None,)], "t string").select(T.tokenize_kmers(F.col("t"), 3, on_error="null"), T.tokenize_letters(F.col("t"), on_error="null"), T.overlapping_kmers(F.col("t"), 2))
    assert [tuple(r) for r in odd.collect()] == [(None, None, ["AC", "C-"]), (None, None, []), (["ACG"], [6, 8, 9], ["AC", "CG"]), (None, None, None)]
    tokens = spark.createDataFrame([(["ACG", "A", "ä", "", None, "x", "AXG"],), (None,), ([],)], "t array<string>").select(T.kmer_ids(F.col("t"), 3, 6))
    assert [r[0] for r in tokens.collect()] == [[6 + 0 * 16 + 2 * 4 + 3, 70, None, None, None, None, 6], None, []]


def test_whole_batches_mask_as_the_expressions_do(spark):
    rng = random.Random(2)
    arrays = [None, [], [None, 7, None], *([rng.choice([None, *range(11)]) for _ in range(rng.choice([1, 9, 11, 120, 1200]))] for _ in range(60)), [7] * 40_000]
    keys = [None, "x" * 60, "é", *range(10**9, 10**9 + 61)]
    df = spark.createDataFrame([(i, None if k is None else str(k), a) for i, (k, a) in enumerate(zip(keys, arrays))], "i int, k string, ids array<int>").coalesce(1)
    for rate in (0.0, 0.15, 1.0):
        both = df.select(T.mlm_ids(F.col("k"), F.col("ids"), 5, 11, 6, rate).alias("x"), T.mlm_arrays(F.col("k"), F.col("ids"), 5, 11, 6, rate).alias("y"))
        assert both.where("not (x.id <=> y.ids and x.label <=> y.labels)").count() == 0
        for skip in (None, 1):
            both = df.select(T.uniform_mask(F.col("k"), F.col("ids"), 5, rate, skip=skip).alias("x"), T.uniform_mask_arrays(F.col("k"), F.col("ids"), 5, rate, skip=skip).alias("y"))
            assert both.where("not (x.id <=> y.ids and x.truth <=> y.truth and (x is null or size(filter(x, s -> s.masked)) = y.n_masked))").count() == 0
    long = spark.range(4).select("id", F.array_repeat(F.lit(7), 2_000_000).alias("ids"))
    began = time.time()
    assert long.select(T.mlm_arrays(F.col("id"), F.col("ids"), 7, 11, 6).alias("x")).agg(F.sum(F.size("x.ids"))).first()[0] == 8_000_000
    assert time.time() - began < 12  # four microseconds a place before


def test_blocks_of_whole_batches(spark):
    rng = random.Random(4)
    arrays = [None, [], [6], [1] * 8, [1] * 7, [6] + [1] * 15 + [6], [None] + [1] * 15, [None] * 7 + [6], *([rng.choice([1, 1, 1, 1, 1, 1, 6, None]) for _ in range(rng.choice([1, 7, 8, 9, 40, 300]))] for _ in range(80))]

    def plain(ids, size, pad):
        blocks = [ids[i * size : (i + 1) * size] for i in range(len(ids or []) // size)]
        return [True if any(x not in (None, pad) for x in b) else None if None in b else False for b in blocks]

    df = spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "i int, ids array<int>").coalesce(1)
    for n, pad in ((0, 1), (1, 1), (3, 1), (3, 6)):
        found = df.select("i", T.block_valid(F.col("ids"), n, pad).alias("v"))
        assert all(r.v == plain(arrays[r.i], 2**n, pad) for r in found.collect())
        assert "slice(" not in plan_of(found)  # no array for each block
    long = spark.range(1).select(T.block_valid(F.array_repeat(F.lit(7), 1_000_003), 3).alias("v"))
    assert long.select(F.size("v"), F.array_min("v")).first() == (125_000, True)


def test_null_texts_have_blocks_of_pads(spark, tmp_path):
    import duckdb

    from strandkit import plans

    texts = [(0, None), (7, None), (8, None), (31, None), (32, ""), (47, "abcdefgh"), (-9, "abc")]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = plans.queries()["msk3_block_valid"](spark, str(tmp_path))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(tuple(r) for r in found.collect()) == sorted(duck.execute(plans.oracle_sql()["msk3_block_valid"]).fetchall())


def test_answers_and_texts_of_whole_batches(spark):
    df = spark.createDataFrame([([5, 6, 7, 4, 8], 1), ([5, 6], 5), ([4, 4], 0), ([], 0), (None, 0), ([6, 7], 1)], "ids array<int>, start int").coalesce(1)
    assert [r[0] for r in df.select(P.answer_ids(F.col("ids"), F.col("start"), 4)).collect()] == [[6, 7], [], [], [], None, [7]]
    names = ["a", "", "cc", "é"]
    ids = spark.createDataFrame([([0, 2, 3, 1],), ([],), (None,), ([4],), ([-1],), ([0, None],)], "ids array<int>").coalesce(1)
    assert [r[0] for r in ids.select(T.detokenize(F.col("ids"), names, on_error="null")).collect()] == ["aaccé".replace("aa", "a"), "", None, None, None, None]


def test_letters_as_the_patterns_had_them(spark):
    from strandkit.functions import sequence as S
    from strandkit.plans import fixtures as X

    texts = ["", "acgtnACGTN -xyz\n", "ß İ é 漢 🧬a", None, "\x00\x7f"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    old = F.translate(F.regexp_replace(F.translate("t", X.UPPER, X.LOWER), "[^a-z]", ""), X.LOWER, X.BASES), F.regexp_replace(F.translate("t", X.LOWER, X.UPPER), "[^ACGTN]", "N")
    rows = df.select(X.letters_dna(F.col("t")).alias("a"), old[0].alias("b"), S.sanitize_dna(F.col("t")).alias("c"), old[1].alias("d"), batches.characters(F.col("t")).alias("e"), "t").collect()
    assert all(r.a == r.b and r.c == r.d and (r.t is None and r.e is None or sorted(r.e) == sorted(set(r.t))) for r in rows)


def test_windows_are_a_row_a_block(spark, tmp_path):
    rng = random.Random(4)
    records = {c: "".join(rng.choice("ACGT") for _ in range(n)) for c, n in (("a", 70_000), ("b", 300), ("c", 0))}
    tiles = genome.tile_genome(spark.createDataFrame(list(records.items()), "name string, seq string"), 512)
    windows = [(i, rng.choice(["a", "a", "b", "c", "none"]), s, s + rng.choice([0, 1, 512, 4096, 40_000])) for i, s in enumerate(rng.choice([0, 511, 32_767, 32_768, rng.randrange(75_000)]) for _ in range(200))]
    genome.save_tiles(tiles, "tiles_in_blocks", 4, str(tmp_path / "tiles"))
    asked = spark.createDataFrame(windows, "window_id long, chrom string, start long, end long")
    for held in (tiles, spark.table("tiles_in_blocks")):
        got = {r.window_id: (r.seq, r.complete) for r in genome.fetch_windows(held, asked, 512).collect()}
        assert got == {i: (w := records.get(c, "")[s:e], len(w) == e - s) for i, c, s, e in windows}
    joined = genome.fetch_windows(spark.table("tiles_in_blocks"), asked, 512)
    assert "tile_no" not in plan_of(joined).split("Generate")[1].split("\n")[0]  # exploded by block
    spark.sql("DROP TABLE tiles_in_blocks")
