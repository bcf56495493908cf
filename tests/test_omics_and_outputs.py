"""Quirks and hand cases of the omics, output, chat, scoring, genome, reader and streaming operators."""

import gzip

import pytest
from pyspark.sql import functions as F

from strandkit.functions import outputs as P
from strandkit.operators import chat, genome, model_outputs, omics, scoring
from strandkit.operators.numbering import number_rows
from strandkit.sources import files
from strandkit.streaming import prepare as ST


def one(spark, value, f, kind):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def test_bin_at_and_above_the_maximum(spark):
    rows = spark.createDataFrame([(0.0,), (0.1,), (5.0,), (10.0,), (99.0,), (-1.0,), (None,)], "x double")
    got = [tuple(r) for r in rows.select(omics.bin_fixed(F.col("x"), 0, 10, 5), omics.bin_fixed(F.col("x"), 0, 10, 5, clip=True)).collect()]
    assert got == [(0, 0), (1, 1), (3, 3), (5, 4), (5, 4), (0, 0), (None, None)]


def test_constant_cells(spark):
    rows = spark.createDataFrame([(1, 1, 3.0), (1, 2, 3.0), (2, 1, 1.0), (2, 2, 4.0)], "cell_id int, gene_idx int, value double")
    got = {(r.cell_id, r.gene_idx): r.bin for r in omics.bin_per_cell(rows, 4).collect()}
    assert got == {(1, 1): 1, (1, 2): 1, (2, 1): 1, (2, 2): 3}
    e = spark.range(1).select(omics.cell_edges(F.lit(3.0), F.lit(3.0), 4).alias("a"), omics.cell_edges(F.lit(1.0), F.lit(4.0), 4).alias("b")).first()
    assert e.a == [2.9, 3.1] and e.b == [1.0, 2.0, 3.0, 4.01]


def test_last_gene_of_a_position_holds(spark):
    rows = spark.createDataFrame([(1, 5, 2, 7), (1, 9, 2, 8), (1, 6, 0, 1)], "cell_id int, gene_idx int, pos int, bin int")
    assert omics.densify(rows, 4).first()["values"] == [1, 0, 8, 0]


def test_padded_length():
    assert omics.padded_length(19062, 2) == 19064 and omics.padded_length(16, 4) == 16


def test_pairing_keeps_single_modalities(spark):
    a = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "s int, values array<double>")
    b = spark.createDataFrame([(2, [3.0]), (3, [4.0])], "s int, values array<double>")
    assert {tuple(map(str, r)) for r in omics.pair_omics(a, b, "s", ("x", "y")).collect()} == {("1", "[1.0]", "None"), ("2", "[2.0]", "[3.0]"), ("3", "None", "[4.0]")}


def test_bags_and_epochs(spark):
    cells = spark.createDataFrame([(i * 1000, [i]) for i in range(7)], "cell_id long, values array<int>")
    assert [r["values"] for r in omics.bag_cells(cells, 3).orderBy("bag_id").collect()] == [[0, 1, 2], [3, 4, 5]]
    assert [r["values"] for r in omics.bag_cells(cells, 3, epochs=2).orderBy("bag_id").collect()] == [[0, 1, 2], [3, 4, 5], [6, 0, 1], [2, 3, 4]]


def test_numbers_do_not_depend_on_partitions(spark):
    rows = spark.range(0, 50000, 7)
    for n in (1, 9):
        assert number_rows(rows.repartition(n), ["id"]).where("rn * 7 <> id").count() == 0


def test_numbers_of_sparse_and_hot_keys(spark):
    rows = [(None if i % 5 == 0 else "hot" if i % 3 else f"k{i % 7}", i**6, i) for i in range(600)]
    df = spark.createDataFrame(rows, "key string, at long, range int").repartition(5)
    expected = {}
    for key in {r[0] for r in rows}:
        for place, r in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: r[1])):
            expected[r[2]] = place
    out = number_rows(df, ["at"], "pos", by=["key"])
    assert out.columns == ["key", "at", "range", "pos"] and {r["range"]: r.pos for r in out.collect()} == expected
    assert "SinglePartition" not in number_rows(df, ["at"], "pos", by=["key"])._jdf.queryExecution().executedPlan().toString()
    assert number_rows(df.limit(0), ["at"]).count() == 0


def test_softmax_and_argmax(spark):
    assert one(spark, [1000.0, 1000.0], P.softmax, "array<double>") == [0.5, 0.5]
    assert one(spark, [1.0, 3.0, 3.0, 9.0], lambda c: P.argmax(c, 3), "array<double>") == 1
    assert [r.id for r in one(spark, [1.0, 3.0, 3.0], lambda c: P.top_k(c, 2), "array<double>")] == [1, 2]


@pytest.mark.parametrize("n, keep, left", [(10, 0.5, 6), (8, 0.5, 4), (9, 1.0, 9)])
def test_crop_center(spark, n, keep, left):
    got = one(spark, list(range(n)), lambda c: P.crop_center(c, keep), "array<int>")
    assert len(got) == left and got[0] == int((1 - keep) * n) // 2


def test_crop_to_length(spark):
    assert one(spark, [1, 2, 3, 4, 5], lambda c: P.crop_to_length(c, 3), "array<int>") == [2, 3, 4]
    assert one(spark, [1, 2, 3, 4], lambda c: P.crop_to_length(c, 3), "array<int>") == [2, 3]  # an odd surplus loses one more
    assert one(spark, [1, 2, 3], lambda c: P.crop_to_length(c, 3), "array<int>") == [1, 2, 3]
    assert one(spark, [1, 2], lambda c: P.crop_to_length(c, -1), "array<int>") == [1, 2]
    with pytest.raises(Exception, match="shorter"):
        one(spark, [1, 2], lambda c: P.crop_to_length(c, 3), "array<int>")


def test_upsample(spark):
    assert one(spark, [1.0, 3.0], lambda c: P.upsample_x2(c), "array<double>") == [1.0, 1.0, 3.0, 3.0]
    assert one(spark, [1.0, 3.0], lambda c: P.upsample_x2(c, "linear"), "array<double>") == [1.0, 2.0, 3.0, 3.0]


def test_placeholders(spark):
    assert one(spark, [5, 9, 6, 7], lambda c: P.expand_placeholders(c, 9, 2), "array<int>") == [5, 9, 9, 6]
    two = spark.createDataFrame([([1.0, 2.0, 8.0, 8.0, 3.0, 4.0, 8.0, 8.0, 5.0], [5, 9, 6, 9, 7])], "v array<double>, ids array<int>")
    assert two.select(P.compact_outputs(F.col("v"), F.col("ids"), 9, 2).alias("y")).first().y == [1.0, 2.0, 3.0, 4.0, 5.0, 0.0, 0.0, 0.0, 0.0]


def test_answers(spark):
    assert one(spark, [5, 6, 7, 4, 8], lambda c: P.answer_ids(c, F.lit(1), 4), "array<int>") == [6, 7]
    assert one(spark, [5, 6], lambda c: P.answer_ids(c, F.lit(5), 4), "array<int>") == []
    assert one(spark, [5, 6], lambda c: P.first_pad(c, 1), "array<int>") is None


def test_mcc(spark):
    pairs = spark.createDataFrame([(0, 0), (0, 0), (1, 1), (1, 0), (2, 2), (2, 1)], "truth int, pred int")
    c, s, t, p = 4, 6, [2, 2, 2], [3, 2, 1]
    expected = (c * s - sum(a * b for a, b in zip(t, p))) / ((s * s - sum(x * x for x in p)) * (s * s - sum(x * x for x in t))) ** 0.5
    assert abs(model_outputs.mcc(pairs).first().mcc - expected) < 1e-12
    assert model_outputs.mcc(spark.createDataFrame([(1, 1), (1, 1)], "truth int, pred int")).first().mcc == 0


def test_species(spark):
    known = spark.createDataFrame([("<pad>", 1), ("mouse", 7), ("human", 6)], "species string, token_id int")
    assert [r.species for r in genome.list_species(known).collect()] == ["human", "mouse"]
    with pytest.raises(Exception, match="unknown species"):
        genome.encode_species(spark.createDataFrame([("cat",)], "species string"), known).collect()
    with pytest.raises(Exception, match="reserved"):
        genome.species_head(known, on_error="raise").collect()


def test_windows(spark):
    chromosome = "ACGTTGCAAC" * 5
    tiles = genome.tile_genome(spark.createDataFrame([("c", chromosome)], "name string, seq string"), 8)
    windows = spark.createDataFrame([(1, "c", 0, 8), (2, "c", 5, 33), (3, "c", 45, 60), (4, "x", 0, 3), (5, "c", 9, 9), (6, "c", 9, 4)], "window_id int, chrom string, start long, end long")
    got = {r.window_id: (r.seq, r.complete) for r in genome.fetch_windows(tiles, windows, 8).collect()}
    assert got == {1: (chromosome[:8], True), 2: (chromosome[5:33], True), 3: (chromosome[45:60], False), 4: ("", False), 5: ("", True), 6: ("", True)}


def test_windows_of_real_length(spark):
    chromosome = "".join("ACGT"[i * i % 7 % 4] for i in range(400_000))
    tiles = genome.tile_genome(spark.createDataFrame([("c", chromosome)], "name string, seq string"), 65_536)
    windows = spark.createDataFrame([(1, "c", 100_001, 100_001 + 131_072), (2, "c", 0, 196_608), (3, "c", 300_000, 431_072)], "window_id int, chrom string, start long, end long")
    got = {r.window_id: (r.seq, r.complete) for r in genome.fetch_windows(tiles, windows, 65_536).collect()}
    assert got == {1: (chromosome[100_001:231_073], True), 2: (chromosome[:196_608], True), 3: (chromosome[300_000:], False)}


def test_tracks_of_the_own_species(spark):
    tracks = spark.createDataFrame([("human", 6, "b"), ("human", 6, "a"), ("human", 6, "c"), ("mouse", 7, "a")], "species string, token_id int, track string")
    outputs = spark.createDataFrame([(1, "human", "a", 1.0), (1, "human", "c", 3.0), (1, "mouse", "a", 9.0), (2, "mouse", "a", 5.0), (2, "human", "b", 8.0)], "row int, species string, track string, value double")
    rows = spark.createDataFrame([(1, "human"), (2, "mouse"), (3, "mouse"), (4, "cat"), (5, None)], "row int, species string")
    got = {r.row: r["values"] for r in genome.pick_tracks(outputs, rows, tracks).collect()}
    assert got == {1: [1.0, 0.0, 3.0], 2: [5.0, 0.0, 0.0], 3: [0.0] * 3, 4: [0.0] * 3, 5: [0.0] * 3}


def test_chat(spark):
    turns = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "user", None)], "conv_id int, turn int, role string, text string")
    got = {r.conv_id: r.prompt for r in chat.render_prompt(turns, "P").collect()}
    assert got == {1: "P USER: a ASSISTANT: b ASSISTANT:", 2: "P USER:  ASSISTANT:"}
    rows = spark.createDataFrame([("a <DNA> <DNA>", 2), ("<DNA>", 0)], "text string, n int")
    assert [r.found for r in chat.placeholder_violations(rows, "text", "n").collect()] == [1]


def test_scoring(spark):
    rows = spark.range(1000).select("id", F.array(F.col("id").cast("int")).alias("ids"))

    def load():
        return lambda frame: {"size": [len(frame)] * len(frame), "twice": [2 * int(x[0]) for x in frame["ids"]]}

    got = scoring.score_batches(rows, load, ["id"] + ["ids"], {"size": "int", "twice": "long"}, 64)
    assert got.where("twice <> 2 * id").count() == 0 and got.agg(F.max("size")).first()[0] <= 64
    assert scoring.output_names([1], [(2, 0)]) == ["embeddings_1", "attention_map_layer_2_number_0"]
    with pytest.raises(ValueError):
        scoring.output_names([0])


@pytest.mark.parametrize("zipped", [False, True])
def test_fasta(spark, tmp_path, zipped):
    text = b">chr1 first one\nACGT\nAC\n>chr2\nNN\r\nA\n>empty\n"
    path = tmp_path / ("x.fa.gz" if zipped else "x.fa")
    path.write_bytes(gzip.compress(text) if zipped else text)
    got = {r.name: (r.description, r.seq) for r in files.read_fasta(spark, str(path)).collect()}
    assert got == {"chr1": ("first one", "ACGTAC"), "chr2": ("", "NNA"), "empty": ("", "")}


def test_small_files(spark, tmp_path):
    (tmp_path / "genes.txt").write_text("g1\ng2\n\ng3\n")
    (tmp_path / "map.json").write_text('{"a": 1,\n "b": 2}')
    (tmp_path / "x.csv").write_text("id,cohort,g1,g.2\ns1,c,1.5,2\n")
    assert [(r.gene, r.gene_pos) for r in files.read_gene_list(spark, str(tmp_path / "genes.txt")).collect()] == [("g1", 0), ("g2", 1), ("g3", 2)]
    genes = spark.range(250).select(F.concat(F.lit("g"), "id").alias("gene"), F.col("id").alias("at"))
    files.write_gene_list(genes.repartition(3), str(tmp_path / "many"), "gene", "at", per_file=100)
    back = files.read_gene_list(spark, str(tmp_path / "many"), per_file=100).collect()
    assert sorted((r.gene_pos, r.gene) for r in back) == [(i, f"g{i}") for i in range(250)]
    assert {(r.key, r.value) for r in files.read_json_lookup(spark, str(tmp_path / "map.json")).collect()} == {("a", 1), ("b", 2)}
    assert {(r.gene, r.value) for r in files.read_expression_csv(spark, str(tmp_path / "x.csv"), ["id", "cohort"], "rna").collect()} == {("g1", 1.5), ("g.2", 2.0)}


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, "ACGTN" * i + "x") for i in range(20)], "seq_id long, seq string")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    ST.write_prepared(ST.prepare(stream, n_tokens=16), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(str, ST.prepare(rows, n_tokens=16).collect()))


def test_the_shared_folder_must_be_named_on_a_cluster():
    from types import SimpleNamespace

    from strandkit.operators.numbering import shared_dir

    conf = {}
    session = lambda master: SimpleNamespace(conf=SimpleNamespace(get=conf.get, set=conf.__setitem__), sparkContext=SimpleNamespace(master=master))
    for master in ("local-cluster[3,2,1024]", "spark://host:7077", "yarn"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(session(master))
    first = shared_dir(session("local[4]"))
    assert shared_dir(session("local[4]")) == first == conf["spark.checkpoint.dir"] and shared_dir(session("yarn")) == first
