"""Worked examples and properties of sequence, vocabulary, tokenization and mask operators."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandkit.functions import sequence as S
from strandkit.functions import tokens as T
from strandkit.operators import sequences, vocab


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("k, seq, expected", [
    (6, "ACGTGTACNTGCACGGANCGACTAGTCTGA", "ACGTGT A C N TGCACG G A N CGACTA GTCTGA"),
    (6, "ACGTGTACGTGCACGGACGACTAGTCAGCA", "ACGTGT ACGTGC ACGGAC GACTAG TCAGCA"),
    (5, "ATCGAATNGGCGATGCAC", "ATCGA A T N GGCGA TGCAC"),
    (6, "ATCCCGGNNTCGACACN", "ATCCCG G N N TCGACA C N"),
    (3, "", ""),
])
def test_kmer_examples(spark, k, seq, expected):
    assert one(spark, seq, lambda c: T.tokenize_kmers(c, k)) == expected.split()


def test_kmers_reject_what_is_not_in_the_vocabulary(spark):
    with pytest.raises(Exception, match="not in the vocabulary"):
        one(spark, "acgt", lambda c: T.tokenize_kmers(c, 3))
    assert one(spark, "acgt", lambda c: T.tokenize_kmers(c, 3, on_error="null")) is None
    assert one(spark, None, lambda c: T.tokenize_kmers(c, 3)) is None


def test_letter_ids_and_padding(spark):
    rows = spark.createDataFrame([(1, "ACGT"), (2, "AC")], "id int, seq string").select("id", T.tokenize_letters(F.col("seq")).alias("ids"), F.lit(0).alias("batch"))
    got = {r.id: r.ids for r in sequences.pad_to_batch_max(rows, "ids", "batch").collect()}
    assert got == {1: [6, 8, 9, 7], 2: [6, 8, 1, 1]}
    assert {r.id: r.ids for r in sequences.pad_all(rows, "ids").collect()} == got


@pytest.mark.parametrize("ids, text", [([6, 7, 8, 8, 7, 7, 1], "ATCCTT<pad>"), ([6, 6, 7, 8, 9, 7], "AATCGT"), ([8, 7, 9, 8, 7, 7], "CTGCTT")])
def test_detokenize_examples(spark, ids, text):
    assert one(spark, ids, lambda c: T.detokenize(c, [*vocab.SPECIALS, *vocab.LETTERS]), "array<int>") == text


@settings(max_examples=15, deadline=None)
@given(st.text("ACGTN", max_size=60))
def test_detokenize_inverts(spark, seq):
    assert one(spark, seq, lambda c: T.detokenize(T.tokenize_letters(c), [*vocab.SPECIALS, *vocab.LETTERS])) == seq
    assert "".join(one(spark, seq, lambda c: T.tokenize_kmers(c, 4))) == seq


def test_one_hot(spark):
    assert one(spark, "NCGA", S.one_hot) == [[0, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [1, 0, 0, 0]]


def test_sanitize_keeps_length(spark):
    for text in ("aßc\n", "", "ACGTNRYK", "漢字"):
        assert len(one(spark, text, S.sanitize_dna)) == len(text)


def test_predicates_and_cuts(spark):
    assert [one(spark, x, S.is_valid_dna) for x in ("acgtN", "", "ACX", "ACGT\n")] == [True, False, False, False]
    assert one(spark, "ACGTA", lambda c: S.crop_to_multiple(c, 2)) == "ACGT"
    assert one(spark, "ACGTA", lambda c: S.pad_n_to_multiple(c, 4)) == "ACGTANNN"
    assert one(spark, "", lambda c: S.pad_n_to_multiple(c, 4)) == ""
    assert one(spark, "ACG", lambda c: T.overlapping_kmers(c, 5)) == []
    assert one(spark, "ACGTA", lambda c: T.overlapping_kmers(c, 4)) == ["ACGT", "CGTA"]


def test_layouts(spark):
    assert vocab.vocab_layout(spark, 6, "v2").count() == 4107
    small = {r.token: r.token_id for r in vocab.vocab_layout(spark, 1, "v2").collect()}
    assert [small[x] for x in "ATCGN"] == [10, 11, 12, 13, 14]
    v1 = {r.token: r.token_id for r in vocab.vocab_layout(spark, 2, "v1").collect()}
    assert v1["AA"] == 4 and v1["N"] == 24 and v1["<eos>"] == 25 and v1["<bos>"] == 26
    assert one(spark, ["GGGGGG"], lambda c: T.kmer_ids(c, 6, 6), "array<string>") == [4101]


def test_check_and_add(spark):
    v = vocab.vocab_layout(spark, 1, "letters")
    assert vocab.check_vocab(v, v).count() == 0
    assert {(r.problem, r.item) for r in vocab.check_vocab(v.where("token <> 'N'"), v).collect()} == {("missing token", "N")}
    more = vocab.add_tokens(v, spark.createDataFrame([("Z",), ("A",), ("B",), ("Z",)], "token string"))
    assert {r.token: r.token_id for r in more.collect() if r.token_id > 10} == {"B": 11, "Z": 12}


def test_lookup_is_strict(spark):
    v = vocab.vocab_layout(spark, 1, "letters")
    rows = spark.createDataFrame([(1, ["A", "X"])], "id int, tokens array<string>")
    assert [r.token_id for r in vocab.encode_tokens(rows, "id", "tokens", v, unk=0).orderBy("pos").collect()] == [6, 0]
    with pytest.raises(Exception, match="not in the vocabulary"):
        vocab.encode_tokens(rows, "id", "tokens", v).collect()
    ids = spark.createDataFrame([(1, [6, 10, 2]), (2, [])], "id int, ids array<int>")
    assert [r.token for r in vocab.decode_ids(ids, "id", "ids", v).orderBy("pos").collect()] == ["A", "N", "<mask>"]
    with pytest.raises(Exception, match="not in the vocabulary"):
        vocab.decode_ids(spark.createDataFrame([(1, [99])], "id int, ids array<int>"), "id", "ids", v).collect()


def test_strict_alphabet(spark):
    assert one(spark, "ATCGN", S.strict_alphabet) == "ATCGN" and one(spark, "", S.strict_alphabet) == ""
    assert one(spark, "ATX", lambda c: S.strict_alphabet(c, on_error="null")) is None
    for bad in ("ATX", "atc", "A\n"):
        with pytest.raises(Exception, match="not in the vocabulary"):
            one(spark, bad, S.strict_alphabet)


def test_regex_boundaries(spark):
    tokens = ["AC", "<mask>"]
    assert one(spark, "AC<mask>GT", lambda c: T.tokenize_regex(c, tokens, boundaries=True))[:2] == ["AC", "<mask>"]
    assert one(spark, "AC<mask>", lambda c: T.tokenize_regex(c, tokens, boundaries=True))[1] == "<unk>"
    assert one(spark, "ACx AC", lambda c: T.tokenize_regex(c, tokens)) == ["AC", "<unk>", "AC"]


def test_fixed_padding(spark):
    assert one(spark, [6, 7], lambda c: T.pad_fixed(c, 4), "array<int>") == [6, 7, 1, 1]
    with pytest.raises(Exception, match="longer"):
        one(spark, [6, 7, 8], lambda c: T.pad_fixed(c, 2), "array<int>")
    with pytest.raises(ValueError):
        T.add_special(F.lit(None), cls=3, bos=5)


def test_mlm_rates(spark):
    rows = spark.range(200).select(F.col("id").alias("k"), F.array_repeat(F.lit(7), 100).alias("ids"))
    out = sequences.mlm_rows(rows, "k", "ids", 1, 11, 6).select(F.explode(F.arrays_zip("ids", "labels")).alias("x")).select("x.ids", "x.labels")
    picked = out.where("labels <> -100")
    n, masked, same = picked.count(), picked.where("ids = 2").count(), picked.where("ids = 7").count()
    assert 0.13 < n / 20000 < 0.17 and 0.76 < masked / n < 0.84 and 0.07 < same / n < 0.13
    again = sequences.mlm_rows(rows.repartition(7), "k", "ids", 1, 11, 6)
    assert sorted(map(str, again.collect())) == sorted(map(str, sequences.mlm_rows(rows, "k", "ids", 1, 11, 6).collect()))


def test_max_length(spark):
    rows = spark.createDataFrame([(1, [1, 2]), (2, [1, 2, 3])], "id int, ids array<int>")
    assert sequences.check_max_length(rows, "ids", 2, on_error="filter").count() == 1
    with pytest.raises(Exception, match="longer"):
        sequences.check_max_length(rows, "ids", 2).collect()
