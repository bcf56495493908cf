"""Queries of the sequence, vocabulary, tokenization and mask operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandkit.functions import batches
from strandkit.functions import sequence as S
from strandkit.functions import tokens as T
from strandkit.operators import genome, sequences, vocab
from strandkit.plans import fixtures as X
from strandkit.plans.registry import query


# ---- sequences -----------------------------------------------------------------------------------------------------


@query("flagship_top_kmers", f"""
    WITH s AS (SELECT lang, {X.letters_dna_sql('text')} AS seq FROM documents),
    k AS (SELECT lang, unnest(regexp_extract_all(seq, '[ACGT]{{6}}|[ACGTN]')) AS kmer FROM s),
    c AS (SELECT lang, kmer, count(*) AS n FROM k WHERE length(kmer) = 6 GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, kmer) AS rank FROM c)
    SELECT lang, kmer, n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def flagship_top_kmers(spark, d):
    kmers = X.table(spark, d, "documents").select("lang", F.explode(T.tokenize_kmers(S.sanitize_dna(X.letters_dna(F.col("text"))), 6)).alias("kmer"))
    counted = kmers.where(F.length("kmer") == 6).groupBy("lang", "kmer").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "kmer"))
    return counted.withColumn("rank", rank).where("rank <= 10")


@query("seq1_sanitize", f"WITH {X.TEXTS} SELECT seq_id, seq FROM s")
def seq1(spark, d):
    return X.texts_as_dna(spark, d)


@query("seq2_valid_dna", f"""WITH {X.SEQS}, u AS (SELECT seq_id, CASE WHEN seq_id % 3 = 0 THEN lower(seq) WHEN seq_id % 3 = 1 THEN seq || '-' ELSE '' END AS seq FROM s)
    SELECT seq_id, regexp_matches(seq, '^[ACGTNacgtn]+\\z') AS valid FROM u""")
def seq2(spark, d):
    s = X.seqs(spark, d)
    seq = F.when(F.col("seq_id") % 3 == 0, F.translate("seq", S.UPPER, S.LOWER)).when(F.col("seq_id") % 3 == 1, F.concat("seq", F.lit("-"))).otherwise("")
    return s.select("seq_id", S.is_valid_dna(seq).alias("valid"))


@query("seq3_only_alphabet", "SELECT doc_id, regexp_matches(text, '^[A-Za-z .,]*\\z') AS ok, CASE WHEN regexp_matches(text, '^[A-Za-z .,]*\\z') THEN md5(text) END AS strict FROM documents")
def seq3(spark, d):
    text = F.col("text")
    return X.table(spark, d, "documents").select("doc_id", S.only_alphabet(text, "A-Za-z .,").alias("ok"), F.md5(S.strict_alphabet(text, "A-Za-z .,", on_error="null")).alias("strict"))


@query("seq4_n_free", f"WITH {X.SEQS}, n AS (SELECT seq_id, replace(seq, 'GGGGGG', 'N') AS seq FROM s) SELECT seq_id, length(seq) AS n FROM n WHERE instr(seq, 'N') = 0")
def seq4(spark, d):
    rows = X.seqs(spark, d).withColumn("seq", F.replace(F.col("seq"), F.lit("GGGGGG"), F.lit("N")))
    return rows.where(S.n_free(F.col("seq"))).select("seq_id", F.length("seq").cast("long").alias("n"))


@query("seq5_length_multiple", f"WITH {X.TEXTS} SELECT seq_id, length(seq) AS n FROM s WHERE length(seq) % 4 = 0")
def seq5(spark, d):
    return X.texts_as_dna(spark, d).where(S.length_multiple_of(F.col("seq"), 4)).select("seq_id", F.length("seq").cast("long").alias("n"))


@query("seq6_crop", f"WITH {X.TEXTS} SELECT seq_id, md5(substr(seq, 1, length(seq) - length(seq) % 128)) AS cropped, CAST(length(seq) - length(seq) % 128 AS BIGINT) AS n FROM s")
def seq6(spark, d):
    c = S.crop_to_multiple(F.col("seq"), 128)
    return X.texts_as_dna(spark, d).select("seq_id", F.md5(c).alias("cropped"), F.length(c).cast("long").alias("n"))


@query("seq7_pad", f"WITH {X.TEXTS} SELECT seq_id, md5(rpad(seq, CAST(ceil(length(seq) / 128.0) * 128 AS INTEGER), 'N')) AS padded FROM s")
def seq7(spark, d):
    return X.texts_as_dna(spark, d).select("seq_id", F.md5(S.pad_n_to_multiple(F.col("seq"), 128)).alias("padded"))


@query("seq8_fetch_windows", f"""WITH {X.SEQS}, {X.WINDOWS}, c AS (SELECT windows.*, coalesce(substr(seq, "start" + 1, "end" - "start"), '') AS seq FROM windows LEFT JOIN s ON seq_id = chrom)
    SELECT window_id, chrom, "start", "end", md5(seq) AS seq, length(seq) = "end" - "start" AS complete FROM c""")
def seq8(spark, d):
    """The tiles are kept in buckets first, so the windows are dealt to them and not both to new places."""
    path = X.scratch(spark, "tiles")
    name = "tiles_" + path.rsplit("-", 1)[1]
    genome.save_tiles(genome.tile_genome(X.seqs(spark, d), 512, "seq_id", "seq"), name, max(8, spark.sparkContext.defaultParallelism), path)
    return genome.fetch_windows(spark.table(name), X.windows(spark, d), 512).withColumn("seq", F.md5("seq"))


@query("seq9_windows_at", """SELECT event_id AS window_id, CAST(floor(value * 20) AS BIGINT) AS "start", CAST(floor(value * 20) AS BIGINT) + 16 * 6 AS "end" FROM events""")
def seq9(spark, d):
    w = X.windows(spark, d)
    return w.select("window_id", "start", S.window_end(F.col("start"), 16, 6).alias("end"))


@query("seq10_one_hot", f"WITH {X.TEXTS} SELECT seq_id, length(seq) AS n, md5(replace(replace(replace(replace(replace(seq, 'A', '1000'), 'C', '0100'), 'G', '0010'), 'T', '0001'), 'N', '0000')) AS bits FROM s")
def seq10(spark, d):
    rows = X.texts_as_dna(spark, d).select("seq_id", S.one_hot(F.col("seq")).alias("v"))
    return rows.select("seq_id", F.size("v").cast("long").alias("n"), F.md5(F.array_join(F.flatten("v").cast("array<string>"), "")).alias("bits"))


@query("seq11_head", f"WITH {X.SEQS} SELECT seq_id, seq FROM s ORDER BY seq_id LIMIT 100")
def seq11(spark, d):
    return X.seqs(spark, d).orderBy("seq_id").limit(100)


# ---- vocabularies --------------------------------------------------------------------------------------------------

KMERS = "SELECT array_to_string(list_transform(range(0, {k}), lambda j: substr('ATCG', CAST((i // CAST(power(4, {k} - 1 - j) AS BIGINT)) % 4 + 1 AS BIGINT), 1)), '') AS token, i FROM range(0, CAST(power(4, {k}) AS BIGINT)) t(i)"
LAYOUT2 = f"""v AS (SELECT unnest(['<unk>','<pad>','<mask>','<cls>','<eos>','<bos>']) AS token, unnest(range(0, 6)) AS token_id, 'special' AS kind
    UNION ALL SELECT token, i + 6, 'standard' FROM ({KMERS.format(k=6)})
    UNION ALL SELECT unnest(['A','T','C','G','N']), unnest(range(4102, 4107)), 'standard')"""
LAYOUT1 = f"""v AS (SELECT unnest(['<unk>','<pad>','<mask>','<cls>']) AS token, unnest(range(0, 4)) AS token_id, 'special' AS kind
    UNION ALL SELECT token, i + 4, 'standard' FROM ({KMERS.format(k=6)})
    UNION ALL SELECT unnest(['A','T','C','G','N']), unnest(range(4100, 4105)), 'standard'
    UNION ALL SELECT unnest(['<eos>','<bos>']), unnest(range(4105, 4107)), 'special')"""
USED = f"u AS (SELECT kmer AS token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(seq, '[ACGT]{{6}}|[ACGTN]')) AS kmer FROM s) GROUP BY kmer)"


def used(spark, d):
    """How often each token of the sequences occurs."""
    return X.seqs(spark, d).select(F.explode(T.tokenize_kmers(F.col("seq"), 6)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query("voc1_kmers", f"WITH {X.SEQS}, {USED}, k AS ({KMERS.format(k=6)}) SELECT token, CAST(i AS INTEGER) AS token_id, coalesce(n, 0) AS n FROM k LEFT JOIN u USING (token)")
def voc1(spark, d):
    return vocab.kmer_vocab(spark, 6).join(used(spark, d), "token", "left").select("token", "token_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("voc2_layout_v1", f"WITH {X.SEQS}, {USED}, {LAYOUT1} SELECT token, CAST(token_id AS INTEGER) AS token_id, kind, coalesce(n, 0) AS n FROM v LEFT JOIN u USING (token)")
def voc2(spark, d):
    return vocab.vocab_layout(spark, 6, "v1").join(used(spark, d), "token", "left").select("token", "token_id", "kind", F.coalesce("n", F.lit(0)).alias("n"))


@query("voc3_layout_v2", f"WITH {X.SEQS}, {USED}, {LAYOUT2} SELECT token, CAST(token_id AS INTEGER) AS token_id, kind, coalesce(n, 0) AS n FROM v LEFT JOIN u USING (token)")
def voc3(spark, d):
    return vocab.vocab_layout(spark, 6, "v2").join(used(spark, d), "token", "left").select("token", "token_id", "kind", F.coalesce("n", F.lit(0)).alias("n"))


@query("voc4_letters", f"""WITH {X.TEXTS}, u AS (SELECT unnest(string_split(seq, '')) AS token FROM s WHERE seq <> ''), c AS (SELECT token, count(*) AS n FROM u GROUP BY token),
    v AS (SELECT unnest(['<unk>','<pad>','<mask>','<cls>','<eos>','<bos>','A','T','C','G','N']) AS token, unnest(range(0, 11)) AS token_id)
    SELECT token, CAST(token_id AS INTEGER) AS token_id, coalesce(n, 0) AS n FROM v LEFT JOIN c USING (token)""")
def voc4(spark, d):
    n = X.texts_as_dna(spark, d).select(F.explode(S.letters(F.col("seq"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return vocab.vocab_layout(spark, 1, "letters").join(n, "token", "left").select("token", "token_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("voc5_omics_vocab", f"""WITH {X.COUNTS}, b AS (SELECT CAST(least(CAST(value AS BIGINT), 63) AS VARCHAR) AS token, count(*) AS n FROM counts GROUP BY 1),
    v AS (SELECT CAST(i AS VARCHAR) AS token, i AS token_id FROM range(0, 64) t(i) UNION ALL SELECT unnest(['<cls>','<pad>','<mask>']), unnest(range(64, 67)))
    SELECT token, CAST(token_id AS INTEGER) AS token_id, coalesce(n, 0) AS n FROM v LEFT JOIN b USING (token)""")
def voc5(spark, d):
    n = X.counts(spark, d).groupBy(F.least(F.col("value").cast("long"), F.lit(63)).cast("string").alias("token")).agg(F.count("*").alias("n"))
    return vocab.omics_vocab(spark, 64).join(n, "token", "left").select("token", "token_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("voc6_check", f"""WITH {X.SEQS}, {USED}, g AS (SELECT token, row_number() OVER (ORDER BY token) AS token_id FROM u), {LAYOUT2},
    a AS (SELECT 'missing token' AS problem, token AS item FROM v WHERE token NOT IN (SELECT token FROM g) UNION ALL SELECT 'unknown token', token FROM g WHERE token NOT IN (SELECT token FROM v)
          UNION ALL SELECT 'missing id', CAST(i AS VARCHAR) FROM range(0, (SELECT count(*) FROM g)) t(i) WHERE i NOT IN (SELECT token_id FROM g))
    SELECT problem, item FROM a""")
def voc6(spark, d):
    given = used(spark, d).withColumn("token_id", F.row_number().over(Window.orderBy("token")))
    return vocab.check_vocab(given, vocab.vocab_layout(spark, 6, "v2"))


ADDED = """WITH n AS (SELECT DISTINCT {c} AS token FROM documents), v0 AS (SELECT unnest(['<unk>','<pad>','<mask>','<cls>','<eos>','<bos>','A','T','C','G','N']) AS token, unnest(range(0, 11)) AS token_id)
    SELECT token, CAST(token_id AS INTEGER) AS token_id, CASE WHEN token_id < 6 THEN 'special' ELSE 'standard' END AS kind FROM v0
    UNION ALL SELECT token, CAST(10 + row_number() OVER (ORDER BY token) AS INTEGER), '{k}' FROM n WHERE token NOT IN (SELECT token FROM v0)"""


@query("voc7_add_tokens", ADDED.format(c="unnest(regexp_extract_all(text, '(?s).'))", k="standard"))
def voc7(spark, d):
    return vocab.add_tokens(vocab.vocab_layout(spark, 1, "letters"), X.table(spark, d, "documents").select(F.explode(batches.characters(F.col("text"))).alias("token")))


@query("voc8_add_special_tokens", ADDED.format(c="'<' || source || '>'", k="special"))
def voc8(spark, d):
    return vocab.add_tokens(vocab.vocab_layout(spark, 1, "letters"), X.table(spark, d, "documents").select(F.concat(F.lit("<"), "source", F.lit(">")).alias("token")), "special")


@query("voc9_lookup", f"""WITH {X.SEQS}, k AS (SELECT seq_id, {X.SIXMERS.format('seq')} AS w FROM s)
    SELECT seq_id, {X.hashed_sql(f"list_transform(w, lambda t: {X.TOKEN_ID})")} AS ids, {X.hashed_sql('w')} AS tokens FROM k WHERE len(w) > 0""")
def voc9(spark, d):
    """There and back by looking up inside the arrays."""
    v = vocab.Lookup(vocab.vocab_layout(spark, 6, "v2"))
    rows = X.seqs(spark, d).select("seq_id", T.tokenize_kmers(F.col("seq"), 6).alias("tokens")).where(F.size("tokens") > 0)
    encoded = rows.select("seq_id", v.ids(F.col("tokens")).alias("ids"))
    return encoded.select("seq_id", X.hashed(F.col("ids")).alias("ids"), X.hashed(v.tokens_of(F.col("ids"))).alias("tokens"))


@query("voc9_lookup_long", f"""WITH {X.SEQS}, k AS (SELECT seq_id, {X.SIXMERS.format('seq')} AS w FROM s), p AS (SELECT unnest(w) AS t FROM k)
    SELECT t AS token, CAST({X.TOKEN_ID} AS INTEGER) AS token_id, count(*) AS n FROM p GROUP BY ALL""")
def voc9_long(spark, d):
    """By joins, for vocabularies of any size."""
    v = vocab.vocab_layout(spark, 6, "v2")
    encoded = vocab.encode_tokens(X.seqs(spark, d).select("seq_id", T.tokenize_kmers(F.col("seq"), 6).alias("tokens")), "seq_id", "tokens", v)
    counted = encoded.groupBy("token_id").agg(F.count("*").alias("n"))
    decoded = vocab.decode_ids(counted.select("n", F.array("token_id").alias("ids")), "n", "ids", v)
    return decoded.select("token", "token_id", "n")


# ---- tokenization --------------------------------------------------------------------------------------------------

#: The whole second layout, 4,107 tokens, and what its members are in SQL.
IN_LAYOUT2 = "regexp_full_match(t, '<(unk|pad|mask|cls|eos|bos)>|[ATCG]{6}|[ATCGN]')"


@query("tok1_regex", f"""WITH {X.SEQS}, u AS (SELECT seq_id, regexp_extract_all(substr(seq, 1, 9) || ' <mask>' || substr(seq, 10) || '-x', '<unk>|<pad>|<mask>|<cls>|<eos>|<bos>|[ATCG]{{6}}|[ATCGN]|[^ ]') AS w FROM s)
    SELECT seq_id, {X.hashed_sql(f"list_transform(w, lambda t: CASE WHEN {IN_LAYOUT2} THEN t ELSE '<unk>' END)")} AS tokens FROM u""")
def tok1(spark, d):
    text = F.concat(F.substring("seq", 1, 9), F.lit(" <mask>"), F.expr("substr(seq, 10)"), F.lit("-x"))
    return X.seqs(spark, d).select("seq_id", X.hashed(T.tokenize_regex(text, vocab.layout_tokens(6, "v2"))).alias("tokens"))


@query("tok2_regex_boundaries", f"""WITH {X.SEQS}, u AS (SELECT seq_id, regexp_extract_all(substr(seq, 1, 6) || ' ' || substr(seq, 7, 6) || '<mask>' || substr(seq, 13) || ' G GATTACA AC<mask>', '\\b<unk>\\b|\\b<pad>\\b|\\b<mask>\\b|\\b<cls>\\b|\\b<eos>\\b|\\b<bos>\\b|\\b[ATCG]{{6}}\\b|\\b[ATCGN]\\b|[^ ]') AS w FROM s)
    SELECT seq_id, {X.hashed_sql(f"list_transform(w, lambda t: CASE WHEN {IN_LAYOUT2} THEN t ELSE '<unk>' END)")} AS tokens FROM u""")
def tok2(spark, d):
    text = F.concat(F.substring("seq", 1, 6), F.lit(" "), F.substring("seq", 7, 6), F.lit("<mask>"), F.expr("substr(seq, 13)"), F.lit(" G GATTACA AC<mask>"))
    return X.seqs(spark, d).select("seq_id", X.hashed(T.tokenize_regex(text, vocab.layout_tokens(6, "v2"), boundaries=True)).alias("tokens"))


@query("tok3_kmers", f"WITH {X.TEXTS} SELECT seq_id, md5(array_to_string(regexp_extract_all(seq, '[ACGT]{{6}}|[ACGTN]'), ',')) AS tokens, len(regexp_extract_all(seq, '[ACGT]{{6}}|[ACGTN]')) AS n FROM s")
def tok3(spark, d):
    tokens = T.tokenize_kmers(F.col("seq"), 6)
    return X.texts_as_dna(spark, d).withColumn("t", tokens).select("seq_id", F.md5(F.array_join("t", ",")).alias("tokens"), F.size("t").cast("long").alias("n"))


@query("tok4_codons", f"WITH {X.SEQS} SELECT seq_id, {X.hashed_sql("regexp_extract_all(seq, '[ACGT]{3}|[ACGTN]')")} AS tokens FROM s")
def tok4(spark, d):
    return X.seqs(spark, d).select("seq_id", X.hashed(T.tokenize_kmers(F.col("seq"), 3)).alias("tokens"))


@query("tok5_kmer_ids", f"WITH {X.SEQS}, k AS (SELECT seq_id, {X.SIXMERS.format('seq')} AS w FROM s) SELECT seq_id, {X.hashed_sql(f"list_transform(w, lambda t: {X.TOKEN_ID})")} AS ids FROM k")
def tok5(spark, d):
    return X.seqs(spark, d).select("seq_id", X.hashed(T.kmer_ids(T.tokenize_kmers(F.col("seq"), 6), 6, 6)).alias("ids"))


@query("tok6_letters", f"""WITH {X.TEXTS} SELECT seq_id, md5(array_to_string(list_transform(string_split(seq, ''), lambda c: CAST(instr('ATCGN', c) + 5 AS VARCHAR)), ',')) AS ids FROM s WHERE seq <> ''""")
def tok6(spark, d):
    return X.texts_as_dna(spark, d).where("seq <> ''").select("seq_id", X.hashed(T.tokenize_letters(F.col("seq"))).alias("ids"))


@query("tok7_overlapping", f"WITH {X.SEQS} SELECT seq_id, {X.hashed_sql("list_transform(range(1, greatest(length(seq) - 3, 1)), lambda i: substr(seq, i, 5))")} AS kmers FROM s")
def tok7(spark, d):
    return X.seqs(spark, d).select("seq_id", X.hashed(T.overlapping_kmers(F.col("seq"), 5)).alias("kmers"))


@query("tok8_add_special", f"WITH {X.IDS} SELECT seq_id, {X.hashed_sql('list_concat([3], u, [4])')} AS ids FROM t")
def tok8(spark, d):
    ids = F.filter("ids", lambda x: x != 1)
    return X.id_rows(spark, d).select("seq_id", X.hashed(T.add_special(ids, cls=T.CLS, eos=T.EOS)).alias("ids"))


@query("tok9_pad_batch", f"""WITH {X.IDS}, m AS (SELECT seq_id, u, max(len(u)) OVER (PARTITION BY seq_id // 5) AS n FROM t)
    SELECT seq_id, seq_id // 5 AS batch, {X.hashed_sql('list_concat(u, list_transform(range(0, n - len(u)), lambda i: 1))')} AS ids FROM m""")
def tok9(spark, d):
    rows = X.id_rows(spark, d).select("seq_id", F.expr("seq_id div 5").alias("batch"), F.filter("ids", lambda x: x != 1).alias("ids"))
    return sequences.pad_to_batch_max(rows, "ids", "batch").withColumn("ids", X.hashed(F.col("ids")))


@query("tok10_pad_fixed", f"WITH {X.IDS} SELECT seq_id, CASE WHEN len(u) <= 4096 THEN {X.hashed_sql('list_concat(u, list_transform(range(0, 4096 - len(u)), lambda i: 1))')} END AS ids FROM t")
def tok10(spark, d):
    return X.id_rows(spark, d).select("seq_id", X.hashed(T.pad_fixed(F.filter("ids", lambda x: x != 1), 4096, on_error="null")).alias("ids"))


@query("tok11_truncate_pad", f"WITH {X.IDS} SELECT seq_id, {X.hashed_sql('list_concat(u[1:1024], list_transform(range(0, greatest(1024 - len(u), 0)), lambda i: 1))')} AS ids FROM t")
def tok11(spark, d):
    return X.id_rows(spark, d).select("seq_id", X.hashed(T.truncate_pad(F.filter("ids", lambda x: x != 1), 1024)).alias("ids"))


@query("tok12_batch_tokenize", f"""WITH {X.TEXTS}, k AS (SELECT seq_id, {X.SIXMERS.format('seq')} AS w FROM s), m AS (SELECT seq_id, w, max(len(w)) OVER (PARTITION BY seq_id // 8) AS n FROM k)
    SELECT seq_id, {X.hashed_sql('w')} AS tokens, {X.hashed_sql(f"list_concat([3], list_transform(w, lambda t: {X.TOKEN_ID}), list_transform(range(0, n - len(w)), lambda i: 1))")} AS ids FROM m""")
def tok12(spark, d):
    done = sequences.batch_tokenize(X.texts_as_dna(spark, d).withColumn("batch", F.expr("seq_id div 8")), "seq", 6, batch="batch")
    return done.select("seq_id", X.hashed(F.col("tokens")).alias("tokens"), X.hashed(F.col("token_ids")).alias("ids"))


@query("tok13_detokenize", f"WITH {X.SEQS} SELECT seq_id, md5(seq || repeat('<pad>', CAST(seq_id % 32 AS INTEGER))) AS text FROM s")
def tok13(spark, d):
    return X.id_rows(spark, d).select("seq_id", F.md5(T.detokenize(F.col("ids"), [*vocab.SPECIALS, *vocab.LETTERS])).alias("text"))


@query("tok14_multimodal", f"""WITH {X.SEQS}, k AS (SELECT seq_id, seq, {X.SIXMERS.format('seq')} AS w, {X.SIXMERS.format('reverse(seq)')} AS v FROM s)
    SELECT seq_id, {X.hashed_sql(f"list_concat([3], list_transform(w, lambda t: {X.TOKEN_ID}))")} AS dna_ids, {X.hashed_sql(f"list_concat([3], list_transform(v, lambda t: {X.TOKEN_ID}))")} AS rna_ids,
    {X.hashed_sql("list_transform(regexp_extract_all(translate(seq, 'ACGT', 'MKLX'), '.'), lambda c: CASE WHEN c = 'X' THEN '<unk>' ELSE c END)")} AS protein_tokens FROM k""")
def tok14(spark, d):
    rows = X.seqs(spark, d).select("seq_id", "seq", F.reverse("seq").alias("rna"), F.translate("seq", "ACGT", "MKLX").alias("protein"))
    out = sequences.tokenize_multimodal(rows, "seq", "rna", "protein", list("MKLARNDCEQGHI"))
    return out.select("seq_id", *[X.hashed(F.col(c)).alias(c) for c in ("dna_ids", "rna_ids", "protein_tokens")])


# ---- masks ---------------------------------------------------------------------------------------------------------


@query("msk1_padding_mask", f"WITH {X.IDS} SELECT seq_id, {X.hashed_sql("list_transform(ids, lambda x: CASE WHEN x <> 1 THEN 'true' ELSE 'false' END)")} AS mask FROM r")
def msk1(spark, d):
    return X.id_rows(spark, d).select("seq_id", X.hashed(T.padding_mask(F.col("ids"))).alias("mask"))


@query("msk2_length", f"WITH {X.IDS} SELECT seq_id, CAST(len(u) AS INTEGER) AS n FROM t")
def msk2(spark, d):
    return X.id_rows(spark, d).select("seq_id", T.seq_length(F.col("ids")).alias("n"))


@query("msk3_block_valid", f"WITH {X.IDS} SELECT seq_id, {X.hashed_sql("list_transform(range(0, len(ids) // 8), lambda b: CASE WHEN len(list_filter(ids[b * 8 + 1 : b * 8 + 8], lambda x: x <> 1)) > 0 THEN 'true' ELSE 'false' END)")} AS valid FROM r")
def msk3(spark, d):
    """A null text has pads alone, as in the SQL."""
    return X.id_rows(spark, d).select("seq_id", X.hashed(T.block_valid(F.coalesce("ids", X.pads()), 3)).alias("valid"))


@query("msk4_position_ids", f"""WITH {X.IDS} SELECT seq_id, {X.hashed_sql('ids')} AS ids, {X.hashed_sql('list_concat(list_transform(range(2, len(u) + 2), lambda i: i), list_transform(range(0, seq_id % 32), lambda i: 1))')} AS positions FROM t JOIN r USING (seq_id) WHERE len(ids) > 0""")
def msk4(spark, d):
    rows = X.id_rows(spark, d).where(F.size("ids") > 0)
    return rows.select("seq_id", X.hashed(F.col("ids")).alias("ids"), X.hashed(T.position_ids(F.col("ids"))).alias("positions"))


def uniform_sql(key: str, pos: str, seed: int, draw: int = 0) -> str:
    return f"(CAST(('0x' || substr(md5(CAST({key} AS VARCHAR) || ':' || CAST({pos} AS VARCHAR) || ':{seed}'), {8 * draw + 1}, 8)) AS BIGINT) / 4294967296.0)"


@query("msk5_mlm_rows", f"""WITH {X.IDS}, p AS (SELECT seq_id, unnest(range(0, len(ids))) AS pos, unnest(ids) AS x FROM r),
    u AS (SELECT *, {uniform_sql('seq_id', 'pos', 7)} AS a, {uniform_sql('seq_id', 'pos', 7, 1)} AS b, {uniform_sql('seq_id', 'pos', 7, 2)} AS c FROM p),
    q AS (SELECT *, x >= 6 AND a < 0.15 AS picked FROM u),
    m AS (SELECT seq_id, pos, CAST(CASE WHEN NOT picked THEN x WHEN b < 0.8 THEN 2 WHEN b < 0.9 THEN (x - 6 + 1 + CAST(floor(c * 4) AS INTEGER)) % 5 + 6 ELSE x END AS INTEGER) AS id, CAST(CASE WHEN picked THEN x ELSE -100 END AS INTEGER) AS label FROM q)
    SELECT seq_id, md5(string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos)) AS ids, md5(string_agg(CAST(label AS VARCHAR), ',' ORDER BY pos)) AS labels FROM m GROUP BY seq_id""")
def msk5(spark, d):
    rows = sequences.mlm_rows(X.id_rows(spark, d).where(F.size("ids") > 0), "seq_id", "ids", seed=7, vocab_size=11, n_special=6)
    return rows.select("seq_id", X.hashed(F.col("ids")).alias("ids"), X.hashed(F.col("labels")).alias("labels"))


@query("msk6_uniform_mask", f"""WITH {X.IDS}, p AS (SELECT seq_id, unnest(range(0, len(ids))) AS pos, unnest(ids) AS x FROM r), q AS (SELECT *, {uniform_sql('seq_id', 'pos', 3)} < 0.2 AS masked FROM p)
    SELECT seq_id, md5(string_agg(CAST(CASE WHEN masked THEN 2 ELSE x END AS VARCHAR), ',' ORDER BY pos)) AS ids, md5(string_agg(CAST(x AS VARCHAR), ',' ORDER BY pos)) AS truth, count(*) FILTER (masked) AS n_masked FROM q GROUP BY seq_id""")
def msk6(spark, d):
    rows = X.id_rows(spark, d).where(F.size("ids") > 0).select("seq_id", T.uniform_mask_arrays(F.col("seq_id"), F.col("ids"), 3, 0.2).alias("x"))
    return rows.select("seq_id", X.hashed(F.col("x.ids")).alias("ids"), X.hashed(F.col("x.truth")).alias("truth"), "x.n_masked")


@query("msk7_mask_ratio", f"WITH {X.IDS} SELECT seq_id, CASE WHEN len(u) > 0 THEN round(len(list_filter(u, lambda x: x = 7)) / CAST(len(u) AS DOUBLE), 6) END AS ratio FROM t")
def msk7(spark, d):
    return X.id_rows(spark, d).select("seq_id", F.round(T.mask_ratio(F.col("ids"), mask=7), 6).alias("ratio"))


@query("msk8_rescale", f"""WITH {X.EMB}, k AS (SELECT seq_id, pos, v, CASE WHEN (seq_id + pos) % 4 = 0 THEN 2 ELSE 6 END AS token_id FROM e),
    o AS (SELECT seq_id, avg(CASE WHEN (seq_id + p) % 4 = 0 THEN 1.0 ELSE 0.0 END) AS observed FROM (SELECT DISTINCT seq_id, unnest(range(0, 8)) AS p FROM e) GROUP BY seq_id)
    SELECT seq_id, pos, d - 1 AS dim, round(CAST(v[d] AS DOUBLE) * CASE WHEN token_id = 2 THEN 0.0 ELSE (1 - 0.15 * 0.8) / (1 - observed) END, 6) + 0.0 AS x FROM k JOIN o USING (seq_id), range(1, 65) t(d)""")
def msk8(spark, d):
    e = X.embeddings(spark, d)
    rows = e.select("seq_id").distinct().withColumn("ids", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda p: F.when((F.col("seq_id") + p) % 4 == 0, 2).otherwise(6)))
    done = sequences.rescale_masked(e, rows, "seq_id", "ids", 0.15, 0.8)
    return done.select("seq_id", "pos", F.posexplode("v").alias("dim", "x")).select("seq_id", "pos", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x"))
