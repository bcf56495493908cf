"""Token files, alignment and manifest against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from strandkit.llm import alignment, manifest, token_blocks  # noqa: E402
from strandkit.llm.encoders import ByteBpe, PieceBpe, vocabulary_path  # noqa: E402

BYTES, PIECES = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model")
ODD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a   b", "a\n b", "a \nb", "a\n \nb", "a\n\n", "\n", "\ta b", "it's we'll I'M", "x,y;z: u.", "end.\nThe next, and\nmore", "end.\n\nThe", "end .\nThe",
    "no break  x", "a  b  c", "　 x", "zero​width ​x", "<|endoftext|>", "a <|endoftext|> b", "<s> </s> <unk>", "▁a ▁ b", "日本語 テスト", "🙂 🙃🙂", "é é", "Ünïcödé, ßen.\nÄh!", "1234 5 6,7 ½ ²",
    "\x00 \x1c a \x1d", "tab\tin words and\ttabs", "()[]{} -- ... !!", "ﬁ ﬂ", "a" * 5000, "ab " * 3000, "᠎ x ᠎y", "A\rB \r C", "word.\n", "word. \nword", "क्षि नमस्ते", "퟿ ￿",
]


def random_texts(n, seed=5):
    rng = random.Random(seed)
    pieces = [" ", " ", " ", "\n", ".", ",", "the", "Anble", "wh", "é", "ß", "日", "'s", "  ", "\t", "9", "-", " ", "<|endoftext|>", "▁"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("plain", [False, True])
def test_words_are_encoded_as_whole_texts_are(plain):
    ours, theirs = ByteBpe(BYTES, plain, 50), ByteBpe(BYTES, plain)
    texts = ODD + random_texts(1500)
    texts += ["re, Anble. the\nNext, word.\nThe end;\nÜber: é,\nx", "a,b .c ,d \ne\n f", "x.\ny.\nz", "don't, it's.\nI'm"] * 2
    for at in range(0, len(texts), 100):  # what is kept is dropped again and again
        assert ours.encode(texts[at : at + 100]) == theirs.whole(texts[at : at + 100])


def test_pieces_of_words_are_those_of_whole_texts():
    ours = PieceBpe(PIECES, 50)
    assert ours.by_words
    texts = ODD + random_texts(1500)
    for at in range(0, len(texts), 100):
        assert ours.encode(texts[at : at + 100]) == ours.whole(texts[at : at + 100])


@pytest.mark.parametrize("n", [0, 1, 31, 1023, 1024, 1025, 5000])
def test_blocks_give_back_what_was_packed(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 50257, n), rng.integers(0, 3, n), np.full(n, 9), np.where(rng.random(n) < 0.05, rng.integers(0, 2**32, n), rng.integers(700, 900, n))):
        ids = ids.astype(np.uint32)
        packed = token_blocks.packed_blocks(ids)
        assert np.array_equal(token_blocks.unpacked_blocks(packed, n), ids)
        for a, b in np.sort(rng.integers(0, n + 1, (6, 2)), axis=1):
            assert np.array_equal(token_blocks.unpacked_blocks(packed, n, a, b), ids[a:b])
    near = rng.integers(700, 900, 4096).astype(np.uint32)
    near[::50] += 40_000
    assert len(token_blocks.packed_blocks(near)) < 4096 * 10 // 8 + 600  # eight bits each and the exceptions, not sixteen


def test_damaged_token_files_are_errors():
    writer = token_blocks.FileWriter(0, 100, 4)
    content = [*writer.add(1, np.arange(250, dtype=np.uint32)), *writer.rest()][0] + b"\n"
    assert [h["n_ids"] for h, _ in token_blocks.segments(content)] == [100, 100, 50]
    for bad in (content[:-30], content[:60] + bytes([content[60] ^ 1]) + content[61:], b"xxxx" + content[4:]):
        with pytest.raises(ValueError):
            list(token_blocks.segments(bad))


def plain_ids(texts):
    encoder = ByteBpe(BYTES)
    return [np.r_[np.frombuffer(x, "<u4"), 2].astype("<u4") for x in encoder.whole([t or "" for t in texts])]


@pytest.mark.parametrize("part_bytes, segment_ids, per_file", [(1 << 20, 1 << 20, 8), (3000, 64, 2)])
def test_token_table(spark, part_bytes, segment_ids, per_file):
    texts = ODD + random_texts(60) + ["x y. " * 20_000, None, None]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)] + [(None, "no id"), (None, None), (3, "same"), (3, "same"), (3, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"part": F.lit("clash"), "Hash": F.lit(1), "ids": F.lit(None).cast("string")})
    found = token_blocks.token_table(docs, vocabulary=BYTES, part_bytes=part_bytes, segment_ids=segment_ids, segments_per_file=per_file).collect()
    assert found[0].asDict().keys() == {"doc_id", "start", "n_tokens", "ids_crc32"}
    ids = plain_ids([t for _, t in rows])
    want = sorted(((d is not None, d or 0, len(x), zlib.crc32(x.tobytes())) for (d, _), x in zip(rows, ids)))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in found) == want
    ordered = sorted(found, key=lambda r: (r.start, r.n_tokens))
    assert [r.start for r in ordered] == np.r_[0, np.cumsum([r.n_tokens for r in ordered])[:-1]].tolist()
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in ordered]
    assert keys == sorted(keys)


def test_token_table_of_many_equal_rows_and_of_none(spark):
    docs = spark.range(500).select(F.lit(4).cast("long").alias("doc_id"), F.lit("hot row of words").alias("text"))
    found = token_blocks.token_table(docs, vocabulary=BYTES, part_bytes=1000)
    assert found.agg(F.count("*"), F.countDistinct("start"), F.countDistinct("ids_crc32")).first() == (500, 500, 1)
    assert token_blocks.token_table(docs.limit(0), vocabulary=BYTES).count() == 0
    assert token_blocks.token_table(docs.limit(2), vocabulary=BYTES, end_id=None).select("n_tokens").first()[0] == 4


def plain_alignment(rows):
    """Groups and links by walking over both token lists."""
    a, b = ByteBpe(BYTES, True), PieceBpe(PIECES)
    a_bytes, b_bytes = a.token_bytes(), b.token_bytes()
    out, links = [], []
    for doc, text in rows:
        left = np.frombuffer(a.whole([" " + text])[0], "<u4").tolist() if text else []
        right = b.model.encode(text) if text else []
        raw = (" " + (text or "")).encode()
        if b"".join(a_bytes[i] for i in left) != raw or b"".join(b_bytes[i] for i in right) != raw:
            left, right = [], []
        ends = [dict(zip(np.cumsum([len(v[i]) for i in x]).tolist(), range(len(x)))) for x, v in ((left, a_bytes), (right, b_bytes))]
        common, i, j, groups = sorted(set(ends[0]) & set(ends[1])), 0, 0, []
        for e in common:
            i2, j2 = ends[0][e] + 1, ends[1][e] + 1
            groups.append((left[i:i2], right[j:j2]))
            links.append((doc, left[i2 - 1], right[j2 - 1]))
            i, j = i2, j2
        out.append((doc, left, right, groups))
    count = {}
    for _, x, y in links:
        count[x, y] = count.get((x, y), 0) + 1
    best = {}
    for (x, y), n in count.items():
        best[y] = max(n, best.get(y, 0))
    result = []
    for doc, left, right, groups in out:
        mine = [(g[0][-1], g[1][-1]) for g in groups]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        result.append((doc, len(left), len(right), len(groups), len(mine), sum(count[p] == best[p[1]] for p in mine), sum(count[p] for p in mine), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return result


def test_alignment(spark):
    texts = [t for t in ODD + random_texts(150) + ["Plain words, as usual. " * 30] * 4 + [None, "longest text. " * 30_000]]
    rows = list(enumerate(texts)) + [(None, "no id"), (5, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"a": F.lit("clash"), "n": F.lit(1), "id": F.lit(2)})
    found = alignment.aligned_documents(docs, BYTES, PIECES)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, found.collect()), key=key) == sorted(plain_alignment(rows), key=key)
    assert sum(r[1] > 0 for r in plain_alignment(rows)) > 60
    assert alignment.aligned_documents(docs.limit(0), BYTES, PIECES).count() == 0
    arrays = alignment.as_arrays(alignment.align_tokens(docs.where("doc_id < 40"), BYTES, PIECES))
    for r in arrays.join(docs.where("doc_id <> 5"), "doc_id").select("doc_id", arrays["a"], arrays["b"], "a_counts", "b_counts", "text").collect():
        assert len(r.a) == sum(r.a_counts) and len(r.b) == sum(r.b_counts) and len(r.a_counts) == len(r.b_counts)
        assert not r.a or r.a == np.frombuffer(ByteBpe(BYTES, True).whole([" " + r.text])[0], "<u4").tolist()


def test_groups_of_very_many_tokens_take_four_bytes():
    import pyarrow as pa

    lists = pa.LargeListArray.from_arrays(pa.array([0, 2, 2, 3], pa.int64()), pa.array([70_000, 3, 9], pa.int32()))
    sizes = np.array([2, 0, 1])
    assert alignment._entries(alignment._packed(lists, "<u4"), sizes).tolist() == [70_000, 3, 9]
    assert alignment._entries(alignment._packed(lists.slice(2), "<u2"), sizes[2:]).tolist() == [9]
    mixed = pa.concat_arrays([alignment._packed(lists, "<u4"), alignment._packed(lists.slice(2), "<u2")])
    assert alignment._entries(mixed, np.r_[sizes, 1]).tolist() == [70_000, 3, 9, 9]


def test_pairs_are_bounded_by_the_vocabularies():
    a, b = [b"ab", b"b", b"xab"], [b"b", b"cb", b"ab"]
    possible = {(x, y) for x in a for y in b if x.endswith(y) or y.endswith(x)}
    assert len(possible) <= alignment.most_pairs(a, b)


def plain_manifest(rows):
    """The manifest by lists: rows of (doc_id, source, lang, n_chars, text)."""
    h = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r: h(*map(field, r))

    def climb(nodes):
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, i in enumerate(at):
                first = i // 16 * 16
                paths[k].append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + 16])))
            nodes, at = [h(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)], [i // 16 for i in at]
        return nodes[0], paths

    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    groups = [sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources]
    done = [climb([leaf(r) for r in g]) for g in groups]
    root, upper = climb([d[0] for d in done])
    out = []
    for g, (sub, paths), up in zip(groups, done, upper):
        for r, path in zip(g, paths):
            given = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                given = (*r[:4], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4]))
            node = leaf(given)
            for before, behind in path + up:
                node = h(before, node, behind)
            out.append((r[0], leaf(r), sub, root, h(*[x for p in path + up for x in p]), node, node == root))
    return out


@pytest.mark.parametrize("sizes", [[1], [16], [1, 17, 300, 16, 0], [5000, 1, 4097]])
def test_manifest(spark, sizes):
    rng = random.Random(len(sizes))
    names = [None, "src1", "é", "", "z"]
    rows = [(rng.randrange(10**6) if rng.random() < 0.97 else None, names[k], rng.choice(["en", None]), rng.choice([None, 5]), rng.choice([None, "", "Text A", "é ß"]) if rng.random() < 0.3 else f"Row {i} of {k}") for k, n in enumerate(sizes) for i in range(n)]
    rows += rows[:3]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string").withColumns({"tree": F.lit(1), "node": F.lit("x"), "no": F.lit(None).cast("int"), "ROOT": F.lit(0)})
    found = manifest.manifest(docs)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, found.collect()), key=key) == sorted(plain_manifest(rows), key=key)


def test_manifest_paths_prove_rows_and_large_ids_stay_exact(spark):
    rows = [(2**60 + i if i else None, "s" if i % 3 else "t", None, i, f"A{i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string")
    found = manifest.manifest(docs, with_paths=True).collect()
    assert {r.doc_id for r in found} == {r[0] for r in rows}
    assert sum(not r.verified for r in found) > 30
    for r in found[::7]:
        assert manifest.folded(r.leaf, [(s["before"], s["behind"]) for s in r.path]) == r.root
    assert manifest.manifest(docs.limit(0)).count() == 0


def test_a_label_too_dense_for_windows_is_compared_exactly(spark):
    """Vectors so close about their centre that sorted passes would need as many comparisons as all pairs have."""
    from strandkit.llm import embeddings

    rng = np.random.default_rng(12)
    base = np.ones(16) * 2
    rows = [(i, (base + 0.02 * rng.normal(size=16)).tolist(), "dense") for i in range(2500)] + [(10_000 + i, rng.normal(size=16).tolist(), "wide") for i in range(300)] + [(20_000 + i, rows_, "wide") for i, rows_ in enumerate([[1.0] * 16, [1.0] * 15 + [1.01]])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    about = embeddings.centres(docs.select(F.col("embedding").alias("v"), "label", F.lit(16).alias("dim")), 0.99995, 16, 64).collect()
    assert {r.label: r.exact for r in about}["dense"]
    found = {r.vec_id: r.n_links for r in embeddings.near_duplicates(docs, threshold=0.99995).collect()}
    for label in ("dense", "wide"):
        ids = [r[0] for r in rows if r[2] == label]
        x = np.array([r[1] for r in rows if r[2] == label])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = (x @ x.T >= 0.99995).sum(axis=1) - 1
        assert [found[i] for i in ids] == near.tolist()


def test_a_record_of_many_segments_is_joined_in_linear_time(spark):
    import time

    from strandkit.llm import warc

    size = 4096
    body = warc.HTTP_HEAD + warc.chunked(bytes(range(256)) * (64 << 12), 1 << 20)
    parts = [body[i : i + size] for i in range(0, len(body), size)]
    digest = hashlib.sha256(bytes(range(256)) * (64 << 12)).hexdigest()
    rows = [("o", "response" if k == 0 else "continuation", None, "1" if k == 0 else None, digest if k == 0 else None, None, "o", k + 1, len(body) if k == len(parts) - 1 else None, bytes(p), None) for k, p in enumerate(parts)]
    rows += [(None, "continuation", None, None, None, None, None, 2, None, b"lost", None)] * 2
    began = time.time()
    found = warc.reassemble(spark.createDataFrame(rows, warc.RECORDS)).select("record_id", "problem", F.length("payload").alias("n"), F.sha2("payload", 256).alias("d")).collect()
    assert time.time() - began < 90
    assert sorted(map(tuple, found), key=str) == sorted([("o", None, 64 << 20, digest), (None, "missing segment", None, None), (None, "missing segment", None, None)], key=str)


def test_revisits_of_nothing_and_of_lost_responses(spark):
    from strandkit.llm import warc

    columns = "record_id string, type string, url string, page_id string, digest string, refers_to string, payload binary, problem string"
    rows = [("a", "response", "u", "1", "d", None, b"x" * 9, None)] + [(f"r{i}", "revisit", None, str(i), "d", "a", None, None) for i in range(3)] + [(f"l{i}", "revisit", None, str(i), "d", "gone", None, None) for i in range(500)] + [(f"n{i}", "revisit", None, None, None, None, None, None) for i in range(500)] + [("w", "warcinfo", None, None, None, None, None, None)]
    found = {r.record_id: (r.refers_to_page, r.payload_bytes) for r in warc.resolve_revisits(spark.createDataFrame(rows, columns)).collect()}
    assert len(found) == 1004 and found["r2"] == ("1", 9) and found["l7"] == found["n7"] == (None, None)


def test_a_language_model_grows_with_its_counts_not_with_features_times_languages():
    import pyarrow as pa

    from strandkit.llm import language_id

    rng = random.Random(6)
    rows = [(f"l{k:03d}", n, f"{n}:{k * 37 + i if i % 4 else i}", rng.randint(1, 9)) for k in range(200) for n in (0, 2) for i in range(200)]
    rows = list({r[:3]: r for r in rows}.values())
    table = pa.Table.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.string(), pa.int64()))], names=["lang", "length", "feature", "n"])
    model = language_id.Model(table, language_id.Limits(longest=2))
    assert sum(x.nbytes for x in model.state()[3:]) < 20 * len(rows)
    counts = {}
    for lang, n, feature, c in rows:
        counts.setdefault((n, feature), {})[lang] = c
    for n in (0, 2):
        own = [own for (m, _), own in counts.items() if m == n]
        kinds, totals = len(own), np.array([sum(o.get(lang, 0) for o in own) for lang in model.langs])
        for f in rng.sample(sorted(x for m, x in counts if m == n), 20):
            logs = np.log((np.array([counts[n, f].get(lang, 0) for lang in model.langs]) + 0.5) / (totals + 0.5 * (kinds + 1)))
            assert np.allclose(model._means(n, [model.place[n][f]], np.ones(1, np.int64))[0], logs - logs.mean(), atol=1e-5)


def test_pages_are_marked_as_revisits_without_a_shuffle_of_their_payloads(spark):
    from strandkit.llm import warc

    rows = [(i if i % 9 else None, f"u{i}", (f"p{i % 40 if i % 3 else i}" * 200).encode()) for i in range(200)] + [(500 + i, "u", b"hot" * 99) for i in range(150)] + [(700 + i, "u", b"short") for i in range(3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, payload binary")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # whether Spark sees by itself that the join is small depends on which side ends first
    try:
        marked = warc.mark_revisits(pages, len(rows))
        plan = marked._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan
        found, shuffled = (sorted(map(str, x.drop("payload").collect())) for x in (marked, warc.mark_revisits(pages, len(rows), most_broadcast=0)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found == shuffled and marked.where("refers_to is not null").count() > 149


def test_words_are_learned_once_whatever_marks_follow_them():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdeéñßxyzAB") for _ in range(6)) for _ in range(60)]
    marks = ["", ",", ".", "!?", ",$$$", "%%%", ".\nThe", ",\nund;"]
    ours = ByteBpe(BYTES)
    texts = [" ".join(w + m for w in words) for m in marks]
    assert ours.encode(texts) == ours.whole(texts)
    assert len(getattr(ours.kept, "recent", ours.kept)) < 2 * len(words) + 20  # not a word for each of its marks


@pytest.mark.parametrize("plain", [False, True])
def test_texts_are_cut_only_where_the_library_cuts_them(plain):
    ours, rng = ByteBpe(BYTES, plain, 2000), random.Random(9)
    pieces = ["a", "Zq", "é", "ÿ", "Ā", "ɏ", "ʼ", "×", "÷", "ª", "×,", "÷.", "日", "1", "½", "'", "'s", "'re", "''", "_", ",", ".", "<", "|", ">", "$$", "~", "`", " ", " ", " ", "  ", "\n", "\n", "\n\n", "\r", "\t", " ", "　", "​", "́", "<|endoftext|>", "🙂", "–", "“"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(12_000)]
    for at in range(0, len(texts), 200):
        assert ours.encode(texts[at : at + 200]) == ours.whole(texts[at : at + 200])
