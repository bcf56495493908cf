"""The corpus operators against brute force, and their odd cases."""

import collections
import hashlib
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from strandkit.llm import common, decontaminate, embeddings, language_id, mixing, quality, shards, simhash, substring_dedup, token_counts, warc

DOCS = "doc_id long, text string, lang string, source string"
WORDS = {"en": "the of and in to with from that river stone".split(), "fr": "le la de et une avec dans pierre eau où".split(), "de": "der und das mit von über stein fluß nicht ein".split()}


def random_docs(n=120, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rnd.choice(list(WORDS))
        words = [rnd.choice(WORDS[lang]) + rnd.choice(["", "", "s", "en", "é"]) for _ in range(rnd.choice([3, 40, 200]))]
        rows.append((i, " ".join(words), lang, f"src{0 if rnd.random() < 0.4 else rnd.randrange(5)}"))
    for i in range(n, n + 30):
        _, text, lang, source = rows[rnd.randrange(n)]
        words = text.split()
        if i % 2:
            words[rnd.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words), lang, source))
    return rows


ODD = [(900, None, "en", "src1"), (901, "", "en", None), (902, " \n\t", None, "src1"), (903, "12345 !!", "fr", "src2"), (None, "the river and the stone", "en", "src0"), (904, "x" * 50_000, "en", "src0"), (904, "x" * 50_000, "en", "src0")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(random_docs() + ODD, DOCS).repartition(3).cache()


def empty(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df):
    """With columns that have the names of results and internals."""
    names = ["row", "ident", "source_of", "of_source", "parts", "low", "steps", "bucket", "spread", "hash", "times", "block_of_copies", "text_of", "good", "hot", "__text", "__source", "__bucket", "size", "shard", "slot", "copy", "n_copies", "shuffle_key", "lang_pred", "score", "chunk", "id", "fp", "key", "n_words", "hit", "kept", "rep", "v", "rank"]
    return df.withColumns({c: F.lit("clash") for c in names if c not in df.columns})


def by_id(df, *columns):
    return {r.doc_id: tuple(r[c] for c in columns) for r in df.collect()}


# ---- 1 -------------------------------------------------------------------------------------------------------------


def test_language(spark, docs):
    train = docs.where("doc_id % 5 <> 0")
    model = language_id.learn(train, "doc_id", "text", "lang")
    found = language_id.identify(clashing(docs), model)
    assert found.columns.count("lang_pred") == 1
    rows = found.collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.doc_id is not None and r.doc_id < 150 and r.doc_id % 5 == 0]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    assert {r.lang_pred for r in rows if r.doc_id in (900, 901, 902, 903)} == {"und"}


def features(rows):
    return pa.table(dict(zip(("lang", "length", "feature", "n"), map(list, zip(*rows)))) if rows else {"lang": pa.array([], pa.string()), "length": pa.array([], pa.int32()), "feature": pa.array([], pa.string()), "n": pa.array([], pa.int64())})


def test_language_backs_off(spark):
    model = language_id.Model(features([("a", 0, "word", 9), ("b", 0, "word", 1), ("a", 2, "xy", 1), ("b", 2, "xy", 9), ("a", 1, "q", 5), ("b", 1, "q", 1)]), language_id.Limits(longest=2))
    assert [x[0] for x in model.predict(["word", "xyz", "q", "漢字", None, ""])] == ["a", "b", "a", "a", "und", "und"]
    assert language_id.Model(features([]), language_id.Limits()).predict(["text"]) == [("und", 0.0)]


def predicted_by_hand(train, texts, longest=4, smoothing=0.5):
    """Language and share by the definition: dictionaries of counts, one word after the other."""
    words = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    counts = [collections.defaultdict(collections.Counter) for _ in range(longest + 1)]
    for text, lang in train:
        for w in words(text):
            counts[0][lang][w] += 1
            for n in range(1, longest + 1):
                for i in range(len(w) + 3 - n):
                    counts[n][lang][f"<{w}>"[i : i + n]] += 1
    langs = sorted(counts[0])
    known = [set().union(*own.values()) for own in counts]

    def logs(n, feature):
        x = np.array([np.log((counts[n][lang][feature] + smoothing) / (sum(counts[n][lang].values()) + smoothing * (len(known[n]) + 1))) for lang in langs])
        return x - x.mean()

    def of_word(w):
        if w in known[0]:
            return logs(0, w)
        for n in range(longest, 0, -1):
            if found := [g for i in range(len(w) + 3 - n) if (g := f"<{w}>"[i : i + n]) in known[n]]:
                return np.mean([logs(n, g) for g in found], 0)
        return np.zeros(len(langs))

    out = []
    for text in texts:
        total = sum((of_word(w) for w in words(text)), np.zeros(len(langs)))
        share = np.exp(total - total.max())
        out.append((langs[int(total.argmax())], share.max() / share.sum()) if words(text) else ("und", 0.0))
    return out


def test_language_equals_brute_force(spark, docs):
    rows = [r for r in docs.collect() if r.doc_id is not None and r.doc_id < 150]
    train = [(r.text, r.lang) for r in rows if r.doc_id % 5]
    df = spark.createDataFrame([(r.doc_id, r.text, r.lang) for r in rows if r.doc_id % 5], "doc_id long, text string, lang string")
    model = language_id.learn(df, "doc_id", "text", "lang", language_id.Limits(bytes_per_lang=1 << 30, sample_bytes=1 << 32))
    texts = [r.text for r in rows] + ["unheard pierrestein", "é", None, "", "12", "the " * 20_000]
    for (lang, share), (own, score) in zip(predicted_by_hand(train, texts), model.predict(texts)):
        assert own == lang and abs(score - share) < 1e-3


def test_language_without_anything_to_learn(spark):
    model = language_id.learn(empty(spark), "doc_id", "text", "lang")
    assert language_id.identify(empty(spark), model).count() == 0


def test_sample_is_bounded(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("x" * 9).alias("text"), F.lit("x").alias("lang"))
    n = lambda **limits: language_id.sampled(rows, "doc_id", "text", "lang", language_id.Limits(**limits)).count()
    assert 400 < n(bytes_per_lang=5000) < 600 and 400 < n(sample_bytes=5000) < 600 and n() == 5000


# ---- 2 -------------------------------------------------------------------------------------------------------------


def without_repeats(rows, length):
    """Brute force over (id, text) rows."""
    order = sorted({(1 << 63 if i is None else i, (t or "").encode()) for i, t in rows})
    seen, out = set(), {}
    for ident, data in order:
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            s = data[p : p + length]
            if s in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(s)
        out[ident, data] = (sum(gone), bytes(x for x, g in zip(data, gone) if not g), len(re.findall(b"\1+", gone)))
    return out


@pytest.mark.parametrize("length, hot, chunk", [(100, 20_000, 4000), (40, 20_000, 4000), (40, 2, 4000), (100, 2, 1500)])
def test_substrings(spark, length, hot, chunk):
    rnd = random.Random(length)
    passage = "".join(rnd.choice("abcdefg hij") for _ in range(130))
    rows = [(i, "".join(rnd.choice("abcdefgh ijé") for _ in range(rnd.choice([0, 30, 200, 600])))) for i in range(60)]
    rows += [(i, a + passage + b) for i, (_, a), (_, b) in zip(range(100, 140), rows, rows[7:])]
    rows += [(200, "z" * 1000), (201, "ab" * 400), (202, None), (203, passage * 3), (204, passage[:100]), (None, passage), (205, "z" * 120), (205, "z" * 120)]
    rows += [(206, passage + "y" * 300)] * 30 + [(None, passage + passage)] * 40 + [(None, None)] * 20 + [(207, "very long " * 20_000)]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    expected = without_repeats(rows, length)
    got = substring_dedup.remove_repeats(df, length=length, chunk_bytes=chunk, hot=hot).collect()
    assert sorted(str((r.doc_id, r.text)) for r in got) == sorted(str(r) for r in rows)
    for r in got:
        if r.doc_id is None:  # those without an id are ordered by start only
            continue
        removed, kept, spans = expected[r.doc_id, (r.text or "").encode()]
        assert (sum(s.end - s.start for s in r.spans), bytes(r.kept), len(r.spans)) == (removed, kept, spans), r.doc_id


@pytest.mark.parametrize("trial", range(20))
def test_parts_of_hot_runs(trial):
    rnd = random.Random(trial)
    data = np.frombuffer("".join(rnd.choice("ab c") for _ in range(rnd.randint(100, 900))).encode(), np.uint8)
    starts, counts, _, anchors = substring_dedup.anchored_runs(data, np.array([len(data) // 3, len(data)]), 50)
    begin, number, core = substring_dedup.split_by_place(starts, counts, anchors, 50)
    spread = lambda s, n: sorted(x for a, k in zip(s.tolist(), n.tolist()) for x in range(a, a + k))
    assert spread(begin, number) == spread(starts, counts)
    assert (core >= begin + number - 1).all() and (core + 50 - substring_dedup.PLACES + 1 <= begin + 50).all()
    keyed = {}
    for b, k, c in zip(begin.tolist(), number.tolist(), core.tolist()):
        for p in range(b, b + k):
            keyed.setdefault(data[p : p + 50].tobytes(), set()).add(data[c : c + 50 - substring_dedup.PLACES + 1].tobytes())
    assert all(len(x) == 1 for x in keyed.values())


def test_substrings_of_nothing(spark):
    assert substring_dedup.remove_repeats(empty(spark)).count() == 0


@pytest.mark.parametrize("trial", range(40))
def test_two_stage_sort(trial):
    rnd = random.Random(trial)
    depth, letters = rnd.choice([3, 8, 40, 100]), rnd.choice([2, 3, 26, 256])
    data = bytes(rnd.randrange(letters) for _ in range(rnd.randint(1, 300)))
    data += data[: rnd.randint(0, 150)]
    text = np.frombuffer(data + bytes(depth + 8), np.uint8)
    wanted = np.array(sorted(rnd.sample(range(len(data)), rnd.randint(1, len(data)))))
    order = substring_dedup.two_stage_order(text, wanted, depth)
    keys = [text.tobytes()[p : p + depth] for p in order.tolist()]
    assert sorted(order.tolist()) == wanted.tolist() and keys == sorted(keys)
    shared = [next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), depth) for x, y in zip(keys, keys[1:])]
    assert substring_dedup.common_prefixes(text, order, depth).tolist() == [0, *shared]


# ---- 3 -------------------------------------------------------------------------------------------------------------


def test_mixture_follows_the_weights(spark):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").otherwise(F.lit(None)).alias("source"))
    out = mixing.mix_sources(clashing(rows), {"a": 4.0, "b": 1.0}, default_weight=1.0, size=2.0)
    shares = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(sum(shares.values()) / 12000 - 1) < 0.05 and abs(shares["a"] / shares["b"] - 4) < 0.4 and abs(shares[None] / shares["b"] - 1) < 0.15
    copies = out.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("n_copies").alias("m"), F.max("copy").alias("last"))
    assert copies.where("n <> m or last <> m - 1").count() == 0
    again = mixing.mix_sources(rows.repartition(7), {"a": 4.0, "b": 1.0}, default_weight=1.0, size=2.0)
    assert again.select("doc_id", "copy", "shuffle_key").exceptAll(out.select("doc_id", "copy", "shuffle_key")).count() == 0


def test_poisson_tables(spark):
    import math

    rates = [0.0, 0.3, 4.0, 80.0, 1e3, 65_536.0]
    for r in mixing.poisson_tables(spark.createDataFrame([(str(x), x) for x in rates], "source string, rate double")).collect():
        ks = range(r.low, r.low + len(r.steps))
        exact = np.cumsum([math.exp(k * math.log(r.rate) - r.rate - math.lgamma(k + 1)) if r.rate else 1.0 for k in ks])
        assert r.parts == 1 and np.allclose(r.steps, exact, atol=1e-9) and r.steps[-1] == 1.0 and len(r.steps) < 7000


@pytest.mark.parametrize("rate", [1e3, 1e6, 1e9])
def test_any_rate(spark, rate):
    """A source of ten bytes beside a large one, as often as its rate says."""
    n = int(rate * 20)
    rows = spark.createDataFrame([(i, "x", "small") for i in range(10)] + [(100, "y" * min(n, 1000), "large")], "doc_id long, text string, source string")
    rows = rows.withColumn("text", F.when(F.col("source") == "large", "y" * 1000).otherwise(F.col("text")))
    counted = mixing.with_counts(rows, {"small": 1.0, "large": 1.0}, size=20 * rate / 1010)
    own = [r.n_copies for r in counted.where("given_2 = 'small'").collect()]
    assert len(own) == 10 and all(abs(x - rate) < 8 * rate**0.5 for x in own) and len(set(own)) > 5


@pytest.mark.parametrize("options", [{}, {"most_broadcast": 0}, {"most_rate": 0.5}])
def test_copies_equal_brute_force(spark, docs, options):
    import math

    rows = [r for r in docs.collect()]
    sizes = collections.Counter()
    for r in rows:
        sizes[r.source] += len((r.text or "").encode())
    weights = {s: (3.0 if s == "src1" else 1.0) if n else 0.0 for s, n in sizes.items()}
    expected = collections.Counter()
    for r in rows:
        rate = weights[r.source] / sum(weights.values()) * 2 * sum(sizes.values()) / sizes[r.source] if sizes[r.source] else 0.0
        ident = str(r.doc_id) if r.doc_id is not None else hashlib.md5((r.text or "").encode()).hexdigest()
        parts = max(1, math.ceil(rate / options.get("most_rate", 65_536)))
        n = 0
        for part in range(parts):
            u = int(hashlib.md5((f"17:{ident}" + (f":{part}" if part else "")).encode()).hexdigest()[:12], 16) / 2**48
            k, upto = 0, math.exp(-rate / parts)
            while upto <= u:
                k += 1
                upto += math.exp(k * math.log(rate / parts) - rate / parts - math.lgamma(k + 1))
            n += k
        expected[r.doc_id, r.text] += n
    out = mixing.mix_sources(clashing(docs), {"src1": 3.0}, size=2.0, **options)
    assert out.columns.count("copy") == 1 and out.where("shuffle_key = 'clash' or row <> 'clash'").count() == 0
    assert collections.Counter((r.doc_id, r.text) for r in out.collect()) == +expected
    kept = mixing.mix_sources(clashing(docs), {"src1": 3.0}, size=2.0, added=False, **options)
    assert kept.columns == clashing(docs).columns and kept.where("copy <> 'clash'").count() == 0


def test_mixture_oddities(spark, docs):
    assert mixing.mix_sources(empty(spark)).count() == 0
    assert mixing.mix_sources(docs.where("text is null")).count() == 0
    many = mixing.repeated(spark.createDataFrame([(1, 0), (2, 1), (3, 150_000)], "a int, n long"), "n", "i").groupBy("a").agg(F.count("*").alias("n"), F.countDistinct("i").alias("d"), F.max("i").alias("m"))
    assert sorted(map(tuple, many.collect())) == [(2, 1, 1, 0), (3, 150_000, 150_000, 149_999)]


# ---- 4 -------------------------------------------------------------------------------------------------------------


def simhash_of(text, width=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(ids, pairs):
    top = {i: i for i in ids}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        top[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_simhash(spark, docs):
    rows = [r for r in docs.collect() if r.doc_id is not None]
    fps = {r.doc_id: simhash_of(r.text) for r in rows}
    ids = sorted(fps)
    expected = groups(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if bin(fps[a] ^ fps[b]).count("1") <= 3])
    got = simhash.near_duplicates(clashing(docs)).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is not None:
            assert (r.fingerprint, r.component_id) == (f"{fps[r.doc_id]:016x}", expected[r.doc_id])
    assert len(set(expected.values())) < len(ids) - 10
    assert simhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("most_homes", [1024, 3])
def test_anchors_meet_all_pairs_within_three_bits(spark, most_homes):
    rnd = random.Random(4)
    values = set()
    for _ in range(40):
        base = rnd.getrandbits(64)
        for _ in range(12):
            base ^= sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 4)))
            values.add(base)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    expected = groups(signed, [(signed[i], signed[j]) for i in range(len(values)) for j in range(i) if bin(values[i] ^ values[j]).count("1") <= 3])
    found = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), most_homes=most_homes)
    got = {r.node: r.component for r in common.connected_components(found).collect()}
    assert {s: got.get(s, s) for s in signed} == expected


def jaccard_of(a, b, width=5):
    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
        return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()

    a, b = shingles(a or ""), shingles(b or "")
    return len(a & b) / len(a | b) if a and b else 0.0


def near_copies():
    """Texts of 30 to 300 words with copies that have some words changed, so that many are similar but far in bits."""
    rnd = random.Random(12)
    rows = []
    for _ in range(25):
        words = [f"w{rnd.randrange(3000)}" for _ in range(rnd.choice([30, 60, 120, 300]))]
        for changed in (0, 1, 2, 3, 5):
            copy = list(words)
            for at in rnd.sample(range(len(words)), changed * len(words) // 120 + (changed > 2)):
                copy[at] = f"n{rnd.randrange(3000)}"
            rows.append((len(rows), " ".join(copy)))
    return rows + [(900, None), (901, ""), (902, " "), (903, "two words"), (904, "Two  words")]


@pytest.mark.parametrize("block", [512, 3])
def test_near_copies_by_jaccard(spark, monkeypatch, block):
    from strandkit.llm import jaccard

    rows = near_copies()
    fps, far = {i: simhash_of(t) for i, t in rows}, 0
    pairs = []
    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            bits, similar = bin(fps[i] ^ fps[j]).count("1"), jaccard_of(a, b) >= 0.8
            far += bits > 3 and similar
            if bits <= 3 or similar:
                pairs.append((i, j))
    assert far > 30
    whole = jaccard.similar_texts
    monkeypatch.setattr(simhash, "similar_texts", lambda *a: whole(*a, block=block))
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    got = simhash.near_duplicates(df, similar=0.8).collect()
    assert {r.doc_id: r.component_id for r in got} == groups([i for i, _ in rows], pairs)
    assert simhash.near_duplicates(empty(spark), similar=0.8).count() == 0


def test_pipeline_leaves_no_similar_pair(spark):
    import corpus_pipeline

    df = spark.createDataFrame([(i, t, "en", "src0") for i, t in near_copies()], DOCS)
    kept = corpus_pipeline.one_of_each_group(spark, df, "").collect()
    assert max(jaccard_of(a.text, b.text) for i, a in enumerate(kept) for b in kept[:i]) < 0.8


def test_components(spark):
    rnd = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 300) if i % 50] + [(1000, rnd.randrange(1000, 1300)) for _ in range(200)] + [(5, 5)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == groups(nodes, [e for e in edges if e[0] != e[1]])
    assert common.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


# ---- 5 -------------------------------------------------------------------------------------------------------------


def shards_by_hand(spark, rows, schema, n_shards, bucket_bytes, seed=2024):
    """Rows with shard and slot: numbered copies of equal rows, dealt, sorted and shuffled on one list."""
    df = spark.createDataFrame(rows, schema)
    row = F.struct(*df.columns)
    hashes = {tuple(r): h for r, h in zip(rows, ((h.a, h.b) for h in [x.h for x in df.coalesce(1).select(F.struct(F.xxhash64(F.lit(seed), row).alias("a"), F.xxhash64(F.lit(seed + 1), row).alias("b")).alias("h")).collect()]))}
    seen, each = collections.Counter(), []
    for r in rows:
        each.append((*hashes[tuple(r)], seen[tuple(r)], tuple(r)))
        seen[tuple(r)] += 1
    total = sum(len((r[1] or "").encode()) + 8 for r in rows)
    n_buckets = max(1, -(-total // bucket_bytes))
    keyed = spark.createDataFrame([(a, b, c, i) for i, (a, b, c, _) in enumerate(each)], "a long, b long, copy long, i int").select("i", F.xxhash64(F.struct("a", "b"), "copy").alias("h")).collect()
    buckets = collections.defaultdict(list)
    for k in keyed:
        buckets[k.h % n_buckets].append((k.h, each[k.i][3]))
    order = []
    for b in sorted(buckets):
        own = sorted(buckets[b], key=lambda x: x[0])
        order += [own[i][1] for i in shards.permutation(seed, b, len(own))]
    runs = np.array_split(np.arange(len(order)), n_shards)
    return sorted(((order[p], s, i) for s, run in enumerate(runs) for i, p in enumerate(run)), key=str)


@pytest.mark.parametrize("n, copies", [(7, 1), (7, 300), (400, 3)])
def test_shards(spark, docs, n, copies):
    rows = [tuple(r) for r in docs.collect()]
    rows += [rows[3]] * (copies - 1)
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    got = shards.shuffle_into_shards(df, n_shards=n, bucket_bytes=5000)
    found = sorted(((tuple(r)[:4], r.shard, r.slot) for r in got.collect()), key=str)
    assert found == shards_by_hand(spark, rows, DOCS, n, 5000)
    assert all(r.size == len((r.text or "").encode()) + 8 for r in got.collect())
    counts = collections.Counter(x[1] for x in found)
    assert max(counts.values()) - min(counts[s] for s in range(n)) <= 1


def test_shards_of_odd_tables(spark, docs, tmp_path):
    out = shards.write_shards(clashing(docs), str(tmp_path / "out"), n_shards=3, bucket_bytes=20_000)
    assert out.columns.count("size") == 1 and out.count() == docs.count() and out.where("bucket <> 'clash'").count() == 0 and dict(out.dtypes)["size"] == "bigint"
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("shard")) == ["shard=0", "shard=1", "shard=2"]
    assert shards.shuffle_into_shards(empty(spark)).count() == 0


# ---- 6 -------------------------------------------------------------------------------------------------------------

PAGES = [(i, f"http://x/{i}", f"<p>{'é' * i}\r\n\r\n{i % 4}</p>" * (i % 9 * 30)) for i in range(60)]
PAGES += [(100 + i, "http://x/same", "s" * 5000) for i in range(5)] + [(200, None, None), (201, "http://x/\r\nEvil: 1", ""), (202, "u", "tiny"), (203, "u", "tiny"), (None, "n", "s" * 5000), (300, "twice", "t" * 9000), (300, "twice", "t" * 9000)]


def test_archives_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    warc.write_pages(pages.withColumn("payload", F.lit(1)), str(tmp_path / "w"), segment_bytes=700, chunk_bytes=64, file_bytes=20_000)
    records = warc.read_records(spark, str(tmp_path / "w"))
    assert records.where("type = 'continuation'").count() > 20
    whole = warc.reassemble(records)
    assert whole.where("problem is not null").count() == 0
    back = [(r.page_id and int(r.page_id), r.payload_bytes, r.payload_digest, r.type, r.refers_to_page and int(r.refers_to_page)) for r in warc.resolve_revisits(whole).collect()]
    first = {}
    for i, _, html in PAGES:
        data = (html or "").encode()
        if len(data) >= 100 and i is not None:
            first[data] = min(first.get(data, i), i)
    expected = []
    for i, _, html in PAGES:
        data = (html or "").encode()
        other = first.get(data)
        revisit = other is not None and (i is None or i > other)
        expected.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", other if revisit else None))
    assert sorted(map(str, back)) == sorted(map(str, expected))


def test_broken_archives(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "a" * 3000), (2, "u", "b" * 3000)], "page_id long, url string, html string")
    warc.write_pages(pages, str(tmp_path / "w"), segment_bytes=1000)
    records = warc.read_records(spark, str(tmp_path / "w"))
    lost = warc.reassemble(records.where("not (segment = 2 and block like '%a%')")).collect()
    assert sorted((r.page_id, r.problem) for r in lost) == [("1", "missing segment"), ("2", None)]
    cut = records.withColumn("block", F.when((F.col("segment") == 2) & F.col("block").cast("string").contains("b"), F.expr("substring(block, 1, 900)")).otherwise(F.col("block")))
    assert sorted((r.page_id, r.problem) for r in warc.reassemble(cut).collect()) == [("1", None), ("2", "total length")]
    assert warc.reassemble(records.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_long_repeated_pages_in_the_table(spark, tmp_path):
    given = [(r.page_id, r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    top = max(r[0] for r in given) + 1
    rows = given + [(top + 5 * i + k, r[1], r[2] * (1 if k < 3 else 4)) for i, r in enumerate(given[:12]) for k in range(5)] + [(top + 1000 + i, None, "long " * 100_000) for i in range(4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    warc.write_pages(df, str(tmp_path / "w"), file_bytes=1 << 20)
    back = {int(r.page_id): (r.payload_bytes, r.payload_digest, r.type, r.refers_to_page and int(r.refers_to_page)) for r in warc.resolve_revisits(warc.reassemble(warc.read_records(spark, str(tmp_path / "w")))).collect()}
    first = {}
    for i, _, html in sorted(rows):
        first.setdefault(html, i)
    expected = {i: (len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), *(("revisit", first[h]) if first[h] < i and len((h or "").encode()) >= 100 else ("response", None))) for i, _, h in rows}
    assert back == expected and sum(x[2] == "revisit" for x in back.values()) > 30


def test_archives_that_are_cut_or_damaged(spark, tmp_path):
    import gzip

    plain = b"\r\n\r\n".join(warc._record(b"response", f"<{i}>", [(b"X-Page-ID", b"%d" % i)], warc.HTTP_HEAD + warc.chunked(b"p" * 300, 100)) for i in range(3))
    lost = plain.replace(b"Content-Length", b"Content-Lost", 1)
    number = warc._record(b"continuation", "<9>", [(b"WARC-Segment-Number", b"two"), (b"WARC-Segment-Origin-ID", b"<8>")], b"x")
    for name, data in [("whole.warc", plain), ("cut.warc", plain[:-40]), ("cut.warc.gz", gzip.compress(plain)[:-60]), ("tail.warc.gz", gzip.compress(plain)[:-4]), ("head.warc", plain + b"\r\n\r\nWARC/1.1\r\nWARC-Type: x"), ("noise.warc.gz", b"\x1f\x8b" + b"?" * 90), ("lost.warc", lost), ("number.warc", number), ("empty.warc", b"")]:
        (tmp_path / name).write_bytes(data)
    found = collections.defaultdict(list)
    for name in sorted(p.name for p in tmp_path.iterdir()):
        for r in warc.reassemble(warc.read_records(spark, str(tmp_path / name))).collect():
            found[name].append((r.page_id, r.problem, r.payload and len(r.payload)))
    good = [(str(i), None, 300) for i in range(3)]
    assert sorted(found["whole.warc"]) == good and found["empty.warc"] == []
    assert sorted(found["cut.warc"], key=str) == good[:2] + [("2", "archive", None)]
    assert ("archive" in {x[1] for x in found["cut.warc.gz"]}) and all(x in good or x[1:] == ("archive", None) for x in found["cut.warc.gz"])
    assert sorted(found["tail.warc.gz"], key=str) == good + [(None, "archive", None)] and sorted(found["head.warc"], key=str) == good + [(None, "archive", None)]
    assert found["noise.warc.gz"] == [(None, "archive", None)] and found["lost.warc"] == [("0", "content length", None)] and found["number.warc"] == [(None, "segment", None)]
    assert warc.resolve_revisits(warc.reassemble(warc.read_records(spark, str(tmp_path)))).where("problem is null").count() >= 11


def test_chunked_framing():
    for data in (b"", b"x", bytes(range(256)) * 9):
        assert warc.unchunked(warc.chunked(data, 7)) == data
    assert warc.unchunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    for bad in (b"", b"5\r\nab", b"zz\r\n", b"2\r\nabc\r\n0\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(bad)


def test_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_pages(pages, str(tmp_path / "w"))
    assert warc.resolve_revisits(warc.reassemble(warc.read_records(spark, str(tmp_path / "w")))).count() == 0


# ---- 7 -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block, window", [(1024, 64), (40, 8)])
def test_embeddings(spark, block, window):
    rnd = np.random.default_rng(2)
    rows, n = [], 0
    for label in (1, 2, None):
        for _ in range(40):
            base = rnd.standard_normal(16)
            for _ in range(rnd.integers(1, 6)):
                rows.append((n, [float(x) for x in np.float32(base + 0.04 * rnd.standard_normal(16))], label))
                n += 1
    dense = rnd.standard_normal(16)
    for _ in range(150):
        rows.append((n, [float(x) for x in np.float32(dense + 0.01 * rnd.standard_normal(16))], 2))
        n += 1
    rows += [(n, rows[0][1], 1), (n + 1, None, 1), (n + 2, [0.0] * 16, 1), (n + 3, [float("nan")] * 16, 1), (n + 4, [float("inf")] + [1.0] * 15, 1), (n + 5, [None] * 16, 1), (n + 6, [1.0, 2.0], 1), (n + 7, [2.0, 4.0], 1), (n + 8, [], 1)]
    good = [(i, np.array(v, float), label) for i, v, label in rows if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    pairs = [(a[0], b[0]) for k, a in enumerate(good) for b in good[:k] if a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / (np.linalg.norm(a[1]) * np.linalg.norm(b[1])) >= 0.98]
    links = collections.Counter(x for p in pairs for x in p)
    expected = groups([r[0] for r in rows], pairs)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"rep": F.lit(0), "id": F.lit(0)})
    got = embeddings.near_duplicates(df, block=block, window=window).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {i: (links[i], expected[i], expected[i] == i) for i in expected}


TABLES = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="needs the test tables")
def test_near_pairs_planted_in_the_table(spark):
    """Copies at cosines about the threshold, exact ones, null ids and repeated rows beside the given vectors."""
    rnd = np.random.default_rng(8)
    given = [(r.vec_id, np.array(r.embedding), r.label) for r in spark.read.parquet(f"{TABLES}/embeddings.parquet").collect()]
    rows, n = list(given), max(r[0] for r in given) + 1
    for _, v, label in given[::3]:
        other = rnd.standard_normal(len(v))
        other -= other @ v / (v @ v) * v
        for cosine in (0.975, 0.981, 0.99, 1.0):
            rows.append((n, cosine * v / np.linalg.norm(v) + (1 - cosine**2) ** 0.5 * other / np.linalg.norm(other), label))
            n += 1
    rows += [(n, given[0][1], given[0][2])] * 3 + [(None, given[1][1], given[1][2])] * 2
    df = spark.createDataFrame([(i, [float(x) for x in v], label) for i, v, label in rows], "vec_id long, embedding array<double>, label int")
    unit = [v / np.linalg.norm(v) for _, v, _ in rows]
    near = np.stack(unit) @ np.stack(unit).T >= 0.98
    near &= np.equal.outer(np.array([r[2] for r in rows]), np.array([r[2] for r in rows]))
    np.fill_diagonal(near, False)
    got = embeddings.near_duplicates(df).collect()
    assert sorted((str(r.vec_id), r.n_links) for r in got) == sorted((str(rows[i][0]), int(k)) for i, k in enumerate(near.sum(1)))
    of = groups(range(len(rows)), [(int(a), int(b)) for a, b in np.argwhere(np.triu(near))])
    lowest = {}
    for i, r in enumerate(rows):
        lowest[of[i]] = min(lowest.get(of[i], 1 << 62), 1 << 62 if r[0] is None else r[0])
    assert sorted((str(r.vec_id), r.component_id, r.kept) for r in got) == sorted((str(r[0]), lowest[of[i]], r[0] == lowest[of[i]]) for i, r in enumerate(rows))
    assert near.sum() > 100


def test_vectors_about_a_common_direction(spark):
    """Isolated pairs among vectors that all lie close together; their keys are taken about the centre."""
    rnd = np.random.default_rng(4)
    unit = lambda k: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(rnd.standard_normal((k, 32)))
    base = np.sqrt(0.9) * unit(1) + np.sqrt(0.1) * unit(3000)
    first = base[:150] / np.linalg.norm(base[:150], axis=1, keepdims=True)
    other = unit(150)
    other -= (other * first).sum(1, keepdims=True) * first
    pairs = 0.982 * first + (1 - 0.982**2) ** 0.5 * other / np.linalg.norm(other, axis=1, keepdims=True)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([base, pairs]))]
    got = {r.vec_id: r.component_id for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), window=16).collect()}
    assert sum(got[i] == got[3000 + i] for i in range(150)) >= 148
    few = embeddings.centres(spark.createDataFrame([(i, [1.0, 0.0] if i % 2 else [0.0, 1.0], "a", 2) for i in range(64)], "rep long, v array<double>, label string, dim int"), 0.98, 16, 64).first()
    assert few.centre == [0.5, 0.5] and few.passes == 16


def test_no_embeddings(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# ---- 8 -------------------------------------------------------------------------------------------------------------


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


@pytest.mark.parametrize("block, shingle", [(12 << 20, 2), (60, 1), (60, 3)])
def test_contamination(spark, block, shingle):
    rnd = random.Random(3)
    vocabulary = ["a", "b", "c", "dé", "e1", "f"]
    text = lambda n: rnd.choice([" ", ", ", "\n"]).join(rnd.choice(vocabulary).upper() if rnd.random() < 0.2 else rnd.choice(vocabulary) for _ in range(n))
    items = [(i, text(rnd.choice([1, 2, 3, 4, 5, 8]))) for i in range(12)] + [(50, None), (51, "..."), (None, "f f f f"), (3, "c c c")]
    docs = [(i, text(rnd.choice([0, 2, 30, 80]))) for i in range(60)] + [(90, None), (91, "-"), (92, "a " * 5000), (92, "a " * 5000)]
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words_of(t)
        for k in range(max(1, len(w) - 3) if w else 0):
            windows[tuple(w[k : k + 4])].add("null" if i is None else str(i))
    expected = {}
    for i, t in docs:
        w, hit, found = words_of(t), set(), set()
        for k in range(len(w)):
            for n in range(1, 5):
                if k + n <= len(w) and (ids := windows.get(tuple(w[k : k + n]))):
                    hit |= set(range(k, k + n))
                    found |= ids
        expected[i] = (len(w), len(hit), sorted(found), bool(hit), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    df = clashing(spark.createDataFrame(docs, "doc_id long, text string"))
    got = decontaminate.find_contamination(df, spark.createDataFrame(items, "item_id long, text string"), width=4, shingle=shingle, block_bytes=block, carry=("hit", "rank")).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_words, r.n_hit, r["items"], r.contaminated, r.items_sha256) == expected[r.doc_id]
        assert sum(s.end - s.start for s in r.spans) == r.n_hit and r.carried.hit == "clash"


def test_one_block_at_a_time(spark, monkeypatch):
    """Of twenty blocks one index is alive at a time, and the plan has no Python stage for each."""
    alive, most = set(), []
    whole = decontaminate.block_index

    def watched(docs, windows, shingle):
        index = whole(docs, windows, shingle)
        alive.add(id(index))
        most.append(len(alive))
        gone = index.destroy
        index.destroy = lambda: (alive.discard(id(index)), gone())
        return index

    monkeypatch.setattr(decontaminate, "block_index", watched)
    items = [(i, " ".join(f"w{i}x{j}" for j in range(40))) for i in range(40)]
    docs = [(i, " ".join(f"w{i}x{j}" for j in range(i, i + 20))) for i in range(30)]
    out = decontaminate.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_bytes=4000)
    assert len(most) >= 20 and max(most) == 1 and not alive
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert {r.doc_id: (r.n_hit, r["items"]) for r in out.collect()} == {i: ((40 - i if i > 20 else 20, [str(i)])) for i in range(30)}


def test_contamination_of_nothing(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contamination(docs, none).where("contaminated").count() == 0
    assert decontaminate.find_contamination(empty(spark), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


# ---- 9 -------------------------------------------------------------------------------------------------------------


def test_kneser_ney_sums_to_one_and_prefers_what_it_knows(spark):
    rnd = random.Random(6)
    text = "".join(rnd.choice("abc ") for _ in range(3000))
    letters = sorted(set(text))
    seen = collections.Counter(text[i : i + 3] for i in range(len(text) - 2))
    seen = {g: n for i, (g, n) in enumerate(sorted(seen.items())) if i % 5}
    asked = {a + b + c for a in letters for b in letters for c in letters}
    rows = spark.createDataFrame([("en", g, seen.get(g, 0)) for g in asked | set(seen)], "lang string, gram string, a long")
    p = {r.gram: np.exp(r.logp) for r in quality.kneser_ney(rows, 3).collect()}
    n_letters = len({g[2] for g in seen})
    for a in letters:
        for b in letters:
            total = sum(p[a + b + c] for c in letters)
            assert 1 - 1 / (n_letters + 1) <= total <= 1 + 1e-9  # the rest is left for unknown characters
    assert all(0 < x <= 1 for x in p.values())


def kneser_ney_by_hand(texts, order):
    """A function of context and character: interpolated modified Kneser-Ney from plain counters."""
    counts = [collections.Counter() for _ in range(order + 1)]
    for text in texts:
        padded = quality.BEGIN * (order - 1) + text + quality.END
        counts[order].update(padded[i : i + order] for i in range(len(padded) - order + 1))
    for n in range(order - 1, 0, -1):
        counts[n].update(gram[1:] for gram in counts[n + 1])
    discounts, contexts = [None], [None]
    for own in counts[1:]:
        c = [sum(v == k for v in own.values()) for k in range(5)]
        y = c[1] / (c[1] + 2 * c[2]) if c[1] + 2 * c[2] else 0.0
        discounts.append([0.0] + [max(0.05 * k, min(0.95 * k, k - (k + 1) * y * (c[k + 1] / c[k] if c[k] else 0.0))) for k in (1, 2, 3)])
        after = collections.defaultdict(list)
        for gram, v in own.items():
            after[gram[:-1]].append(v)
        contexts.append(after)

    def p(n, gram):
        below = p(n - 1, gram[1:]) if n > 1 else 1 / (len(counts[1]) + 1)
        seen = contexts[n].get(gram[:-1])
        if not seen:
            return below
        d = discounts[n]
        return (max(counts[n][gram] - d[min(counts[n][gram], 3)], 0.0) + sum(d[min(v, 3)] for v in seen) * below) / sum(seen)

    return discounts, lambda text: np.exp(-np.mean([np.log(p(order, padded[i : i + order])) for padded in [quality.BEGIN * (order - 1) + text + quality.END] for i in range(len(padded) - order + 1)]))


@pytest.mark.parametrize("chunk_bytes", [3000, 32 << 20])
def test_quality_equals_brute_force(spark, chunk_bytes):
    rnd = random.Random(15)
    rows = [(i, " ".join(rnd.choice(WORDS[lang]) for _ in range(rnd.choice([1, 5, 20]))), lang) for i, lang in enumerate(["en", "fr"] * 100)]
    rows += [(300, "", "en"), (301, None, "fr"), (302, "zzz 漢字", "en"), (None, "the river", "en"), (303, "la pierre " * 3000, "fr")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 7 == 0)) for i in range(0, 200)], "doc_id long, quality int, toxic int")
    trusted = {i for i in range(200) if i % 3 and i % 7}
    got = {r.doc_id: r for r in quality.classify(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), labels, order=3, chunk_bytes=chunk_bytes).collect()}
    limits, of = {}, {}
    for lang in ("en", "fr"):
        of[lang] = kneser_ney_by_hand([t for i, t, own in rows if own == lang and i in trusted and not quality.is_calibration(i)], 3)[1]
        held = sorted(of[lang](t) for i, t, own in rows if own == lang and i in trusted and quality.is_calibration(i))
        limits[lang] = held[int(np.ceil(quality.QUANTILE * len(held))) - 1] * quality.MARGIN
    for i, text, lang in rows:
        r = got[i]
        if not text:
            assert r.perplexity is None and not r.keep
            continue
        own = of[lang](text)
        assert abs(r.perplexity / own - 1) < 1e-6 and abs(r.threshold / limits[lang] - 1) < 1e-6 and r.n_chars == len(text)
        margin = np.log(limits[lang]) + quality.SLACK / len(text) ** 0.5 - np.log(own)
        assert abs(margin) < 1e-6 or r.keep == (margin > 0)


def test_quality(spark):
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice(WORDS["en"]) for _ in range(60)), "en" if i % 2 else None) for i in range(200)]
    rows += [(i, "".join(rnd.choice("qxzwkvj!#@") for _ in range(300)), "en") for i in range(200, 240)] + [(300, None, "en"), (301, "", "en"), (None, "the river", "en"), (1, rows[1][1], "en")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string")).repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 150)] + [(i, 1, 1) for i in range(200, 210)] + [(None, 1, 0), (7, 0, None)], "doc_id long, quality int, toxic int")
    got = quality.classify(df, labels, chunk_bytes=6000, margin=1.15, slack=3.0).collect()
    assert len(got) == len(rows)
    assert all(r.keep for r in got if r.doc_id is not None and r.doc_id < 200) and not any(r.keep for r in got if r.doc_id is not None and r.doc_id >= 200)
    assert {r.lang for r in got} == {"en", "und"}
    assert quality.classify(spark.createDataFrame([], "doc_id long, text string, lang string"), labels).count() == 0
    assert quality.classify(df, labels.limit(0)).where("not keep and n_chars > 0").count() == 0


def test_quality_of_languages_without_labels(spark):
    rnd = random.Random(8)
    good = lambda lang: " ".join(rnd.choice(WORDS[lang]) for _ in range(60))
    rows = [(i, good("en"), "en") for i in range(120)] + [(i, good("fr"), "fr") for i in range(120, 240)]
    rows += [(i, good("en"), lang) for i, lang in enumerate([None, "xx"] * 5, 300)]
    rows += [(i, "".join(rnd.choice("qxzwkvj!#@") for _ in range(300)), lang) for i, lang in enumerate([None, "xx", "yy"] * 5, 400)]
    calibration = next(i for i in range(500, 600) if quality.is_calibration(i))
    rows += [(calibration, "".join(rnd.choice("qxzwkvj!#@") for _ in range(300)), "yy"), (None, good("fr"), None), (700, None, "xx")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(240)] + [(calibration, 1, 0)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = quality.classify(df, labels.where(f"doc_id <> {calibration}"), chunk_bytes=9000, margin=1.15, slack=3.0).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    assert all(r.perplexity > 1.0 for r in got if r.n_chars)
    assert {r.doc_id for r in got if not r.keep} == {*range(400, 415), calibration, 700}
    again = quality.classify(df, labels, chunk_bytes=9000, margin=1.15, slack=3.0).where("lang = 'en'").agg(F.max("threshold")).first()[0]
    assert again == max(r.threshold for r in got if r.lang == "en")


def test_slots():
    rnd = np.random.default_rng(1)
    keys = np.unique(rnd.integers(0, 1 << 63, 5000, np.uint64))
    slots = quality.GramSlots(16)
    for part in np.array_split(rnd.permutation(keys), 7):
        slots.add(part)
    assert np.array_equal(slots.keys[slots.find(keys)], keys) and (slots.find(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)] == -1).all()


# ---- 10 ------------------------------------------------------------------------------------------------------------


def test_token_counts(spark, docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=token_counts.tokenizer_path())
    got = token_counts.count_tokens(clashing(docs), "doc_id", "text", limit=50, with_prefixes=True).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        text = texts[r.doc_id]
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(model.encode(text))) and r.over_limit == (r.n_tokens > 50)
        for at in range(0, min(len(text), 300), 7):
            assert token_counts.tokens_at(r.prefix_steps, at) == len(model.encode(text[:at]))
        assert len(model.encode(text[: r.limit_chars])) <= 50 and (r.limit_chars == len(text) or r.over_limit)
    assert token_counts.count_tokens(empty(spark), "doc_id", "text").count() == 0


def test_token_counts_of_any_text():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=token_counts.tokenizer_path())
    counter, rnd = token_counts.PrefixCounter(token_counts.tokenizer_path(), max_kept=50), random.Random(2)
    letters = "abc the  \n\t12345 éß▁<s></s><unk><0x0A>漢字😀.,;:-ingeration\x00́"
    for _ in range(500):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60)))
        assert int(counter.deltas(text).sum()) == len(model.encode(text)), repr(text)


# ---- the pipeline --------------------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, text, lang, source, len(text)) for i, text, lang, source in random_docs()] + [(i, t, lang, s, None) for i, t, lang, s in ODD]
    rows.append((500, "the stone and the river of that one two three four five six and", "en", "src1", 10))
    spark.createDataFrame(rows, DOCS + ", n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "River of that one two three four five six, and so on.")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "decontamination", "mixing", "sharding"]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert after.columns == docs.columns
        if name == "language_id":
            assert after.where("doc_id in (900, 901, 902, 903)").count() == 0 and after.count() >= docs.count() - 6
        if name == "simhash_near_dedup":
            fps = [simhash_of(r.text) for r in after.where("doc_id is not null and doc_id <> 904").collect()]
            assert min(bin(a ^ b).count("1") for i, a in enumerate(fps) for b in fps[:i]) > 3
        if name == "decontamination":
            assert after.count() == docs.count() - 1 and after.where("doc_id = 500").count() == 0
        if name == "sharding":
            assert after.count() == docs.count()
        docs = after
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
    assert corpus_pipeline.ORACLE_SQL is None


def test_pipeline_keeps_one_row_of_each_group(spark):
    import corpus_pipeline

    long = "x" * 5000
    rows = [(904, long, "en", "src0"), (904, long, "en", "src0"), (904, long, "fr", "src1"), (None, long, "en", "src0"), (7, "the river and the stone", "en", "src0"), (None, "the river and the stone", "en", "src0")]
    rows += [(None, "no number at all", "en", "src2"), (None, "no number at all", "en", "src2"), (None, "no number at all", "en", None), (8, None, "en", "src0"), (9, "", None, "src0"), (None, " ", "en", "src0")]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    kept = sorted(map(tuple, corpus_pipeline.one_of_each_group(spark, df, "").select("doc_id", "text").collect()), key=str)
    assert kept == [(7, "the river and the stone"), (8, None), (904, long), (None, "no number at all")]


def test_pipeline_keeps_clashing_columns(spark, tmp_path):
    import corpus_pipeline

    df = clashing(spark.createDataFrame([(i, t, "en", "src0") for i, t in enumerate(["the river of stone and " * 3, "from that with in to the", None])], DOCS)).withColumn("a b.c", F.lit("clash"))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns, name
        assert all(v == "clash" for r in out.collect() for c, v in r.asDict().items() if c not in ("doc_id", "text", "lang", "source")), name


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], DOCS + ", n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("trial", range(30))
def test_labels_of_links(trial):
    rnd = random.Random(trial)
    n = rnd.randint(1, 60)
    pairs = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(rnd.randint(0, 60))]
    a, b = (np.array([p[i] for p in pairs], np.int64) for i in (0, 1))
    assert dict(enumerate(common.labels_of_links(a, b, n).tolist())) == groups(range(n), pairs)
