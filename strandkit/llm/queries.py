"""The registered queries of the corpus operators, with production parameters, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandkit.llm import alignment, decontaminate, embeddings, language_id, manifest, mixing, quality, shards, simhash, substring_dedup, token_blocks, token_counts, warc
from strandkit.llm.common import scratch_path
from strandkit.llm.encoders import vocabulary_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out():
    """Documents that nothing is learned from; those without an id are among them."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.learn(docs.where(~held_out()), "doc_id", "text", "lang")
    return language_id.identify(docs.select("doc_id", "text", held_out().alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=100)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return done.select("doc_id", n_bytes.alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Sources are to have equal shares, but for two that count double and half.
WEIGHTS = {"src1": 2.0, "src2": 0.5}


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), WEIGHTS)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, bits=3)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = shards.shuffle_into_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), n_shards=24)
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return sharded.select("doc_id", "size", crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_pages(table(spark, sf_dir, "pages"), path)
    back = warc.resolve_revisits(warc.reassemble(warc.read_records(spark, path)))
    return back.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_to_page").cast("long").alias("refers_to"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), "doc_id", "text", token_counts.tokenizer_path("piece_bpe_32k.model"), limit=4096, with_prefixes=True)


def op11_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_blocks.token_table(table(spark, sf_dir, "documents"), "doc_id", "text", vocabulary_path("byte_bpe_50k.json"), end_id=2)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned_documents(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"))


def queries():
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


ORACLES = {
    "op2_suffix_array_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
        c AS (SELECT doc_id, b, substr(x, 2 * b + 1, 1200) AS x FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 99, 500)) AS b FROM d WHERE length(x) >= 200)),
        w AS (SELECT doc_id, b + q AS p, md5(substr(x, 2 * q + 1, 200)) AS k FROM (SELECT doc_id, b, x, unnest(range(0, least(500, length(x) // 2 - 99))) AS q FROM c)),
        f AS (SELECT k, min(doc_id) AS d0, arg_min(p, (doc_id, p)) AS p0 FROM w GROUP BY k HAVING count(*) > 1),
        r AS (SELECT doc_id, p FROM w JOIN f USING (k) WHERE doc_id <> d0 OR p <> p0),
        g AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS step FROM r),
        s AS (SELECT doc_id, p, sum(CASE WHEN step IS NULL OR step > 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM g),
        t AS (SELECT doc_id, run, min(p) AS a, max(p) + 100 AS b FROM s GROUP BY doc_id, run),
        o AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS after FROM t),
        kept AS (SELECT o.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans,
                        string_agg(substr(x, 2 * before + 1, 2 * (a - before)) || CASE WHEN after IS NULL THEN substr(x, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS y
                 FROM o JOIN d USING (doc_id) GROUP BY o.doc_id)
        SELECT d.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(y, x))) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)
    """,
    "op3_mixing": """
        WITH b AS (SELECT source, sum(octet_length(encode(coalesce(text, '')))) AS bytes FROM documents GROUP BY source),
        w AS (SELECT source, CAST(bytes AS DOUBLE) AS bytes, CASE WHEN bytes = 0 THEN 0.0 WHEN source = 'src1' THEN 2.0 WHEN source = 'src2' THEN 0.5 ELSE 1.0 END::DOUBLE AS weight FROM b),
        r AS (SELECT source, CASE WHEN bytes > 0 THEN weight / sum(weight) OVER () * sum(bytes) OVER () / bytes ELSE 0.0 END AS rate FROM w),
        m AS (SELECT source, parts, rate / parts AS mean FROM (SELECT *, greatest(CAST(ceil(rate / 65536) AS BIGINT), 1) AS parts FROM r)),
        l AS (SELECT *, CAST(greatest(floor(mean - 12 * sqrt(mean) - 30), 0) AS BIGINT) AS low, CASE WHEN mean > 0 THEN CAST(ceil(mean + 12 * sqrt(mean) + 30) AS BIGINT) ELSE 0 END AS high FROM m),
        k AS (SELECT *, unnest(range(low, high + 1)) AS k FROM l),
        f AS (SELECT *, exp(sum(CASE WHEN k > low THEN ln(mean) - ln(CAST(k AS DOUBLE)) ELSE 0 END) OVER (PARTITION BY source ORDER BY k)) AS term FROM k),
        c AS (SELECT source, sum(term) OVER (PARTITION BY source ORDER BY k) / sum(term) OVER (PARTITION BY source) AS cdf FROM f),
        p AS (SELECT documents.source, low, doc_id, unnest(range(0, parts)) AS part FROM documents JOIN l ON documents.source IS NOT DISTINCT FROM l.source),
        u AS (SELECT *, CAST(('0x' || substr(md5('17:' || CAST(doc_id AS VARCHAR) || CASE WHEN part > 0 THEN ':' || CAST(part AS VARCHAR) ELSE '' END), 1, 12)) AS BIGINT) / 281474976710656.0::DOUBLE AS u FROM p),
        g AS (SELECT doc_id, part, low, count(cdf) AS steps FROM u LEFT JOIN c ON u.source IS NOT DISTINCT FROM c.source AND cdf <= u GROUP BY doc_id, part, low),
        n AS (SELECT doc_id, CAST(sum(low + steps) AS BIGINT) AS n FROM g GROUP BY doc_id)
        SELECT doc_id, text, lang, source, n_chars, copy, n AS n_copies, md5('order17:' || CAST(doc_id AS VARCHAR) || ':' || CAST(copy AS VARCHAR)) AS shuffle_key
        FROM (SELECT documents.*, n, unnest(range(0, n)) AS copy FROM documents JOIN n USING (doc_id) WHERE n > 0)
    """,
    "op6_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
             f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
               CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to
        FROM p LEFT JOIN f USING (d)
    """,
    "op7_embedding_dedup": """
        WITH RECURSIVE u AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
                 WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.98),
        reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
        low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
        SELECT e.vec_id, (SELECT count(*) FROM link WHERE link.a = e.vec_id) AS n_links, low.component_id, e.vec_id = low.component_id AS kept
        FROM embeddings e JOIN low ON low.a = e.vec_id
    """,
    "op8_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS k
                FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM i WHERE len(w) > 0)),
        lens AS (SELECT DISTINCT n FROM win),
        g AS (SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)),
        m AS (SELECT doc_id, g.n, s, item_id FROM g JOIN win ON g.k = win.k AND g.n = win.n),
        h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM m)) GROUP BY doc_id),
        t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
    """,
}


def _tree_sql(name: str, depth: int) -> str:
    """CTEs over {name}0(tree, no, n, h): the levels {name}1, ... of 16 nodes a node, and {name}s0, ...: what stands before and behind a node in its run."""
    levels = [f"{name}{k + 1} AS (SELECT tree, no // 16 AS no, (n + 15) // 16 AS n, sha256(string_agg(h, '' ORDER BY no)) AS h FROM {name}{k} WHERE n > 1 GROUP BY tree, no // 16, n)" for k in range(depth)]
    around = [
        f"{name}s{k} AS (SELECT x.tree, x.no, coalesce(string_agg(y.h, '' ORDER BY y.no) FILTER (y.no < x.no), '') AS bef, coalesce(string_agg(y.h, '' ORDER BY y.no) FILTER (y.no > x.no), '') AS aft FROM {name}{k} x JOIN {name}{k} y ON x.tree = y.tree AND x.no // 16 = y.no // 16 WHERE x.n > 1 GROUP BY x.tree, x.no)"
        for k in range(depth)
    ]
    return ", ".join([*levels, *around])


def _climb_sql(name: str, depth: int, source: str, out: str, keep: str) -> str:
    """CTEs that carry {source}(tree, no, proof, fold) up the levels, as {out}."""
    steps = []
    for k in range(depth):
        steps.append(f"{out}{k} AS (SELECT x.* EXCLUDE (proof, fold), proof || coalesce(bef || aft, '') AS proof, CASE WHEN bef IS NULL THEN fold ELSE sha256(bef || fold || aft) END AS fold FROM {source if k == 0 else f'{out}{k - 1}'} x LEFT JOIN {name}s{k} s ON s.tree = x.tree AND s.no = x.no // {16**k})")
    return ", ".join([*steps, f"{out} AS (SELECT {keep} FROM {out}{depth - 1})"])


def manifest_sql(depth: int = 5, top_depth: int = 3) -> str:
    """The manifest of documents by levels written out, enough of them for 16^depth rows of a source and 16^top_depth sources."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc_table = "(SELECT list_transform(range(0, 256), lambda i: list_reduce(list_concat([i], range(0, 8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)))"
    crc = "xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))), lambda c, b: xor(t.crcs[(xor(c, b) % 256) + 1], c // 256)))"
    return f"""
        WITH t AS (SELECT {crc_table} AS crcs),
        d AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 THEN {leaf(lowered)} ELSE {leaf('text')} END AS given FROM documents, t),
        o AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS no, count(*) OVER (PARTITION BY source) AS n FROM d),
        a0 AS (SELECT tree, no, n, leaf AS h FROM o), {_tree_sql('a', depth)},
        sub AS ({' UNION ALL '.join(f'SELECT tree, h FROM a{k} WHERE n = 1' for k in range(depth + 1))}),
        b0 AS (SELECT 0 AS tree, tree AS no, count(*) OVER () AS n, h FROM sub), {_tree_sql('b', top_depth)},
        root AS ({' UNION ALL '.join(f'SELECT h FROM b{k} WHERE n = 1' for k in range(top_depth + 1))}),
        start AS (SELECT doc_id, leaf, tree, no, '' AS proof, given AS fold FROM o), {_climb_sql('a', depth, 'start', 'up', 'doc_id, leaf, tree AS of, 0 AS tree, tree AS no, proof, fold')},
        {_climb_sql('b', top_depth, 'up', 'whole', '*')}
        SELECT doc_id, leaf, sub.h AS subroot, root.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root.h AS verified
        FROM whole JOIN sub ON sub.tree = whole.of, root
    """


ORACLES["op13_manifest"] = manifest_sql()


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
