"""A quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandkit.llm.common import checkpoint, freed_shuffles, repeated, scratch_path, with_times

BEGIN, END = "\x02", "\x03"
UNKNOWN_LANG = "und"
#: Names the model of the trusted text of all languages, which scores languages that have none of their own.
POOLED = "\x02all"
#: A language's threshold is this quantile of the perplexities held back, times a margin; slack is for short texts. Held
#: out by halves, this keeps 98 to 100 % of the trusted French and Spanish documents of the test tables and 11 % of those of
#: low quality; a margin of 1.15 and a slack of 3 kept 100 % and 17 %. Orders 5 and 6 kept as many.
QUANTILE, MARGIN, SLACK = 0.99, 1.0, 1.0


class GramSlots:
    """A growing set of 64-bit hashes with open addressing, looked up for whole arrays at a time."""

    def __init__(self, n: int = 1 << 16):
        self.keys, self.bits = np.zeros(0, np.uint64), 0
        self._build(self.keys, n)

    def _build(self, keys: np.ndarray, n: int) -> None:
        self.bits = int(n - 1).bit_length()
        self.slot = np.full(1 << self.bits, -1, np.int32)
        self.keys = keys
        self._place(np.arange(len(keys)))

    def _place(self, at: np.ndarray) -> None:
        place = (self.keys[at] >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(at):
            free = self.slot[place] < 0
            self.slot[place[free]] = at[free]
            left = self.slot[place] != at
            at, place = at[left], place[left] + 1 & (1 << self.bits) - 1

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, in order of insertion; -1 for those that are not in the set."""
        if not len(self.keys):
            return np.full(len(hashes), -1, np.int32)
        place = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.slot[place]
        open_ = np.flatnonzero((out >= 0) & (self.keys[out] != hashes))
        while len(open_):
            place[open_] = place[open_] + 1 & (1 << self.bits) - 1
            out[open_] = self.slot[place[open_]]
            open_ = open_[(out[open_] >= 0) & (self.keys[out[open_]] != hashes[open_])]
        return out

    def add(self, new: np.ndarray) -> None:
        """Insert distinct hashes that are not in the set."""
        keys = np.r_[self.keys, new]
        if 2 * len(keys) > len(self.slot):
            self._build(keys, 4 * len(keys))
        else:
            at = np.arange(len(self.keys), len(keys))
            self.keys = keys
            self._place(at)


def gram_hashes(codes: np.ndarray, order: int) -> np.ndarray:
    """A hash of the `order` characters from each position."""
    factors = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 63, order, np.uint64) * np.uint64(2) + np.uint64(1)
    n = len(codes) - order + 1
    h = np.zeros(n, np.uint64)
    for i in range(order):
        h += (codes[i : i + n].astype(np.uint64) + np.uint64(1)) * factors[i]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ h >> np.uint64(29)


def _blocks(texts: list[str], order: int, size: int = 1 << 20):
    """(first text, characters, start of each text's grams, number of its grams) for runs of texts of about that size."""
    at = 0
    while at < len(texts):
        to, total = at, 0
        while to < len(texts) and (to == at or total + len(texts[to]) < size):
            total += len(texts[to])
            to += 1
        text = "".join(f"{BEGIN * (order - 1)}{t}{END}" for t in texts[at:to])
        counts = np.array([len(t) + 1 for t in texts[at:to]])
        yield at, text, np.r_[0, (counts + order - 1).cumsum()[:-1]], counts
        at = to


def _own_grams(text: str, begins: np.ndarray, counts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the grams that lie within one text, and their hashes."""
    h = gram_hashes(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), order)
    place = np.repeat(begins - np.r_[0, counts.cumsum()[:-1]], counts) + np.arange(counts.sum())
    return place, h[place]


def is_calibration(doc_id: object) -> bool:
    """Trusted documents that are not learned from; the thresholds come from them."""
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def _by_lang(table: pa.Table) -> dict[str, tuple[list[int], list[str]]]:
    """The places and texts of the rows of each language."""
    out: dict[str, tuple[list, list[str]]] = {}
    for i, (lang, text) in enumerate(zip(table.column("lang").to_pylist(), table.column("text").to_pylist())):
        rows, texts = out.setdefault(lang, ([], []))
        rows.append(i)
        texts.append(text or "")
    return out


def gram_counts(chunks: DataFrame, trusted: DataFrame, order: int) -> DataFrame:
    """Rows (chunk, lang, gram, n): the distinct grams of a chunk and how often its trusted documents have them."""

    def run(key, docs, labels):
        known = {x for x in labels.column("id").to_pylist() if not is_calibration(x)}
        times, good = docs.column("times").to_numpy(), docs.column("good").to_pylist()
        langs, grams, numbers = [], [], []
        for lang, (rows, texts) in _by_lang(docs).items():
            slots, count, names = GramSlots(), np.zeros(0, np.int64), []
            ids = docs.column("id").take(pa.array(rows)).to_pylist()
            weight = np.array([times[r] if (good[r] and not is_calibration(i) or i in known) else 0 for r, i in zip(rows, ids)], np.int64)
            for at, text, begins, counts in _blocks(texts, order):
                place, h = _own_grams(text, begins, counts, order)
                new, first = np.unique(h[slots.find(h) < 0], return_index=True)
                where = place[slots.find(h) < 0][first].tolist()
                slots.add(new)
                names += [text[p : p + order] for p in where]
                count = np.r_[count, np.zeros(len(new), np.int64)]
                each = np.repeat(weight[at : at + len(counts)], counts)
                mine = np.flatnonzero(each)
                np.add.at(count, slots.find(h[mine]), each[mine])
            langs += [lang] * len(names)
            grams += names
            numbers.append(count)
        numbers = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        return pa.table({"chunk": pa.array([key[0].as_py()] * len(grams), pa.int64()), "lang": pa.array(langs, pa.string()), "gram": pa.array(grams, pa.string()), "n": pa.array(numbers)})

    return chunks.groupBy("chunk").cogroup(trusted.groupBy("chunk")).applyInArrow(run, "chunk long, lang string, gram string, n long")


#: So many languages at most are joined by broadcast: a row of some numbers each.
FEW_LANGS = 10_000


def kneser_ney(counted: DataFrame, order: int, few_langs: bool = False) -> DataFrame:
    """Rows (lang, gram, logp) for all grams of counted(lang, gram, a), a the count in trusted text, 0 for unseen ones.

    Interpolated modified Kneser-Ney: the highest order has the counts, a lower one the number of distinct characters
    before a gram; three discounts per order and language come from the counts of counts. The tables are joined on
    grams and contexts, which deal them to shards; a context's numbers are summed before the shuffle. With few_langs the discounts,
    a row for each language, are broadcast, so that no gram is dealt by its language alone.
    """
    seen = counted.where("a > 0").select("lang", "gram", "a")
    levels = {order: seen}
    for n in range(order - 1, 0, -1):
        levels[n] = levels[n + 1].groupBy("lang", F.expr(f"substr(gram, 2, {n})").alias("gram")).agg(F.count("*").alias("a"))
    asked = {order: counted.select("lang", "gram")}
    for n in range(order - 1, 0, -1):
        asked[n] = asked[n + 1].select("lang", F.expr(f"substr(gram, 2, {n})").alias("gram")).distinct()
    lower = None
    for n in range(1, order + 1):
        level = levels[n]
        c = [F.count_if(F.col("a") == k).cast("double") for k in (1, 2, 3, 4)]
        ratio = lambda x, y: F.when(y > 0, x / F.when(y > 0, y)).otherwise(0.0)
        discounts = level.groupBy("lang").agg(*[x.alias(f"c{k}") for k, x in enumerate(c, 1)], F.count("*").alias("kinds"))
        y = ratio(F.col("c1"), F.col("c1") + 2 * F.col("c2"))
        bounded = lambda d, k: F.greatest(F.lit(0.05 * k), F.least(d, F.lit(0.95 * k)))
        discounts = discounts.select("lang", "kinds", *[bounded(k - (k + 1) * y * ratio(F.col(f"c{k + 1}"), F.col(f"c{k}")), k).alias(f"d{k}") for k in (1, 2, 3)])
        contexts = level.groupBy("lang", F.expr(f"substr(gram, 1, {n - 1})").alias("context")).agg(F.sum("a").alias("total"), *[F.count_if(F.col("a") == k if k < 3 else F.col("a") >= 3).alias(f"k{k}") for k in (1, 2, 3)])
        rows = asked[n].withColumn("context", F.expr(f"substr(gram, 1, {n - 1})")).join(level, ["lang", "gram"], "left").join(contexts, ["lang", "context"], "left").join(F.broadcast(discounts) if few_langs else discounts, "lang", "left")
        if n == 1:
            below = rows.withColumn("below", 1.0 / (F.coalesce("kinds", F.lit(0)) + 1))
        else:
            below = rows.withColumn("shorter", F.expr(f"substr(gram, 2, {n - 1})")).join(lower.select("lang", F.col("gram").alias("shorter"), F.col("p").alias("below")), ["lang", "shorter"])
        a = F.coalesce("a", F.lit(0))
        discount = F.when(a == 0, 0.0).when(a == 1, F.col("d1")).when(a == 2, F.col("d2")).otherwise(F.col("d3"))
        freed = F.col("d1") * F.col("k1") + F.col("d2") * F.col("k2") + F.col("d3") * F.col("k3")
        p = F.when(F.col("total").isNull(), F.col("below")).otherwise((a - discount + freed * F.col("below")) / F.col("total"))
        lower = below.select("lang", "gram", p.alias("p"))
    return lower.select("lang", "gram", F.log("p").alias("logp"))


def perplexities_of(docs: pa.Table, replies: pa.Table, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Characters and perplexity (nan without any) of each row, from the log probabilities of all grams of the chunk."""
    n_chars, perplexity = np.zeros(docs.num_rows, np.int64), np.full(docs.num_rows, np.nan)
    of_lang, logs = replies.column("lang").combine_chunks().dictionary_encode(), replies.column("logp").to_numpy().astype(np.float64)
    codes, known = of_lang.indices.to_numpy(), {x: i for i, x in enumerate(of_lang.dictionary.to_pylist())}
    for lang, (rows, texts) in _by_lang(docs).items():
        at = np.flatnonzero(codes == known.get(lang, -1))
        grams = "".join(replies.column("gram").take(pa.array(at)).to_pylist())
        slots = GramSlots(max(1 << 16, 4 * len(at)))
        slots.add(gram_hashes(np.frombuffer(grams.encode("utf-32-le", "surrogatepass"), np.uint32), order)[::order])
        own = logs[at]
        for first, text, begins, counts in _blocks(texts, order):
            values = own[slots.find(_own_grams(text, begins, counts, order)[1])]
            mean = np.add.reduceat(values, np.r_[0, counts.cumsum()[:-1]]) / counts
            where = np.array(rows[first : first + len(counts)])
            n_chars[where] = counts - 1
            perplexity[where] = np.where(counts > 1, np.exp(-mean), np.nan)
    return n_chars, perplexity


def perplexities(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = 4, chunk_bytes: int = 32 << 20) -> DataFrame:
    """Rows (id, lang, n_chars, perplexity, trusted, calibration, pooled, times), times the number of rows that it stands for.

    A language of which nothing was learned is scored by a model of the trusted text of all languages, marked as pooled. If
    there is any, the calibration documents come a second time, with the language POOLED and their scores under that model.

    The documents are dealt to chunks of about chunk_bytes by a hash of the id, to which the labels go, too. A chunk counts its
    grams; their sums over chunks are joined, shard by shard of language and gram, to contexts and shorter grams, which
    makes the model and the log probability of each gram of the corpus. Each chunk is sent those of its own grams and
    scores its documents. So no task and not the driver ever holds the model, and what is shuffled is the texts,
    once for the counts and once for the scores, and the distinct grams of each chunk. The counts are written to
    the shared folder.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(lang_col), F.lit(UNKNOWN_LANG)).alias("lang"), F.col(text_col).alias("text"))
    total = base.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n_chunks = F.lit(max(1, -(-total // chunk_bytes)))
    good = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).where("q = 1 and t = 0").select("id")
    trusted = good.select(F.pmod(F.xxhash64(F.lit(2), "id"), n_chunks).alias("chunk"), "id")
    base, any_hot = with_times(base, "id", "text", chunk_bytes)
    rows = base.where("not hot").withColumn("good", F.lit(None).cast("boolean"))
    if any_hot:  # these are not where their labels are
        rows = rows.unionByName(base.where("hot").join(good.withColumn("good", F.lit(True)), "id", "left"))
    chunks = rows.select(F.pmod("key", n_chunks).alias("chunk"), "id", "lang", "text", "times", "good")
    path = scratch_path(spark, "grams")
    with freed_shuffles(spark):
        gram_counts(chunks, trusted, order).write.option("compression", "zstd").parquet(path)
        counted = spark.read.parquet(path)
        summed = checkpoint(counted.groupBy("lang", "gram").agg(F.sum("n").alias("a")))
        learned = checkpoint(summed.groupBy("lang").agg((F.max("a") > 0).alias("learned")))
        few = learned.count() < FEW_LANGS
        sent = F.broadcast if few else lambda df: df
        if learned.where("not learned").count():
            held_back = trusted.where(F.crc32(F.col("id").cast("string")) % 5 == 0).select("id")
            again = chunks.join(held_back, "id", "left_semi").withColumn("lang", F.lit(POOLED))
            path = scratch_path(spark, "pooled-grams")
            gram_counts(again, trusted.limit(0), order).write.option("compression", "zstd").parquet(path)
            chunks = chunks.unionByName(again)
            own = F.when(F.col("learned"), F.col("lang")).otherwise(F.lit(POOLED)).alias("lang")
            counted = counted.join(sent(learned), "lang").select("chunk", "lang", own.alias("model"), "gram").unionByName(spark.read.parquet(path).select("chunk", "lang", F.col("lang").alias("model"), "gram"))
            whole = summed.where("a > 0").select(F.lit(POOLED).alias("lang"), "gram", "a")
            asked = counted.where(F.col("model") == POOLED).select(F.col("model").alias("lang"), "gram", F.lit(0).cast("long").alias("a"))
            kept = summed.join(sent(learned.where("learned")), "lang", "left_semi").select("lang", "gram", "a")
            summed = checkpoint(kept.unionByName(whole.unionByName(asked).groupBy("lang", "gram").agg(F.sum("a").alias("a"))))
        else:
            counted = counted.withColumn("model", F.col("lang"))
        model = checkpoint(kneser_ney(summed, order, few).withColumnRenamed("lang", "model"))
    replies = counted.join(model, ["model", "gram"]).select("chunk", "lang", "gram", F.col("logp").cast("float").alias("logp"), F.lit(None).cast("long").alias("id"))
    replies = replies.unionByName(trusted.select("chunk", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("gram"), F.lit(None).cast("float").alias("logp"), "id"))

    def back(key, left, right):
        labelled = pc.is_valid(right.column("id"))
        good = pc.or_(pc.fill_null(left.column("good"), False), pc.is_in(left.column("id"), value_set=right.filter(labelled).column("id").combine_chunks(), skip_nulls=True))
        n_chars, perplexity = perplexities_of(left, right.filter(pc.invert(labelled)), order)
        return pa.Table.from_arrays([left.column("id"), left.column("lang"), pa.array(n_chars), pa.array(perplexity, mask=np.isnan(perplexity)), good, left.column("times")], names=["id", "lang", "n_chars", "perplexity", "trusted", "times"])

    scored = chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(back, "id long, lang string, n_chars long, perplexity double, trusted boolean, times long")
    marked = scored.join(sent(learned), "lang", "left").withColumn("pooled", ~F.coalesce("learned", F.lit(False))).drop("learned")
    marked = marked.join(F.broadcast(learned.agg(F.coalesce(F.bool_or("learned"), F.lit(False)).alias("any")))).withColumn("perplexity", F.when(F.col("any"), F.col("perplexity"))).drop("any")
    return marked.withColumn("calibration", F.col("trusted") & (F.crc32(F.col("id").cast("string")) % 5 == 0))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = 4, quantile: float = QUANTILE, margin: float = MARGIN, slack: float = SLACK, **more) -> DataFrame:
    """Documents with the perplexity of their text under a model of trusted text of their language, and whether to keep them.

    Trusted are documents labelled with quality 1 and not as toxic. A fifth of them, by a hash of the id, is not learned
    from; a language's threshold is margin times the given quantile of its perplexities, or of those of all languages
    where it has none. A language of which nothing was learned is scored by a model of all trusted text, and judged by the
    perplexities that the same fifth of all languages has under that model. A text of n characters may exceed it by the factor exp(slack / sqrt(n)), as the mean over few
    characters says little. Without any document to learn from there are no perplexities and no threshold, and all texts are kept.

    Returns the id, lang (null as `und`, which is a language like others), n_chars, perplexity per character, threshold and
    keep. Null and empty texts have no perplexity and are not kept. Ids must be numbers, or texts that are; null ids are never trusted; repeated rows are
    scored alike; of several labels of a document the highest counts; an empty table gives no rows; other columns are not read.
    """
    with freed_shuffles(docs.sparkSession):
        scored = checkpoint(repeated(perplexities(docs, labels, id_col, text_col, lang_col, order, **more), "times", "number"))
    trusted = scored.where(F.col("calibration") & F.col("perplexity").isNotNull() & (~F.col("pooled") | (F.col("lang") == POOLED)))
    limit = lambda: (F.percentile_approx("perplexity", F.lit(quantile), F.lit(10_000)) * F.lit(margin))
    per_lang = checkpoint(trusted.groupBy(F.col("lang").alias("judge")).agg(limit().alias("own")))
    per_lang = F.broadcast(per_lang) if per_lang.count() <= FEW_LANGS else per_lang
    overall = trusted.where(~F.col("pooled")).agg(limit().alias("all"))
    rows = scored.where(F.col("lang") != POOLED).withColumn("judge", F.when(F.col("pooled"), F.lit(POOLED)).otherwise(F.col("lang")))
    joined = rows.join(F.broadcast(overall)).join(per_lang, "judge", "left").withColumn("threshold", F.coalesce("own", "all"))
    keep = (F.col("n_chars") > 0) & F.coalesce(F.log("perplexity") <= F.log("threshold") + slack / F.sqrt(F.greatest("n_chars", F.lit(1))), F.lit(True))
    return joined.select(F.col("id").alias(id_col), "lang", "n_chars", "perplexity", "threshold", keep.alias("keep"))
