"""Language identification by known words, backing off to character n-grams for the others."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandkit.llm.common import checkpoint, map_batches, sliced

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*").findall
UNDETERMINED = "und"


@dataclass(frozen=True)
class Limits:
    """Bounds of the sample that is learned from, of which all words and n-grams are kept; so they bound the model, whatever the number of languages.

    bytes_per_lang: text of a language, about so much, in documents chosen by a hash of id and text. sample_bytes: of all
    languages together, shared evenly. longest: length of the longest n-gram. smoothing: added to each count.
    """

    bytes_per_lang: int = 2 << 20
    sample_bytes: int = 16 << 20
    longest: int = 4
    smoothing: float = 0.5


def _grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def sampled(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, limits: Limits) -> DataFrame:
    """Rows of each language with about as many bytes as the limits allow, by a threshold on a hash of id and text: no sort, no row limit."""
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1
    sizes = checkpoint(labelled.groupBy(lang_col).agg(F.sum(size).alias("bytes_of_lang")))
    n_langs = sizes.count()
    per_lang = min(limits.bytes_per_lang, limits.sample_bytes / max(1, n_langs))
    share = F.pmod(F.xxhash64(F.lit("learn"), F.col(id_col).cast("string"), text_col), F.lit(1 << 40)) / float(1 << 40)
    if n_langs <= 10_000:  # beyond that a shuffled join, which splits skewed ones
        sizes = F.broadcast(sizes)
    return labelled.join(sizes, lang_col).where(share * F.col("bytes_of_lang") < per_lang).drop("bytes_of_lang")


def _counted(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["lang", "length", "feature", "n"])


FEATURES = "lang string, length int, feature string, n long"


def count_features(labelled: DataFrame, text_col: str, lang_col: str, limits: Limits) -> DataFrame:
    """Rows (lang, length, feature, n): length 0 for words, else that of the n-gram.

    Words are counted in the texts, n-grams in the counted words, each of which stands for all its occurrences.
    """

    def words_in(batch):
        counts: dict[str, Counter] = {}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts.setdefault(lang, Counter()).update(WORD(text.lower()))
        return _counted([(lang, 0, x, n) for lang, own in counts.items() for x, n in own.items()])

    def grams_in(batch):
        counts: dict[tuple[str, int], Counter] = {}
        for lang, word, times in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
            for n in range(1, limits.longest + 1):
                own = counts.setdefault((lang, n), Counter())
                for gram in _grams(word, n):
                    own[gram] += times
        return _counted([(lang, n, x, k) for (lang, n), own in counts.items() for x, k in own.items()])

    total = lambda df: df.groupBy("lang", "length", "feature").agg(F.sum("n").alias("n"))
    words = checkpoint(total(map_batches(labelled.select(text_col, lang_col), words_in, FEATURES)))
    return words.unionByName(total(map_batches(words, grams_in, FEATURES, rows=20_000)))


class Model:
    """Log frequencies per language of words and n-grams, relative to the mean over languages.

    A language without a feature has the smoothed log frequency of an unseen one, its base; a feature only stores the languages that have it
    and by how much they exceed their base. So the model grows with the counts, not with features times languages.
    """

    def __init__(self, features: pa.Table, limits: Limits):
        self.longest = limits.longest
        order = features.sort_by([("length", "ascending"), ("feature", "ascending")])
        lang, length = order.column("lang").combine_chunks().dictionary_encode(), order.column("length").to_numpy()
        self.langs = sorted(lang.dictionary.to_pylist())
        n_langs, numbers = len(self.langs), {x: i for i, x in enumerate(self.langs)}
        self.which = np.array([numbers[x] for x in lang.dictionary.to_pylist()], np.int32)[lang.indices.to_numpy()] if len(order) else np.zeros(0, np.int32)
        counts = order.column("n").to_numpy().astype(np.float64)
        self.excess = np.log1p(counts / limits.smoothing).astype(np.float32)
        self.place: list[dict[str, int]] = []  # of a feature among all
        starts, base, begin = [np.zeros(0, np.int64)], [], 0
        for n in range(limits.longest + 1):
            rows = np.flatnonzero(length == n)
            code = order.column("feature").take(pa.array(rows)).combine_chunks().dictionary_encode()
            starts.append(rows[np.unique(code.indices.to_numpy(), return_index=True)[1]])
            totals = np.bincount(self.which[rows], counts[rows], n_langs) if n_langs else np.zeros(0)
            unseen = np.log(limits.smoothing / (totals + limits.smoothing * (len(code.dictionary) + 1)))
            base.append(unseen - unseen.mean() if n_langs else unseen)
            self.place.append(dict(zip(code.dictionary.to_pylist(), range(begin, begin + len(code.dictionary)))))
            begin += len(code.dictionary)
        self.base, self.starts = np.array(base), np.r_[np.concatenate(starts), len(order)]
        self.keep()

    def keep(self, max_kept: int = 150_000, most_bytes: int = 48 << 20) -> None:
        """Start without scored words; up to max_kept of them will be kept, fewer if there are many languages."""
        self.max_kept, self.kept = min(max_kept, most_bytes // (4 * max(1, len(self.langs)))), {}
        self.rows = np.zeros((0, len(self.langs)), np.float32)

    def state(self) -> tuple:
        """The model as plain data, which needs no class to be read."""
        return self.longest, self.langs, self.place, self.base, self.starts, self.which, self.excess

    @classmethod
    def of_state(cls, state: tuple) -> Model:
        model = cls.__new__(cls)
        model.longest, model.langs, model.place, model.base, model.starts, model.which, model.excess = state
        model.keep()
        return model

    def _means(self, n: int, features: list[int], sizes: np.ndarray) -> np.ndarray:
        """For runs of so many features of length n: the mean of their log frequencies, relative to the mean over languages."""
        first, n_langs = self.starts[features], len(self.langs)
        counts = self.starts[np.array(features) + 1] - first
        at = np.repeat(first - (counts.cumsum() - counts), counts) + np.arange(counts.sum())
        run = np.repeat(np.repeat(np.arange(len(sizes)), sizes), counts)
        excess = self.excess[at].astype(np.float64)
        summed = np.bincount(run * n_langs + self.which[at], excess, len(sizes) * n_langs).reshape(len(sizes), n_langs)
        return self.base[n] + (summed - summed.mean(1, keepdims=True)) / sizes[:, None]

    def _score(self, words: list[str]) -> np.ndarray:
        """Scores of words: of a known one its own; else the mean of its longest n-grams of which any is known; else zeros."""
        out = np.zeros((len(words), len(self.langs)))
        known = self.place[0]
        at = [i for i, w in enumerate(words) if w in known]
        if at:
            out[at] = self._means(0, [known[words[i]] for i in at], np.ones(len(at), np.int64))
        left = [i for i, w in enumerate(words) if w not in known]
        for n in range(self.longest, 0, -1):
            place, flat, sizes, at, unknown = self.place[n], [], [], [], []
            for i in left:
                word = f"<{words[i]}>"
                if found := [place[g] for j in range(len(word) - n + 1) if (g := word[j : j + n]) in place]:
                    flat += found
                    sizes.append(len(found))
                    at.append(i)
                else:
                    unknown.append(i)
            if at:
                out[at] = self._means(n, flat, np.array(sizes))
            left = unknown
        return out

    def _rows_of(self, words: list[str]) -> np.ndarray:
        """Scores of words one by one; those of max_kept words are kept for the next time."""
        kept = self.kept
        new = list({w for w in words if w not in kept})
        if len(kept) + len(new) > self.max_kept:
            kept.clear()
            self.rows = self.rows[:0]
            new = list(set(words))
        if new:
            kept.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
            self.rows = np.concatenate([self.rows, self._score(new).astype(np.float32)])
        return self.rows[[kept[w] for w in words]]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """For each text the best language, the first of equals, and its share of the probability under even priors."""
        out: list[tuple[str, float]] = []
        for at in range(0, len(texts), 64):
            lists = [WORD(t.lower()) if t else [] for t in texts[at : at + 64]]
            words = [w for own in lists for w in own]
            total = np.zeros((len(lists), len(self.langs)))
            ends = np.cumsum([len(own) for own in lists])
            for start in range(0, len(words), 100_000):
                scores = self._rows_of(words[start : start + 100_000])
                doc = np.searchsorted(ends, np.arange(start, start + len(scores)), "right")
                first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
                total[doc[first]] += np.add.reduceat(scores, first, dtype=np.float64)
            for own, score in zip(lists, total):
                if not own or not self.langs:
                    out.append((UNDETERMINED, 0.0))
                else:
                    best = int(score.argmax())
                    out.append((self.langs[best], float(1 / np.exp(np.clip(score - score[best], -700, 0)).sum())))
        return out


def learn(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, limits: Limits = Limits()) -> Model:
    """A model from the rows with a text and a language. What reaches the driver are the features of the sample, bounded by the limits."""
    usable = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return Model(count_features(sampled(usable, "id", "text", "lang", limits), "text", "lang", limits).toArrow(), limits)


def predicted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Rows (row, lang_pred, score): the documents as structs, so that no name can clash, and what identify says of them."""
    shared = docs.sparkSession.sparkContext.broadcast(model.state())

    def run(batches):
        predict = Model.of_state(shared.value).predict
        for batch in sliced(batches):
            found = predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["row", "lang_pred", "score"])

    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([source.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return source.mapInArrow(run, schema)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents with lang_pred and score added, replacing columns of these names.

    Only the text is used, all of it: A document's score is the sum over its words, word by word from the table of
    known words, else from the longest known n-grams. Null texts and texts without a letter give `und` and 0, as
    does a model that has learned nothing. Ties take the first language by name; repeated rows get equal
    predictions; an empty table gives no rows. One narrow pass; the model, bounded by its limits, is broadcast.
    """
    given = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    return predicted(docs, model, text_col).select(*[F.col(f"row.`{c}`") for c in given], "lang_pred", "score")
