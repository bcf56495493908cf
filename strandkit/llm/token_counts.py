"""Token counts by prefix dynamic programming over a BPE vocabulary with byte fallback."""

from __future__ import annotations

import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from strandkit.llm.common import sliced

SPACE = "▁"


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    """The place of a vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


class PrefixCounter:
    """Exact token counts of all prefixes of a text, without encoding any of them.

    In BPE the encoding of a prefix that ends in token t is the encoding of what stands before t, followed by t,
    and exactly one t is possible: the one that the merges don't change when it follows the token before it.
    So count[i] = count[i - len(t)] + 1, which one pass over the text finds. No piece holds a space after
    another character, nor a character outside the vocabulary, (nor, as a rule, both letters and others), so the passes of
    separate units are independent, and frequent units are kept with their counts, max_kept of them at most.
    """

    def __init__(self, model_file: str, max_kept: int = 500_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        self.score = {model.id_to_piece(i): model.get_score(i) for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
        if any(SPACE in piece.lstrip(SPACE) for piece in self.score):
            raise ValueError("a piece holds a space after another character")
        self.reach: dict[str, int] = {}  # length of the longest piece that ends in three given characters
        for piece in self.score:
            self.reach[piece[-3:]] = max(len(piece), self.reach.get(piece[-3:], 2))
        self.pieces = list(self.score)
        self.number = {piece: i for i, piece in enumerate(self.pieces)}
        self.max_kept = max_kept
        self.kept: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}  # by left number << 20 | right number
        mixes = regex.compile(r"\p{L}[^\p{L}▁]|[^\p{L}▁]\p{L}").search
        if any(map(mixes, self.score)) or "\n" in "".join(self.score):
            self.units = regex.compile("▁+[^▁]*|[^▁]+").findall
        else:
            self.units = regex.compile(r"▁*\p{L}+|▁+[^\p{L}▁\n]*|[^\p{L}▁\n]+|\n").findall

    def stays(self, key: int) -> bool:
        """Whether the two pieces of a key, one after the other, are encoded as just these two tokens."""
        if len(self.pairs) > 2 * self.max_kept:
            self.pairs.clear()
        left, right = self.pieces[key >> 20], self.pieces[key & (1 << 20) - 1]
        known = self.pairs[key] = self.merged(left + right) == [left, right]
        return known

    def merged(self, text: str) -> list[str]:
        """Encoding of a short text by the merges themselves: the best score first, the leftmost of equals."""
        score, none = self.score, float("-inf")
        parts = list(text)
        ranks = [score.get(x + y, none) for x, y in zip(parts, parts[1:])]
        while ranks and (best := max(ranks)) > none:
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = score.get(parts[i] + parts[i + 1], none)
            if i:
                ranks[i - 1] = score.get(parts[i - 1] + parts[i], none)
        return parts

    def steps(self, unit: str) -> bytes:
        """For each character of the unit, as a signed byte: by how much it changes the count of the prefix that it ends.

        A step is at least minus the longest piece and at most four.
        """
        number, reach, pairs, stays = self.number.get, self.reach.get, self.pairs, self.stays
        count, last = [0], [-1]  # last: number of the token that ends the prefix, -1 for none or a character outside the vocabulary
        for end in range(1, len(unit) + 1):
            for start in range(max(0, end - reach(unit[end - 3 : end], 2)) if end > 2 else 0, end):
                piece = number(unit[start:end])
                if piece is None:
                    continue
                if (left := last[start]) >= 0:
                    known = pairs.get(key := left << 20 | piece)
                    if known is False or known is None and not stays(key):
                        continue
                count.append(count[start] + 1)
                last.append(piece)
                break
            else:
                count.append(count[-1] + len(unit[end - 1].encode()))
                last.append(-1)
        return bytes([(b - a) & 255 for a, b in zip(count, count[1:])])

    def of_unit(self, unit: str) -> bytes:
        """The steps of a unit, kept for the next time if it is short."""
        if (known := self.kept.get(unit)) is None:
            known = self.steps(unit)
            if len(unit) <= 32:
                if len(self.kept) >= self.max_kept:
                    self.kept.clear()
                self.kept[unit] = known
        return known

    def deltas(self, text: str | None) -> np.ndarray:
        """Steps for the characters of a text; their running sum is the token count at every prefix.

        The space that the tokenizer puts in front belongs to the first character.
        """
        if not text:
            return np.zeros(0, np.int8)
        steps = np.frombuffer(b"".join(map(self.of_unit, self.units(SPACE + text.replace(" ", SPACE)))), np.int8)
        front, steps = int(steps[0]), steps[1:].copy()
        steps[0] += front
        return steps


def _counter(model_file: str) -> PrefixCounter:
    """The counter of this process, which outlives a task, with the units that it has kept."""
    held = sys.modules.setdefault("strandkit_worker_state", types.ModuleType("strandkit_worker_state")).__dict__
    if model_file not in held:
        held[model_file] = PrefixCounter(model_file)
    return held[model_file]


def longest_prefix(deltas: bytes | None, budget: int) -> int:
    """Characters of the longest prefix that has no more tokens than the budget, from its stored steps."""
    within = np.flatnonzero(np.frombuffer(deltas or b"", np.int8).cumsum(dtype=np.int64) <= budget)
    return int(within[-1]) + 1 if len(within) else 0


def tokens_at(deltas: bytes | None, n_chars: int) -> int:
    """Tokens of the prefix of so many characters, from its stored steps."""
    return int(np.frombuffer(deltas or b"", np.int8)[: max(0, n_chars)].sum(dtype=np.int64))


def count_tokens(df: DataFrame, id_col: str, text_col: str, model_file: str | None = None, limit: int = 4096, with_prefixes: bool = False) -> DataFrame:
    """Exact token counts of whole texts, in one narrow pass without a shuffle.

    Returns the id, n_bytes, n_tokens, over_limit (more tokens than the limit), limit_chars (characters of the
    longest prefix within the limit: where to cut the text) and, if with_prefixes, prefix_steps: a signed byte
    per character whose running sum is the token count at every prefix. A null text counts as empty: 0 bytes,
    0 tokens. Null ids, ties and repeated rows are kept as they are, an empty table gives no rows, and other
    columns of the input, whatever their names, are not read. Counts are those of the library without begin,
    end or added special tokens; strings of special tokens inside a text are ordinary text.
    """
    path = model_file or tokenizer_path()

    def run(batches):
        counter = _counter(path)
        for batch in sliced(batches):
            texts = batch.column(1)
            n_tokens, cut, steps = [], [], []
            for text in texts.to_pylist():
                own = counter.deltas(text)
                total = int(own.sum(dtype=np.int64))
                n_tokens.append(total)
                if total <= limit:
                    cut.append(len(own))
                else:
                    cut.append(longest_prefix(own.tobytes(), limit))
                if with_prefixes:
                    steps.append(own.tobytes())
            n_bytes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            n_tokens = pa.array(n_tokens, pa.int64())
            columns = [batch.column(0), n_bytes, n_tokens, pc.greater(n_tokens, limit), pa.array(cut, pa.int64())]
            if with_prefixes:
                columns.append(pa.array(steps, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_bytes", "n_tokens", "over_limit", "limit_chars", "prefix_steps"][: len(columns)])

    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean, limit_chars long" + ", prefix_steps binary" * with_prefixes)
