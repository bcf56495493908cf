"""Token ids of many texts by the public tokenizers' libraries, in workers."""

from __future__ import annotations

import json
import os
import re
import sys
import types
from array import array
from itertools import repeat

import numpy as np
import pyarrow as pa

#: What a space may not stand before if a text is to be cut there: white space in any version of Unicode, and a little more.
_UNSURE = re.compile("[\\s\\x00-\\x20\\x7f-\\xa0\\u034f\\u061c\\u115f\\u1160\\u1680\\u17b4\\u17b5\\u180b-\\u180f\\u2000-\\u200f\\u2028-\\u202f\\u205f-\\u206f\\u3000\\u3164\\ufeff\\uffa0]")


def vocabulary_path(name: str) -> str:
    """The place of a vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)

#: Old letters alone, with or without a space before them: one word to the library.
_WORD = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ɏ]+")


def _bytes_in(low_high: str) -> np.ndarray:
    """Whether a byte is in the ranges, as a table."""
    return np.array([re.match(f"[{low_high}]", chr(b)) is not None for b in range(256)])


_LETTER, _MARK, _LEAD, _SEEN = _bytes_in("A-Za-z"), _bytes_in(r"!-&(-/:-@\[-`{-~"), _bytes_in("\xc3-\xc8"), _bytes_in("!-~")


def _sure_cuts(raw: np.ndarray) -> np.ndarray:
    """Where to cut texts in UTF-8: before each space, before a mark behind an old letter unless it is an apostrophe, and on both sides of a line feed between what is seen and a letter."""
    cut = raw == 32
    old = np.zeros(len(raw), bool)  # where an old letter of two bytes ends, which \xd7 and \xf7 are not
    old[1:] = _LEAD[raw[:-1]]
    twice = np.flatnonzero(old & ((raw == 0x97) | (raw == 0xB7)))
    old[twice[raw[twice - 1] == 0xC3]] = False
    cut[1:] |= _MARK[raw[1:]] & (_LETTER[raw] | old)[:-1]
    feeds = np.flatnonzero(raw[1:-1] == 10) + 1
    feeds = feeds[(_SEEN[raw[feeds - 1]] | old[feeds - 1]) & (_LETTER[raw[feeds + 1]] | _LEAD[raw[feeds + 1]])]
    cut[feeds] = cut[feeds + 1] = True
    return np.flatnonzero(cut)


_NEW = object()


class Kept:
    """Ids by word, most of them at most: what was not used since half as many came is dropped."""

    def __init__(self, most: int):
        self.most, self.recent, self.older = most, {}, {}

    def of(self, words: list[str]) -> tuple[list, list[int]]:
        """The ids of words, and the places of those that aren't known."""
        ids = list(map(self.recent.get, words, repeat(_NEW)))
        new = [i for i, x in enumerate(ids) if x is _NEW]
        if new and self.older:
            for i in new:
                if (x := self.older.get(words[i], _NEW)) is not _NEW:
                    ids[i] = self.recent[words[i]] = x
            new = [i for i in new if ids[i] is _NEW]
        return ids, new

    def put(self, learned: dict) -> None:
        self.recent.update(learned)
        for w in learned:
            if len(w) > 48:
                del self.recent[w]
        if len(self.recent) > self.most // 2:
            self.recent, self.older = {}, self.recent


class ByteBpe:
    """Ids of whole texts as the tokenizers library gives them without begin, end or added special tokens.

    The library cuts a text into words before it merges bytes, and a space before what is no white space always begins a
    word, as a mark behind a letter does. So each stretch between such places is encoded by the library once and then kept,
    max_kept of them at most; Arrow finds the different ones of the texts. A text with another kind of space, or with the string
    of an added token that counts as such, is given to the library whole; so is every text if the vocabulary file asks for another way of cutting.
    """

    def __init__(self, file: str, plain_specials: bool = False, max_kept: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = plain_specials
        with open(file, encoding="utf-8") as f:
            settings = json.load(f)
        cut = settings.get("pre_tokenizer") or {}
        self.by_words = settings.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        added = [t["content"] for t in settings.get("added_tokens", []) if not (plain_specials and t.get("special"))]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level vocabularies write as they are
        self.shown = {b: chr(b) for b in visible} | {x: chr(256 + i) for i, x in enumerate(x for x in range(256) if x not in visible)}
        self.line_feed = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        self.kept = Kept(max_kept)  # ids of a space and the word after it, or of a word at the start of a text; null where the text can't be cut

    def whole(self, texts: list[str]) -> list[bytes]:
        """Ids as the library gives them, as little-endian unsigned 32-bit integers."""
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _listed(self, words: list[str]) -> list[bytes]:
        """Ids of words without white space but a space before them: a line each of one text, whose line feeds are words of their own."""
        ids = np.array(self.tokenizer.encode("\n".join(words), add_special_tokens=False).ids, "<u4")
        ends = np.flatnonzero(ids == self.line_feed)
        if len(ends) != len(words) - 1:
            return self.whole(words)
        data, cuts = ids.tobytes(), (4 * np.r_[-1, ends, len(ids)]).tolist()
        return [data[a + 4 : b] for a, b in zip(cuts, cuts[1:])]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters alone but a space before them, from the library's model itself: there is nothing to cut."""
        merged, shown, mark = self.tokenizer.model.tokenize, self.shown, self.shown[32]
        written = (w.replace(" ", mark) if w.isascii() else w.encode().decode("latin-1").translate(shown) for w in words)
        return [array("I", [t.id for t in merged(w)]).tobytes() for w in written]

    def _ids(self, words: list[str]) -> list[bytes | None]:
        """Ids of different words, with or without a space before them; those that are not known are encoded."""
        ids, new = self.kept.of(words)
        letters, plain, odd, unsure = [], [], [], []
        for w in map(words.__getitem__, new):
            if _WORD.fullmatch(w):
                letters.append(w)
                continue
            bare = w.removeprefix(" ")
            if bare and not _UNSURE.search(bare) and not (self.added and self.added.search(bare)):
                plain.append(w)
            elif not w.startswith(" ") or bare and not _UNSURE.match(bare):
                odd.append(w)
            else:
                unsure.append(w)
        learned = dict(zip(letters, self._letters(letters)))
        if plain:
            learned.update(zip(plain, self._listed(plain)))
        if odd:
            learned.update(zip(odd, self.whole(odd)))
        learned.update(dict.fromkeys(unsure))
        for i in new:
            ids[i] = learned[words[i]]
        self.kept.put(learned)
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids, as little-endian unsigned 32-bit integers."""
        if not self.by_words or not any(texts):
            return self.whole(texts)
        given = pa.array(texts, pa.large_string())
        bounds, content = np.frombuffer(given.buffers()[1], np.int64, len(texts) + 1), given.buffers()[2]
        inner = _sure_cuts(np.frombuffer(content, np.uint8, bounds[-1]))
        at = np.searchsorted(inner, bounds[:-1]) + np.arange(len(texts))  # each text's first word, which may be empty
        cuts = np.empty(len(texts) + len(inner) + 1, np.int64)
        within = np.ones(len(cuts) - 1, bool)
        within[at] = False
        cuts[at], cuts[:-1][within], cuts[-1] = bounds[:-1], inner, bounds[-1]
        coded = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), content).dictionary_encode()
        codes, ids = coded.indices.to_numpy(), self._ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        left = np.zeros(len(texts), bool)
        if None in ids:
            left |= np.logical_or.reduceat(np.fromiter((x is None for x in ids), bool, len(ids))[codes], at)
            ids = [x or b"" for x in ids]
        ends = np.fromiter(map(len, ids), np.int64, len(ids))[codes].cumsum()
        data = b"".join(map(ids.__getitem__, codes.tolist()))
        starts = np.r_[0, ends][at].tolist()
        out = [data[a:b] for a, b in zip(starts, [*starts[1:], len(data)])]
        if self.added:
            left |= np.fromiter((self.added.search(t) is not None for t in texts), bool, len(texts))
        left = np.flatnonzero(left).tolist()
        for i, own in zip(left, self.whole([texts[i] for i in left])):
            out[i] = own
        return out

    def token_bytes(self) -> list[bytes]:
        """The bytes that each id stands for; those of an added token in UTF-8."""
        of_char = {c: b for b, c in self.shown.items()}
        added = {i for i in self.tokenizer.get_added_tokens_decoder()}
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        return [name.encode() if i in added else bytes(of_char[c] for c in name) for i, name in enumerate(names)]


class PieceBpe:
    """Ids of whole texts as the sentencepiece library gives them without begin or end.

    Where no piece has a space behind another character and the model leaves texts as they are, the words of a text with single spaces
    between them are encoded apart from one another; each is given to the library once and then kept, max_kept of them at most.
    """

    def __init__(self, file: str, max_kept: int = 300_000):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=file)
        spaced = any("▁" in model.id_to_piece(i).lstrip("▁") for i in range(model.get_piece_size()))
        self.by_words = not spaced and b"identity" in model.serialized_model_proto() and [model.id_to_piece(i) for i in model.encode("a  b")][1:2] == ["▁"]
        self.kept: dict[str, bytes] = {}
        self.max_kept = max_kept

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", x).tobytes() for x in self.model.encode(texts, num_threads=1)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids, as little-endian unsigned 32-bit integers."""
        if not self.by_words:
            return self.whole(texts)
        rows = [t.split(" ") for t in texts]
        apart = [all(row) and "▁" not in t for row, t in zip(rows, texts)]
        words: set[str] = set()
        for row, ok in zip(rows, apart):
            if ok:
                words.update(row)
        if len(self.kept) > self.max_kept:
            self.kept.clear()
        new = [w for w in words if w not in self.kept]
        self.kept.update(zip(new, self.whole(new)))
        of = self.kept.__getitem__
        left = iter(self.whole([t for t, ok in zip(texts, apart) if not ok]))
        out = [b"".join(map(of, row)) if ok else next(left) for row, ok in zip(rows, apart)]
        for w in new:
            if len(w) > 48:
                del self.kept[w]
        return out

    def token_bytes(self) -> list[bytes]:
        """The bytes that each id stands for: a piece in UTF-8 with spaces for its marks, or the byte of a byte piece."""
        model = self.model
        return [bytes([int(model.id_to_piece(i)[1:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.get_piece_size())]


def held(kind: type, *args):
    """The encoder of this worker process, which outlives a task, with what it has kept."""
    own = sys.modules.setdefault("strandkit_worker_state", types.ModuleType("strandkit_worker_state")).__dict__
    key = f"{kind.__name__}{args}"
    if key not in own:
        own[key] = kind(*args)
    return own[key]
