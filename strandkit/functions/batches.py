"""What array expressions take too long for, letter by letter: whole Arrow batches of texts and arrays at once, in tasks."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType

#: Positions whose hashes are computed at once: their words stay in a core's cache.
PIECE = 1 << 14


def bound_batches(spark: SparkSession, most: str = "4m", name: str = "spark.sql.execution.arrow.maxBytesPerBatch") -> None:
    """Let batches for Python workers have about so many bytes, as long texts make large ones; not if the session has a bound of its own."""
    if spark.conf.get(name) in ("64m", "67108864b", "67108864"):  # Spark's default
        spark.conf.set(name, most)


def _letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins and the last ends."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    places = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset) if len(texts) else np.zeros(1, np.int32)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data[places[0] : places[-1]], places - places[0]


def _strings(data: np.ndarray, places: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(places) - 1, pa.py_buffer(np.ascontiguousarray(places, np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


def _lists(values: pa.Array, places: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.ascontiguousarray(places, np.int32)), values, mask=None if missing is None else pa.array(missing))


def _bounds(lists: pa.Array) -> np.ndarray:
    """Where each list begins among all entries, and the last ends; a null one has none."""
    return np.r_[0, np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64).cumsum()]


def _missing(a: pa.Array) -> np.ndarray:
    return np.asarray(a.is_null().to_numpy(zero_copy_only=False))


def _any(flags: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether any flag holds, for each stretch between two places."""
    before = np.r_[0, flags.cumsum()]
    return before[places[1:]] > before[places[:-1]]


def translated(text: Column, table: bytes, delete: bytes = b"") -> Column:
    """Each byte of a text's UTF-8 by a table of 256, those of delete left out; the outcome must be UTF-8."""

    @F.arrow_udf(StringType())
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if b is None else b.translate(table, delete) for b in texts.cast(pa.binary()).to_pylist()], pa.binary()).cast(pa.string())

    return run(text)


def characters(text: Column) -> Column:
    """The different characters of a text, in any order."""

    @F.arrow_udf(ArrayType(StringType()))
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else list(set(t)) for t in texts.to_pylist()], pa.list_(pa.string()))

    return run(text)


def _alphabet(letters: str, ids: list[int]) -> np.ndarray:
    of = np.full(256, -1, np.int32)
    of[list(letters.encode())] = ids
    return of


def letter_ids(seq: Column, ids: dict[str, int]) -> Column:
    """The ids of a text's letters; null if one has none."""
    of = _alphabet("".join(ids), list(ids.values()))

    @F.arrow_udf(ArrayType(IntegerType()))
    def run(texts: pa.Array) -> pa.Array:
        data, places = _letters(texts)
        found = of[data]
        return _lists(pa.array(found), places, _missing(texts) | _any(found < 0, places))

    return run(seq)


def kmers(seq: Column, k: int) -> Column:
    """Non-overlapping k-mers of A, C, G, T from the left between Ns, the rest as single letters; null where there is another character."""

    @F.arrow_udf(ArrayType(StringType()))
    def run(texts: pa.Array) -> pa.Array:
        data, places = _letters(texts)
        n = len(data)
        odd = _any(_alphabet("ACGTN", [0] * 5)[data] < 0, places)
        is_n = data == ord("N")
        begins = is_n.copy()  # of a stretch without N, or an N
        begins[1:] |= is_n[:-1]
        begins[places[:-1][places[:-1] < n]] = True
        at = np.flatnonzero(begins).astype(np.int32)
        lengths = np.diff(np.r_[at, n]).astype(np.int32)
        inside = np.arange(n, dtype=np.int32) - np.repeat(at, lengths)
        starts = np.flatnonzero((inside % k == 0) | (inside >= np.repeat(lengths // k * k, lengths)))
        return _lists(_strings(data, np.r_[starts, n]), np.searchsorted(starts, places), _missing(texts) | odd)

    return run(seq)


def overlapping(seq: Column, k: int) -> Column:
    """The k characters at each place of a text."""

    @F.arrow_udf(ArrayType(StringType()))
    def run(texts: pa.Array) -> pa.Array:
        data, places = _letters(texts)
        if (data > 127).any():
            return pa.array([None if t is None else [t[i : i + k] for i in range(len(t) - k + 1)] for t in texts.to_pylist()], pa.list_(pa.string()))
        counts = np.maximum(np.diff(places) - (k - 1), 0)
        ends = np.r_[0, counts.cumsum()]
        starts = np.arange(ends[-1]) + np.repeat(places[:-1] - ends[:-1], counts)
        return _lists(_strings(data[starts[:, None] + np.arange(k)].reshape(-1), np.arange(len(starts) + 1) * k), ends, _missing(texts))

    return run(seq)


def kmer_ids(tokens: Column, letters: str, offset: int, singles: dict[str, int]) -> Column:
    """Ids of tokens: a letter's by singles, else offset and the token as a number whose digits are letters, up to the first other character."""
    base, digit, single = len(letters), _alphabet(letters, list(range(len(letters)))), _alphabet("".join(singles), list(singles.values()))

    @F.arrow_udf(ArrayType(IntegerType()))
    def run(lists: pa.Array) -> pa.Array:
        flat = pc.list_flatten(lists)
        data, places = _letters(flat)
        size = np.diff(places)
        out, value, going = np.full(len(flat), -1, np.int64), np.zeros(len(flat), np.int64), size > 1
        is_one = size == 1
        out[is_one] = single[data[places[:-1][is_one]]]
        for j in range(int(size.max(initial=0)) if going.any() else 0):
            going &= size > j
            d = digit[data[np.where(going, places[:-1] + j, 0)]]
            going &= d >= 0
            value = np.where(going, value * base + d, value)
        out = np.where(size > 1, value + offset, out)
        wide = np.flatnonzero((size > 1) & (np.asarray(pc.utf8_length(flat).fill_null(0)) == 1)) if (data > 127).any() else []
        out[wide] = -1  # one character that is no letter
        return _lists(pa.array(out, mask=out < 0).cast(pa.int32()), _bounds(lists), _missing(lists))

    return run(tokens)


def looked_up(tokens: Column, names: list[str], ids: list[int], unknown: int | None) -> Column:
    """For each token its id, or unknown, which may be null."""

    @F.arrow_udf(ArrayType(IntegerType()))
    def run(lists: pa.Array) -> pa.Array:
        at = pc.index_in(pc.list_flatten(lists), value_set=pa.array(names, pa.string()))
        found = pc.take(pa.array(ids, pa.int32()), at)
        return _lists(found if unknown is None else pc.fill_null(found, unknown), _bounds(lists), _missing(lists))

    return run(tokens)


def _named(lists: pa.Array, names: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The names of all ids, null where there is none; and where a list begins."""
    ids = pc.list_flatten(lists).cast(pa.int64())
    known = pc.and_(pc.greater_equal(ids, 0), pc.less(ids, len(names)))
    return pc.take(pa.array(names, pa.string()), pc.if_else(known, ids, None)), _bounds(lists)


def names_of(ids: Column, names: list[str]) -> Column:
    """For each id its name, null if it has none."""

    @F.arrow_udf(ArrayType(StringType()))
    def run(lists: pa.Array) -> pa.Array:
        return _lists(*_named(lists, names), _missing(lists))

    return run(ids)


def text_of(ids: Column, names: list[str]) -> Column:
    """The names of all ids as one text; null if one has none."""

    @F.arrow_udf(StringType())
    def run(lists: pa.Array) -> pa.Array:
        found, bounds = _named(lists, names)
        odd = _missing(lists) | _any(_missing(found), bounds)
        data, places = _letters(found)
        whole = _strings(data, places[bounds])
        return pc.if_else(pa.array(odd), None, whole)

    return run(ids)


def between(ids: Column, start: Column, stop: int) -> Column:
    """An array's entries from start up to, without, the first one that is stop."""

    @F.arrow_udf(ArrayType(IntegerType()))
    def run(lists: pa.Array, starts: pa.Array) -> pa.Array:
        flat, bounds = pc.list_flatten(lists), _bounds(lists)
        begin = np.minimum(bounds[:-1] + np.asarray(pc.fill_null(starts, 0)).astype(np.int64), bounds[1:])
        stops = np.r_[np.flatnonzero(np.asarray(pc.fill_null(pc.equal(flat, stop), False))), len(flat)]
        end = np.minimum(stops[np.searchsorted(stops, begin)], bounds[1:])
        sizes = end - begin
        ends = np.r_[0, sizes.cumsum()]
        places = np.arange(ends[-1]) + np.repeat(begin - ends[:-1], sizes)
        return _lists(flat.take(pa.array(places)), ends, _missing(lists) | _missing(starts))

    return run(ids, start)


def any_in_blocks(ids: Column, size: int, pad: int) -> Column:
    """For each whole block of an array's entries whether any is no pad, null if that hangs on nulls; a null array has no blocks."""

    @F.arrow_udf(ArrayType(BooleanType()))
    def run(lists: pa.Array) -> pa.Array:
        bounds = _bounds(lists)
        counts = np.diff(bounds) // size
        ends = np.r_[0, counts.cumsum()]
        starts = np.arange(ends[-1]) * size + np.repeat(bounds[:-1] - ends[:-1] * size, counts)

        def holds(flags: pa.Array) -> np.ndarray:
            before = np.r_[0, np.asarray(flags).cumsum()]
            return before[starts + size] > before[starts]

        real = pc.not_equal(pc.list_flatten(lists), pad)
        found = holds(pc.fill_null(real, False))
        return _lists(pa.array(found, mask=~found & holds(real.is_null()) if real.null_count else None), ends)

    return run(ids)


def joined_md5(values: Column) -> Column:
    """MD5 of an array's entries as text, comma-joined; nulls are left out."""

    @F.arrow_udf(StringType())
    def run(lists: pa.Array) -> pa.Array:
        flat = pc.list_flatten(lists).cast(pa.string())
        joined = pc.binary_join(_lists(flat, _bounds(lists)), ",") if not flat.null_count else pa.array([",".join(x for x in own if x is not None) for own in _lists(flat, _bounds(lists)).to_pylist()], pa.string())
        data, places = _letters(joined)
        view, ends = memoryview(data), places.tolist()
        digests = [hashlib.md5(view[a:b]).hexdigest() for a, b in zip(ends, ends[1:])]
        return pc.if_else(lists.is_null(), None, pa.array(digests, pa.string()))

    return run(values)


_K = [int(abs(np.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_BEGIN = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _md5(words: np.ndarray) -> np.ndarray:
    """Four draws for each column of 16 words, a message of one block: the MD5's words as they are written."""
    n = words.shape[1]
    u = np.uint32
    a, b, c, d = (np.full(n, x, u) for x in _BEGIN)
    f, t = np.empty(n, u), np.empty(n, u)
    filled = words.any(axis=1)
    for i in range(64):
        if i < 16:
            g = i
            np.bitwise_xor(c, d, f); np.bitwise_and(f, b, f); np.bitwise_xor(f, d, f)  # fmt: skip  # noqa: E702
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, f); np.bitwise_and(f, d, f); np.bitwise_xor(f, c, f)  # fmt: skip  # noqa: E702
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, f); np.bitwise_xor(f, d, f)  # fmt: skip  # noqa: E702
        else:
            g = 7 * i % 16
            np.bitwise_not(d, f); np.bitwise_or(f, b, f); np.bitwise_xor(f, c, f)  # fmt: skip  # noqa: E702
        np.add(f, a, f)
        np.add(f, u(_K[i]), f)
        if filled[g]:
            np.add(f, words[g], f)
        np.left_shift(f, u(_TURNS[i]), t)
        np.right_shift(f, u(32 - _TURNS[i]), f)
        np.bitwise_or(f, t, f)
        np.add(f, b, f)
        a, d, c, b, f = d, c, b, f, a
    return np.stack([(x + u(y)).byteswap() for x, y in zip((a, b, c, d), _BEGIN)])


def draws(keys: list, bounds: np.ndarray, seed: int, wanted: np.ndarray) -> np.ndarray:
    """Four draws of 32 bits for each wanted entry of lists that begin at bounds: the MD5 of `key:place:seed`, without the key if it is null."""
    out = np.zeros((4, len(wanted)), np.uint32)
    fronts = [b"" if key is None else f"{key}:".encode() for key in keys]
    end = f":{seed}".encode() + b"\x80"
    for first in range(0, len(wanted), PIECE):
        mine = wanted[first : first + PIECE]
        block = np.zeros((len(mine), 64), np.uint8)
        lists = np.searchsorted(bounds, mine[[0, -1]], side="right") - 1
        cuts = np.searchsorted(mine, bounds[lists[0] : lists[1] + 2])
        for row, lo, hi in zip(range(lists[0], lists[1] + 1), cuts, cuts[1:]):
            if lo == hi:
                continue
            place, front = mine[lo:hi] - bounds[row], fronts[row]
            at, lo = len(front), int(lo)
            if at + len(end) > 45:  # more than a block, or nearly
                texts = [front + str(p).encode() + end[:-1] for p in place.tolist()]
                out[:, first + lo : first + int(hi)] = np.array([np.frombuffer(hashlib.md5(x).digest(), ">u4") for x in texts], np.uint32).T
                continue
            width, done = len(str(int(place[0]))), 0
            while done < len(place):
                stop = int(np.searchsorted(place, 10**width))
                own = block[lo + done : lo + stop]
                if at:
                    own[:, :at] = np.frombuffer(front, np.uint8)
                rest = place[done:stop]
                for j in range(width - 1, -1, -1):
                    own[:, at + j] = 48 + rest % 10
                    rest = rest // 10
                length = at + width + len(end) - 1
                own[:, at + width : length + 1] = np.frombuffer(end, np.uint8)
                own[:, 56:58] = 8 * length & 255, 8 * length >> 8
                done, width = stop, width + 1
        hashed = _md5(np.ascontiguousarray(block.view("<u4").T))
        plain = block[:, 56:58].any(axis=1)
        out[:, first : first + len(mine)] = np.where(plain, hashed, out[:, first : first + len(mine)])
    return out


def _values(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All entries, zero for nulls, and which are null."""
    flat = pc.list_flatten(lists).cast(pa.int64())
    return np.array(pc.fill_null(flat, 0)), _missing(flat)


def masked_arrays(seq_id: Column, ids: Column, seed: int, vocab_size: int, n_special: int, limits: tuple[int, int, int], mask: int) -> Column:
    """A struct of arrays (ids, labels) as tokens.mlm_ids has them: draws below limits are picked, masked, and masked or changed."""
    kinds = vocab_size - n_special

    @F.arrow_udf("struct<ids: array<int>, labels: array<int>>")
    def run(keys: pa.Array, lists: pa.Array) -> pa.Array:
        x, gone = _values(lists)
        bounds = _bounds(lists)
        wanted = np.flatnonzero((x >= n_special) & ~gone)
        d = draws(keys.to_pylist(), bounds, seed, wanted)
        hit = d[0] < np.int64(limits[0])
        wanted, d = wanted[hit], d[:, hit]
        old = x[wanted]
        other = (old - n_special + 1 + np.floor(d[2] / 4294967296.0 * (kinds - 1)).astype(np.int64)) % kinds + n_special
        labels = np.full(len(x), -100, np.int32)
        labels[wanted] = old
        x[wanted] = np.where(d[1] < np.int64(limits[1]), mask, np.where(d[1] < np.int64(limits[2]), other, old))
        entries = (pa.array(x, mask=gone).cast(pa.int32()), pa.array(labels))
        return pa.StructArray.from_arrays([_lists(e, bounds, _missing(lists)) for e in entries], ["ids", "labels"])

    return run(seq_id.cast("string"), ids)


def uniformly_masked(seq_id: Column, ids: Column, seed: int, limit: int, mask: int, skip: int | None) -> Column:
    """A struct of arrays (ids, truth) and n_masked, as tokens.uniform_mask has them: draws below the limit are masked."""

    @F.arrow_udf("struct<ids: array<int>, truth: array<int>, n_masked: bigint>")
    def run(keys: pa.Array, lists: pa.Array) -> pa.Array:
        x, gone = _values(lists)
        bounds = _bounds(lists)
        wanted = np.flatnonzero((x != skip) & ~gone) if skip is not None else np.arange(len(x))
        hit = wanted[draws(keys.to_pylist(), bounds, seed, wanted)[0] < np.int64(limit)]
        truth = pa.array(x, mask=gone).cast(pa.int32())
        masked = np.zeros(len(x), bool)
        masked[hit] = True
        ids = pa.array(np.where(masked, mask, x), mask=gone & ~masked).cast(pa.int32())
        before = np.r_[0, masked.cumsum()]
        missing = _missing(lists)
        n = pa.array(before[bounds[1:]] - before[bounds[:-1]], pa.int64())
        return pa.StructArray.from_arrays([_lists(ids, bounds, missing), _lists(truth, bounds, missing), pc.if_else(pa.array(missing), None, n)], ["ids", "truth", "n_masked"])

    return run(seq_id.cast("string"), ids)
