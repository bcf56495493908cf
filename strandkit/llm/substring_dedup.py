"""Removing repeated byte strings with suffix arrays built by two-stage sorting."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandkit.llm.common import repeated, with_times

#: Bytes of the strings that pick anchors, a power of two; the occurrences from which an anchor counts as hot, and the
#: number of places of the anchor in the window that then stay together.
GRAM, HOT, PLACES = 32, 20_000, 8
BLOCK = 1 << 18


# ---- anchors -------------------------------------------------------------------------------------------------------


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position, by doubling."""
    table = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    h, factor, width = table[data], 0x9E3779B97F4A7C15, 1
    while width < GRAM:
        h = h[:-width] * np.uint64(factor) + h[width:]
        factor, width = factor * factor % (1 << 64), 2 * width
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(29)


def _window_min(keys: np.ndarray, width: int) -> np.ndarray:
    """The least key of each window, by doubling."""
    done = 1
    while 2 * done <= width:
        keys, done = np.minimum(keys[:-done], keys[done:]), 2 * done
    return np.minimum(keys[: len(keys) - (width - done)], keys[width - done :]) if width > done else keys


def anchored_runs(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, number, anchor hash and anchor of the runs of window starts that share an anchor.

    data holds documents one after another, ends where each ends. The anchor of a window of `length` bytes is the
    leftmost of its GRAM-byte strings with the least hash, so equal windows have equal anchors at equal places, and each
    window has just one. A run and the bytes of its windows are one segment.
    """
    low = np.maximum(ends - length + 1, np.r_[0, ends[:-1]])
    change = np.zeros(len(data) + 1, np.int32)
    np.add.at(change, low, 1)
    np.add.at(change, ends, -1)
    inside = change.cumsum()[:-1] == 0
    starts, counts, hashes, anchors = [], [], [], []
    mask = np.uint64((1 << 20) - 1)
    for at in range(0, len(data) - length + 1, BLOCK):
        part = data[at : at + BLOCK + length - 1]
        h = _gram_hashes(part)
        place = _window_min((h & ~mask) | np.arange(len(h), dtype=np.uint64), length - GRAM + 1) & mask
        own = np.flatnonzero(inside[at : at + len(place)])
        if not len(own):
            continue
        anchor = place[own]
        new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1] + 1)])
        starts.append(own[new] + at)
        counts.append(np.diff(np.r_[new, len(own)]))
        least = h[anchor[new].astype(np.int64)]  # the least of many, so not spread evenly any more
        least = least * np.uint64(0xC2B2AE3D27D4EB4F)
        hashes.append(least ^ least >> np.uint64(32))
        anchors.append(anchor[new].astype(np.int64) + at)
    return tuple(np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((starts, np.int64), (counts, np.int64), (hashes, np.uint64), (anchors, np.int64)))


def split_by_place(starts: np.ndarray, counts: np.ndarray, anchors: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and number of the parts of runs in which the anchor is at one of PLACES places, and where the core of each begins.

    The core are the length - PLACES + 1 bytes that all windows with the anchor at these places have in common, so
    equal windows lie in parts with equal cores.
    """
    last, first = (anchors - starts) // PLACES, (anchors - starts - counts + 1) // PLACES
    n = last - first + 1
    run = np.repeat(np.arange(len(n)), n)
    low = PLACES * (first[run] + np.arange(len(run)) - np.repeat(n.cumsum() - n, n))
    begin = np.maximum(starts[run], anchors[run] - low - PLACES + 1)
    end = np.minimum(starts[run] + counts[run], anchors[run] - low + 1)
    return begin, end - begin, anchors[run] - low


# ---- suffix arrays -------------------------------------------------------------------------------------------------


def _word(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each position as one number that sorts like them."""
    word = np.zeros(len(at), np.uint64)
    for i in range(8):
        word <<= np.uint64(8)
        word |= text[at + i]
    return word


def direct_sort(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of the depth bytes from each: eight bytes at a time, among those still equal."""
    order = np.argsort(_word(text, at), kind="stable")
    at = at[order]
    word = _word(text, at)
    rank = np.r_[0, np.cumsum(word[1:] != word[:-1])] if len(at) else np.zeros(0, np.int64)
    for done in range(8, depth, 8):
        same = np.r_[False, rank[1:] == rank[:-1]]
        tied = np.flatnonzero(same | np.r_[same[1:], False])
        if not len(tied):
            break
        word = _word(text, at[tied] + done)
        order = np.lexsort((word, rank[tied]))
        at[tied] = at[tied][order]
        word, own = word[order], rank[tied]
        # a new rank begins where the old one does or the word changes; ranks grow in steps that keep their order
        steps = np.zeros(len(at), np.int64)
        steps[tied[1:]] = (own[1:] == own[:-1]) & (word[1:] != word[:-1])
        rank = rank + steps.cumsum()
    return at


def two_stage_order(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """Wanted positions of the text in the order of the suffixes there, as far as depth bytes tell them apart.

    text has depth + 8 bytes of padding. Suffixes that are smaller than their successor are sorted directly. The rest are
    induced: scanning the buckets of first bytes upwards, a suffix that is in its place puts the one before it, if that
    is larger, at the end of what its own bucket has so far. Of a wanted suffix that is to be induced, the successors up
    to one that is sorted directly are ordered along with it.
    """
    n = len(text) - 1
    sign = np.sign(np.diff(text.astype(np.int16)))
    nearest = np.where(sign != 0, np.arange(n), n)
    nearest = np.minimum.accumulate(nearest[::-1])[::-1]
    smaller = np.r_[sign, 1][nearest] > 0  # than its successor; a run of equal bytes goes by the byte after it
    smaller = np.r_[smaller, True]
    needed = np.zeros(len(text), bool)
    needed[wanted] = True
    ahead = wanted[~smaller[wanted]]
    while len(ahead):
        ahead = ahead + 1
        ahead = ahead[~needed[ahead]]
        needed[ahead] = True
        ahead = ahead[~smaller[ahead]]
    direct = direct_sort(text, np.flatnonzero(needed & smaller), depth)
    cuts = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for byte in range(256):
        placed = list(waiting[byte])
        waiting[byte] = []
        wave = np.concatenate(placed) if placed else np.zeros(0, np.int64)
        while len(wave):  # runs of this byte
            wave = wave[wave > 0] - 1
            wave = wave[(text[wave] == byte) & needed[wave]]
            placed.append(wave)
        bucket = np.concatenate([*placed, direct[cuts[byte] : cuts[byte + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[needed[before] & (text[before] > byte)]
        first = text[before]
        before = before[np.argsort(first, kind="stable")]
        ends = np.searchsorted(np.sort(first), np.arange(257))
        for other in np.flatnonzero(np.diff(ends)).tolist():
            waiting[other].append(before[ends[other] : ends[other + 1]])
    order = np.concatenate(out)
    chosen = np.zeros(len(text), bool)
    chosen[wanted] = True
    return order[chosen[order]]


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in the order, at most depth; 0 for the first."""
    lcp = np.zeros(len(order), np.int64)
    open_ = np.arange(1, len(order))
    for done in range(0, depth, 8):
        x = _word(text, order[open_] + done) ^ _word(text, order[open_ - 1] + done)
        equal = x == 0
        lead = np.full(len(x), 8)
        for i in range(8):
            lead = np.where((lead == 8) & (x >> np.uint64(56 - 8 * i) != 0), i, lead)
        lcp[open_] += lead
        open_ = open_[equal]
    return np.minimum(lcp, depth)


def repeated_starts(text: np.ndarray, wanted: np.ndarray, length: int) -> np.ndarray:
    """Of the wanted positions those whose `length` bytes also stand at a smaller wanted one."""
    if len(wanted) < 2:
        return wanted[:0]
    order = two_stage_order(text, wanted, length)
    group = (common_prefixes(text, order, length) < length).cumsum() - 1
    first = np.full(group[-1] + 1, len(text))
    np.minimum.at(first, group, order)
    return np.sort(order[order != first[group]])


# ---- segments ------------------------------------------------------------------------------------------------------


def _stand_before(segments: list[bytes]) -> np.ndarray:
    """For segments in the order of their places: whether an equal one stands before, which is then sent or sorted for both.

    Copies are thus aggregated before the shuffle and before the sort, whose cost would else grow with a group's copies.
    """
    seen: set = set()
    again = np.zeros(len(segments), bool)
    for i, item in enumerate(segments):
        if item in seen:
            again[i] = True
        else:
            seen.add(item)
    return again


def _runs_of(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive numbers."""
    new = np.flatnonzero(np.r_[True, starts[1:] != starts[:-1] + 1]) if len(starts) else np.zeros(0, np.int64)
    return starts[new], starts[np.r_[new[1:] - 1, len(starts) - 1]] if len(starts) else starts


class Chunk:
    """The documents of a chunk in the order of their ids; rows that repeat an id and text are one document."""

    def __init__(self, table: pa.Table):
        table = table.sort_by([("id", "ascending"), ("text", "ascending")])
        ids, texts = table.column("id").to_pylist(), table.column("text").cast(pa.binary()).to_pylist()
        self.table = table
        self.texts, self.ids, self.row_doc = [], [], []
        for i, (ident, text) in enumerate(zip(ids, texts)):
            text = text or b""
            if not i or ident != ids[i - 1] or text != self.texts[-1]:
                self.texts.append(text)
                self.ids.append((1 << 63) - 1 if ident is None else ident)
            self.row_doc.append(len(self.texts) - 1)
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)
        self.ends = np.cumsum([len(x) for x in self.texts], dtype=np.int64)
        self.begins = np.r_[0, self.ends[:-1]].astype(np.int64)


def _pack(*arrays) -> list[bytes]:
    return [np.ascontiguousarray(x).tobytes() for x in arrays]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, chunk_bytes: int = 8 << 20, hot: int = HOT) -> DataFrame:
    """Documents without the bytes that a string of `length` bytes covers which also starts earlier in the corpus.

    Earlier means in a document of a smaller id, or in the same one before; strings are compared in the input, not in
    what is left, and never reach over documents. 1. Documents are dealt to chunks by a hash. In each, every window of
    `length` bytes gets an anchor; the distinct anchor hashes go to shards, which tell each chunk those that occur
    twice in the corpus. 2. Of these the chunk sends the segments, windows that share an anchor in one piece, to shards
    by the anchor, equal segments once. 3. A shard sorts the suffixes at all window starts of its segments in two
    stages; those with a common prefix of `length` bytes are equal windows, of which the first stays. 4. The chunks
    cut what came back. The windows of an anchor with over `hot` occurrences are parted by the place of the anchor in
    them, and go to shards by the bytes that all windows of such a part have in common, so no shard gets a hot passage
    with all its surroundings. Rows with equal ids, or without one, that exceed a chunk are counted and dealt by id and text.

    Returns the id, text, spans (start and end byte of each removed run) and kept (the remaining bytes). A null text counts
    as empty. Ids must be numbers, or texts that are; a null id is larger than any other. Rows that repeat both id and text are one document and come back as
    often; those that repeat an id with another text are ordered by start only. An empty table gives no rows. Other
    columns are not read.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    total = base.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n_chunks = max(1, -(-total // chunk_bytes))
    n_shards = 2 * n_chunks  # a shard sorts several bytes of suffixes for each of its own
    rows, any_hot = with_times(base, "id", "text", chunk_bytes)
    chunks = rows.select("id", "text", "times", F.pmod("key", F.lit(n_chunks)).alias("chunk"))

    def shard_of(hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(32)) * np.uint64(n_shards) >> np.uint64(32)).astype(np.int64)  # grows with the hash

    def request(key, table):
        own = Chunk(table)
        hashes, counts = np.unique(anchored_runs(own.data, own.ends, length)[2], return_counts=True)
        cuts = np.searchsorted(shard_of(hashes), np.arange(n_shards + 1))
        rows = [(s, *_pack(hashes[cuts[s] : cuts[s + 1]], counts[cuts[s] : cuts[s + 1]].astype(np.uint32))) for s in range(n_shards) if cuts[s] < cuts[s + 1]]
        return pa.table({"shard": pa.array([r[0] for r in rows], pa.int64()), "chunk": pa.array([key[0].as_py()] * len(rows), pa.int64()), "hashes": pa.array([r[1] for r in rows], pa.binary()), "counts": pa.array([r[2] for r in rows], pa.binary())})

    def reply(key, table):
        hashes = np.frombuffer(b"".join(table.column("hashes").to_pylist()), np.uint64)
        counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint32)
        distinct, index = np.unique(hashes, return_inverse=True)
        sums = np.bincount(index, counts, len(distinct))
        state = np.where(sums > hot, 2, np.where(sums > 1, 1, 0))[index]
        ends = np.cumsum([len(x) // 8 for x in table.column("hashes").to_pylist()])
        rows = [_pack(hashes[a:b][state[a:b] == 1], hashes[a:b][state[a:b] == 2]) for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist())]
        return pa.table({"chunk": table.column("chunk"), "twice": pa.array([r[0] for r in rows], pa.binary()), "often": pa.array([r[1] for r in rows], pa.binary())})

    def segments(key, left, right):
        own = Chunk(left)
        starts, counts, hashes, anchors = anchored_runs(own.data, own.ends, length)
        twice, often = (np.sort(np.frombuffer(b"".join(right.column(c).to_pylist()), np.uint64)) for c in ("twice", "often"))

        def among(values, where):
            if not len(where):
                return np.zeros(len(values), bool)
            return where[np.minimum(np.searchsorted(where, values), len(where) - 1)] == values

        plain, busy = among(hashes, twice), among(hashes, often)
        begin, number, shard = starts[plain], counts[plain], shard_of(hashes[plain])
        raw = own.data.tobytes()
        if busy.any():
            part, size, core = split_by_place(starts[busy], counts[busy], anchors[busy], length)
            digest = np.array([xxhash.xxh64_intdigest(raw[p : p + length - PLACES + 1]) for p in core.tolist()], np.uint64)
            begin, number, shard = np.r_[begin, part], np.r_[number, size], np.r_[shard, shard_of(digest)]
        order = np.argsort(begin, kind="stable")
        begin, number, shard = begin[order], number[order], shard[order]
        pieces = [raw[a : a + n + length - 1] for a, n in zip(begin.tolist(), number.tolist())]
        again = _stand_before(pieces)
        doc = np.searchsorted(own.ends, begin, "right")
        offset = begin - own.begins[doc]
        ids = np.array(own.ids, np.int64)
        rows = []
        if again.any():
            rows.append((key[0].as_py() % n_shards, *_pack(doc[again].astype(np.int32), ids[:0], offset[again], number[again].astype(np.int32)), b""))
        fresh = np.flatnonzero(~again)
        fresh = fresh[np.argsort(shard[fresh], kind="stable")]
        for s, at in zip(*_split(shard[fresh], fresh)):
            rows.append((s, *_pack(doc[at].astype(np.int32), ids[doc[at]], offset[at], number[at].astype(np.int32)), b"".join([pieces[i] for i in at.tolist()])))
        columns = [pa.array([r[i] for r in rows], pa.binary()) for i in range(1, 6)]
        return pa.Table.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([key[0].as_py()] * len(rows), pa.int64()), *columns], names=["shard", "chunk", "doc", "id", "start", "number", "bytes"])

    def compare(key, table):
        place, doc, ids, start, number, pieces, out = [], [], [], [], [], [], []
        for row, (c, d, i, s, n, b) in enumerate(zip(*(table.column(x).to_pylist() for x in ("chunk", "doc", "id", "start", "number", "bytes")))):
            d, i, s, n = np.frombuffer(d, np.int32), np.frombuffer(i, np.int64), np.frombuffer(s, np.int64), np.frombuffer(n, np.int32)
            if not len(i):  # repeats that the chunk has found itself
                out.append((np.full(len(d), c), d, s, s + n + length - 1))
                continue
            place.append(np.full(len(d), c))
            doc.append(d)
            ids.append(i)
            start.append(s)
            number.append(n.astype(np.int64))
            cuts = np.r_[0, (n + length - 1).astype(np.int64).cumsum()].tolist()
            pieces += [b[x:y] for x, y in zip(cuts, cuts[1:])]
        if pieces:
            place, doc, ids, start, number = (np.concatenate(x) for x in (place, doc, ids, start, number))
            order = np.lexsort((start, ids))
            place, doc, ids, start, number = (x[order] for x in (place, doc, ids, start, number))
            pieces = [pieces[i] for i in order.tolist()]
            again = _stand_before(pieces)
            out.append((place[again], doc[again], start[again], start[again] + number[again] + length - 1))
            left = np.flatnonzero(~again)
            sizes = number[left] + length - 1
            begin = np.r_[0, sizes.cumsum()[:-1]]
            text = np.frombuffer(b"".join([*[pieces[i] for i in left.tolist()], bytes(length + 8)]), np.uint8)
            wanted = np.repeat(begin - np.r_[0, number[left].cumsum()[:-1]], number[left]) + np.arange(number[left].sum())
            first, last = _runs_of(repeated_starts(text, wanted, length))
            at = np.searchsorted(begin, first, "right") - 1
            shift = start[left[at]] - begin[at]
            out.append((place[left[at]], doc[left[at]], first + shift, last + shift + length))
        rows = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 4
        order = np.argsort(rows[0], kind="stable")
        packed = [(c, *_pack(rows[1][at].astype(np.int32), rows[2][at].astype(np.int64), rows[3][at].astype(np.int64))) for c, at in zip(*_split(rows[0][order], order))]
        return pa.Table.from_arrays([pa.array([r[0] for r in packed], pa.int64()), *[pa.array([r[i] for r in packed], pa.binary()) for i in (1, 2, 3)]], names=["chunk", "doc", "start", "end"])

    def cut(key, left, right):
        own = Chunk(left)
        doc, start, end = (np.frombuffer(b"".join(right.column(c).to_pylist()), kind) for c, kind in (("doc", np.int32), ("start", np.int64), ("end", np.int64)))
        change = np.zeros(len(own.data) + 1, np.int32)
        np.add.at(change, own.begins[doc] + start, 1)
        np.add.at(change, own.begins[doc] + end, -1)
        gone = change.cumsum()[:-1] > 0
        kept, spans = [], []
        for a, b in zip(own.begins.tolist(), own.ends.tolist()):
            here = gone[a:b]
            if not here.any():
                kept.append(own.data[a:b].tobytes())
                spans.append([])
                continue
            edges = np.flatnonzero(np.diff(np.r_[False, here, False])).tolist()
            kept.append(own.data[a:b][~here].tobytes())
            spans.append([{"start": x, "end": y} for x, y in zip(edges[::2], edges[1::2])])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        rows = own.row_doc
        return pa.Table.from_arrays([own.table.column("id"), own.table.column("text"), own.table.column("times"), pa.array([spans[d] for d in rows], kind), pa.array([kept[d] for d in rows], pa.binary())], names=["id", "text", "times", "spans", "kept"])

    requests = chunks.groupBy("chunk").applyInArrow(request, "shard long, chunk long, hashes binary, counts binary")
    replies = requests.groupBy("shard").applyInArrow(reply, "chunk long, twice binary, often binary")
    sent = chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(segments, "shard long, chunk long, doc binary, id binary, start binary, number binary, bytes binary")
    found = sent.groupBy("shard").applyInArrow(compare, "chunk long, doc binary, start binary, end binary")
    out = chunks.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(cut, "id long, text string, times long, spans array<struct<start:long,end:long>>, kept binary")
    return (repeated(out, "times", "number") if any_hot else out).select(F.col("id").alias(id_col), F.col("text").alias(text_col), "spans", "kept")


def _split(keys: np.ndarray, rows: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Rows by their keys, which are sorted."""
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[new].tolist(), np.split(rows, new[1:]) if len(keys) else []
