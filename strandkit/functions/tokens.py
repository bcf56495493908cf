"""Tokens, token ids, padding and masks as array expressions."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from strandkit.functions import batches
from strandkit.functions.arrays import let
from strandkit.functions.sequence import fail_unless, only_alphabet

#: The ids of the letter vocabulary.
UNK, PAD, MASK, CLS, EOS, BOS = 0, 1, 2, 3, 4, 5
LETTER_IDS = {"A": 6, "T": 7, "C": 8, "G": 9, "N": 10}


def _is_edge(before: str, after: str) -> bool:
    """Whether a word boundary lies between two characters."""
    return bool(re.match(r"\w", before)) != bool(re.match(r"\w", after))


def reachable(vocabulary: list[str], boundaries: bool = False) -> list[str]:
    """The tokens that an alternation in this order can match: those without an earlier token that is their beginning.

    With boundaries such a token only wins if a word ends where it does.
    """
    rank: dict[str, int] = {}
    for i, token in enumerate(vocabulary):
        rank.setdefault(token, i)

    def beaten(token: str) -> bool:
        starts = (n for n in range(1, len(token)) if rank.get(token[:n], len(vocabulary)) < rank[token])
        return any(not boundaries or _is_edge(token[n - 1], token[n]) for n in starts)

    return [t for t in rank if t and not beaten(t)]


def vocabulary_pattern(vocabulary: list[str], boundaries: bool = False) -> str:
    """A regular expression that matches what the alternation of the vocabulary in its order does, factored by common beginnings.

    Of the tokens that can match at all, all that match at a place begin alike, and the longest comes first in the vocabulary;
    so a tree of characters that tries to go on before it ends finds the same token in one walk. Characters with the same
    branches below them are one class, so all 6-mers are one short expression.
    """
    tree: dict = {}
    for token in reachable(vocabulary, boundaries):
        node = tree
        for c in token:
            node = node.setdefault(c, {})
        node[""] = {}
    end = r"\b" if boundaries else ""

    def written(node: dict) -> str:
        below: dict[str, list[str]] = {}
        for c, child in node.items():
            if c:
                below.setdefault(written(child), []).append(c)
        parts = [(f"[{''.join(map(re.escape, cs))}]" if len(cs) > 1 else re.escape(cs[0])) + rest for rest, cs in below.items()]
        if not parts:
            return end
        return f"(?:{'|'.join(parts + [end] * ('' in node))})"

    return (r"\b" if boundaries else "") + written(tree) if tree else ""


def tokenize_regex(seq: Column, vocabulary: list[str], boundaries: bool = False, unk: str = "<unk>") -> Column:
    """Tokens by an alternation of the vocabulary in its order, else single characters; white space is dropped.

    What is no member becomes unk. With boundaries each token must stand between word boundaries, so letters inside a
    word fall to single characters. The work for a character doesn't grow with the vocabulary.
    """
    found = F.regexp_extract_all(seq, F.lit("(" + "|".join(filter(None, [vocabulary_pattern(vocabulary, boundaries), r"\S"])) + ")"), 1)
    singles = [t for t in dict.fromkeys(vocabulary) if len(t) == 1]  # longer ones are found as members only
    return F.transform(found, lambda t: F.when((F.length(t) > 1) | t.isin(singles), t).otherwise(F.lit(unk)))


def _found(found: Column, given: Column, message: str, on_error: str) -> Column:
    """What was found; where that is null though something was given, an error, or null if on_error is `null`."""
    if on_error not in ("raise", "null"):
        raise ValueError("on_error must be 'raise' or 'null'")
    if on_error == "null":
        return found
    both = F.struct(found.alias("found"), given.isNull().alias("none"))
    return let(both, lambda x: F.when(x["found"].isNull() & ~x["none"], F.raise_error(F.lit(message))).otherwise(x["found"]))


def tokenize_kmers(seq: Column, k: int, on_error: str = "raise") -> Column:
    """Non-overlapping k-mers from the left between Ns; the rest of a piece, and N, as single letters. Upper case only."""
    return _found(batches.kmers(seq, k), seq, "a character is not in the vocabulary", on_error)


def first_kmer_ids(seq: Column, k: int, n: int, offset: int) -> Column:
    """The first n of kmer_ids of tokenize_kmers, for use inside lambdas. They are found in the first n * k letters; all are checked."""
    found = F.regexp_extract_all(F.substring(seq, 1, n * k), F.lit(f"([ACGT]{{{k}}}|[ACGTN])"), 1)
    one = lambda t: F.coalesce(*[F.when(t == x, 4**k + offset + i) for i, x in enumerate("ATCGN")])
    ids = F.transform(F.slice(found, 1, n), lambda t: F.when(F.length(t) > 1, kmer_number(t) + offset).otherwise(one(t)))
    return fail_unless(only_alphabet(seq, "ACGTN"), ids, "a character is not in the vocabulary")


def tokenize_letters(seq: Column, on_error: str = "raise") -> Column:
    """Ids of single letters."""
    return _found(batches.letter_ids(seq, LETTER_IDS), seq, "a character is not in the vocabulary", on_error)


def overlapping_kmers(seq: Column, k: int) -> Column:
    """The k-mer at each position; none if the sequence is shorter."""
    return batches.overlapping(seq, k)


def kmer_number(token: Column) -> Column:
    """A k-mer's place among all k-mers over A, T, C, G in this order."""
    return F.conv(F.translate(token, "ATCG", "0123"), 4, 10).cast("int")


def kmer_ids(tokens: Column, k: int, offset: int) -> Column:
    """Ids of k-mers and single letters in a layout that has offset specials before the k-mers, then A, T, C, G, N."""
    return batches.kmer_ids(tokens, "ATCG", offset, {x: 4**k + offset + i for i, x in enumerate("ATCGN")})


def add_special(ids: Column, cls: int | None = None, bos: int | None = None, eos: int | None = None) -> Column:
    """cls or bos in front, eos at the end."""
    if cls is not None and bos is not None:
        raise ValueError("only one of cls and bos can be prepended")
    front = [F.array(F.lit(x)) for x in (cls, bos) if x is not None]
    return F.concat(*front, ids, *([F.array(F.lit(eos))] if eos is not None else []))


def pad_to(ids: Column, n: Column | int, pad: Column) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.concat(ids, F.array_repeat(pad, F.greatest(n - F.size(ids), F.lit(0))))


def pad_fixed(ids: Column, n: int, pad: int = PAD, on_error: str = "raise") -> Column:
    """Padded on the right to n; a longer array is an error."""
    return fail_unless(F.size(ids) <= n, pad_to(ids, n, F.lit(pad)), f"longer than {n}", on_error)


def truncate_pad(ids: Column, n: int, pad: int = PAD) -> Column:
    return pad_to(F.slice(ids, 1, n), n, F.lit(pad))


def padding_mask(ids: Column, pad: int = PAD) -> Column:
    return F.transform(ids, lambda x: x != pad)


def seq_length(ids: Column, pad: int = PAD) -> Column:
    return F.size(F.filter(ids, lambda x: x != pad))


def block_valid(ids: Column, n: int, pad: int = PAD) -> Column:
    """For each block of 2^n ids: whether any is no pad. One pass over whole batches of rows; not for use inside lambdas."""
    return batches.any_in_blocks(ids, 2**n, pad)


def hash_uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from the MD5 of keys and seed, the same in any partitioning and engine."""
    text = F.concat_ws(":", *[k.cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def mask_ratio(ids: Column, mask: int = MASK, pad: int = PAD) -> Column:
    """Masked part of what is no pad; null if all is pad."""
    n = seq_length(ids, pad)
    return F.when(n > 0, F.size(F.filter(ids, lambda x: x == mask)) / F.when(n > 0, n))


def draw_text(seed: int, *keys: Column) -> Column:
    """32 hexadecimal digits from keys and seed: four draws of eight digits each, the first one that of hash_uniform."""
    return F.md5(F.concat_ws(":", *[k.cast("string") for k in keys], F.lit(str(seed))))


def drawn_below(digits: Column, number: int, rate: float) -> Column:
    """Whether the draw of that number among digits is below rate, by comparing digits as text."""
    limit = math.ceil(rate * 2**32)
    if limit > 2**32 - 1:
        return F.lit(True)
    return F.substring(digits, 8 * number + 1, 8) < f"{max(limit, 0):08x}"


def mlm_ids(seq_id: Column, ids: Column, seed: int, vocab_size: int, n_special: int, rate: float = 0.15, split: tuple[float, float] = (0.8, 0.1), mask: int = MASK) -> Column:
    """Structs (id, label) for masked language modelling; label -100 where nothing is to be predicted.

    Of the tokens that are no specials a part `rate` is picked; of these split[0] are masked, split[1] become another
    token, the rest stays. The three draws of a position come from one hash of the sequence, position and seed, and specials need none.
    """
    kinds = vocab_size - n_special

    def one(x, pos):
        def drawn(digits):
            other = F.conv(F.substring(digits, 17, 8), 16, 10).cast("double") / 4294967296.0
            shifted = (x - n_special + 1 + F.floor(other * (kinds - 1)).cast("int")) % kinds + n_special
            new = F.when(drawn_below(digits, 1, split[0]), F.lit(mask)).when(drawn_below(digits, 1, split[0] + split[1]), shifted).otherwise(x)
            picked = F.struct(new.cast("int").alias("id"), x.cast("int").alias("label"))
            return F.when(drawn_below(digits, 0, rate), picked).otherwise(left)

        left = F.struct(x.cast("int").alias("id"), F.lit(-100).alias("label"))
        return F.when(x >= n_special, let(draw_text(seed, seq_id, pos), drawn)).otherwise(left)

    return F.transform(ids, one)


def uniform_mask(seq_id: Column, ids: Column, seed: int, rate: float, mask: int = MASK, skip: int | None = None) -> Column:
    """Structs (id, truth, masked): values masked at a uniform rate; pads as well, unless skip names their id."""

    def one(x, pos):
        hit = drawn_below(draw_text(seed, seq_id, pos), 0, rate)
        hit = hit if skip is None else (x != skip) & hit
        entry = lambda id, masked: F.struct(id.cast("int").alias("id"), x.cast("int").alias("truth"), F.lit(masked).alias("masked"))
        return F.when(hit, entry(F.lit(mask), True)).otherwise(entry(x, False))

    return F.transform(ids, one)


def _limit(rate: float) -> int:
    """The draws below a rate are those below this number."""
    return max(0, math.ceil(rate * 2**32))


def mlm_arrays(seq_id: Column, ids: Column, seed: int, vocab_size: int, n_special: int, rate: float = 0.15, split: tuple[float, float] = (0.8, 0.1), mask: int = MASK) -> Column:
    """What mlm_ids gives as a struct of two arrays (ids, labels), for whole batches of rows; not for use inside lambdas."""
    return batches.masked_arrays(seq_id, ids, seed, vocab_size, n_special, (_limit(rate), _limit(split[0]), _limit(split[0] + split[1])), mask)


def uniform_mask_arrays(seq_id: Column, ids: Column, seed: int, rate: float, mask: int = MASK, skip: int | None = None) -> Column:
    """What uniform_mask gives as a struct of arrays (ids, truth) and the number n_masked, for whole batches of rows; not for use inside lambdas."""
    return batches.uniformly_masked(seq_id, ids, seed, _limit(rate), mask, skip)


@F.arrow_udf(ArrayType(IntegerType()))
def _counted_from(ids: pa.Array, pad: pa.Array) -> pa.Array:
    real = np.asarray(pc.fill_null(pc.not_equal(pc.list_flatten(ids), pad[0].as_py()), False))
    # starts of the arrays among all entries; a null array has none
    counts = np.asarray(pc.fill_null(pc.list_value_length(ids), 0)).astype(np.int64)
    before = np.repeat(np.r_[0, real.cumsum()][np.r_[0, counts.cumsum()][:-1]], counts)
    places = (real.cumsum() - before) * real + pad[0].as_py()
    return pa.ListArray.from_arrays(pa.array(np.r_[0, counts.cumsum()].astype(np.int32)), pa.array(places.astype(np.int32)), mask=ids.is_null())


def position_ids(ids: Column, pad: int = PAD) -> Column:
    """For each id its place among those that are no pads, from pad + 1 on; pads have pad. One running sum over the array, in Arrow; null ids count as pads."""
    return _counted_from(ids, F.lit(pad))


def detokenize(ids: Column, tokens: list[str], on_error: str = "raise") -> Column:
    """The text of ids, tokens[i] the token of id i."""
    return _found(batches.text_of(ids, tokens), ids, "an id is not in the vocabulary", on_error)
