"""Probabilities, crops, up-sampling and coordinates of model outputs, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandkit.functions import batches
from strandkit.functions.arrays import let
from strandkit.functions.sequence import fail_unless


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def _raised(x: Column) -> Column:
    """Exponentials, shifted by the maximum."""
    return let(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(v - top)))


def softmax(x: Column) -> Column:
    """Softmax of an array, shifted by its maximum."""
    return let(_raised(x), lambda raised: let(_total(raised), lambda total: F.transform(raised, lambda v: v / total)))


def positive_prob(x: Column) -> Column:
    """Probability of the last class."""
    return let(_raised(x), lambda raised: F.element_at(raised, -1) / _total(raised))


def log_prob(x: Column, at: Column) -> Column:
    """Log probability of the class with that number, from 0."""
    return F.get(x, at) - F.array_max(x) - F.log(_total(_raised(x)))


def argmax(x: Column, m: int | None = None) -> Column:
    """Number of the greatest of the first m values, the first of equals."""
    part = F.slice(x, 1, m) if m else x
    return (F.array_position(part, F.array_max(part)) - 1).cast("int")


def top_k(x: Column, k: int) -> Column:
    """Structs (p, id) of the k greatest probabilities, the lower id first among equals."""
    p = softmax(x)
    pairs = F.transform(p, lambda v, i: F.struct((-v).alias("minus"), i.alias("id")))  # of equal ones the lower id first
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda s: F.struct((-s["minus"]).alias("p"), s["id"].alias("id")))


def crop_center(x: Column, keep: float) -> Column:
    """Without c // 2 values at each end, c = int((1 - keep) * length); an odd c leaves one more."""
    half = F.floor(((1 - keep) * F.size(x)).cast("int") / 2).cast("int")
    return F.slice(x, half + 1, F.size(x) - 2 * half)


def crop_to_length(x: Column, n: int, on_error: str = "raise") -> Column:
    """The middle n values; -1 for all. Of an odd surplus both ends lose the larger half, so one value less is left."""
    if n == -1:
        return x
    trim = F.floor((n - F.size(x)) / 2).cast("int")  # negative, floored
    kept = F.when(trim == 0, x).otherwise(F.slice(x, -trim + 1, F.greatest(F.size(x) + 2 * trim, F.lit(0))))
    return fail_unless(F.size(x) >= n, kept, f"shorter than {n}", on_error)


def prediction_start(start: Column, length: Column, keep: float) -> Column:
    """Genomic start of a centre-cropped prediction."""
    return start + (length * (1 - keep) / 2).cast("long")


def prediction_length(length: Column, keep: float) -> Column:
    return (length * keep).cast("long")


def track_position(start: Column, end: Column, n: Column, i: Column) -> Column:
    """Place of value i of n that are spaced evenly from start to end, both included."""
    return start + F.when(n > 1, i * (end - start) / F.when(n > 1, n - 1)).otherwise(0.0)


def upsample_x2(x: Column, method: str = "nearest") -> Column:
    """Twice as many values: each repeated, or followed by itself plus half the step to the next (0 for the last)."""
    if method == "nearest":
        return F.flatten(F.transform(x, lambda v: F.array(v, v)))
    if method == "linear":
        return F.flatten(F.transform(x, lambda v, i: F.array(v, v + (F.coalesce(F.get(x, i + 1), v) - v) / 2)))
    raise ValueError("method must be 'nearest' or 'linear'")


def spatial_features(x: Column, y: Column, low: float, high: float, n: int) -> Column:
    """cos(x / c) and sin(y / c) at n scales spaced evenly from low to high; c = low * (high / low) ** (scale / (n - 1))."""
    scales = [low + (high - low) * i / (n - 1) for i in range(n)]
    c = [low * (high / low) ** (s / (n - 1)) for s in scales]
    return F.array(*[f for v in c for f in (F.cos(x / F.lit(v)), F.sin(y / F.lit(v)))])


def expand_placeholders(ids: Column, placeholder: int, r: int) -> Column:
    """Each placeholder as r slots, cut to the original length. Slots have the placeholder's id."""
    return F.slice(F.flatten(F.transform(ids, lambda x: F.when(x == placeholder, F.array_repeat(x, r)).otherwise(F.array(x)))), F.lit(1), F.size(ids))


def compact_outputs(values: Column, ids: Column, placeholder: int, r: int) -> Column:
    """Values without the r that follow each placeholder of ids, and as many zeros at the end. Placeholders are taken in turn.

    By the turn of the j-th of them, place i counts without the j * r values removed before; so what stays are the stretches between
    placeholders, each j * r further on in the values: one pass, however many there are.
    """
    places = F.filter(F.transform(ids, lambda x, i: F.when(x == placeholder, i)), lambda i: i.isNotNull())

    def stretches(v: Column, at: Column) -> Column:
        before = lambda j: F.coalesce(F.get(at, j - 1), F.lit(-1)) + 1
        between = F.transform(at, lambda s, j: F.slice(v, before(j) + j * r + 1, s + 1 - before(j)))
        behind = before(F.size(at)) + F.size(at) * r
        kept = F.concat(F.flatten(between), F.slice(v, behind + 1, F.greatest(F.size(v) - behind, F.lit(0))))
        return let(kept, lambda k: F.concat(k, F.array_repeat(F.lit(0.0), F.size(v) - F.size(k))))

    return let(values, lambda v: let(places, lambda at: stretches(v, at)))


def first_pad(ids: Column, pad: int) -> Column:
    """Place of the first pad, from 0; null if there is none."""
    at = F.array_position(ids, F.lit(pad))
    return F.when(at > 0, (at - 1).cast("int"))


def answer_ids(ids: Column, start: Column, eos: int) -> Column:
    """Ids from start up to, without, the first eos after it."""
    return batches.between(ids, start, eos)
