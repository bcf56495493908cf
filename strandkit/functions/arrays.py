"""Helpers for array expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once. Inside the lambda of another array function it would be once per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dense(entries: Column, n: Column, zero: Column) -> Column:
    """An array of n values from structs (pos, value) in any order, zero where there is none; of equal positions the greatest value.

    Positions outside 0 to n - 1 are left out. One pass over the sorted entries, each after the zeros of the gap before it.
    """

    def fill(e: Column) -> Column:
        def filled(u: Column) -> Column:
            before = lambda i: F.when(i > 0, F.get(u, i - 1)["pos"]).otherwise(-1)
            parts = F.transform(u, lambda x, i: F.concat(F.array_repeat(zero, x["pos"].cast("int") - before(i).cast("int") - 1), F.array(x["value"])))
            last = F.when(F.size(u) > 0, F.element_at(F.when(F.size(u) > 0, u), -1)["pos"]).otherwise(-1).cast("int")
            return F.concat(F.flatten(parts), F.array_repeat(zero, n.cast("int") - 1 - last))

        return let(F.filter(e, lambda x, i: F.coalesce(F.get(e, i + 1)["pos"] != x["pos"], F.lit(True))), filled)

    return let(F.sort_array(F.filter(entries, lambda x: (x["pos"] >= 0) & (x["pos"] < n))), fill)


def dense_text(entries: Column, n: Column, zero: str, after: tuple[str, Column] | None = None) -> Column:
    """What `dense` gives, joined by commas, without the array: a gap is one repeated string, so an entry costs a step and a zero a copied byte or two.

    The zeros in front of the first entry and behind the last are put around the rest, so they are copied once. A row with a null value
    takes the array, as array_join leaves nulls out. after=(text, k) puts k times that text behind.
    """

    def fill(e: Column) -> Column:
        def filled(u: Column) -> Column:
            gap = lambda x, i: F.when(i > 0, x["pos"] - F.get(u, i - 1)["pos"] - 1).otherwise(0).cast("int")
            between = F.array_join(F.transform(u, lambda x, i: F.concat(F.repeat(F.lit(zero + ","), gap(x, i)), x["value"].cast("string"))), ",")
            first, last = F.get(u, F.lit(0))["pos"].cast("int"), F.get(u, F.size(u) - 1)["pos"].cast("int")
            return F.concat(F.repeat(F.lit(zero + ","), first), between, F.repeat(F.lit("," + zero), n.cast("int") - 1 - last), *behind)

        return let(F.filter(e, lambda x, i: F.coalesce(F.get(e, i + 1)["pos"] != x["pos"], F.lit(True))), filled)

    behind = [F.repeat(F.lit("," + after[0]), after[1])] if after else []
    inside = F.filter(entries, lambda x: (x["pos"] >= 0) & (x["pos"] < n))
    by_array = F.concat(F.array_join(dense(entries, n, F.lit(int(zero))).cast("array<string>"), ","), *behind)
    plain = (F.size(inside) > 0) & ~F.exists(inside, lambda x: x["value"].isNull())
    return F.when(plain, let(F.sort_array(inside), fill)).otherwise(by_array)
