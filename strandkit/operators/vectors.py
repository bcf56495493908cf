"""Sums of vectors per key without a row for each dimension."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _codes(columns: list[pa.Array]) -> np.ndarray:
    """A number for each row, equal where all columns are; nulls are equal to one another."""
    out = np.zeros(len(columns[0]), np.int64)
    for column in columns:
        own = column.dictionary_encode(null_encoding="encode")
        out = out * max(1, len(own.dictionary)) + np.asarray(own.indices)
        out = np.unique(out, return_inverse=True)[1].reshape(-1)
    return out


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The entries of all lists, and how many each has; a null list has none."""
    return np.asarray(pc.list_flatten(lists).cast(pa.float64()).to_numpy(zero_copy_only=False)), np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, sizes.cumsum()].astype(np.int32)), pa.array(values))


def _summed(rows: pa.Table, n_keys: int) -> pa.Table:
    """One row for each key of rows(keys, sums, counts)."""
    rows = rows.combine_chunks()
    columns = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in rows.columns]
    code = _codes(columns[:n_keys])
    first = np.unique(code, return_index=True)[1]
    (values, sizes), (counts, _) = _flat(columns[n_keys]), _flat(columns[n_keys + 1])
    dims = np.zeros(len(first), np.int64)
    np.maximum.at(dims, code, sizes)  # a key's longest vector
    starts = np.r_[0, dims.cumsum()]
    place = np.repeat(starts[code] - (sizes.cumsum() - sizes), sizes) + np.arange(len(values))
    sums, n = (np.bincount(place, weights=x, minlength=starts[-1]) for x in (values, counts))
    return pa.Table.from_arrays([*[c.take(pa.array(first)) for c in columns[:n_keys]], _lists(sums, dims), _lists(n.astype(np.int64), dims)], names=rows.column_names)


def vector_sums(df: DataFrame, keys: list[str], v: str = "v", held_bytes: int = 64 << 20) -> DataFrame:
    """(keys, sums, counts) of the vectors of each key: arrays with the sum, in double precision, and the number of values at each position.

    A task sums the vectors of its own rows first, so what is shuffled is a row for each key and task, whatever the dimensions; it
    passes on its sums when they exceed held_bytes. Sorted by key, these are summed as they come: a hot key is a sum, not a group.
    Vectors of a key may differ in length: a position counts those that reach it. Null values are left out, null vectors add
    nothing; a key that only has such, or empty ones, has empty arrays. Null keys are equal.
    """
    kept = df.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)], F.col(f"`{v}`").cast("array<double>").alias("v"))
    n_keys = len(keys)
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields[:n_keys]), "sums array<double>, counts array<bigint>"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            values, sizes = _flat(batch.column(n_keys))
            known = ~np.isnan(values) | np.asarray(pc.is_valid(pc.list_flatten(batch.column(n_keys))))
            rows = pa.Table.from_arrays([*batch.columns[:n_keys], _lists(np.where(known, values, 0.0), sizes), _lists(known.astype(np.int64), sizes)], names=[*batch.schema.names[:n_keys], "sums", "counts"])
            held.append(_summed(rows, n_keys))
            if sum(t.nbytes for t in held) > held_bytes:
                held = [_summed(pa.concat_tables(held), n_keys)]
                if held[0].nbytes > held_bytes // 2:
                    yield from held.pop().to_batches(max_chunksize=10_000)
        if held:
            yield from _summed(pa.concat_tables(held), n_keys).to_batches(max_chunksize=10_000)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = pa.Table.from_batches([batch])
            rest = _summed(own if rest is None else pa.concat_tables([rest, own]), n_keys)
            last = _codes([pa.chunked_array([rest.column(i).combine_chunks(), batch.column(i).slice(batch.num_rows - 1)]).combine_chunks() for i in range(n_keys)])
            goes_on = last[:-1] == last[-1]  # the key that the batch ends in
            yield from rest.filter(pa.array(~goes_on)).to_batches()
            rest = rest.filter(pa.array(goes_on))
        if rest is not None:
            yield from rest.to_batches()

    names = [f"k{i}" for i in range(n_keys)]
    dealt = kept.mapInArrow(partial, schema).repartition(*names).sortWithinPartitions(*names)
    return dealt.mapInArrow(merged, schema).select(*[F.col(n).alias(k) for n, k in zip(names, keys)], "sums", "counts")


def mean_vectors(df: DataFrame, keys: list[str], v: str = "v") -> DataFrame:
    """(keys, mean): the mean of the vectors of each key at each position, null where no vector has a value."""
    mean = F.transform(F.arrays_zip("sums", "counts"), lambda x: F.when(x["counts"] > 0, x["sums"] / x["counts"]))
    return vector_sums(df, keys, v).select(*keys, mean.alias("mean"))
