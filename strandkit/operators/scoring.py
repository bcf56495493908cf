"""Scoring rows with a predictor that the caller supplies."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def length_batches(lengths: np.ndarray, batch_size: int, most_values: int | None = None) -> Iterator[np.ndarray]:
    """The rows of each batch: of near length, at most batch_size of them and, padded to the longest, most_values values; a longer row is a batch of its own."""
    order = np.argsort(lengths, kind="stable")
    first = 0
    for at in range(len(order)):
        full = at - first == batch_size or (most_values is not None and at > first and (at - first + 1) * lengths[order[at]] > most_values)
        if full:
            yield order[first:at]
            first = at
    if first < len(order):
        yield order[first:]


def padded_share(batches: list[np.ndarray]) -> float:
    """Which part of the values would be padding, if the rows of each batch, given by their lengths, were padded to its longest."""
    room = sum(len(b) * b.max() for b in batches)
    return 1 - sum(b.sum() for b in batches) / room if room else 0.0


def _predictor(load: Callable, keep_as: str | None):
    """What load gives; if keep_as names it, the one that this worker process has loaded before."""
    if keep_as is None:
        return load()
    held = sys.modules.setdefault("strandkit_worker_state", types.ModuleType("strandkit_worker_state")).__dict__
    name = f"predictor {keep_as}"
    if name not in held:
        held[name] = load()
    return held[name]


def score_batches(
    df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], dict]], columns: list[str], outputs: dict[str, str], batch_size: int = 256,
    length: str | None = None, most_values: int | None = None, chunk_rows: int = 4096, keep_as: str | None = None, profile=None,
) -> DataFrame:
    """df's columns with named outputs of a predictor.

    load gives the predictor, a function of a pandas frame of at most batch_size rows that returns a sequence per output name. Only the
    outputs asked for, with their SQL types, come back; others it returns are left. Arrays are NumPy arrays in the frame.

    load is called once in each task or, with keep_as, a name for what it gives, once in each worker process, which outlives tasks.
    With length, the name of an array column, a task gathers chunk_rows rows and makes batches of rows of near length of them, so that
    little is padding; with most_values a batch of long rows has fewer of them. Rows then come back in another order. profile is a resource
    profile, as for accelerators, for the stage that scores.
    """
    kept = df.select(*columns)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), *(f"`{name}` {kind}" for name, kind in outputs.items())])

    def chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for frame in frames:
            held.append(frame)
            n += len(frame)
            if n >= chunk_rows:
                yield pd.concat(held, ignore_index=True)
                held, n = [], 0
        if n:
            yield pd.concat(held, ignore_index=True)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = _predictor(load, keep_as)
        for frame in chunks(frames) if length else frames:
            if length:
                sizes = np.array([0 if x is None else len(x) for x in frame[length]], np.int64)
                parts = length_batches(sizes, batch_size, most_values)
            else:
                parts = (np.arange(at, min(at + batch_size, len(frame))) for at in range(0, len(frame), batch_size))
            for rows in parts:
                part = frame.iloc[rows].reset_index(drop=True)
                found = predict(part)
                yield part.assign(**{name: list(found[name]) for name in outputs})

    return kept.mapInPandas(run, schema, profile=profile)


def output_names(layers: list[int] = (), attention: list[tuple[int, int]] = (), n_layers: int = 12, n_heads: int = 12) -> list[str]:
    """Names of outputs to ask a predictor for: layers from 1; attention by layer from 1 and head from 0."""
    if bad := [x for x in layers if not 1 <= x <= n_layers] + [x for x in attention if not (1 <= x[0] <= n_layers and 0 <= x[1] < n_heads)]:
        raise ValueError(f"no such output: {bad}")
    return [f"embeddings_{x}" for x in layers] + [f"attention_map_layer_{a}_number_{b}" for a, b in attention]
