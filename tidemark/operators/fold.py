"""Folds over sorted rows with a bounded state, where no window function can say what depends on earlier choices."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def _spans(batch: pa.RecordBatch, keys: Sequence[str]) -> list[tuple[int, int]]:
    """Runs of rows with equal keys."""
    n = batch.num_rows
    new = np.zeros(n, bool)
    for k in keys:
        codes = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    heads = [0, *np.flatnonzero(new).tolist(), n]
    return list(zip(heads[:-1], heads[1:]))


def fold_sorted(df: DataFrame, keys: Sequence[str], order: str, start: Callable[[], Any], step: Callable[[Any, pa.RecordBatch], tuple[Any, dict]], schema: str) -> DataFrame:
    """Rows of each key in order, an Arrow batch at a time, to what `step` makes of them; the state is carried between batches.

    step(state, rows of one key) gives the next state and a dict of output columns of one length.
    schema: those columns; the keys come before them. A key's rows are one task's, and are never
    held at once, whatever their number."""
    kinds = dict(df.dtypes)
    full = ", ".join([*[f"{k} {kinds[k]}" for k in keys], schema])
    arrow = to_arrow_schema(StructType.fromDDL(full))
    made = [f for f in arrow][len(keys) :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None
        for batch in batches:
            for a, b in _spans(batch, keys) if batch.num_rows else []:
                rows = batch.slice(a, b - a)
                key = tuple(rows.column(k)[0].as_py() for k in keys)
                if key != now:
                    now, state = key, start()
                state, out = step(state, rows)
                arrays = [x.cast(f.type) if isinstance(x := out[f.name], pa.Array) else pa.array(x, f.type) for f in made]
                if len(arrays[0]):
                    same = [pa.array([v], arrow.field(k).type).take(pa.array(np.zeros(len(arrays[0]), np.int32))) for k, v in zip(keys, key)]
                    yield pa.RecordBatch.from_arrays([*same, *arrays], schema=arrow)

    return df.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(run, full)


def greedy(gap: int) -> tuple[Callable[[], int], Callable[[int, pa.RecordBatch], tuple[int, dict]]]:
    """start and step of a choice of bar_idx in which each is `gap` or more behind the one before."""

    def step(free: int, rows: pa.RecordBatch) -> tuple[int, dict]:
        at = rows.column("bar_idx").to_numpy()
        k, taken = int(np.searchsorted(at, free)), []
        while k < len(at):
            taken.append(int(at[k]))
            free = taken[-1] + gap
            k = int(np.searchsorted(at, free))
        return free, {"bar_idx": taken}

    return lambda: -(2**62), step
