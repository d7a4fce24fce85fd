"""Bars from a stream of ticks, and the last row of each bar time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.fold import fold_sorted, greedy


def stream_bars(ticks: DataFrame, symbol: str, time: str, price: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Closed bars of a fixed size; ticks later than `late` are dropped. Works on batch tables alike."""
    df = ticks.withColumn("_t", F.col(time).cast("timestamp"))
    df = df.withWatermark("_t", late) if ticks.isStreaming else df
    return df.groupBy(F.col(symbol).alias("symbol"), F.window("_t", size).alias("w")).agg(
        F.min_by(price, "_t").cast("float").alias("open"), F.max(price).cast("float").alias("high"), F.min(price).cast("float").alias("low"),
        F.max_by(price, "_t").cast("float").alias("close"), F.count("*").alias("tick_volume"),
    ).select("symbol", F.col("w.start").alias("time"), "open", "high", "low", "close", "tick_volume")


def open_positions(signals: DataFrame, hold: int) -> DataFrame:
    """Signals (symbol, ea_id, bar_idx, in order) to entries, one position at a time: the state is the first free bar.

    On a stream, one long for each (symbol, ea_id) is kept between batches."""
    schema = "symbol string, ea_id int, entry_idx long"
    if not signals.isStreaming:
        entries = signals.select("symbol", "ea_id", (F.col("bar_idx") + 1).cast("long").alias("bar_idx"))
        return fold_sorted(entries, ("symbol", "ea_id"), "bar_idx", *greedy(hold + 1), "bar_idx long").withColumnRenamed("bar_idx", "entry_idx")

    def more(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        free = state.get[0] if state.exists else -1
        taken = []
        for e in sorted(i + 1 for f in frames for i in f["bar_idx"].tolist()):
            if e >= free:
                taken.append(e)
                free = e + hold + 1
        state.update((free,))
        yield pd.DataFrame({"symbol": key[0], "ea_id": key[1], "entry_idx": taken})

    return signals.groupBy("symbol", "ea_id").applyInPandasWithState(more, schema, "free long", "append", "NoTimeout")
