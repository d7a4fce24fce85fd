"""Bars from events, and indicators with finite windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_bars(bars: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Add bar_idx, from 0 in order of time, and n, the symbol's bars."""
    w = Window.partitionBy(*keys)
    return bars.withColumn("bar_idx", F.row_number().over(w.orderBy("time")) - 1).withColumn("n", F.count("*").over(w))


def tick_bars(ticks: DataFrame, symbol: str, time: str, price: str, unit: str = "hour", order: str | None = None) -> DataFrame:
    """Bars of a calendar unit: open and close by first and last tick, combined before the shuffle."""
    by = F.struct(time, order) if order else F.col(time)
    bars = ticks.groupBy(F.col(symbol).alias("symbol"), F.date_trunc(unit, time).alias("time")).agg(
        F.min_by(price, by).cast("float").alias("open"),
        F.max(price).cast("float").alias("high"),
        F.min(price).cast("float").alias("low"),
        F.max_by(price, by).cast("float").alias("close"),
        F.count("*").alias("tick_volume"),
    )
    return number_bars(bars)


def _d(c: str) -> Column:
    return F.col(c).cast("double")


def with_indicators(bars: DataFrame) -> DataFrame:
    """Add moving averages, bands, momentum, RSI, CCI, Williams %R, stochastics and ATR, all of finite windows.

    One shuffle by symbol: every window shares its partitioning and order. Values are null until
    their window is full."""
    w = Window.partitionBy("symbol").orderBy("bar_idx")
    over = lambda n: w.rowsBetween(1 - n, 0)
    full = lambda x, n: F.when(F.col("bar_idx") >= n - 1, x)
    close = _d("close")
    prev = F.lag("close").over(w).cast("double")
    true_range = F.coalesce(F.greatest(_d("high") - _d("low"), F.abs(_d("high") - prev), F.abs(_d("low") - prev)), _d("high") - _d("low"))
    df = bars.withColumn("_tr", true_range).withColumn("_d", close - prev).withColumn("_tp", (_d("high") + _d("low") + close) / 3)
    f = lambda x: x.cast("float")
    df = df.select(
        "*",
        f(full(F.avg(close).over(over(3)), 3)).alias("ma_3_sma"),
        f(full(F.avg(close).over(over(20)), 20)).alias("ma_20_sma"),
        f(full(sum((n * F.lag(close, 5 - n).over(w) for n in range(1, 6)), F.lit(0.0)) / 15, 5)).alias("ma_5_lwma"),
        f(full(F.stddev_pop(close).over(over(20)), 20)).alias("stddev_20"),
        f(100 * close / F.lag(close, 10).over(w)).alias("mom_10"),
        f(full(F.avg("_tr").over(over(14)), 14)).alias("atr_14"),
        full(F.sum(F.greatest("_d", F.lit(0.0))).over(over(14)), 15).alias("_up"),
        full(F.sum(F.greatest(-F.col("_d"), F.lit(0.0))).over(over(14)), 15).alias("_down"),
        F.max(_d("high")).over(over(14)).alias("_hh"),
        F.min(_d("low")).over(over(14)).alias("_ll"),
        F.avg("_tp").over(over(14)).alias("_mtp"),
        F.collect_list("_tp").over(over(14)).alias("_tps"),
    )
    share = (close - F.col("_ll")) / F.nullif(F.col("_hh") - F.col("_ll"), F.lit(0.0))
    spread = F.aggregate("_tps", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("_mtp"))) / 14
    return df.select(
        *[c for c in df.columns if not c.startswith("_")],
        f(100 * F.col("_up") / F.nullif(F.col("_up") + F.col("_down"), F.lit(0.0))).alias("rsi_14"),
        f(full((F.col("_tp") - F.col("_mtp")) / F.nullif(0.015 * spread, F.lit(0.0)), 14)).alias("cci_14"),
        f(full(100 * share, 14)).alias("stoch_14_1_1_k"),
        f(full(100 * share - 100, 14)).alias("wpr_14"),
        f(_d("ma_20_sma") + 2 * _d("stddev_20")).alias("bb_20_2_upper"),
        f(_d("ma_20_sma") - 2 * _d("stddev_20")).alias("bb_20_2_lower"),
    )
