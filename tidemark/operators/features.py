"""Volatility regime, price structure and news columns of bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import NEWS
from .predicates import by_bar


def volatility_regime(bars: DataFrame, lookback: int = 200, average: int = 20, atr: str = "atr_14", atr_period: int = 14) -> DataFrame:
    """volregime_ columns: the ATR's percentile rank among the last lookback - 1 bars before it, its ratio to its mean, and the regime.

    Null until atr_period + lookback + average bars are known. Regime 0 up to 30, 2 from 70, else 1."""
    w = by_bar()
    x = F.col(atr).cast("double")
    warm = F.col("bar_idx") >= atr_period + lookback + average
    past = F.collect_list(x).over(w.rowsBetween(1 - lookback, -1))
    df = bars.withColumn("_p", past).withColumn("_m", F.avg(x).over(w.rowsBetween(1 - average, 0)))
    less = F.size(F.filter("_p", lambda v: v < x))
    equal = F.size(F.filter("_p", lambda v: v == x))
    pctl = F.when(warm & x.isNotNull(), 100 * (less + 0.5 * equal) / (lookback - 1))
    ratio = F.when(warm & x.isNotNull(), F.when(F.col("_m") > 0, x / F.nullif(F.col("_m"), F.lit(0.0))).otherwise(1.0))
    df = df.withColumns({"volregime_atr_pctl": pctl.cast("float"), "volregime_atr_ratio": ratio.cast("float")})
    p = F.col("volregime_atr_pctl")
    return df.withColumn("volregime_regime", F.when(p <= 30, 0).when(p >= 70, 2).when(p.isNotNull(), 1).cast("float")).drop("_p", "_m")


def round_step(price: Column, digits: int | None = None) -> Column:
    """Distance of round numbers: fixed for 4/5 and 3 digits, else a twentieth of the price's power of ten."""
    if digits in (4, 5):
        return F.lit(0.0050)
    if digits == 3:
        return F.lit(0.50)
    return F.pow(F.lit(10.0), F.floor(F.log10(price))) / 20


def price_structure(bars: DataFrame, digits: int | None = None, gap_atr: float = 0.10, session_hours: int = 8, look_back: int = 6) -> DataFrame:
    """ps_ columns at the close: distances to the previous day's and session's extremes and to round numbers, gap and its fill, in ATRs of the bar before.

    The previous session is the last one with bars, null if it lies more than look_back sessions back."""
    w = by_bar()
    day, session = F.to_date("time"), F.floor(F.unix_timestamp(F.col("time").cast("timestamp")) / (3600 * session_hours))
    df = bars.withColumn("_day", day).withColumn("_ses", session)
    num = lambda c: F.col(c).cast("double")

    def previous(part: str, p: str) -> DataFrame:
        each = df.groupBy("symbol", part).agg(F.max(num("high")).alias("h"), F.min(num("low")).alias("l"), F.max_by(num("close"), "bar_idx").alias("c"), F.min_by(num("open"), "bar_idx").alias("o"), F.min("bar_idx").alias("b"))
        lag = Window.partitionBy("symbol").orderBy("b")
        near = F.col(part) - F.lag(part).over(lag) <= look_back if part == "_ses" else F.lit(True)
        before = lambda c: F.when(near, F.lag(c).over(lag))
        return each.select("symbol", part, before("h").alias(f"_{p}h"), before("l").alias(f"_{p}l"), F.lag("c").over(lag).alias(f"_{p}c"), F.col("o").alias(f"_{p}o"))

    df = df.join(previous("_day", "d"), ["symbol", "_day"]).join(previous("_ses", "s"), ["symbol", "_ses"])
    today = Window.partitionBy("symbol", "_day").orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"_th": F.max(num("high")).over(today), "_tl": F.min(num("low")).over(today), "_atr": F.lag(num("atr_14")).over(w)})
    atr, c, step = F.when(F.col("_atr") > 0, F.col("_atr")), num("close"), round_step(num("close"), digits)
    gap = F.col("_do") - F.col("_dc")
    filled = F.when(gap > 0, F.col("_do") - F.col("_tl")).otherwise(F.col("_th") - F.col("_do"))
    fill = F.when(F.abs(gap) < gap_atr * atr, 100.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * filled / F.nullif(F.abs(gap), F.lit(0.0)))))
    away = lambda level: ((level - c) / atr).cast("float")
    return df.select(
        *bars.columns,
        away(F.col("_dh")).alias("ps_dist_pdh_atr"), away(F.col("_dl")).alias("ps_dist_pdl_atr"), away(F.col("_sh")).alias("ps_dist_sess_h_atr"), away(F.col("_sl")).alias("ps_dist_sess_l_atr"),
        away(F.ceil(c / step) * step).alias("ps_dist_round_up_atr"), away(F.floor(c / step) * step).alias("ps_dist_round_dn_atr"),
        (gap / atr).cast("float").alias("ps_gap_atr"), F.when(gap.isNotNull() & atr.isNotNull(), fill).cast("float").alias("ps_gap_fill_pct"),
    )


def news_features(bars: DataFrame, events: DataFrame, by: list[str], window_minutes: int = 30, seconds: int = 0) -> DataFrame:
    """The seven news_ columns from events (t, importance, surprise): an event at the reference time is the last one.

    The reference is the bar's close, open_s (epoch seconds) and `seconds` of the bar. One shuffle of
    the union, running values in both directions, and two running counts for the next 24 hours. Of events
    of one time the one with the greatest importance, then surprise, counts."""
    e = F.struct("t", "importance", "surprise")
    b = bars.withColumn("_t", F.col("open_s") + seconds).withColumn("_kind", F.lit(1))
    ev = events.select(*by, F.col("t").alias("_t"), F.lit(0).alias("_kind"), e.alias("_e"))
    part = Window.partitionBy(*by)
    running = lambda *order: F.last("_e", ignorenulls=True).over(part.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    u = b.unionByName(ev, allowMissingColumns=True).withColumns(
        {
            "_last": running("_t", "_kind", "_e"),
            "_next": running(F.col("_t").desc(), F.col("_kind").desc(), F.col("_e")),
            "_n": F.count("_e").over(part.orderBy("_t").rangeBetween(Window.unboundedPreceding, 86_400)) - F.count("_e").over(part.orderBy("_t").rangeBetween(Window.unboundedPreceding, 0)),
        }
    ).filter("_kind = 1")
    to, since = (F.col("_next.t") - F.col("_t")) / 60, (F.col("_t") - F.col("_last.t")) / 60
    f = lambda x: x.cast("float")
    inside = F.coalesce(to <= window_minutes, F.lit(False)) | F.coalesce(since <= window_minutes, F.lit(False))
    values = [to, F.col("_next.importance"), since, F.col("_last.importance"), F.col("_last.surprise"), inside.cast("int"), F.col("_n")]
    return u.select(*bars.columns, *[f(x).alias(c) for c, x in zip(NEWS, values)])
