"""As-of joins of events to bars, by one sorted pass over the union of both."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import timeframe_seconds

#: Minutes that stand for "none near".
FAR_MINUTES = 1440


def asof(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str], forward: bool = False, inclusive: bool = False) -> DataFrame:
    """Left's rows with the values (prefixed asof_) of the nearest right row before (or after) them in time.

    Sorted once by key and time with the two sides interleaved; at equal times the order of the
    sides decides whether an equal right row counts. Of right rows of one time the one with the
    greatest values counts. Forward sorts downwards, so that both directions keep one running value."""
    value = F.struct(F.col(right_time).alias("_t"), *values)
    first = 0 if inclusive != forward else 2
    l = left.withColumn("_time", F.col(left_time)).withColumn("_kind", F.lit(1))
    r = right.select(*by, F.col(right_time).alias("_time"), F.lit(first).alias("_kind"), value.alias("_v"))
    order = [F.col("_time").desc(), F.col("_kind").desc(), F.col("_v")] if forward else ["_time", "_kind", "_v"]
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r, allowMissingColumns=True).withColumn("_found", F.last("_v", ignorenulls=True).over(w)).filter("_kind = 1")
    return both.select(*left.columns, F.col("_found._t").alias("asof_time"), *[F.col(f"_found.{v}").alias(f"asof_{v}") for v in values])


def currencies(symbol: str) -> tuple[str | None, str]:
    """(base, quote) of a pair; metals have a quote only."""
    m = re.match(r"^([A-Za-z]{3})([A-Za-z]{3})", symbol)
    if not m:
        raise ValueError(f"no currencies in {symbol!r}")
    base, quote = m[1].upper(), m[2].upper()
    return (None if base in ("XAU", "XAG", "XPT", "XPD") else base), quote


def currency_sign(currency: Column, symbol: str) -> Column:
    """1 for the base currency, -1 for the quote currency, else 0."""
    base, quote = currencies(symbol)
    out = F.when(currency == quote, -1).otherwise(0)
    return F.when(currency == base, 1).otherwise(out) if base else out


@dataclass(frozen=True)
class CalendarOptions:
    high: int = 3
    medium: int = 2
    max_minutes: int = FAR_MINUTES
    impact_max_age: int = 240
    holiday_type: int = 2
    min_history: int = 4


def surprise_z(events: DataFrame, min_history: int = 4, keys: tuple[str, ...] = ("event_id",), time: str = "t") -> DataFrame:
    """Add surprise (actual less forecast) and z: the surprise over the sample deviation of the key's earlier ones."""
    past = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, -1)
    df = events.withColumn("surprise", F.col("actual") - F.col("forecast"))
    sd = F.when(F.count("surprise").over(past) >= min_history, F.stddev_samp("surprise").over(past))
    return df.withColumn("z", F.col("surprise") / F.nullif(sd, F.lit(0.0)))


def released_groups(events: DataFrame, by: list[str], options: CalendarOptions = CalendarOptions()) -> DataFrame:
    """by, t, impact, absz of each time with releases of high importance whose impact is signed.

    Only these releases make the history of surprises. impact: the sign of their summed impact x
    currency sign; absz: their largest |z|, null without history."""
    high = events.filter((F.col("importance") >= options.high) & F.col("actual").isNotNull() & F.col("impact").isin(1, -1))
    z = surprise_z(high, options.min_history, ("event_id", *by))
    return z.groupBy(*by, "t").agg(F.signum(F.sum(F.col("impact") * F.col("sign")).cast("double")).alias("impact"), F.max(F.abs("z")).alias("absz"))


def calendar_features(bars: DataFrame, events: DataFrame, seconds: int, by: list[str], options: CalendarOptions = CalendarOptions()) -> DataFrame:
    """The ten cal_ columns of bars (open_s, the open in epoch seconds) from events (by, t, event_id, event_type, importance, impact, sign, actual, forecast).

    Of each tier, minutes to the next and since the last event, and whether one lies in this bar or
    the next: the next event may lie at the close itself, the last one only before it. Impact and
    surprise of the last release of high importance, 0 once it is too old. All are null outside the
    span of the feed. Events are one row a time before they meet the bars; both directions of all
    tiers are two running values over one shuffle of the union."""
    if taken := [c for c in bars.columns if c.startswith("cal_")]:
        raise ValueError(f"calendar columns exist: {taken}")
    feed = events.filter(F.coalesce(F.col("event_type") != options.holiday_type, F.lit(True)) & F.col("importance").isNotNull())
    tiers = {"high": options.high, "medplus": options.medium}
    times = feed.groupBy(*by, "t").agg(F.max("importance").alias("_i"))
    groups = released_groups(feed, by, options).select(*by, "t", F.struct(F.col("t").alias("at"), "impact", "absz").alias("_g"))
    times = times.join(groups, [*by, "t"], "left").select(*by, F.col("t").alias("_at"), F.lit(2).alias("_kind"), F.col("t").alias("_any"), "_g", *[F.when(F.col("_i") >= least, F.col("t")).alias(f"_{n}") for n, least in tiers.items()])
    b = bars.withColumn("_at", F.col("open_s") + seconds).withColumn("_kind", F.lit(1))
    part = Window.partitionBy(*(by or [F.lit(0)]))
    # At equal times the event comes after the bar: strictly before going up, at or after going down.
    up = part.orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    down = part.orderBy(F.col("_at").desc(), F.col("_kind").desc()).rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c, w: F.last(c, ignorenulls=True).over(w)
    seen = {f"{c}_up": last(c, up) for c in ("_any", "_g", *[f"_{n}" for n in tiers])} | {f"{c}_down": last(c, down) for c in ("_any", *[f"_{n}" for n in tiers])}
    df = b.unionByName(times, allowMissingColumns=True).withColumns(seen).filter("_kind = 1")
    close, far = F.col("_at"), F.lit(float(options.max_minutes))
    minutes = lambda x: F.coalesce(F.least(x / 60, far), far)
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("int")
    made = {}
    for n in tiers:
        nxt, prev = F.col(f"_{n}_down"), F.col(f"_{n}_up")
        made |= {
            f"cal_min_to_next_{n}": minutes(nxt - close), f"cal_min_since_last_{n}": minutes(close - prev),
            f"cal_{n}_in_bar": flag(prev >= F.col("open_s")), f"cal_{n}_next_bar": flag(nxt < close + seconds),
        }
    fresh = F.coalesce((close - F.col("_g_up.at")) / 60 <= options.impact_max_age, F.lit(False))
    made["cal_last_impact_sym"] = F.when(fresh, F.coalesce("_g_up.impact", F.lit(0.0))).otherwise(0.0)
    made["cal_last_surprise_absz"] = F.when(fresh, F.col("_g_up.absz")).otherwise(0.0)
    inside = F.col("_any_down").isNotNull() & (F.col("_any_up").isNotNull() | (F.col("_any_down") == close))
    return df.select(*bars.columns, *[F.when(inside, x).cast("float").alias(c) for c, x in made.items()])


def symbol_events(calendar: DataFrame, symbol: str, wanted: list[str] | None = None) -> DataFrame:
    """Events of read_calendar that concern a symbol: those of its currencies (or of `wanted`), with impact 1, -1 or null and the currency's sign."""
    names = [c.upper() for c in wanted] if wanted else [c for c in currencies(symbol) if c]
    impact = F.when(F.col("impact_type") == 1, 1).when(F.col("impact_type") == 2, -1)
    return calendar.filter(F.col("currency").isin(names)).withColumns({"impact": impact, "sign": currency_sign(F.col("currency"), symbol)})


def attach_calendar(bars: DataFrame, calendar: DataFrame, symbol: str, timeframe: str, options: CalendarOptions = CalendarOptions(), wanted: list[str] | None = None) -> DataFrame:
    """Bars (time, the open) of one symbol with the cal_ columns from a calendar file's rows."""
    b = bars.withColumn("open_s", F.unix_timestamp(F.col("time").cast("timestamp")))
    return calendar_features(b, symbol_events(calendar, symbol, wanted), timeframe_seconds(timeframe), [], options).drop("open_s")


def align_spread(bars: DataFrame, spreads: DataFrame, fixed: float, by: list[str], order: str = "bar_idx") -> DataFrame:
    """Add spread: that of the bar's own time, else the last known one, else the fixed; and fallback, whether fixed. Not positive counts as missing."""
    df = bars.join(spreads.select(*by, "time", F.when(F.col("spread") > 0, F.col("spread")).alias("_s")), [*by, "time"], "left")
    known = F.last("_s", ignorenulls=True).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_k", known).select(*bars.columns, F.coalesce("_k", F.lit(fixed)).alias("spread"), F.col("_k").isNull().alias("fallback"))


def spread_statistics(spreads: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Of positive spreads: n, mean, median, p90, p99 and most; and the mean by hour of the day."""
    known = spreads.filter("spread > 0")
    shares = {"median": 0.5, "p90": 0.9, "p99": 0.99}
    whole = known.groupBy(*by).agg(F.count("*").alias("n"), F.avg("spread").alias("mean"), *[F.percentile("spread", p).alias(n) for n, p in shares.items()], F.max("spread").alias("most"))
    return whole, known.groupBy(*by, F.hour("time").alias("hour")).agg(F.count("*").alias("n"), F.avg("spread").alias("mean"))
