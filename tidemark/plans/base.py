"""Bars, conditions and side tables derived from the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bars import tick_bars, with_indicators
from ..operators.outcomes import with_forward
from ..operators.predicates import Atom, parse_condition, triggers
from ..operators.simulate import with_prices

H = 5
HOUR = 3600
TEXTS = [
    "rsi_14 < 40", "rsi_14 > 60", "cci_14 < -80", "mom_10 > 100", "stoch_14_1_1_k > 80", "ma_20_sma > close", "close crosses_above ma_20_sma", "close crosses_below ma_3_sma",
    "rsi_14 < 45 AND close < ma_20_sma", "tick_volume >= 2", "wpr_14 <= -80", "rsi_14 != 50", "stoch_14_1_1_k == 100", "rsi_14 crosses_above 50",
]
CONDITIONS = [parse_condition(t) for t in TEXTS]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tick_bars(read(spark, sf_dir, "events"), "event_type", "ts", "value")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tick_bars(read(spark, sf_dir, "orders"), "o_orderpriority", "o_orderdate", "o_totalprice", "day", "o_orderkey")


def indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_indicators(hourly(spark, sf_dir))


def full_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators, outcomes and prices of every bar: one shuffle by symbol."""
    return with_prices(with_forward(indicators(spark, sf_dir), H))


def side(df: DataFrame) -> DataFrame:
    return df.withColumn("direction", F.when(F.col("cond_id") % 2 == 0, "long").otherwise("short"))


def hits(bars: DataFrame, conditions=None) -> DataFrame:
    keep = [c for c in ("n", "fwd", "valid", "entry", "atr", "entry_hour", "regimes") if c in bars.columns]
    return side(triggers(bars, conditions or CONDITIONS, keep=keep))


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a calendar event of its own symbol."""
    e = read(spark, sf_dir, "events")
    t = F.unix_timestamp(F.col("ts").cast("timestamp"))
    k = F.col("event_id")
    return e.select(
        F.col("event_type").alias("symbol"), t.alias("t"), "ts", (k % 5).alias("event_id"), F.when(k % 13 == 0, 2.0).otherwise(1.0).alias("event_type"), (1 + k % 3).cast("double").alias("importance"),
        F.when(k % 7 == 0, 0.0).when(k % 2 == 0, 1.0).otherwise(-1.0).alias("impact"), F.lit(1).alias("sign"), F.when(k % 11 != 0, F.col("value")).alias("actual"), F.lit(50.0).alias("forecast"),
    )


BARS = """
raw AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS time, arg_min(value, ts)::FLOAT AS open, max(value)::FLOAT AS high, min(value)::FLOAT AS low,
               arg_max(value, ts)::FLOAT AS close, count(*) AS tick_volume FROM events GROUP BY 1, 2),
bars AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time) - 1 AS bar_idx, count(*) OVER (PARTITION BY symbol) AS n FROM raw)"""

DAILY = """
draw AS (SELECT o_orderpriority AS symbol, date_trunc('day', o_orderdate) AS time, arg_min(o_totalprice, o_orderkey)::FLOAT AS open, max(o_totalprice)::FLOAT AS high, min(o_totalprice)::FLOAT AS low,
               arg_max(o_totalprice, o_orderkey)::FLOAT AS close, count(*) AS tick_volume FROM orders GROUP BY 1, 2),
dbars AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time) - 1 AS bar_idx, count(*) OVER (PARTITION BY symbol) AS n FROM draw)"""

INDICATORS = (
    BARS
    + """,
i0 AS (SELECT *, close::DOUBLE AS c, high::DOUBLE AS h, low::DOUBLE AS l, lag(close) OVER w::DOUBLE AS pc FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx)),
i1 AS (SELECT *, greatest(h - l, abs(h - pc), abs(l - pc)) AS tr, c - pc AS d, (h + l + c) / 3 AS tp FROM i0),
i2 AS (SELECT *, CASE WHEN bar_idx >= 2 THEN avg(c) OVER w3 END::FLOAT AS ma_3_sma, CASE WHEN bar_idx >= 19 THEN avg(c) OVER w20 END::FLOAT AS ma_20_sma,
              CASE WHEN bar_idx >= 4 THEN (lag(c, 4) OVER w + 2 * lag(c, 3) OVER w + 3 * lag(c, 2) OVER w + 4 * lag(c, 1) OVER w + 5 * c) / 15 END::FLOAT AS ma_5_lwma,
              CASE WHEN bar_idx >= 19 THEN stddev_pop(c) OVER w20 END::FLOAT AS stddev_20, (100 * c / lag(c, 10) OVER w)::FLOAT AS mom_10,
              CASE WHEN bar_idx >= 13 THEN avg(tr) OVER w14 END::FLOAT AS atr_14,
              CASE WHEN bar_idx >= 14 THEN sum(greatest(d, 0.0)) OVER w14 END AS up, CASE WHEN bar_idx >= 14 THEN sum(greatest(-d, 0.0)) OVER w14 END AS down,
              max(h) OVER w14 AS hh, min(l) OVER w14 AS ll, avg(tp) OVER w14 AS mtp, list(tp) OVER w14 AS tps
       FROM i1 WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx), w3 AS (PARTITION BY symbol ORDER BY bar_idx ROWS 2 PRECEDING),
                      w14 AS (PARTITION BY symbol ORDER BY bar_idx ROWS 13 PRECEDING), w20 AS (PARTITION BY symbol ORDER BY bar_idx ROWS 19 PRECEDING)),
ind AS (SELECT symbol, time, open, high, low, close, tick_volume, bar_idx, n, ma_3_sma, ma_20_sma, ma_5_lwma, stddev_20, mom_10, atr_14,
               (100 * up / nullif(up + down, 0))::FLOAT AS rsi_14,
               CASE WHEN bar_idx >= 13 THEN (tp - mtp) / nullif(0.015::DOUBLE * list_sum(list_transform(tps, lambda x: abs(x - mtp))) / 14, 0) END::FLOAT AS cci_14,
               CASE WHEN bar_idx >= 13 THEN 100 * (c - ll) / nullif(hh - ll, 0) END::FLOAT AS stoch_14_1_1_k,
               CASE WHEN bar_idx >= 13 THEN 100 * (c - ll) / nullif(hh - ll, 0) - 100 END::FLOAT AS wpr_14,
               (ma_20_sma::DOUBLE + 2 * stddev_20::DOUBLE)::FLOAT AS bb_20_2_upper, (ma_20_sma::DOUBLE - 2 * stddev_20::DOUBLE)::FLOAT AS bb_20_2_lower FROM i2)"""
)


def atom_sql(a: Atom) -> str:
    two = isinstance(a.threshold, str)
    t = a.threshold if two else f"{a.threshold!r}::FLOAT"
    if a.op.startswith("crosses"):
        before = f"lag({t}) OVER w" if two else t
        x, y = (">", "<=") if a.op == "crosses_above" else ("<", ">=")
        out = f"({a.column} {x} {t} AND lag({a.column}) OVER w {y} {before})"
    else:
        out = f"({a.column} {'=' if a.op == '==' else a.op} {t})"
    out = f"coalesce({out}, {'TRUE' if a.op == '!=' else 'FALSE'})"
    return f"({out} OR bar_idx = 0)" if two else out


def full_sql(conditions=None, source: str = "ind", more: str = "") -> str:
    """CTEs up to `full` (bars with fwd, valid, entry, atr, hours) and `hits`."""
    fwd = ", ".join(f"coalesce((lead(close, {h}) OVER w > lead(open, 1) OVER w)::INT, 0)" for h in range(1, H + 1))
    conditions = conditions or CONDITIONS
    flags = ", ".join(f"({' AND '.join(atom_sql(a) for a in c.atoms)}) AS h{k}" for k, c in enumerate(conditions))
    union = " UNION ALL ".join(f"SELECT *, {k} AS cond_id FROM flags WHERE h{k}" for k in range(len(conditions)))
    return (
        INDICATORS
        + more
        + f""",
full_bars AS (SELECT *, [{fwd}] AS fwd, bar_idx < n - {H} AS valid, lead(open, 1) OVER w::DOUBLE AS entry, CASE WHEN atr_14 > 0 AND atr_14 < 'inf'::FLOAT THEN atr_14::DOUBLE END AS atr,
                     hour(time) AS hour, lead(hour(time), 1) OVER w AS entry_hour FROM {source} WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx)),
flags AS (SELECT *, {flags} FROM full_bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx)),
hits0 AS ({union}),
hits AS (SELECT *, CASE WHEN cond_id % 2 = 0 THEN 'long' ELSE 'short' END AS direction FROM hits0)"""
    )


def nudge(digits: int) -> float:
    """What is added before rounding, so that exact halves go one way in every engine."""
    return float(f"1e-{digits + 4}")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles and floats rounded, so that two engines' sums compare; no negative zero."""
    return df.select(*[(F.round(F.col(c).cast("double") + nudge(digits), digits) + 0.0).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def nudged(sql: str) -> str:
    """SQL in which every round(x, digits) adds what `rounded` adds."""
    out, at = "", 0
    while (k := sql.find("round(", at)) >= 0:
        if k and (sql[k - 1].isalnum() or sql[k - 1] == "_"):
            out, at = out + sql[at : k + 6], k + 6
            continue
        depth, end, comma = 1, k + 6, None
        while depth:
            c = sql[end]
            depth += (c in "([{") - (c in ")]}")
            if c == "," and depth == 1:
                comma = end
            end += 1
        if comma is None:  # whole numbers are part of the data, not of the comparison
            out, at = out + sql[at : k + 6], k + 6
            continue
        digits = int(sql[comma + 1 : end - 1])
        out += f"{sql[at:k]}(round(({nudged(sql[k + 6 : comma])})::DOUBLE + {nudge(digits)!r}::DOUBLE, {digits}) + 0.0::DOUBLE)"
        at = end
    return out + sql[at:]
