"""One query for each operator group on the driver's tables, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import adjust_p
from ..operators import asof, backtest, features, gate, generate, outcomes, predicates, rank, report, simulate, validate
from ..operators.indicators import export_columns
from ..schema import NEWS, PRICE_STRUCTURE
from ..session import ship
from ..streaming.bars import open_positions, stream_bars
from . import outputs
from .base import BARS, CONDITIONS, DAILY, H, HOUR, INDICATORS, TEXTS, calendar, daily, full_bars, full_sql, hits, hourly, indicators, nudged, read, rounded

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
COSTS = simulate.Costs(spread=0.4, slippage=0.1, sessions=((22, 3, 1.7), (0, 7, 1.5), (7, 16, 1.0)))
HALF = "((0.4 * (CASE WHEN entry_hour >= 22 OR entry_hour < 3 THEN 1.7 WHEN entry_hour >= 0 AND entry_hour < 7 THEN 1.5 ELSE 1.0 END) + 0.1) / 2)::DOUBLE"
SIGN = "(CASE WHEN direction = 'short' THEN -1 ELSE 1 END)"


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = nudged(sql)
        return f

    return keep


def r(*names: str) -> str:
    return ", ".join(f"round({n}::DOUBLE, 6) AS {n}" for n in names)


@query(f"WITH {BARS} SELECT symbol, epoch(time)::BIGINT AS t, bar_idx, n, tick_volume, {r('open', 'high', 'low', 'close')} FROM bars")
def d1_bars(spark, sf):
    return rounded(hourly(spark, sf).select("symbol", F.unix_timestamp("time").alias("t"), "bar_idx", "n", "tick_volume", "open", "high", "low", "close"))


_IND = ["ma_3_sma", "ma_20_sma", "ma_5_lwma", "stddev_20", "mom_10", "atr_14", "rsi_14", "cci_14", "stoch_14_1_1_k", "wpr_14", "bb_20_2_upper", "bb_20_2_lower"]


@query(f"WITH {INDICATORS} SELECT symbol, bar_idx, {', '.join(f'round({c}::DOUBLE, 2) AS {c}' for c in _IND)} FROM ind")
def i1_indicators(spark, sf):
    return rounded(indicators(spark, sf).select("symbol", "bar_idx", *_IND), 2)


def _ema(x: str, n: int) -> str:
    return f"list_reduce(list({x}) OVER u, lambda a, b: a + (b - a) * {2 / (n + 1)!r}::DOUBLE)"


def _smma(x: str, n: int, some: str = "") -> str:
    held = f"(list({x}) {some} OVER u)"
    return f"CASE WHEN len({held}) >= {n} THEN list_reduce(list_prepend(list_avg({held}[1:{n}]), {held}[{n + 1}:]), lambda a, b: (a * {n - 1} + b) / {n}::DOUBLE) END"


def _mean(x: str, n: int, least: int) -> str:
    return f"CASE WHEN bar_idx >= {least} THEN avg({x}) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS {n - 1} PRECEDING) END"


_UP = "WINDOW u AS (PARTITION BY symbol ORDER BY bar_idx ROWS UNBOUNDED PRECEDING), w AS (PARTITION BY symbol ORDER BY bar_idx), w14 AS (PARTITION BY symbol ORDER BY bar_idx ROWS 13 PRECEDING)"
# Directional movement, its two means, and the mean of how far these are apart.
_ADX = f"""dm0 AS (SELECT *, coalesce(c - pc, 0) AS mv, coalesce(greatest(h - l, abs(h - pc), abs(l - pc)), 0) AS tr0, greatest(h - lag(h) OVER w, 0) AS du, greatest(lag(l) OVER w - l, 0) AS dd, (h + l + c) / 3 AS tp0, (h + l) / 2 AS md,
    tick_volume::DOUBLE AS v, open::DOUBLE AS o FROM i0 {_UP}),
    dm1 AS (SELECT *, CASE WHEN du > dd THEN du ELSE 0 END AS dp, CASE WHEN dd > du THEN dd ELSE 0 END AS dn FROM dm0), dm2 AS (SELECT *, CASE WHEN tr0 <> 0 THEN 100 * dp / tr0 ELSE 0 END AS sp, CASE WHEN tr0 <> 0 THEN 100 * dn / tr0 ELSE 0 END AS sn FROM dm1),
    dm3 AS (SELECT *, {_ema('sp', 14)} AS pdi, {_ema('sn', 14)} AS ndi FROM dm2 {_UP}), dm4 AS (SELECT *, CASE WHEN pdi + ndi <> 0 THEN 100 * abs(pdi - ndi) / (pdi + ndi) ELSE 0 END AS dx FROM dm3), dm AS (SELECT *, {_ema('dx', 14)} AS adx FROM dm4 {_UP})"""
_EXPORT = {
    "ma_20_ema": _ema("c", 20), "ma_20_smma": _smma("c", 20), "dema_10": f"2 * e10 - {_ema('e10', 10)}", "macd_12_26_9_main": "mc", "macd_12_26_9_signal": _mean("mc", 9, 8), "adx_14": "adx",
    "rsi_14": "CASE WHEN ls <> 0 THEN 100 - 100 / (1 + gn / ls) WHEN gn IS NULL THEN NULL WHEN gn <> 0 THEN 100 ELSE 50 END", "bears_13": f"l - {_ema('c', 13)}", "bulls_13": f"h - {_ema('c', 13)}",
    "ad": "sum(fl) OVER u", "obv": "sum(CASE WHEN bar_idx = 0 THEN v ELSE sign(mv) * v END) OVER u", "ao": "ao", "ac": f"ao - {_mean('ao', 5, 37)}", "atr_14": _mean("tr0", 14, 14), "mom_14": "100 * c / lag(c, 14) OVER w", "force_13": "v * (m13 - lag(m13) OVER w)",
    "demarker_14": "CASE WHEN bar_idx >= 14 THEN coalesce(sum(du) OVER w14 / nullif(sum(du) OVER w14 + sum(dd) OVER w14, 0), 0) END", "trix_14": "(t3 - lag(t3) OVER w) / lag(t3) OVER w", "chaikin_3_10": "ch",
    "mfi_14": "CASE WHEN bar_idx >= 14 THEN coalesce(100 - 100 / (1 + sum(CASE WHEN td > 0 THEN tp0 * v ELSE 0 END) OVER w14 / nullif(sum(CASE WHEN td < 0 THEN tp0 * v ELSE 0 END) OVER w14, 0)), 100) END",
}


@query(
    f"""WITH {INDICATORS}, {_ADX}, x1 AS (SELECT *, coalesce((2 * c - l - h) / nullif(h - l, 0), 0) * v AS fl, {_ema('c', 10)} AS e10, {_ema('c', 12)} - {_ema('c', 26)} AS mc, {_mean('md', 5, 33)} - {_mean('md', 34, 33)} AS ao, {_mean('c', 13, 12)} AS m13, {_ema('c', 14)} AS t1, tp0 - lag(tp0) OVER w AS td,
    {_smma('greatest(mv, 0)', 14, 'FILTER (bar_idx > 0)')} AS gn, {_smma('greatest(-mv, 0)', 14, 'FILTER (bar_idx > 0)')} AS ls FROM dm {_UP}), x2 AS (SELECT *, sum(fl) OVER u AS acc, {_ema('t1', 14)} AS t2 FROM x1 {_UP}), x3 AS (SELECT *, {_ema('t2', 14)} AS t3, {_ema('acc', 3)} - {_ema('acc', 10)} AS ch FROM x2 {_UP}),
    x4 AS (SELECT symbol, bar_idx, {', '.join(f'({x})::FLOAT AS {c}' for c, x in _EXPORT.items())} FROM x3 {_UP}) SELECT symbol, bar_idx, {', '.join(f'round({c}, 2) AS {c}' for c in _EXPORT)} FROM x4"""
)
def i1_export_columns(spark, sf):
    return rounded(export_columns(hourly(spark, sf)).select("symbol", "bar_idx", *_EXPORT), 2)


@query(f"WITH {full_sql()} SELECT symbol, cond_id, bar_idx FROM hits")
def p1_p16_triggers(spark, sf):
    return hits(indicators(spark, sf)).select("symbol", "cond_id", "bar_idx")


@query(
    f"""WITH {full_sql()}, d AS (SELECT symbol, floor((epoch(max(time)) - epoch(min(time))) / 86400) AS days FROM bars GROUP BY 1),
    k AS (SELECT symbol, cond_id, count(*) AS n FROM hits GROUP BY 1, 2)
    SELECT symbol, cond_id, k.n, round(coalesce(k.n / nullif(days / 365.25::DOUBLE, 0), 0), 6) AS per_year FROM k JOIN d USING (symbol) WHERE k.n >= 50 AND coalesce(k.n / nullif(days / 365.25::DOUBLE, 0), 0) >= 10"""
)
def p17_frequency(spark, sf):
    b = indicators(spark, sf)
    return rounded(predicates.frequency_filter(hits(b), b))


_QUOTED = ", ".join(f"({k}, '{t}')" for k, t in enumerate(TEXTS))


@query(
    f"""WITH t(cond_id, txt) AS (VALUES {_QUOTED}), p AS (SELECT cond_id, generate_subscripts(string_split(txt, ' AND '), 1) AS i, string_split(unnest(string_split(txt, ' AND ')), ' ') AS w FROM t),
    q AS (SELECT cond_id, i, w[1] AS a, w[2] AS op, w[3] AS b, try_cast(w[3] AS DOUBLE) AS x FROM p)
    SELECT cond_id, string_agg(a || ' ' || op || ' ' || coalesce(x::VARCHAR, b), ' AND ' ORDER BY i) AS condition, string_agg(a || CASE WHEN x IS NULL THEN ',' || b ELSE '' END, ',' ORDER BY i) AS columns, '' AS custom FROM q GROUP BY 1"""
)
def p14_condition_columns(spark, sf):
    rows = [(k, str(c), ",".join(c.columns), ",".join(c.uses("cal_", "news_", "ps_"))) for k, c in enumerate(CONDITIONS)]
    return spark.createDataFrame(rows, "cond_id int, condition string, columns string, custom string")


_PROFILE = full_sql() + (
    ", hs AS (SELECT unnest(range(1, 6)) AS horizon), prof AS (SELECT symbol, cond_id, horizon, sum(fwd[horizon]) AS n_bull, count(*) AS nn, sum(fwd[horizon]) / count(*)::DOUBLE AS prob_bull FROM hits, hs WHERE valid GROUP BY 1, 2, 3),"
    " base AS (SELECT symbol, horizon, sum(fwd[horizon]) / count(*)::DOUBLE AS base_prob FROM full_bars, hs WHERE valid GROUP BY 1, 2)"
)


@query(f"WITH {_PROFILE} SELECT symbol, cond_id, horizon, n_bull::BIGINT AS n_bull, nn AS n, {r('prob_bull')} FROM prof")
def a1_profile(spark, sf):
    return rounded(outcomes.profile(hits(full_bars(spark, sf)), H))


@query(f"WITH {_PROFILE} SELECT symbol, horizon, {r('base_prob')} FROM base")
def a2_baseline(spark, sf):
    return rounded(outcomes.baseline(full_bars(spark, sf), H))


def _significance(spark, sf, **options):
    b = full_bars(spark, sf)
    return outcomes.significance(outcomes.profile(hits(b), H), outcomes.baseline(b, H), **options)


_Z = "1.96::DOUBLE"
_SIG = f"""{_PROFILE}, s AS (SELECT symbol, cond_id, horizon, n_bull, nn, prob_bull, base_prob, prob_bull - base_prob AS effect_size,
    CASE WHEN base_prob * (1 - base_prob) = 0 THEN 0 ELSE (prob_bull - base_prob) / sqrt(base_prob * (1 - base_prob) / nn) END AS z,
    greatest(0, (prob_bull + {_Z} * {_Z} / (2 * nn)) / (1 + {_Z} * {_Z} / nn) - {_Z} * sqrt(prob_bull * (1 - prob_bull) / nn + {_Z} * {_Z} / (4 * nn * nn)) / (1 + {_Z} * {_Z} / nn)) AS ci_low,
    least(1, (prob_bull + {_Z} * {_Z} / (2 * nn)) / (1 + {_Z} * {_Z} / nn) + {_Z} * sqrt(prob_bull * (1 - prob_bull) / nn + {_Z} * {_Z} / (4 * nn * nn)) / (1 + {_Z} * {_Z} / nn)) AS ci_high
    FROM prof JOIN base USING (symbol, horizon))"""


@query(f"WITH {_SIG} SELECT symbol, cond_id, horizon, {r('z', 'ci_low', 'ci_high', 'effect_size')} FROM s")
def a3_a5_z_and_wilson(spark, sf):
    return rounded(_significance(spark, sf).select("symbol", "cond_id", "horizon", "z", "ci_low", "ci_high", "effect_size"))


@query(
    """WITH e AS (SELECT event_type AS symbol, event_id, CASE WHEN event_id % 7 <> 0 THEN ((event_id * 7919) % 1009) / 1009.0::DOUBLE END AS p FROM events),
    k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY p NULLS LAST) AS rk, count(p) OVER (PARTITION BY symbol) AS m FROM e)
    SELECT symbol, event_id, round(CASE WHEN p IS NOT NULL THEN min(least(1, p * m / rk)) FILTER (p IS NOT NULL) OVER (PARTITION BY symbol ORDER BY rk DESC ROWS UNBOUNDED PRECEDING) END, 6) AS p_adj FROM k"""
)
def a6_bh_adjust(spark, sf):
    e = read(spark, sf, "events").select(F.col("event_type").alias("symbol"), "event_id", F.when(F.col("event_id") % 7 != 0, ((F.col("event_id") * 7919) % 1009) / 1009.0).alias("p"))
    return rounded(adjust_p(e, "p", keys=("symbol",)).drop("p"))


_ERF = "(SELECT exp(-x * x) * sum(exp((2 * k + 1) * ln(x) - lgamma(k + 1.5))) FROM (SELECT unnest(range(0, 400)) AS k))"
_P = f"""{_SIG}, pv0 AS (SELECT *, greatest(abs(z) / sqrt(2), 1e-12) AS x FROM s), pv AS (SELECT *, CASE WHEN x > 5 THEN 0 ELSE 1 - {_ERF} END AS p_value FROM pv0),
    pr AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY p_value) AS rk, count(*) OVER (PARTITION BY symbol) AS m FROM pv),
    pa AS (SELECT *, min(least(1, p_value * m / rk)) OVER (PARTITION BY symbol ORDER BY rk DESC ROWS UNBOUNDED PRECEDING) AS p_adj FROM pr)"""


@query(f"WITH {_P} SELECT symbol, cond_id, horizon, n_bull, nn AS n, {r('prob_bull', 'base_prob', 'z', 'ci_low', 'ci_high', 'p_value', 'effect_size', 'p_adj')}, p_adj < 0.05 AS significant FROM pa")
def a7_significance(spark, sf):
    return rounded(_significance(spark, sf))


@query(
    f"""WITH {_SIG} SELECT symbol, cond_id, arg_max(horizon, struct_pack(a := effect_size, b := -(ci_high - ci_low), c := -horizon)) AS optimal_horizon FROM s WHERE abs(z) > 0.5 GROUP BY 1, 2"""
)
def a8_optimal_horizon(spark, sf):
    return outcomes.optimal_horizon(_significance(spark, sf).withColumn("significant", F.abs("z") > 0.5))


@query(
    f"""WITH {_SIG}, best AS (SELECT symbol, cond_id, arg_max(horizon, struct_pack(a := effect_size, b := -(ci_high - ci_low), c := -horizon)) AS optimal_horizon FROM s WHERE abs(z) > 0.5 GROUP BY 1, 2)
    SELECT b.symbol, b.cond_id, optimal_horizon, round(f.prob_bull, 6) AS prob_bull, round(a.base_prob, 6) AS base_prob, CASE WHEN f.prob_bull >= a.base_prob THEN 'long' ELSE 'short' END AS direction
    FROM best b JOIN s f ON f.symbol = b.symbol AND f.cond_id = b.cond_id AND f.horizon = 1 JOIN s a ON a.symbol = b.symbol AND a.cond_id = b.cond_id AND a.horizon = optimal_horizon"""
)
def a9_direction(spark, sf):
    s = _significance(spark, sf).withColumn("significant", F.abs("z") > 0.5)
    return rounded(outcomes.direction(s, outcomes.optimal_horizon(s)).select("symbol", "cond_id", "optimal_horizon", "prob_bull", "base_prob", "direction"))


@query(
    f"""WITH {full_sql()}, b AS (SELECT symbol, avg(fwd[2]) AS base FROM full_bars WHERE bar_idx < n - 2 GROUP BY 1), p AS (SELECT symbol, cond_id, avg(fwd[2]) AS p FROM hits WHERE bar_idx < n - 2 GROUP BY 1, 2)
    SELECT symbol, cond_id, round(abs(p - base), 6) AS score FROM p JOIN b USING (symbol)"""
)
def g11_screen(spark, sf):
    b = full_bars(spark, sf)
    return rounded(generate.screen(hits(b), b))


@query(
    """WITH e AS (SELECT event_type AS symbol, event_id AS cond_id, 'f' || (event_id % 4) AS family, ((event_id * 31) % 997) / 997.0::DOUBLE AS score FROM events),
    k AS (SELECT *, row_number() OVER (PARTITION BY symbol, family ORDER BY score DESC, cond_id) <= 3 AS f FROM e),
    q AS (SELECT *, row_number() OVER (PARTITION BY symbol, f ORDER BY score DESC, cond_id) AS rk, count_if(f) OVER (PARTITION BY symbol) AS nf FROM k)
    SELECT symbol, cond_id, family, round(score, 6) AS score FROM q WHERE f OR rk <= 15 - nf"""
)
def g12_stratified_pool(spark, sf):
    e = read(spark, sf, "events")
    scored = e.select(F.col("event_type").alias("symbol"), F.col("event_id").alias("cond_id"), F.concat(F.lit("f"), (F.col("event_id") % 4).cast("string")).alias("family"), (((F.col("event_id") * 31) % 997) / 997.0).alias("score"))
    return rounded(generate.stratified_pool(scored, 15))


_CORR = ["rsi_14", "cci_14", "mom_10", "stoch_14_1_1_k"]


@query(
    f"WITH {INDICATORS} "
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}::DOUBLE, {b}::DOUBLE), 6) AS r FROM ind" for i, a in enumerate(_CORR) for b in _CORR[i + 1 :])
)
def g15_correlations(spark, sf):
    rows = [(a, b, x) for (a, b), x in generate.correlations(indicators(spark, sf), _CORR).items()]
    return rounded(spark.createDataFrame(rows, "a string, b string, r double"))


_ATOMS = """ats(col, thr, op, k) AS (SELECT c, t, o, row_number() OVER () FROM (SELECT unnest(['rsi_14', 'cci_14', 'stoch_14_1_1_k']) AS c, unnest([[30, 70], [-100, 100], [20, 80]]) AS ts) JOIN (SELECT unnest(['<', '>']) AS o) ON TRUE, unnest(ts) AS u(t) UNION ALL SELECT 'mom_10', 0, '>', 100),
    ma AS (SELECT unnest(['ma_3_sma', 'ma_20_sma', 'ma_5_lwma']) || ' ' || o || ' close' AS condition FROM (SELECT unnest(['<', '>']) AS o)),
    tx AS (SELECT *, col || ' ' || op || ' ' || thr || '.0' AS txt, list_position(['rsi_14', 'cci_14', 'mom_10', 'stoch_14_1_1_k'], col) AS f FROM ats)"""
_APART = "(SELECT coalesce(max(abs(r)), 0) <= 0.85 FROM cr WHERE least(f1, f2) = least({a}.f, {b}.f) AND greatest(f1, f2) = greatest({a}.f, {b}.f))"


@query(
    f"""WITH {INDICATORS}, {_ATOMS}, cr AS ({' UNION ALL '.join(f"SELECT {i + 1} AS f1, {j + 1} AS f2, corr({a}::DOUBLE, {b}::DOUBLE) AS r FROM ind" for i, a in enumerate(_CORR) for j, b in enumerate(_CORR) if i < j)})
    SELECT txt AS condition, 1 AS n_atoms FROM tx UNION ALL SELECT condition, 1 FROM ma
    UNION ALL SELECT a.txt || ' AND ' || b.txt, 2 FROM tx a JOIN tx b ON a.f < b.f WHERE {_APART.format(a='a', b='b')}
    UNION ALL SELECT a.txt || ' AND ' || b.txt || ' AND ' || c.txt, 3 FROM tx a JOIN tx b ON a.f < b.f JOIN tx c ON b.f < c.f WHERE {_APART.format(a='a', b='b')} AND {_APART.format(a='a', b='c')} AND {_APART.format(a='b', b='c')}"""
)
def g1_g13_generated(spark, sf):
    b = indicators(spark, sf)
    found = generate.atoms(b.columns, moving_averages=True)
    combos = generate.combine([a for a in found if a.column in _CORR], generate.correlations(b, _CORR), 3)
    return spark.createDataFrame([(str(x), len(getattr(x, "atoms", (x,)))) for x in [*found, *combos]], "condition string, n_atoms int")


_CAL = """cal0 AS (SELECT event_type AS symbol, floor(epoch(ts))::BIGINT AS t, event_id % 5 AS event_id, CASE WHEN event_id % 13 = 0 THEN 2 ELSE 1 END AS kind, 1 + event_id % 3 AS importance, CASE WHEN event_id % 7 = 0 THEN 0.0 WHEN event_id % 2 = 0 THEN 1.0 ELSE -1.0 END AS impact,
    CASE WHEN event_id % 11 <> 0 THEN value END AS actual, 50.0::DOUBLE AS forecast, ts FROM events), cal AS (SELECT * FROM cal0 WHERE kind <> 2)"""


def _tier_sql(least: int) -> str:
    e = f"(SELECT DISTINCT symbol, t FROM cal WHERE importance >= {least})"
    return f"""SELECT b.symbol, b.bar_idx, b.close_s, f.t AS nxt, l.t AS lst FROM cb b ASOF LEFT JOIN {e} f ON b.symbol = f.symbol AND b.close_s <= f.t ASOF LEFT JOIN {e} l ON b.symbol = l.symbol AND b.close_s > l.t"""


def _tier_columns(a: str, tier: str) -> str:
    return f"""coalesce(least(({a}.nxt - close_s) / 60.0, 1440), 1440) AS cal_min_to_next_{tier}, coalesce(least((close_s - {a}.lst) / 60.0, 1440), 1440) AS cal_min_since_last_{tier},
    coalesce({a}.lst >= close_s - 3600, FALSE)::INT AS cal_{tier}_in_bar, coalesce({a}.nxt < close_s + 3600, FALSE)::INT AS cal_{tier}_next_bar"""


_CALENDAR = [f"cal_{m}_{t}" for t in ("high", "medplus") for m in ("min_to_next", "min_since_last")] + ["cal_last_impact_sym", "cal_last_surprise_absz"]
_CALENDAR += [f"cal_{t}_{m}" for t in ("high", "medplus") for m in ("in_bar", "next_bar")]


@query(
    f"""WITH {BARS}, {_CAL}, cb AS (SELECT symbol, bar_idx, epoch(time)::BIGINT + 3600 AS close_s FROM bars), hi AS ({_tier_sql(3)}), me AS ({_tier_sql(2)}),
    z0 AS (SELECT *, actual - forecast AS sur FROM cal WHERE importance >= 3 AND actual IS NOT NULL AND impact <> 0),
    z AS (SELECT *, CASE WHEN count(sur) OVER w >= 4 THEN stddev_samp(sur) OVER w END AS sd FROM z0 WINDOW w AS (PARTITION BY event_id, symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    g AS (SELECT symbol, t, sign(sum(impact)) AS impact, max(abs(sur / nullif(sd, 0))) AS absz FROM z GROUP BY 1, 2),
    span AS (SELECT symbol, min(t) AS lo, max(t) AS hi FROM cal GROUP BY 1),
    j AS (SELECT hi.symbol, hi.bar_idx, hi.close_s, {_tier_columns('hi', 'high')}, {_tier_columns('me', 'medplus')} FROM hi JOIN me USING (symbol, bar_idx, close_s)),
    k AS (SELECT j.*, CASE WHEN (j.close_s - g.t) / 60.0 <= 240 THEN g.impact ELSE 0 END AS cal_last_impact_sym, CASE WHEN (j.close_s - g.t) / 60.0 <= 240 THEN g.absz ELSE 0 END AS cal_last_surprise_absz FROM j ASOF LEFT JOIN g ON j.symbol = g.symbol AND j.close_s > g.t)
    SELECT symbol, bar_idx, {', '.join(f'CASE WHEN close_s BETWEEN lo AND hi THEN round({c}::FLOAT, 2) END AS {c}' for c in _CALENDAR)} FROM k JOIN span USING (symbol)"""
)
def i5_calendar(spark, sf):
    b = hourly(spark, sf).withColumn("open_s", F.unix_timestamp("time"))
    return rounded(asof.calendar_features(b, calendar(spark, sf), HOUR, ["symbol"]).select("symbol", "bar_idx", *_CALENDAR), 2)


@query(
    f"""WITH {BARS}, e AS (SELECT event_type AS symbol, ts, max(event_id) AS event_id FROM events GROUP BY 1, 2)
    SELECT b.symbol, b.bar_idx, e.event_id AS last_id, f.event_id AS next_id FROM bars b ASOF LEFT JOIN e ON b.symbol = e.symbol AND b.time > e.ts ASOF LEFT JOIN e f ON b.symbol = f.symbol AND b.time <= f.ts"""
)
def j2_j3_asof(spark, sf):
    b = hourly(spark, sf).select("symbol", "bar_idx", F.col("time").cast("timestamp").alias("time"))
    e = read(spark, sf, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    out = asof.asof(b, e, ["symbol"], "time", "ts", ["event_id"]).withColumnRenamed("asof_event_id", "last_id").drop("asof_time")
    out = asof.asof(out, e, ["symbol"], "time", "ts", ["event_id"], forward=True, inclusive=True)
    return out.select("symbol", "bar_idx", "last_id", F.col("asof_event_id").alias("next_id"))


def _spread_table(spark, sf):
    """Spreads by hour, of all events."""
    e = read(spark, sf, "events")
    return e.groupBy(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").alias("time")).agg((F.floor(F.avg("value") + 1e-6) - 40.0).alias("spread"))


_SPREAD = "sp AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS time, floor(avg(value) + 1e-6::DOUBLE) - 40 AS spread FROM events GROUP BY 1, 2), al AS (SELECT b.symbol, b.time, b.open, b.bar_idx, b.n, last_value(CASE WHEN sp.spread > 0 THEN sp.spread END IGNORE NULLS) OVER (PARTITION BY b.symbol ORDER BY b.bar_idx ROWS UNBOUNDED PRECEDING) AS k FROM bars b LEFT JOIN sp USING (symbol, time))"


@query(f"WITH {BARS}, {_SPREAD} SELECT symbol, bar_idx, round(coalesce(k, 30.0), 4) AS spread, k IS NULL AS fallback FROM al")
def j9_spread(spark, sf):
    out = asof.align_spread(hourly(spark, sf), _spread_table(spark, sf), 30.0, ["symbol"])
    return rounded(out.select("symbol", "bar_idx", "spread", "fallback"), 4)


@query(f"WITH {BARS}, {_SPREAD} SELECT symbol, count(*) AS n, round(avg(spread), 6) AS mean, round(quantile_cont(spread, 0.5), 6) AS median, round(quantile_cont(spread, 0.9), 6) AS p90, round(quantile_cont(spread, 0.99), 6) AS p99, max(spread) AS most FROM sp WHERE spread > 0 GROUP BY 1")
def a29_spread_calibration(spark, sf):
    return rounded(asof.spread_statistics(_spread_table(spark, sf), ["symbol"])[0])


@query(f"WITH {BARS}, {_SPREAD} SELECT symbol, hour(time)::INT AS hour, count(*) AS n, round(avg(spread), 6) AS mean FROM sp WHERE spread > 0 GROUP BY 1, 2")
def a29_spread_by_hour(spark, sf):
    return rounded(asof.spread_statistics(_spread_table(spark, sf), ["symbol"])[1])


_TRADES = f"""{full_sql()}, x AS (SELECT symbol, bar_idx AS exit_idx, close::DOUBLE AS ex, open::DOUBLE AS exo, hour(time) AS exit_hour FROM bars),
    tr AS (SELECT h.symbol, h.cond_id, h.direction, h.bar_idx, x.exit_idx, CASE WHEN bar_idx + 8 >= n THEN 'timeout' ELSE 'exit' END AS outcome, {SIGN} * (ex - entry) - 2 * {HALF} AS pnl, ({SIGN} * (ex - entry) - 2 * {HALF}) / atr AS r
           FROM hits h JOIN x ON h.symbol = x.symbol AND x.exit_idx = least(h.bar_idx + 8, h.n - 1) WHERE h.bar_idx + 1 < h.n AND atr IS NOT NULL)"""


def _trades(spark, sf):
    b = full_bars(spark, sf)
    return simulate.simulate(hits(b), b, COSTS, 7), b


@query(f"WITH {_TRADES} SELECT symbol, cond_id, bar_idx, exit_idx, outcome, {r('pnl', 'r')} FROM tr")
def m1_simulate(spark, sf):
    return rounded(_trades(spark, sf)[0].drop("direction"))


ATR_COSTS = simulate.Costs(slippage=0.1, spread_atr_mult=0.05, sessions=COSTS.sessions)
_ATR_HALF = HALF.replace("(0.4 *", "(0.05::DOUBLE * atr *")


@query(f"WITH {_TRADES.replace(HALF, _ATR_HALF)} SELECT symbol, cond_id, bar_idx, exit_idx, {r('pnl', 'r')} FROM tr")
def m5_atr_costs(spark, sf):
    """Spreads by the ATR and the session."""
    b = full_bars(spark, sf)
    return rounded(simulate.simulate(hits(b), b, ATR_COSTS, 7).drop("direction", "outcome"))


def _stats_sql(source: str) -> str:
    return f"""e AS (SELECT *, sum(pnl) OVER w AS eq FROM {source} WINDOW w AS (PARTITION BY symbol, cond_id ORDER BY bar_idx ROWS UNBOUNDED PRECEDING)),
    dd AS (SELECT *, max(eq) OVER (PARTITION BY symbol, cond_id ORDER BY bar_idx ROWS UNBOUNDED PRECEDING) - eq AS fall FROM e),
    st AS (SELECT symbol, cond_id, count(*) AS n_trades, count_if(pnl > 0)::BIGINT AS wins, count_if(outcome = 'timeout')::BIGINT AS timeouts, avg((pnl > 0)::INT) AS win_rate, coalesce(avg(pnl) FILTER (pnl > 0), 0) AS avg_win, coalesce(avg(pnl) FILTER (pnl <= 0), 0) AS avg_loss,
           avg(pnl) AS expectancy, avg(r) AS expectancy_r, CASE WHEN coalesce(sum(-pnl) FILTER (pnl <= 0), 0) > 0 THEN coalesce(sum(pnl) FILTER (pnl > 0), 0) / sum(-pnl) FILTER (pnl <= 0) ELSE 'inf'::DOUBLE END AS profit_factor,
           max(fall) AS max_drawdown FROM dd GROUP BY 1, 2)"""


_STATS = f"SELECT symbol, cond_id, n_trades, wins, timeouts, {r('win_rate', 'avg_win', 'avg_loss', 'expectancy', 'expectancy_r', 'profit_factor', 'max_drawdown')} FROM st"


@query(f"WITH {_TRADES}, {_stats_sql('tr')} {_STATS}")
def a12_trade_stats(spark, sf):
    return rounded(simulate.trade_stats(_trades(spark, sf)[0]))


_SCAN = f"""{full_sql()}, x AS (SELECT symbol, bar_idx AS exit_idx, close::DOUBLE AS ex FROM bars), hz AS (SELECT unnest(range(1, 13)) AS horizon),
    rr AS (SELECT h.symbol, cond_id, horizon, ({SIGN} * (ex - entry) - 2 * {HALF}) / atr AS r FROM hits h, hz, x WHERE atr IS NOT NULL AND x.symbol = h.symbol AND x.exit_idx = h.bar_idx + 1 + horizon),
    sc AS (SELECT symbol, cond_id, horizon, count(*) AS n_trades, avg(r) AS mean_r, stddev_samp(r) AS std_r, avg(r) / nullif(stddev_samp(r) / sqrt(count(*)), 0) AS score FROM rr GROUP BY 1, 2, 3)"""


@query(f"WITH {_SCAN} SELECT symbol, cond_id, horizon, n_trades, {r('mean_r', 'std_r', 'score')} FROM sc")
def a13_horizon_scan(spark, sf):
    b = full_bars(spark, sf)
    return rounded(simulate.horizon_scan(hits(b), b, COSTS, 1, 12))


@query(f"WITH {_SCAN} SELECT symbol, cond_id, arg_max(horizon, struct_pack(a := score, b := -horizon)) AS best_horizon FROM sc WHERE score IS NOT NULL GROUP BY 1, 2")
def a14_best_horizon(spark, sf):
    b = full_bars(spark, sf)
    return simulate.best_horizon(simulate.horizon_scan(hits(b), b, COSTS, 1, 12))


_FACTOR = "(CASE WHEN {h} >= 22 OR {h} < 3 THEN 1.7 WHEN {h} >= 0 AND {h} < 7 THEN 1.5 ELSE 1.0 END)"
_OPEN = f"""{full_sql()}, x AS (SELECT symbol, bar_idx AS exit_idx, open::DOUBLE AS ex, hour(time) AS exit_hour FROM bars),
    tr AS (SELECT h.symbol, h.cond_id, h.direction, h.bar_idx, x.exit_idx, 'exit' AS outcome, {SIGN} * (ex - entry) - (CASE WHEN direction = 'short' THEN 0.4 * {_FACTOR.format(h='exit_hour')} ELSE 0.4 * {_FACTOR.format(h='entry_hour')} END + 0.1)::DOUBLE AS pnl,
           ({SIGN} * (ex - entry) - (CASE WHEN direction = 'short' THEN 0.4 * {_FACTOR.format(h='exit_hour')} ELSE 0.4 * {_FACTOR.format(h='entry_hour')} END + 0.1)::DOUBLE) / atr AS r
           FROM hits h JOIN x ON h.symbol = x.symbol AND x.exit_idx = h.bar_idx + 5 WHERE atr IS NOT NULL)"""


def _open_trades(spark, sf):
    b = full_bars(spark, sf)
    return simulate.open_price_trades(hits(b), b, COSTS, 4)


@query(f"WITH {_OPEN} SELECT symbol, cond_id, bar_idx, exit_idx, {r('pnl', 'r')} FROM tr")
def m3_open_price(spark, sf):
    return rounded(_open_trades(spark, sf).drop("direction", "outcome"))


@query(
    f"""WITH RECURSIVE {_OPEN}, pick(symbol, cond_id, bar_idx) AS (SELECT symbol, cond_id, min(bar_idx) FROM tr GROUP BY 1, 2 UNION ALL
    SELECT p.symbol, p.cond_id, (SELECT min(t.bar_idx) FROM tr t WHERE t.symbol = p.symbol AND t.cond_id = p.cond_id AND t.bar_idx >= p.bar_idx + 5) AS nb FROM pick p WHERE nb IS NOT NULL) SELECT symbol, cond_id, bar_idx FROM pick"""
)
def m4_one_at_a_time(spark, sf):
    return simulate.one_at_a_time(_open_trades(spark, sf), 4).select("symbol", "cond_id", "bar_idx")


@query(
    f"""WITH {full_sql()}, x AS (SELECT symbol, bar_idx - 4 AS bi, close::DOUBLE AS ex FROM bars), ma AS (SELECT symbol, avg(atr_14::DOUBLE) AS mean_atr FROM ind WHERE atr_14 > 0 GROUP BY 1),
    c AS (SELECT h.symbol, cond_id, {SIGN} * (ex - entry) / 0.01::DOUBLE AS gross, coalesce(0.05::DOUBLE * atr / 0.01::DOUBLE, 30) + 1 AS cost FROM hits h JOIN x ON h.symbol = x.symbol AND h.bar_idx = x.bi WHERE h.bar_idx < h.n - 5),
    g AS (SELECT symbol, cond_id, count(*) AS n_trades, avg(gross) AS gross_pips, avg(cost) AS cost_pips, avg(gross - cost) AS net_pips FROM c GROUP BY 1, 2)
    SELECT symbol, cond_id, n_trades, {', '.join(f'round({x}, 4) AS {x}' for x in ('gross_pips', 'cost_pips', 'net_pips'))}, round(net_pips / (mean_atr / 0.01::DOUBLE), 4) AS expectancy_r, net_pips / (mean_atr / 0.01::DOUBLE) >= 0 AS passes FROM g JOIN ma USING (symbol)"""
)
def a10_p22_cost_model(spark, sf):
    b = full_bars(spark, sf)
    out = simulate.cost_prefilter(simulate.cost_expectancy(hits(b), b, 3, H, 30.0, 1.0, 0.01, 0.05))
    return rounded(out.drop("mean_atr", "reason"), 4)


_WIN = "wn AS (SELECT symbol, unnest(range(0, (n - 60 + 1)::BIGINT, 20)) AS s FROM (SELECT symbol, max(n) AS n FROM bars GROUP BY 1) WHERE n >= 60), win AS (SELECT symbol, s // 20 AS win_id, s AS train_start, s + 40 AS test_start, s + 60 AS test_end FROM wn)"


def _wins(b):
    return validate.windows(b, 40, 20, 20)


@query(f"WITH {BARS}, {_WIN} SELECT symbol, win_id::INT AS window_id, train_start, test_start, test_end FROM win")
def v1_windows(spark, sf):
    w = _wins(hourly(spark, sf))
    return w.select("symbol", F.col("window").alias("window_id"), "train_start", "test_start", "test_end")


@query(
    f"""WITH {full_sql()}, {_WIN}, hs AS (SELECT unnest(range(1, 6)) AS hz), p AS (SELECT h.symbol, cond_id, direction, win_id, hz, avg(fwd[hz]) AS p FROM hits h JOIN win w ON h.symbol = w.symbol AND h.bar_idx >= test_start AND h.bar_idx < test_end - 5, hs GROUP BY 1, 2, 3, 4, 5),
    m AS (SELECT symbol, cond_id, direction, hz, avg(p) AS m FROM p GROUP BY 1, 2, 3, 4), s AS (SELECT symbol, cond_id, stddev_pop(p) AS prob_std, count(DISTINCT win_id) AS n_windows FROM p GROUP BY 1, 2)
    SELECT symbol, cond_id, any_value(direction) AS direction, bool_and(CASE WHEN direction = 'long' THEN m > 0.5 ELSE m < 0.5 END) AS consistent, round(max(m) FILTER (hz = 1), 6) AS mean_prob_1, round(any_value(prob_std), 6) AS prob_std, any_value(n_windows) AS n_windows FROM m JOIN s USING (symbol, cond_id) GROUP BY 1, 2"""
)
def v2_direction_consistency(spark, sf):
    b = full_bars(spark, sf)
    return rounded(validate.direction_consistency(hits(b), _wins(b), H))


@query(
    f"""WITH {_TRADES}, {_WIN}, m AS (SELECT t.symbol, cond_id, win_id, avg(r) AS m FROM tr t JOIN win w ON t.symbol = w.symbol AND t.bar_idx >= test_start AND t.bar_idx < test_end GROUP BY 1, 2, 3)
    SELECT symbol, cond_id, count(*) AS n_windows, count_if(m > 0)::BIGINT AS n_positive, count_if(m > 0) >= 3 AS stable FROM m GROUP BY 1, 2"""
)
def v3_holding_stability(spark, sf):
    t, b = _trades(spark, sf)
    return validate.holding_stability(t, _wins(b), 3)


_REG = f", {_ADX}, rg AS (SELECT ind.*, adx::FLOAT AS adx_14, quantile_cont(atr_14::DOUBLE, 0.25) OVER (PARTITION BY symbol) AS lo, quantile_cont(atr_14::DOUBLE, 0.75) OVER (PARTITION BY symbol) AS hi FROM ind JOIN (SELECT symbol, bar_idx, adx FROM dm) USING (symbol, bar_idx)), rb AS (SELECT * EXCLUDE (lo, hi), [CASE WHEN adx_14 > 25 THEN 'trending' ELSE 'ranging' END, CASE WHEN atr_14::DOUBLE > hi THEN 'high_vol' WHEN atr_14::DOUBLE < lo THEN 'low_vol' ELSE 'normal_vol' END] AS regimes FROM rg)"


@query(
    f"""WITH {full_sql(source='rb', more=_REG)}, u AS (SELECT symbol, cond_id, unnest(regimes) AS regime, list_sum(fwd) AS k FROM hits WHERE valid), g AS (SELECT symbol, cond_id, regime, count(*) AS n, sum(k) / (5.0::DOUBLE * count(*)) AS mean_prob FROM u WHERE regime <> 'normal_vol' GROUP BY 1, 2, 3),
    b AS (SELECT symbol, cond_id, arg_max(regime, struct_pack(a := mean_prob, b := -list_position(['trending', 'ranging', 'high_vol', 'low_vol'], regime))) AS best FROM g WHERE n >= 10 GROUP BY 1, 2)
    SELECT symbol, cond_id, regime, n, round(mean_prob, 6) AS mean_prob, coalesce(regime = best, FALSE) AS most_robust FROM g LEFT JOIN b USING (symbol, cond_id)"""
)
def v4_regime_stress(spark, sf):
    adx = export_columns(hourly(spark, sf)).select("symbol", "bar_idx", "adx_14")
    return rounded(validate.regime_stress(hits(validate.with_regimes(full_bars(spark, sf).join(adx, ["symbol", "bar_idx"]))), H))


_BASES = CONDITIONS
_FORMS = [(k, f) for k, c in enumerate(_BASES) for f in validate.shifted(c, 15)]
_FORM_SQL = full_sql([*_BASES, *[f for _, f in _FORMS]])


@query(
    f"""WITH {_FORM_SQL}, hs AS (SELECT unnest(range(1, 6)) AS horizon), prof AS (SELECT symbol, cond_id, horizon, sum(fwd[horizon]) / count(*)::DOUBLE AS p FROM hits, hs WHERE valid GROUP BY 1, 2, 3),
    pairs(cond_id, form) AS (VALUES {', '.join(f'({k}, {len(_BASES) + j})' for j, (k, _) in enumerate(_FORMS))}),
    rr AS (SELECT a.symbol, pairs.cond_id, form, CASE WHEN stddev_pop(a.p) > 1e-12 AND stddev_pop(b.p) > 1e-12 THEN covar_pop(a.p, b.p) / (stddev_pop(a.p) * stddev_pop(b.p)) END AS r FROM pairs JOIN prof a USING (cond_id) JOIN prof b ON b.symbol = a.symbol AND b.cond_id = form AND b.horizon = a.horizon GROUP BY 1, 2, 3)
    SELECT symbol, cond_id, round(avg(r), 4) AS sensitivity, count(r) AS n_forms FROM rr GROUP BY 1, 2"""
)
def v5_sensitivity(spark, sf):
    b = full_bars(spark, sf)
    return rounded(validate.sensitivity(lambda cs: hits(b, cs), _BASES, 15, H), 4)


SHIFTS = [11, 17, 23, 29, 31, 37, 41, 43, 47, 53, 59, 61, 67, 71, 73, 79, 83, 89, 97, 101]


@query(
    f"""WITH {full_sql()}, sh AS (SELECT unnest({[0, *SHIFTS]}) AS s), o AS (SELECT symbol, bar_idx, fwd[1]::DOUBLE AS o FROM full_bars), al AS (SELECT symbol, avg(o) AS a FROM o GROUP BY 1),
    e AS (SELECT h.symbol, cond_id, s, avg(o) - any_value(a) AS e FROM hits h, sh JOIN o ON o.symbol = h.symbol AND o.bar_idx = ((h.bar_idx - s) % h.n + h.n) % h.n JOIN al ON al.symbol = h.symbol GROUP BY 1, 2, 3),
    rl AS (SELECT symbol, cond_id, e AS effect FROM e WHERE s = 0)
    SELECT symbol, cond_id, round(any_value(effect), 6) AS effect, round(avg((abs(e) >= abs(effect))::INT), 6) AS p_value, round(avg(e), 6) AS null_mean, round(stddev_pop(e), 4) AS null_std FROM e JOIN rl USING (symbol, cond_id) WHERE s > 0 GROUP BY 1, 2"""
)
def v8_rotation_test(spark, sf):
    b = full_bars(spark, sf)
    out = validate.rotation_test(hits(b), b, SHIFTS)
    return rounded(out.withColumn("null_std", F.round("null_std", 4)))


@query(f"WITH {full_sql()} SELECT symbol, cond_id, count(*) AS n_holdout, round(avg(fwd[1]), 6) AS prob_holdout FROM hits WHERE bar_idx >= floor(n * 0.85::DOUBLE) AND bar_idx < n - 5 GROUP BY 1, 2")
def v9_holdout(spark, sf):
    return rounded(validate.holdout(hits(full_bars(spark, sf)), 0.15, H))


@query()
def a15_bootstrap(spark, sf):
    return rounded(validate.bootstrap(_trades(spark, sf)[0], 100, 0.95, 7))


_DAYS = "SELECT *, year(lo) AS y0, year(hi) AS y1 FROM (SELECT symbol, min(time) AS lo, max(time) AS hi FROM dbars GROUP BY 1)"


@query(
    f"""WITH {DAILY}, sp AS ({_DAYS}), w0 AS (SELECT symbol, lo, hi, unnest(range(y0, y1 + 1)) AS y, y0 FROM sp),
    w1 AS (SELECT symbol, y - y0 AS win_id, lo, hi, make_timestamp(y, 1, 1, 0, 0, 0) AS a, make_timestamp(y + 2, 1, 1, 0, 0, 0) AS b, make_timestamp(y + 3, 1, 1, 0, 0, 0) AS c FROM w0),
    w2 AS (SELECT *, c > hi AS truncated FROM w1 WHERE b > lo AND b <= hi), w3 AS (SELECT *, min(win_id) FILTER (truncated) OVER (PARTITION BY symbol) AS f FROM w2)
    SELECT w.symbol, win_id::INT AS window_id, any_value(truncated) AS truncated, count_if(time < a)::BIGINT AS train_start, count_if(time < b)::BIGINT AS test_start, count_if(time < c)::BIGINT AS test_end FROM w3 w JOIN dbars d ON d.symbol = w.symbol WHERE f IS NULL OR win_id <= f GROUP BY 1, 2"""
)
def x1_calendar_windows(spark, sf):
    w = validate.calendar_windows(daily(spark, sf), 2, 1, 1)
    return w.select("symbol", F.col("window").alias("window_id"), "truncated", "train_start", "test_start", "test_end")


@query(
    f"""WITH {INDICATORS}, v AS (SELECT *, list(atr_14::DOUBLE) FILTER (atr_14 IS NOT NULL) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 49 PRECEDING AND 1 PRECEDING) AS past, avg(atr_14::DOUBLE) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS 9 PRECEDING) AS m FROM ind),
    p AS (SELECT symbol, bar_idx, CASE WHEN bar_idx >= 74 AND atr_14 IS NOT NULL THEN 100 * (len(list_filter(past, lambda x: x < atr_14::DOUBLE)) + 0.5 * len(list_filter(past, lambda x: x = atr_14::DOUBLE))) / 49.0 END::FLOAT AS pctl, CASE WHEN bar_idx >= 74 THEN atr_14::DOUBLE / m END AS ratio FROM v)
    SELECT symbol, bar_idx, round(pctl::DOUBLE, 3) AS volregime_atr_pctl, round(ratio, 3) AS volregime_atr_ratio, CASE WHEN pctl <= 30 THEN 0 WHEN pctl >= 70 THEN 2 WHEN pctl IS NOT NULL THEN 1 END::DOUBLE AS volregime_regime FROM p"""
)
def i2_volatility_regime(spark, sf):
    return rounded(features.volatility_regime(indicators(spark, sf), 50, 10).select("symbol", "bar_idx", "volregime_atr_pctl", "volregime_atr_ratio", "volregime_regime"), 3)


_LEVELS = {f"ps_dist_{n}_atr": f"({x} - close::DOUBLE) / a" for n, x in (("pdh", "dh"), ("pdl", "dl"), ("sess_h", "sh"), ("sess_l", "sl"), ("round_up", "ceil(close::DOUBLE / st) * st"), ("round_dn", "floor(close::DOUBLE / st) * st"))} | {"ps_gap_atr": "gap / a"}


@query(
    f"""WITH {INDICATORS}, t AS (SELECT *, time::DATE AS dy, epoch(time)::BIGINT // 28800 AS ses FROM ind),
    dd AS (SELECT symbol, dy, max(high)::DOUBLE AS h, min(low)::DOUBLE AS l, arg_max(close, bar_idx)::DOUBLE AS c, arg_min(open, bar_idx)::DOUBLE AS o, min(bar_idx) AS b FROM t GROUP BY 1, 2),
    dl AS (SELECT symbol, dy, lag(h) OVER w AS dh, lag(l) OVER w AS dl, lag(c) OVER w AS dc, o AS dopen FROM dd WINDOW w AS (PARTITION BY symbol ORDER BY b)),
    ss AS (SELECT symbol, ses, max(high)::DOUBLE AS h, min(low)::DOUBLE AS l, min(bar_idx) AS b FROM t GROUP BY 1, 2), sl AS (SELECT symbol, ses, CASE WHEN ses - lag(ses) OVER w <= 6 THEN lag(h) OVER w END AS sh, CASE WHEN ses - lag(ses) OVER w <= 6 THEN lag(l) OVER w END AS sl FROM ss WINDOW w AS (PARTITION BY symbol ORDER BY b)),
    j0 AS (SELECT t.*, lag(atr_14) OVER (PARTITION BY symbol ORDER BY bar_idx)::DOUBLE AS at0 FROM t),
    j AS (SELECT j0.*, dh, dl.dl, dc, dopen, sh, sl.sl, CASE WHEN at0 > 0 THEN at0 END AS a, dopen - dc AS gap, max(high) OVER w::DOUBLE AS th, min(low) OVER w::DOUBLE AS tl, power(10.0, floor(log10(close::DOUBLE))) / 20 AS st FROM j0 JOIN dl ON j0.symbol = dl.symbol AND j0.dy = dl.dy JOIN sl ON j0.symbol = sl.symbol AND j0.ses = sl.ses WINDOW w AS (PARTITION BY j0.symbol, j0.dy ORDER BY bar_idx ROWS UNBOUNDED PRECEDING))
    SELECT symbol, bar_idx, {', '.join(f'round(({x})::FLOAT, 3) AS {c}' for c, x in _LEVELS.items())},
    round((CASE WHEN gap IS NOT NULL AND a IS NOT NULL THEN CASE WHEN abs(gap) < 0.1 * a THEN 100 ELSE greatest(0, least(100, 100 * (CASE WHEN gap > 0 THEN dopen - tl ELSE th - dopen END) / nullif(abs(gap), 0))) END END)::FLOAT, 3) AS ps_gap_fill_pct FROM j"""
)
def i3_price_structure(spark, sf):
    return rounded(features.price_structure(indicators(spark, sf)).select("symbol", "bar_idx", *PRICE_STRUCTURE), 3)


_NEWS = """nw AS (SELECT symbol, t, arg_max(importance, struct_pack(i := importance, s := sur)) AS importance, arg_max(sur, struct_pack(i := importance, s := sur)) AS sur FROM (SELECT symbol, t, importance, coalesce(actual - forecast, -1e9::DOUBLE) AS sur FROM cal0) GROUP BY 1, 2),
    ev AS (SELECT symbol, t, count(*) AS k FROM cal0 GROUP BY 1, 2), cm AS (SELECT symbol, t, sum(k) OVER (PARTITION BY symbol ORDER BY t) AS k FROM ev), cb AS (SELECT symbol, bar_idx, epoch(time)::BIGINT + 3600 AS o FROM bars)"""


@query(
    f"""WITH {BARS}, {_CAL}, {_NEWS}, j AS (SELECT c.symbol, c.bar_idx, (f.t - o) / 60.0::DOUBLE AS nx, f.importance AS ni, (o - l.t) / 60.0::DOUBLE AS la, l.importance AS li, CASE WHEN l.sur > -1e9 THEN l.sur END AS ls, coalesce(m.k, 0) - coalesce(n.k, 0) AS k
    FROM cb c ASOF LEFT JOIN nw f ON c.symbol = f.symbol AND c.o < f.t ASOF LEFT JOIN nw l ON c.symbol = l.symbol AND c.o >= l.t ASOF LEFT JOIN cm n ON c.symbol = n.symbol AND c.o >= n.t ASOF LEFT JOIN cm m ON c.symbol = m.symbol AND c.o + 86400 >= m.t)
    SELECT symbol, bar_idx, round(nx::FLOAT, 2) AS news_min_to_next, ni::DOUBLE AS news_next_importance, round(la::FLOAT, 2) AS news_min_since_last, li::DOUBLE AS news_last_importance, round(ls::FLOAT, 2) AS news_last_surprise, (coalesce(nx <= 30, FALSE) OR coalesce(la <= 30, FALSE))::INT::DOUBLE AS news_in_window, k::DOUBLE AS news_count_next_24h FROM j"""
)
def i4_news(spark, sf):
    b = hourly(spark, sf).withColumn("open_s", F.unix_timestamp("time"))
    out = features.news_features(b, calendar(spark, sf).withColumn("surprise", F.col("actual") - F.col("forecast")), ["symbol"], seconds=HOUR)
    return rounded(out.select("symbol", "bar_idx", *NEWS), 2)


TESTER = backtest.Tester(commission=3.5, slippage_points=2, swap_long=-1.5, swap_short=0.5, max_positions=1)


def _backtest(spark, sf, tester=TESTER):
    b = asof.align_spread(hourly(spark, sf), _spread_table(spark, sf), 30.0, ["symbol"])
    signals = hits(indicators(spark, sf)).select("symbol", F.col("cond_id").alias("ea_id"), "direction", "bar_idx")
    return backtest.backtest(signals, b, 6, tester), b


_NIGHTS = """(SELECT coalesce(sum(CASE WHEN isodow(d - INTERVAL 1 DAY) > 5 THEN 0 WHEN isodow(d - INTERVAL 1 DAY) = 3 THEN 3 ELSE 1 END), 0) FROM (SELECT unnest(generate_series(entry_time::DATE::TIMESTAMP, exit_time::DATE::TIMESTAMP, INTERVAL 1 DAY)) AS d) WHERE d > entry_time AND d <= exit_time)"""
_SIGNALS = f"""{full_sql()}, {_SPREAD}, sg AS (SELECT symbol, cond_id AS ea_id, direction, bar_idx + 1 AS e FROM hits WHERE bar_idx + 1 < n),
    bb AS (SELECT symbol, bar_idx, time, n, open::DOUBLE AS o, coalesce(k, 30.0)::DOUBLE AS spread FROM al)"""
_PRICED = """bt0 AS (SELECT p.symbol, p.ea_id, CASE WHEN p.ea_id % 2 = 0 THEN 'long' ELSE 'short' END AS direction, a.bar_idx AS entry_idx, x.bar_idx AS exit_idx, a.time AS entry_time, x.time AS exit_time, a.o AS eo, x.o AS xo, a.spread * 0.01::DOUBLE AS es, x.spread * 0.01::DOUBLE AS xs FROM pick p JOIN bb a ON a.symbol = p.symbol AND a.bar_idx = p.e JOIN bb x ON x.symbol = p.symbol AND x.bar_idx = p.x),
    bt1 AS (SELECT *, round_even(CASE WHEN direction = 'long' THEN eo + es + {slip}::DOUBLE ELSE eo - {slip}::DOUBLE END, 2) AS entry_price, round_even(CASE WHEN direction = 'long' THEN xo - {slip}::DOUBLE ELSE xo + xs + {slip}::DOUBLE END, 2) AS exit_price, {nights} AS nights FROM bt0),
    bt2 AS (SELECT *, (CASE WHEN direction = 'long' THEN exit_price - entry_price ELSE entry_price - exit_price END) * 100 AS gross, (nights * (CASE WHEN direction = 'long' THEN {sl} ELSE {ss} END))::DOUBLE AS swap FROM bt1),
    bt AS (SELECT *, gross + {commission} + swap AS profit FROM bt2)"""
# The next entry of each: the chain of a position at a time, from the first.
_PICK = """nx AS (SELECT symbol, ea_id, e, min(e) OVER (PARTITION BY symbol, ea_id ORDER BY e RANGE BETWEEN 7 FOLLOWING AND UNBOUNDED FOLLOWING) AS ne FROM sg),
    chain(symbol, ea_id, e) AS (SELECT symbol, ea_id, min(e) FROM sg GROUP BY 1, 2 UNION ALL SELECT c.symbol, c.ea_id, x.ne FROM chain c JOIN nx x ON x.symbol = c.symbol AND x.ea_id = c.ea_id AND x.e = c.e WHERE x.ne IS NOT NULL),
    pick AS (SELECT symbol, ea_id, e, e + 6 AS x FROM chain)"""
_BT = f"{_SIGNALS}, {_PICK}, {_PRICED.format(slip=0.02, nights=_NIGHTS, sl=-1.5, ss=0.5, commission=-7.0)}"
_MONEY = ["entry_price", "exit_price", "gross", "swap", "profit"]


@query(f"WITH RECURSIVE {_BT} SELECT symbol, ea_id, direction, entry_idx, exit_idx, nights::INT AS nights, {', '.join(f'round({c}, 4) AS {c}' for c in _MONEY)} FROM bt")
def m6_backtest(spark, sf):
    return rounded(_backtest(spark, sf)[0].select("symbol", "ea_id", "direction", "entry_idx", "exit_idx", "nights", *_MONEY), 4)


_CURVES = f"""{_BT}, eas AS (SELECT DISTINCT symbol, ea_id FROM bt), bk AS (SELECT symbol, ea_id, exit_idx AS bar_idx, sum(profit) AS booked FROM bt GROUP BY 1, 2, 3),
    fl AS (SELECT bt.symbol, ea_id, bb.bar_idx, sum((CASE WHEN direction = 'long' THEN o - entry_price ELSE entry_price - o - spread * 0.01::DOUBLE END) * 100) AS floating FROM bt JOIN bb ON bb.symbol = bt.symbol AND bb.bar_idx >= entry_idx AND bb.bar_idx < exit_idx GROUP BY 1, 2, 3),
    cv0 AS (SELECT eas.symbol, eas.ea_id, bb.bar_idx, 10000 + sum(coalesce(booked, 0)) OVER (PARTITION BY eas.symbol, eas.ea_id ORDER BY bb.bar_idx ROWS UNBOUNDED PRECEDING) AS balance, coalesce(floating, 0) AS floating
            FROM eas JOIN bb ON bb.symbol = eas.symbol LEFT JOIN bk ON bk.symbol = eas.symbol AND bk.ea_id = eas.ea_id AND bk.bar_idx = bb.bar_idx LEFT JOIN fl ON fl.symbol = eas.symbol AND fl.ea_id = eas.ea_id AND fl.bar_idx = bb.bar_idx),
    cv AS (SELECT *, balance + floating AS equity FROM cv0)"""
_FALLS = """pk AS (SELECT *, max(balance) OVER w - balance AS bd, max(equity) OVER w - equity AS ed, max(balance) OVER w AS bp, max(equity) OVER w AS ep FROM cv WINDOW w AS (PARTITION BY symbol, ea_id ORDER BY bar_idx ROWS UNBOUNDED PRECEDING)),
    dd AS (SELECT symbol, ea_id, max(bd) AS balance_dd, max(ed) AS equity_dd, max(coalesce(100 * bd / nullif(bp, 0), 0)) AS balance_dd_pct, max(coalesce(100 * ed / nullif(ep, 0), 0)) AS equity_dd_pct, arg_max(balance, bar_idx) AS final_balance FROM pk GROUP BY 1, 2),
    rn AS (SELECT *, profit > 0 AS w, row_number() OVER (PARTITION BY symbol, ea_id ORDER BY entry_idx) - row_number() OVER (PARTITION BY symbol, ea_id, profit > 0 ORDER BY entry_idx) AS g FROM bt),
    sk AS (SELECT symbol, ea_id, coalesce(max(k) FILTER (w), 0) AS max_consec_wins, coalesce(max(k) FILTER (NOT w), 0) AS max_consec_losses FROM (SELECT symbol, ea_id, w, g, count(*) AS k FROM rn GROUP BY 1, 2, 3, 4) GROUP BY 1, 2),
    sm AS (SELECT symbol, ea_id, count(*) AS n_trades, count_if(direction = 'long')::BIGINT AS long_trades, count_if(direction = 'short')::BIGINT AS short_trades, count_if(profit > 0)::BIGINT AS wins, 100 * avg((profit > 0)::INT) AS win_pct, sum(profit) AS net_profit, coalesce(sum(profit) FILTER (profit > 0), 0) AS gross_profit, coalesce(sum(profit) FILTER (profit < 0), 0) AS gross_loss,
           avg(profit) AS expected_payoff, max(profit) AS largest_profit, min(profit) AS largest_loss, coalesce(avg(profit) FILTER (profit > 0), 0) AS avg_profit, coalesce(avg(profit) FILTER (profit < 0), 0) AS avg_loss FROM bt GROUP BY 1, 2)"""
_SUMS = ["win_pct", "net_profit", "gross_profit", "gross_loss", "profit_factor", "expected_payoff", "largest_profit", "largest_loss", "avg_profit", "avg_loss", "balance_dd", "equity_dd", "balance_dd_pct", "equity_dd_pct", "final_balance", "recovery_factor", "initial_deposit"]


@query(
    f"""WITH RECURSIVE {_CURVES}, {_FALLS}, al2 AS (SELECT *, CASE WHEN gross_loss < 0 THEN gross_profit / -gross_loss WHEN gross_profit > 0 THEN 'inf'::DOUBLE ELSE 0 END AS profit_factor, CASE WHEN equity_dd > 0 THEN net_profit / equity_dd ELSE 0 END AS recovery_factor, 10000.0 AS initial_deposit FROM sm JOIN dd USING (symbol, ea_id) JOIN sk USING (symbol, ea_id))
    SELECT symbol, ea_id, n_trades, long_trades, short_trades, wins, max_consec_wins, max_consec_losses, {', '.join(f'round({c}, 3) AS {c}' for c in _SUMS)} FROM al2"""
)
def a23_a25_backtest_summary(spark, sf):
    t, b = _backtest(spark, sf)
    return rounded(backtest.full_summary(t, backtest.curves(t, b), t), 3)


_RANGE = "2024-01-05 06:00:00", "2024-01-12 18:00:00"
_RANGED = _BT.replace("FROM hits WHERE bar_idx + 1 < n)", f"FROM hits JOIN (SELECT symbol, min(bar_idx) FILTER (time >= TIMESTAMP '{_RANGE[0]}') AS lo, max(bar_idx) FILTER (time <= TIMESTAMP '{_RANGE[1]}') AS last FROM bars GROUP BY 1) USING (symbol) WHERE bar_idx + 1 BETWEEN lo AND last)")


@query(f"WITH RECURSIVE {_RANGED} SELECT symbol, ea_id, direction, entry_idx, exit_idx, round(profit, 4) AS profit FROM bt WHERE exit_time <= TIMESTAMP '{_RANGE[1]}'")
def p25_date_range(spark, sf):
    b = asof.align_spread(hourly(spark, sf), _spread_table(spark, sf), 30.0, ["symbol"])
    signals = hits(indicators(spark, sf)).select("symbol", F.col("cond_id").alias("ea_id"), "direction", "bar_idx")
    return rounded(backtest.backtest(signals, b, 6, TESTER, *_RANGE).select("symbol", "ea_id", "direction", "entry_idx", "exit_idx", "profit"), 4)


@query(f"WITH RECURSIVE {_CURVES} SELECT symbol, ea_id, bar_idx // 50 AS bucket, round(arg_min(equity, bar_idx), 4) AS first, round(min(equity), 4) AS low, round(max(equity), 4) AS high, round(arg_max(equity, bar_idx), 4) AS last FROM cv GROUP BY 1, 2, 3")
def m7_curves(spark, sf):
    t, b = _backtest(spark, sf)
    return rounded(backtest.decimate(backtest.curves(t, b), 50), 4)


# Three at a time: entries one by one, with the list of open exits.
_THREE = """sq AS (SELECT sg.symbol, ea_id, e, least(e + 7, n - 1) AS x, row_number() OVER (PARTITION BY sg.symbol, ea_id ORDER BY e) AS i FROM sg JOIN (SELECT symbol, max(n) AS n FROM bb GROUP BY 1) USING (symbol)),
    st(symbol, ea_id, i, e, x, busy, held) AS (SELECT symbol, ea_id, i, e, x, FALSE, [x] FROM sq WHERE i = 1 UNION ALL
        SELECT q.symbol, q.ea_id, q.i, q.e, q.x, len(list_filter(st.held, lambda y: y > q.e)) >= 3, CASE WHEN len(list_filter(st.held, lambda y: y > q.e)) >= 3 THEN list_filter(st.held, lambda y: y > q.e) ELSE list_append(list_filter(st.held, lambda y: y > q.e), q.x) END
        FROM st JOIN sq q ON q.symbol = st.symbol AND q.ea_id = st.ea_id AND q.i = st.i + 1),
    pick AS (SELECT symbol, ea_id, e, x FROM st WHERE NOT busy)"""


@query(f"WITH RECURSIVE {_SIGNALS}, {_THREE}, {_PRICED.format(slip=0.0, nights=_NIGHTS, sl=0.0, ss=0.0, commission=0.0)} SELECT symbol, ea_id, direction, entry_idx, exit_idx, nights::INT AS nights, {', '.join(f'round({c}, 4) AS {c}' for c in _MONEY)} FROM bt")
def m6_three_positions(spark, sf):
    t = _backtest(spark, sf, backtest.Tester(max_positions=3, reenter_on_exit=True, close_at_end=True, exit_offset=1))[0]
    return rounded(t.select("symbol", "ea_id", "direction", "entry_idx", "exit_idx", "nights", *_MONEY), 4)


@query(
    f"""WITH {BARS}, x AS (SELECT symbol, time AS entry_time, open::DOUBLE AS p, close::DOUBLE AS q, bar_idx FROM bars WHERE bar_idx % 5 <> 0), y AS (SELECT symbol, time AS entry_time, open::DOUBLE AS p, close::DOUBLE + (bar_idx % 3) / 2.0::DOUBLE AS q, bar_idx FROM bars WHERE bar_idx % 7 <> 0),
    c AS (SELECT coalesce(x.symbol, y.symbol) AS symbol, x.bar_idx AS l, y.bar_idx AS r, abs(x.p - y.p) AS ed, abs(x.q - y.q) AS xd FROM x FULL JOIN y ON x.symbol = y.symbol AND x.entry_time = y.entry_time)
    SELECT symbol, 1 AS ea_id, count(l) AS n_emulated, count(r) AS n_reference, count_if(l IS NOT NULL AND r IS NOT NULL)::BIGINT AS n_matched, count_if(r IS NULL)::BIGINT AS only_emulated, count_if(l IS NULL)::BIGINT AS only_reference, count_if(l % 2 = 0 AND r IS NOT NULL)::BIGINT AS exit_time_mismatches,
           round(avg(ed), 6) AS entry_mean_diff, round(avg(xd), 6) AS exit_mean_diff, count_if(ed <= 1e-6)::BIGINT AS entry_exact, count_if(xd <= 1e-6)::BIGINT AS exit_exact FROM c GROUP BY 1"""
)
def j10_compare(spark, sf):
    """Two lists of trades, a trade a bar, that each lack some bars: all three sides of the comparison occur."""
    b, k = hourly(spark, sf).withColumn("t", F.col("time").cast("timestamp")), F.col("bar_idx")
    later = F.when(k % 2 == 0, F.col("t") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("t"))
    part = lambda lack, exit_time, more: b.filter(k % lack != 0).select("symbol", F.lit(1).alias("ea_id"), F.col("t").alias("entry_time"), exit_time.alias("exit_time"), F.col("open").cast("double").alias("entry_price"), (F.col("close").cast("double") + more).alias("exit_price"))
    return rounded(backtest.comparison(backtest.compare(part(5, F.col("t"), F.lit(0.0)), part(7, later, k % 3 / 2.0))))


@query(
    f"""WITH {_SIGNALS.split(', sg AS')[0]}, d AS (SELECT symbol, bar_idx, time AS entry_time, time + INTERVAL 1 HOUR * (bar_idx % 100) AS exit_time FROM bars) SELECT symbol, bar_idx, {_NIGHTS}::INT AS nights FROM d"""
)
def f8_swap_nights(spark, sf):
    b = hourly(spark, sf)
    t = F.col("time").cast("timestamp")
    return b.select("symbol", "bar_idx", backtest.swap_nights(t, (t.cast("long") + F.col("bar_idx") % 100 * 3600).cast("timestamp"), 0, 2).alias("nights"))


_EDGES = """ed AS (SELECT o_custkey AS cond_id, o_orderpriority AS symbol, count(*) AS n_trades, avg(o_totalprice) / 100000 - 1 AS expectancy_r, sum(o_totalprice) / 400000 AS profit_factor, min(o_orderkey) % 3 > 0 AS significant, min(o_orderkey) % 5 > 0 AS walk_forward, max(o_orderkey) % 4 > 0 AS stable, (min(o_orderkey) % 20) / 100.0 AS permutation_p, (max(o_orderkey) % 10) / 10.0 AS sensitivity FROM orders GROUP BY 1, 2)"""


def _edges(spark, sf):
    o = read(spark, sf, "orders")
    lo, hi = F.min("o_orderkey"), F.max("o_orderkey")
    return o.groupBy(F.col("o_custkey").alias("cond_id"), F.col("o_orderpriority").alias("symbol")).agg(
        F.count("*").alias("n_trades"), (F.avg("o_totalprice") / 100000 - 1).alias("expectancy_r"), (F.sum("o_totalprice") / 400000).alias("profit_factor"), (lo % 3 > 0).alias("significant"), (lo % 5 > 0).alias("walk_forward"),
        (hi % 4 > 0).alias("stable"), ((lo % 20) / 100.0).alias("permutation_p"), ((hi % 10) / 10.0).alias("sensitivity"), F.lit(None).cast("double").alias("ci_low"),
    )


GATE = gate.Gate(min_trades=2)
_GATED = f"""{_EDGES}, gd AS (SELECT *, list_filter([CASE WHEN NOT significant THEN 'not significant' END, CASE WHEN NOT walk_forward THEN 'walk-forward inconsistent' END, CASE WHEN NOT stable THEN 'holding period unstable' END, CASE WHEN NOT permutation_p < 0.05 THEN 'permutation test' END,
    CASE WHEN n_trades < 2 THEN 'too few trades' END, CASE WHEN n_trades >= 2 AND NOT expectancy_r > 0 THEN 'expectancy not positive' END, CASE WHEN n_trades >= 2 AND NOT profit_factor >= 1.1 THEN 'profit factor' END], lambda x: x IS NOT NULL) AS rs FROM ed)"""


@query(f"WITH {_GATED} SELECT symbol, cond_id, len(rs) = 0 AS gate_passed, array_to_string(rs, '; ') AS reasons FROM gd")
def p23_strategy_gate(spark, sf):
    return gate.strategy_gate(_edges(spark, sf), GATE).select("symbol", "cond_id", "gate_passed", F.array_join("reasons", "; ").alias("reasons"))


@query(f"WITH {_GATED}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY expectancy_r DESC, cond_id) AS rk FROM gd WHERE len(rs) = 0 AND sensitivity >= 0.3) SELECT symbol, cond_id, round(expectancy_r, 6) AS expectancy_r FROM k WHERE rk <= 5")
def p24_t5_plateau_candidates(spark, sf):
    return rounded(gate.plateau_candidates(gate.strategy_gate(_edges(spark, sf), GATE), 0.3, 5).select("symbol", "cond_id", "expectancy_r"))


_SLICE = ", sl AS (SELECT * REPLACE (bar_idx - 100 AS bar_idx, n - 100 AS n) FROM ind WHERE bar_idx >= 100)"


@query(
    f"""WITH {full_sql(source='sl', more=_SLICE)}, {_TRADES[len(full_sql()) + 2:].replace('FROM bars)', 'FROM sl)')}, {_stats_sql('tr')}
    SELECT symbol, cond_id, n_trades, round(expectancy_r, 6) AS expectancy_r, n_trades >= 5 AND expectancy_r >= 0 AS test_passed FROM st"""
)
def x5_test_period(spark, sf):
    """Conditions evaluated anew on the slice from bar 100 on, which begins with a bar 0 of its own."""
    from .research import slice_bars

    b = simulate.with_prices(outcomes.with_forward(slice_bars(indicators(spark, sf), 100, 2**31), H))
    t = simulate.simulate(hits(b), b, COSTS, 7)
    return rounded(gate.judge_test_period(simulate.trade_stats(t)).select("symbol", "cond_id", "n_trades", "expectancy_r", "test_passed"))


def _ranker_rows(spark, sf):
    l = read(spark, sf, "lineitem")
    k = F.col("l_partkey") % 40
    rows = l.groupBy(k.cast("int").alias("edge_id"), F.concat(F.lit("w"), (F.col("l_suppkey") % 4).cast("string")).alias("window_label")).agg(
        F.count("*").alias("n_trades"), (F.avg("l_discount") * 10 - 0.2).alias("test_exp"), (F.avg("l_tax") * 10).alias("train_exp"), (F.sum("l_extendedprice") / F.sum(F.col("l_quantity") * 1000)).alias("profit_factor")
    )
    e = F.col("edge_id")
    text = F.concat(F.lit("rsi_14 < "), (20 + e % 10 * 3).cast("string"), F.when(e % 4 == 0, F.concat(F.lit(" AND atr_14 > "), (1 + e % 3).cast("string"))).otherwise(""))
    return rows.withColumns({
        "condition": text, "direction": F.when(e % 2 == 0, "long").otherwise("short"), "holding": (6 + e % 5 * 2).cast("int"), "test_passed": F.col("test_exp") > 0.25,
        "sensitivity": F.when(e % 6 != 0, e / 40.0), "uses_calendar": e % 9 == 0, "uses_custom": F.lit(False),
    })


_RANK = """rk0 AS (SELECT (l_partkey % 40)::INT AS edge_id, 'w' || (l_suppkey % 4) AS window_label, count(*) AS n_trades, avg(l_discount) * 10 - 0.2 AS test_exp, avg(l_tax) * 10 AS train_exp, sum(l_extendedprice) / sum(l_quantity * 1000) AS profit_factor FROM lineitem GROUP BY 1, 2),
    rk AS (SELECT *, 'rsi_14 < ' || (20 + edge_id % 10 * 3) || CASE WHEN edge_id % 4 = 0 THEN ' AND atr_14 > ' || (1 + edge_id % 3) ELSE '' END AS condition, CASE WHEN edge_id % 2 = 0 THEN 'long' ELSE 'short' END AS direction, 6 + edge_id % 5 * 2 AS holding, test_exp > 0.25 AS test_passed, 20 + edge_id % 10 * 3 AS t1, CASE WHEN edge_id % 4 = 0 THEN 1 + edge_id % 3 END AS t2,
           CASE WHEN edge_id % 6 <> 0 THEN edge_id / 40.0 END AS sensitivity, least(10, greatest(0, profit_factor)) AS pf FROM rk0)"""


def _like(a: str, b: str) -> str:
    """Similar thresholds (30 %) and holding (2 bars or 25 %)."""
    near = "abs({x} - {y}) <= 0.3::DOUBLE * greatest(abs({x}), abs({y}))"
    return f"""({a}.t2 IS NULL) = ({b}.t2 IS NULL) AND abs({a}.holding - {b}.holding) <= greatest(2, 0.25::DOUBLE * greatest({a}.holding, {b}.holding)) AND {near.format(x=f'{a}.t1', y=f'{b}.t1')} AND coalesce({near.format(x=f'{a}.t2', y=f'{b}.t2')}, TRUE)"""


_PLATEAU = f"""{_RANK}, pr AS (SELECT a.window_label, a.edge_id, b.pf, b.test_exp FROM rk a JOIN rk b ON a.window_label = b.window_label AND a.direction = b.direction AND {_like('a', 'b')}),
    pl AS (SELECT window_label, edge_id, count(*) - 1 AS neighbours, CASE WHEN count(*) > 1 THEN avg((pf >= 1.3 AND test_exp > 0)::INT) * (1 - least(1, stddev_pop(pf) / avg(pf))) ELSE 0 END AS plateau FROM pr GROUP BY 1, 2)"""


def _clamp(x: str) -> str:
    return f"least(1, greatest(0, {x}))"


_STABLE = "greatest(0, 1 - abs(test_exp - train_exp) / greatest(abs(test_exp), abs(train_exp), 1e-9))"
_SCORED = f"""{_PLATEAU}, so AS (SELECT *, 100 * (0.25 * {_clamp('(pf - 1) / 2')} + 0.15 * {_clamp('test_exp / 0.5')} + 0.15 * {_clamp('ln(n_trades / 20.0) / ln(10)')} + 0.25 * plateau + 0.2 * {_STABLE}) AS score,
    concat_ws(';', CASE WHEN n_trades < 20 THEN 'low_frequency' END, CASE WHEN pf < 1.3 THEN 'low_pf' END, CASE WHEN NOT coalesce(sensitivity >= 0.7, FALSE) THEN 'low_sensitivity' END, CASE WHEN plateau < 0.5 THEN 'no_plateau' END, CASE WHEN NOT test_passed THEN 'test_failed' END) AS warnings
    FROM rk JOIN pl USING (window_label, edge_id))"""


@query(f"WITH {_SCORED} SELECT window_label, edge_id, neighbours, round(plateau, 6) AS plateau, round(score, 4) AS score, warnings FROM so")
def r1_r5_rank_windows(spark, sf):
    every = rank.Ranking(sort_dedupe=False, sort_top_n=1_000_000)
    out = rank.rank_window(_ranker_rows(spark, sf), every).select("window_label", "edge_id", "neighbours", "plateau", "score", F.array_join("warnings", ";").alias("warnings"))
    return rounded(out.withColumn("score", F.round(F.col("score") + 1e-8, 4)))


@query(
    f"""WITH {_RANK}, a AS (SELECT condition, direction, sum(n_trades)::BIGINT AS n_trades, sum(pf * n_trades) / sum(n_trades) AS profit_factor, sum(test_exp * n_trades) / sum(n_trades) AS test_exp, sum(train_exp * n_trades) / sum(n_trades) AS train_exp, coalesce(avg(sensitivity), -1) AS sensitivity, count(DISTINCT window_label) AS n_windows,
    count_if(test_passed AND pf >= 1.3 AND n_trades >= 20)::BIGINT AS windows_passed, bool_or(edge_id % 9 = 0) AS uses_calendar FROM rk GROUP BY 1, 2)
    SELECT * REPLACE (round(profit_factor, 6) AS profit_factor, round(test_exp, 6) AS test_exp, round(train_exp, 6) AS train_exp, round(sensitivity, 6) AS sensitivity), round(windows_passed / (SELECT count(DISTINCT window_label) FROM rk), 6) AS consistency FROM a"""
)
def a26_aggregate_windows(spark, sf):
    out = rank.aggregate_windows(_ranker_rows(spark, sf)).withColumn("sensitivity", F.coalesce("sensitivity", F.lit(-1.0)))
    return rounded(out.select("condition", "direction", "n_trades", "profit_factor", "test_exp", "train_exp", "sensitivity", "n_windows", "windows_passed", "uses_calendar", "consistency"))


@query(f"WITH {_RANK}, k AS (SELECT *, row_number() OVER (PARTITION BY window_label, direction, holding, n_trades % 10 ORDER BY (CASE WHEN t2 IS NULL THEN 1 ELSE 2 END), edge_id) AS k FROM rk) SELECT window_label, edge_id FROM k WHERE k = 1")
def u6_collapse_identical(spark, sf):
    rows = rank.with_atoms(_ranker_rows(spark, sf)).withColumns({"n_trades": F.col("n_trades") % 10, "test_exp": F.lit(0.0)})
    return rank.collapse_identical(rows).select("window_label", "edge_id")


# Rows one by one in score order, with the list of those that stay.
_GREEDY = f"""{_SCORED}, so2 AS (SELECT *, row_number() OVER (PARTITION BY window_label, direction ORDER BY score DESC, edge_id) AS i, struct_pack(edge_id := edge_id, t1 := t1, t2 := t2, holding := holding) AS s FROM so),
    gr(window_label, direction, i, kept) AS (SELECT window_label, direction, 1::BIGINT, [s] FROM so2 WHERE i = 1 UNION ALL
        SELECT q.window_label, q.direction, q.i, CASE WHEN len(list_filter(gr.kept, lambda o: {_like('q', 'o')})) > 0 THEN gr.kept ELSE list_append(gr.kept, q.s) END FROM gr JOIN so2 q ON q.window_label = gr.window_label AND q.direction = gr.direction AND q.i = gr.i + 1),
    ls AS (SELECT window_label, direction, arg_max(kept, i) AS kept FROM gr GROUP BY 1, 2), un AS (SELECT window_label, unnest(kept) AS o FROM ls)"""


@query(f"WITH RECURSIVE {_GREEDY}, tp AS (SELECT un.window_label, so.edge_id, so.score, row_number() OVER (PARTITION BY un.window_label ORDER BY score DESC, so.edge_id) AS place FROM un JOIN so ON so.window_label = un.window_label AND so.edge_id = un.o.edge_id) SELECT window_label, edge_id, round(score, 4) AS score, place FROM tp WHERE place <= 20")
def u7_r8_dedupe(spark, sf):
    return rounded(rank.rank_window(_ranker_rows(spark, sf)).select("window_label", "edge_id", "score", F.col("rank").cast("long").alias("place")), 4)


@query("SELECT label, row_number() OVER (ORDER BY k) AS place FROM (SELECT DISTINCT 'run' || (event_id % 120) || '/w' || (event_id % 11) AS label, (event_id % 120) * 1000 + event_id % 11 AS k FROM events)")
def t8_natural_sort(spark, sf):
    e = read(spark, sf, "events").select(F.concat(F.lit("run"), (F.col("event_id") % 120).cast("string"), F.lit("/w"), (F.col("event_id") % 11).cast("string")).alias("label")).distinct()
    return e.select("label", F.row_number().over(Window.orderBy(rank.natural_key(F.col("label")))).cast("long").alias("place"))


@query(f"WITH {_SIG} SELECT symbol, cond_id, count(*) AS n_horizons, round(max(effect_size), 6) AS best_effect FROM s GROUP BY 1, 2")
def c1_edge_report(spark, sf):
    rep = report.edge_report(_significance(spark, sf))
    return rounded(rep.select("symbol", "cond_id", F.size("horizons").cast("long").alias("n_horizons"), F.array_max(F.transform("horizons", lambda h: h["effect_size"])).alias("best_effect")))


@query(
    f"""WITH {_P}, best AS (SELECT symbol, cond_id, arg_max(horizon, struct_pack(a := effect_size, b := -(ci_high - ci_low), c := -horizon)) AS optimal_horizon FROM pa WHERE abs(z) > 0.5 GROUP BY 1, 2),
    cd AS (SELECT DISTINCT symbol, cond_id FROM pa)
    SELECT cd.symbol, cd.cond_id, optimal_horizon, nn AS n, {r('prob_bull', 'base_prob', 'effect_size', 'ci_low', 'ci_high', 'p_value', 'p_adj')} FROM cd LEFT JOIN best USING (symbol, cond_id) LEFT JOIN pa ON pa.symbol = cd.symbol AND pa.cond_id = cd.cond_id AND pa.horizon = optimal_horizon"""
)
def c2_summary_table(spark, sf):
    s = _significance(spark, sf).withColumn("significant", F.abs("z") > 0.5)
    out = report.summary_table(s, outcomes.optimal_horizon(s))
    return rounded(out.select("symbol", "cond_id", "optimal_horizon", "n", "prob_bull", "base_prob", "effect_size", "ci_low", "ci_high", "p_value", "p_adj"))


@query()
def c4_c6_expert_advisors(spark, sf):
    rows = [(k, report.magic_number(str(k)), outputs.advisor({"edge_id": str(k), "condition": t, "direction": "long" if k % 2 == 0 else "short", "best_horizon": 7})) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "cond_id int, magic int, source string")


@query(f"WITH {BARS} SELECT symbol, epoch(time)::BIGINT AS t, tick_volume, {r('open', 'high', 'low', 'close')} FROM bars")
def streaming_bars(spark, sf):
    e = read(spark, sf, "events")
    return rounded(stream_bars(e, "event_type", "ts", "value").select("symbol", F.unix_timestamp("time").alias("t"), "tick_volume", "open", "high", "low", "close"))


@query(f"WITH RECURSIVE {_SIGNALS}, {_PICK.replace('7 FOLLOWING', '6 FOLLOWING')} SELECT symbol, ea_id::INT AS ea_id, e AS entry_idx FROM chain")
def streaming_positions(spark, sf):
    return open_positions(hits(indicators(spark, sf)).filter("bar_idx + 1 < n").select("symbol", F.col("cond_id").cast("int").alias("ea_id"), "bar_idx"), 5)


@query()
def x3_research_run(spark, sf):
    from .research import Config, research

    config = Config(max_horizon=4, alpha=0.99, min_freq_per_year=1, wf_train_bars=40, wf_test_bars=20, wf_step_bars=20, permutation_n=20, permutation_random_state=1, costs=simulate.Costs(0.01), pip_value=0.01, min_precheck_expectancy_r=-10.0)
    edges = research(indicators(spark, sf), config, CONDITIONS).edges
    return rounded(edges.select("symbol", "condition", "direction", "best_horizon", "n_trades", "expectancy_r", "permutation_p", "sensitivity", "gate_passed", F.array_join("reasons", "; ").alias("reasons")))
