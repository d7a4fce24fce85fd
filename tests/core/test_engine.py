"""Operators against hand-made cases and plain Python."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidemark.functions import stats
from tidemark.operators import asof, backtest, bars, features, gate, generate, indicators, outcomes, predicates, rank, report, simulate, validate
from tidemark.operators.predicates import Atom, Condition, parse_condition
from tidemark.plans import outputs
from tidemark.sources import files

START = datetime(2024, 1, 2)


def make(spark, columns, hours=1.0, start=START, symbol="X"):
    n = len(next(iter(columns.values())))
    rows = [(symbol, start + timedelta(hours=hours * i), i, n, *[None if v[i] is None else float(v[i]) for v in columns.values()]) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, time timestamp, bar_idx long, n long, " + ", ".join(f"{c} float" for c in columns))


def held(df, *texts, **options):
    rows = predicates.triggers(df, [parse_condition(t) for t in texts], **options).collect()
    return [sorted(r["bar_idx"] for r in rows if r["cond_id"] == k) for k in range(len(texts))]


def test_comparisons_and_missing_values(spark):
    df = make(spark, {"a": [1, None, 3, 2, 0.8], "b": [2, 1, 1, 2, 1]})
    assert held(df, "a < 2", "a >= 2", "a != 3", "a == 3", "a <= 0.8", "a < 0.8") == [[0, 4], [2, 3], [0, 1, 3, 4], [2], [4], []]
    assert held(df, "a > b", "a > b AND a < 9") == [[0, 2], [0, 2]]  # bar 0 holds with a column as threshold
    assert held(df, "a > b", first_bar_true=False) == [[2]]


def test_crosses(spark):
    df = make(spark, {"a": [1, 3, 2, 1, 3], "b": [2, 2, 2, 2, 2]})
    assert held(df, "a crosses_above 2", "a crosses_below 2", "a crosses_above b") == [[1, 4], [3], [0, 1, 4]]


def test_bad_conditions(spark):
    df = make(spark, {"a": [1]})
    with pytest.raises(KeyError):
        predicates.atom_column(Atom("z", "<", 1.0), df.columns)
    with pytest.raises(ValueError):
        predicates.atom_column(Atom("a", "~", 1.0), df.columns)
    with pytest.raises(ValueError):
        predicates.condition_column(Condition(()), df.columns)
    with pytest.raises(ValueError):
        parse_condition("a <")
    assert str(parse_condition("a < 1 AND b > c")) == "a < 1.0 AND b > c"
    assert parse_condition("cal_x < 1 AND b > news_y").uses("cal_", "news_") == ["cal_x", "news_y"]


def test_frequency(spark):
    df = make(spark, {"a": [1] * 8760})
    out = predicates.frequency_filter(predicates.triggers(df, [parse_condition("a == 1")]), df).collect()
    assert out[0]["n"] == 8760 and abs(out[0]["per_year"] - 8760 / (364 / 365.25)) < 1e-6


def test_forward_profile_by_brute_force(spark):
    rng = np.random.default_rng(1)
    o, c = rng.normal(size=60).astype("f4"), rng.normal(size=60).astype("f4")
    df = outcomes.with_forward(make(spark, {"open": o, "close": c}), 4)
    prof = outcomes.profile(predicates.triggers(df, [parse_condition("close > 0")], keep=["fwd", "valid"]), 4).orderBy("horizon").collect()
    at = [i for i in range(56) if c[i] > 0]
    assert [r["n_bull"] for r in prof] == [sum(c[i + h] > o[i + 1] for i in at) for h in range(1, 5)] and prof[0]["n"] == len(at)


def test_statistics(spark):
    df = spark.createDataFrame([(60, 100), (0, 10), (5, 0), (10, 10)], "k long, n long")
    low, high = stats.wilson(F.col("k"), F.col("n"))
    rows = df.select(stats.z_score(F.col("k"), F.col("n"), F.lit(0.5)).alias("z"), low.alias("l"), high.alias("h")).collect()
    assert abs(rows[0]["z"] - 2.0) < 1e-12 and rows[2]["z"] is None and rows[1]["l"] == 0 and rows[3]["h"] == 1
    p = df.select(stats.two_sided_p(F.lit(1.959963984540054)).alias("p")).first()["p"]
    assert abs(p - 0.05) < 1e-9
    ps = [0.001, 0.005, 0.01, 0.1, 0.5, None]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(ps)], "i int, p double")
    adj = {m: [r["p_adj"] for r in stats.adjust_p(frame, "p", method=m).orderBy("i").collect()] for m in ("fdr_bh", "bonferroni", "fdr_by")}
    assert np.allclose(adj["fdr_bh"][:5], [0.005, 0.0125, 1 / 60, 0.125, 0.5]) and adj["fdr_bh"][5] is None
    assert np.allclose(adj["bonferroni"][:5], [0.005, 0.025, 0.05, 0.5, 1])
    assert np.allclose(adj["fdr_by"][0], 0.005 * sum(1 / i for i in range(1, 6)))
    with pytest.raises(ValueError):
        stats.adjust_p(frame, "p", method="none")
    assert abs(frame.limit(1).select(stats.norm_cdf(F.lit(0.0)).alias("x")).first()["x"] - 0.5) < 1e-12


def uptrend(spark, n=200):
    c = [100 + i for i in range(n)]
    return simulate.with_prices(make(spark, {"open": [x - 0.5 for x in c], "high": [x + 1 for x in c], "low": [x - 1 for x in c], "close": c, "atr_14": [1] * n}))


def signals(spark, df, at, direction="long"):
    some = spark.createDataFrame([(int(i),) for i in at], "bar_idx long")
    return df.join(some, "bar_idx").withColumn("cond_id", F.lit(0)).withColumn("direction", F.lit(direction))


def test_simulation_cases(spark):
    df = uptrend(spark)
    free = simulate.Costs()
    one = simulate.simulate(signals(spark, df, [10]), df, free, 5).collect()
    assert [(r["pnl"], r["outcome"]) for r in one] == [(5.5, "exit")]
    assert simulate.simulate(signals(spark, df, [10], "short"), df, free, 5).first()["pnl"] == -5.5
    assert simulate.simulate(signals(spark, df, [197]), df, free, 5).first()["outcome"] == "timeout"
    assert simulate.simulate(signals(spark, df, [197]), df, free, 5, clip=False).count() == 0
    costs = simulate.Costs(0.1, 0.05)
    three = signals(spark, df, [10, 20, 30])
    scan = {r["horizon"]: r["mean_r"] for r in simulate.horizon_scan(three, df, costs, 1, 9).collect()}
    stats_ = simulate.trade_stats(simulate.simulate(three, df, costs, 7)).first()
    assert abs(scan[7] - stats_["expectancy_r"]) < 1e-9 and stats_["profit_factor"] == math.inf and stats_["max_drawdown"] == 0
    assert simulate.trade_stats(simulate.simulate(signals(spark, df, []), df, costs, 7)).count() == 0
    assert simulate.open_price_trades(signals(spark, df, [10]), df, free, 5).first()["pnl"] == 5.0
    with pytest.raises(ValueError):
        simulate.open_price_trades(three, df, free, 0)


@pytest.mark.parametrize("reenter,want", [(False, [2, 5, 9]), (True, [2, 5, 9, 12])])
def test_one_at_a_time(spark, reenter, want):
    rows = spark.createDataFrame([("X", 0, i) for i in [2, 3, 5, 6, 9, 12]], "symbol string, cond_id int, bar_idx long")
    assert sorted(r["bar_idx"] for r in simulate.one_at_a_time(rows, 3, reenter).collect()) == ([2, 6, 12] if not reenter else want)


def test_sessions(spark):
    df = spark.range(24).select(F.col("id").cast("int").alias("h"))
    out = [r[0] for r in df.select(simulate.session_factor(F.col("h"), [(0, 7, 1.5), (22, 3, 1.7), (13, 13, 9.0)])).collect()]
    assert out == [1.5] * 7 + [1.0] * 15 + [1.7] * 2


def market(spark, n=12, spread=None):
    return make(spark, {"open": [2000 + i for i in range(n)], "spread": spread or [30] * n}, hours=1 / 12)


def trade(spark, df, at, hold, direction="long", **options):
    s = spark.createDataFrame([("X", 1, direction, int(i)) for i in at], "symbol string, ea_id int, direction string, bar_idx long")
    start, end = options.pop("start", None), options.pop("end", None)
    return backtest.backtest(s, df, hold, backtest.Tester(**options), start, end).orderBy("entry_idx").collect()


def test_backtest_cases(spark):
    df = market(spark)
    (t,) = trade(spark, df, [1], 3)
    assert (t["entry_idx"], t["exit_idx"], round(t["entry_price"], 2), t["exit_price"], round(t["profit"], 6)) == (2, 5, 2002.30, 2005.0, 270.0)
    assert round(trade(spark, df, [1], 3, "short")[0]["profit"], 6) == -330.0
    big = market(spark, 20)
    assert [t["entry_idx"] for t in trade(spark, big, range(1, 6), 3)] == [2, 6]
    assert [t["entry_idx"] for t in trade(spark, big, range(1, 6), 3, reenter_on_exit=True)] == [2, 5]
    assert [t["entry_idx"] for t in trade(spark, big, [1, 2], 5, max_positions=2)] == [2, 3]
    small = market(spark, 8)
    assert trade(spark, small, [1], 3, exit_offset=1)[0]["exit_idx"] == 6
    assert trade(spark, small, [5], 3) == [] and trade(spark, small, [5], 3, close_at_end=True)[0]["exit_idx"] == 7
    assert [t["entry_idx"] for t in trade(spark, df, [1, 3], 2, start="2024-01-02 00:15:00", end="2024-01-02 00:35:00")] == [4]
    (t,) = trade(spark, df, [1], 3, commission=3.5, slippage_points=10)
    assert (round(t["entry_price"], 2), round(t["exit_price"], 2), t["commission"]) == (2002.40, 2004.90, -7.0)


def test_equity_and_drawdown(spark):
    df = market(spark)
    s = spark.createDataFrame([("X", 1, "long", 1)], "symbol string, ea_id int, direction string, bar_idx long")
    tester = backtest.Tester()
    t = backtest.backtest(s, df, 3, tester)
    curve = {r["bar_idx"]: r for r in backtest.curves(t, df, tester).collect()}
    assert round(curve[3]["equity"], 6) == 10_070 and curve[4]["balance"] == 10_000 and round(curve[5]["balance"], 6) == 10_270
    assert round(backtest.drawdown(backtest.curves(t, df, tester)).first()["max_dd"], 6) == 30.0
    one = backtest.summary(t).first()
    whole = backtest.full_summary(t, backtest.curves(t, df, tester), s.unionByName(s.withColumn("ea_id", F.lit(2))), tester).orderBy("ea_id").collect()
    assert [(r["ea_id"], r["n_trades"], round(r["final_balance"], 6)) for r in whole] == [(1, 1, 10_270.0), (2, 0, 10_000.0)] and round(whole[0]["recovery_factor"], 6) == 9.0
    assert one["n_trades"] == 1 and one["max_consec_wins"] == 1 and one["max_consec_losses"] == 0


def test_spread_is_carried_on(spark):
    df = market(spark, 8).drop("spread")
    s = spark.createDataFrame([("X", START + timedelta(minutes=5 * i), v) for i, v in enumerate([0.0, 20.0, 50.0, 0.0, 80.0])], "symbol string, time timestamp, spread double")
    rows = asof.align_spread(df, s, 30.0, ["symbol"]).orderBy("bar_idx").collect()
    assert [r["spread"] for r in rows] == [30, 20, 50, 50, 80, 80, 80, 80] and [r["fallback"] for r in rows][:2] == [True, False]


def test_swap_nights(spark):
    day = lambda d, h=10: datetime(2024, 1, d, h)
    cases = [(day(2), day(2, 20), 0), (day(2), day(3), 1), (day(3), day(4), 3), (day(1), day(8), 7), (day(5), day(8), 1)]
    rows = spark.createDataFrame(cases, "a timestamp, b timestamp, want int").select(backtest.swap_nights(F.col("a"), F.col("b"), 0, 2).alias("n"), "want").collect()
    assert [r["n"] for r in rows] == [r["want"] for r in rows]


def events(spark, rows):
    t = lambda s: int((datetime.fromisoformat(s) - datetime(1970, 1, 1)).total_seconds())
    data = [("X", t(s), i, 1.0 if kind != 2 else 2.0, float(imp), float(impact), sign, actual, forecast) for s, i, imp, impact, sign, actual, forecast, kind in rows]
    return spark.createDataFrame(data, "symbol string, t long, event_id long, event_type double, importance double, impact double, sign int, actual double, forecast double")


def test_calendar_scenario(spark):
    feed = events(spark, [
        ("2024-01-05 00:00", 90, 1, 0, -1, None, None, 1), ("2024-01-05 23:59", 91, 1, 0, -1, None, None, 1), ("2024-01-05 13:30", 1, 3, 1, -1, 216.0, 170.0, 1), ("2024-01-05 16:00", 3, 2, 0, -1, None, None, 1),
    ])
    opens = ["12:00", "13:00", "13:30", "15:00", "17:00"]
    secs = [int((datetime.fromisoformat(f"2024-01-05 {o}") - datetime(1970, 1, 1)).total_seconds()) for o in opens]
    df = spark.createDataFrame([("X", i, s) for i, s in enumerate(secs)], "symbol string, bar_idx long, open_s long")
    got = {opens[r["bar_idx"]]: r for r in asof.calendar_features(df, feed, 1800, ["symbol"], asof.CalendarOptions(impact_max_age=60)).collect()}
    assert got["12:00"]["cal_min_to_next_high"] == 60 and got["12:00"]["cal_min_since_last_high"] == 1440
    r = got["13:00"]
    assert (r["cal_min_to_next_high"], r["cal_high_in_bar"], r["cal_high_next_bar"], r["cal_last_impact_sym"]) == (0, 0, 1, 0)
    assert (got["13:30"]["cal_high_in_bar"], got["13:30"]["cal_min_since_last_high"], got["13:30"]["cal_last_impact_sym"]) == (1, 30, -1)
    assert got["15:00"]["cal_min_to_next_medplus"] == 30 and got["15:00"]["cal_min_to_next_high"] == 1440 and got["17:00"]["cal_last_impact_sym"] == 0
    far = spark.createDataFrame([("X", 0, secs[0] - 10**7)], "symbol string, bar_idx long, open_s long")
    assert asof.calendar_features(far, feed, 1800, ["symbol"]).first()["cal_min_to_next_high"] is None


def test_currencies():
    assert asof.currencies("XAUUSD") == (None, "USD") and asof.currencies("eurusd.m") == ("EUR", "USD")
    with pytest.raises(ValueError):
        asof.currencies("1234")


def test_news_repairs(spark):
    rows = [(120, 3, 600, 3, 5, 0, 2), (480, 3, 0, 3, 85, 1, 1), (9000, 3, None, None, None, 0, 0), (None, None, 30, 3, 1, 0, 0)]
    df = make(spark, {c: [r[k] for r in rows] for k, c in enumerate(files.NEWS)}).withColumn("timeframe", F.lit("M30"))
    out = [tuple(r[c] for c in files.NEWS) for r in files.sanitize_news(df).orderBy("bar_idx").collect()]
    assert out == [(120, 3, 600, 3, 5, 0, 2), (0, 3, None, None, None, 1, 2), (None,) * 7, (None,) * 7]
    assert files.sanitize_news(df.filter("bar_idx > 1")).filter("bar_idx = 2").first()["news_min_to_next"] == 9000


def test_windows_and_stability(spark):
    df = uptrend(spark, 400)
    wins = validate.windows(df, 100, 50, 50)
    assert [(r["train_start"], r["test_start"], r["test_end"]) for r in wins.orderBy("window").collect()] == [(s, s + 100, s + 150) for s in range(0, 251, 50)]
    trades = simulate.simulate(signals(spark, df, range(0, 400, 20)), df, simulate.Costs(), 5)
    assert validate.holding_stability(trades, wins, 6).first()["stable"]
    assert validate.windows(df, 500, 50, 50).count() == 0


def test_rotation_by_numpy(spark):
    rng = np.random.default_rng(5)
    o, c = rng.normal(size=80), rng.normal(size=80)
    df = outcomes.with_forward(make(spark, {"open": o, "close": c}), 2)
    at = list(range(3, 70, 5))
    shifts = [7, 9, 9, 20]
    got = validate.rotation_test(signals(spark, df, at), df, shifts).first()
    out = np.array([r["fwd"][0] for r in df.orderBy("bar_idx").collect()], float)
    real = out[at].mean() - out.mean()
    null = np.array([np.roll(out, s)[at].mean() - out.mean() for s in shifts])
    assert np.allclose([got["effect"], got["p_value"], got["null_mean"], got["null_std"]], [real, (abs(null) >= abs(real)).mean(), null.mean(), null.std()])


def test_rotation_compares_doubles_as_sql_does(spark):
    # 2 and 1 bulls of 5 triggers lie as far from 3 of 10, but not in doubles: 0.1000...3 and -0.0999...8.
    out, at = [1, 1, 0, 1, 0, 0, 0, 0, 0, 0], [0, 1, 4, 5, 6]
    df = spark.createDataFrame([("X", i, [x]) for i, x in enumerate(out)], "symbol string, bar_idx long, fwd array<int>")
    got = validate.rotation_test(signals(spark, df, at), df, [2]).first()
    assert [np.roll(out, s)[at].sum() for s in (0, 2)] == [2, 1] and abs(got["effect"]) > abs(got["null_mean"]) > 0.0999
    assert got["p_value"] == 0


def test_shifts():
    assert [str(c) for c in validate.shifted(parse_condition("a < 10 AND b == 1"), 10)] == ["a < 9.0 AND b == 1.0", "a < 11.0 AND b == 1.0"]
    assert validate.shifted(parse_condition("a > b"), 10) == []


def test_calendar_windows(spark):
    df = bars.number_bars(spark.sql("SELECT 'X' AS symbol, explode(sequence(timestamp'2010-01-01', timestamp'2016-06-15', interval 1 day)) AS time"))
    w = validate.calendar_windows(df, 3, 1, 1).orderBy("window").collect()
    assert [(r["train_from"].year, r["truncated"]) for r in w] == [(2010, False), (2011, False), (2012, False), (2013, True)]
    assert w[0]["train_start"] == 0 and w[0]["test_start"] == 1096
    assert validate.calendar_windows(df, 3, 1, 1, 2020).count() == 0


def test_generation(spark):
    cols = ["close", "rsi_14", "cci_20", "mom_10", "stoch_5_3_3_k", "stoch_5_3_3_d", "volregime_regime", "ps_gap_fill_pct", "cal_min_to_next_high", "cal_high_in_bar", "ma_20_sma"]
    out = [str(a) for a in generate.atoms(cols, moving_averages=True, levels={"news_last_importance": [1, 2]})]
    assert "rsi_14 < 30.0" in out and "mom_10 > 0.0" in out and "mom_10 < 0.0" not in out and not any("_d " in x for x in out) and out[-2:] == ["ma_20_sma > close", "ma_20_sma < close"]
    pool = [Atom("rsi_14", "<", 30.0), Atom("rsi_7", "<", 30.0), Atom("cci_20", ">", 1.0)]
    assert [str(c) for c in generate.combine(pool, {("rsi_14", "cci_20"): 0.9, ("rsi_7", "cci_20"): None})] == ["rsi_7 < 30.0 AND cci_20 > 1.0"]
    df = make(spark, {"a": [1, 2, 3, None], "b": [2, 4, 6, 1], "c": [5, 5, 5, 5]})
    corr = generate.correlations(df, ["a", "b", "c"])
    assert abs(corr[("a", "b")] - 1) < 1e-9 and corr[("a", "c")] is None


def test_gate(spark):
    row = {"significant": True, "walk_forward": True, "stable": True, "permutation_p": 0.01, "n_trades": 50, "profit_factor": math.inf, "expectancy_r": 0.2, "ci_low": None}
    rows = [row, row | {"n_trades": 3, "profit_factor": 0.5}, row | {"expectancy_r": None}, row | {"permutation_p": None}]
    schema = "significant boolean, walk_forward boolean, stable boolean, permutation_p double, n_trades int, profit_factor double, expectancy_r double, ci_low double"
    out = gate.strategy_gate(spark.createDataFrame([tuple(r.values()) for r in rows], schema)).collect()
    assert [r["reasons"] for r in out] == [[], ["too few trades"], ["expectancy not positive"], ["permutation test"]]


RANKED = "edge_id int, window_label string, condition string, direction string, holding int, n_trades long, test_exp double, train_exp double, profit_factor double, test_passed boolean, sensitivity double"


def test_ranking_similarity(spark):
    texts = [("rsi_14 < 30 AND atr_14 > 5", 10), ("atr_14 > 5 AND rsi_14 < 21.5", 12), ("rsi_14 < 20 AND atr_14 > 5", 10), ("rsi_14 > 30 AND atr_14 > 5", 10), ("rsi_14 < 30 AND atr_14 > 5", 40), ("rsi_14 < 30", 10)]
    rows = [(i, "w", t, "long", h, 40 + i, 0.2, 0.2, 2.0, True, 0.9) for i, (t, h) in enumerate(texts)]
    df = spark.createDataFrame(rows, RANKED)
    ranked = {r["edge_id"]: r for r in rank.rank_window(df, rank.Ranking(sort_dedupe=False)).collect()}
    # 21.5 is within 30 % of 30 and 20 of 21.5; 20 is not within 30 % of 30. 12 bars are within 2 of 10.
    assert {k: r["neighbours"] for k, r in ranked.items()} == {0: 1, 1: 2, 2: 1, 3: 0, 4: 0, 5: 0}
    # All good and alike: the plateau is whole. 100 x (.25 x .5 + .15 x .4 + .15 x log10(41 / 20) + .25 + .2)
    assert ranked[1]["plateau"] == 1 and abs(ranked[1]["score"] - 100 * (0.125 + 0.06 + 0.15 * math.log10(41 / 20) + 0.45)) < 1e-9
    assert ranked[1]["warnings"] == [] and ranked[3]["warnings"] == ["no_plateau"]
    out = {r["edge_id"]: r for r in rank.rank_window(df).collect()}
    # In score order 2 (the most trades of the three), then 1 falls to it, and 0 stays, as only 1 is near it.
    assert sorted(out) == [0, 2, 3, 4, 5] and out[2]["similar"] == ["atr_14 > 5 AND rsi_14 < 21.5"]


def test_ranking_by_hand(spark):
    rows = [
        (0, "w", "a < 1", "long", 5, 25, 0.1, 0.2, math.inf, False, None), (1, "w", "a < 1.2", "long", 5, 10, -0.1, 0.3, 1.0, True, 0.8),
        (2, "w", "b < 1", "short", 5, 0, 0.0, 0.0, None, True, 0.8), (3, "w", "c < 1 AND d > 2", "long", 5, 25, 0.1, 0.2, 2.0, True, 0.8),
    ]
    out = {r["edge_id"]: r for r in rank.rank_window(spark.createDataFrame(rows, RANKED), rank.Ranking(sort_dedupe=False)).collect()}
    # 3 has the trades and expectancy of 0 and more atoms: one row. 2 has no trades. 0 and 1 are neighbours, of which one is good.
    assert sorted(out) == [0, 1] and out[0]["same_as"] == ["c < 1 AND d > 2"]
    plateau = 0.5 * (1 - 4.5 / 5.5)
    assert abs(out[0]["plateau"] - plateau) < 1e-12 and out[0]["stability"] == 0.5
    assert abs(out[0]["score"] - 100 * (0.25 + 0.15 * 0.2 + 0.15 * math.log10(1.25) + 0.25 * plateau + 0.2 * 0.5)) < 1e-9
    assert out[0]["warnings"] == ["low_sensitivity", "no_plateau", "test_failed"] and out[1]["warnings"] == ["low_frequency", "low_pf", "no_plateau"]
    single = rank.rank_window(spark.createDataFrame(rows, RANKED), rank.Ranking(drop_below_floor=True), single_run=True).collect()
    assert [(r["edge_id"], r["warnings"]) for r in single] == [(0, ["no_plateau", "gate_failed"])]
    parts = (0.25 + 0.15 * 0.2 + 0.15 * math.log10(1.25) + 0.25 * plateau) / 0.8
    assert abs(single[0]["score"] - 100 * parts) < 1e-9


def test_ranking_over_windows(spark):
    rows = [
        (0, "w1", "a < 1", "long", 5, 100, 0.2, 0.2, 2.0, True, 0.8), (1, "w2", "a < 1", "long", 6, 50, 0.5, 0.2, 1.0, True, None), (2, "w3", "a < 1", "long", 6, 10, None, 0.2, None, True, None),
        (3, "w4", "b < 1", "long", 5, 30, -0.2, 0.2, 3.0, True, 0.8),
    ]
    out = {r["condition"]: r for r in rank.rank_timeframe(spark.createDataFrame(rows, RANKED)).collect()}
    a = out["a < 1"]
    assert (a["n_trades"], a["holding"], a["n_windows"], a["windows_passed"], a["consistency"]) == (160, 6, 3, 1, 0.25)
    assert abs(a["profit_factor"] - (2 * 100 + 50) / 150) < 1e-12 and abs(a["test_exp"] - (20 + 25) / 150) < 1e-12
    assert a["warnings"] == ["no_plateau", "few_windows"] and out["b < 1"]["warnings"] == ["low_frequency", "no_plateau", "few_windows", "non_positive_expectancy"]
    settings = rank.Ranking.of({"ranker_min_pf": "1.5", "ranker_sort_top_n": 1.0, "other": 3})
    assert settings.min_pf == 1.5 and settings.sort_top_n == 1 and rank.Ranking.of(None) == rank.Ranking()
    keys = [r["label"] for r in spark.createDataFrame([("w10",), ("w9",), ("w1",), ("w12345678901234567890",), ("w012",)], "label string").orderBy(rank.natural_key(F.col("label"))).collect()]
    assert keys == ["w1", "w9", "w10", "w012", "w12345678901234567890"]


def test_rotation_shifts_by_symbol(spark):
    df = outcomes.with_forward(make(spark, {"open": range(40), "close": [i * 7 % 40 for i in range(40)]}), 2)
    both = df.unionByName(df.withColumn("symbol", F.lit("Y")))
    got = validate.rotation_test(signals(spark, both, [1, 5, 9]).unionByName(signals(spark, df, [2]).withColumn("cond_id", F.lit(9))), both, {"X": [3, 4]})
    assert {r["symbol"] for r in got.collect()} == {"X"}


def test_signals_that_do_not_trade(spark):
    df = make(spark, {"open": [2000.0, 2001, 2002, None, 2004, 2005, 2006, 2007], "spread": [30] * 8}, hours=1 / 12)
    s = spark.createDataFrame([("X", 1, "long", i) for i in (1, 2, 3, 4, 6)], "symbol string, ea_id int, direction string, bar_idx long")
    fates = {r["entry_idx"]: r["fate"] for r in backtest.signal_fates(s, df, 2).collect()}
    # Bar 3 has no price: it blocks nothing, so that 4 is taken and 5 is busy until 6; 7 ends behind the data.
    assert fates == {2: "taken", 3: "busy", 4: "busy", 5: "taken", 7: "busy"}
    fates = {r["entry_idx"]: r["fate"] for r in backtest.signal_fates(s.filter("bar_idx > 1"), df, 2).collect()}
    assert fates == {3: "no_price", 4: "taken", 5: "busy", 7: "open_end"}
    assert tuple(backtest.signal_counts(backtest.signal_fates(s, df, 2)).first())[2:] == (5, 3, 0)


def test_erfc_to_many_digits(spark):
    xs = [k / 16 for k in range(-80, 160)] + [0.46875, 4.0, float("nan")]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", stats.erfc(F.col("x")).alias("y")).collect()
    assert all(r["y"] is None if r["x"] != r["x"] else abs(r["y"] - math.erfc(r["x"])) <= 1e-12 * math.erfc(r["x"]) for r in rows)


def market_of(spark, n, symbol, rng):
    close = 100 + np.cumsum(rng.normal(0, 1, n))
    high, low = close + rng.uniform(0, 2, n), close - rng.uniform(0, 2, n)
    return make(spark, {"open": close - rng.normal(0, 0.5, n), "high": high, "low": low, "close": close, "tick_volume": rng.integers(1, 90, n)}, symbol=symbol)


def test_export_columns_by_numpy(spark):
    """Means with memory over many small batches, against loops."""
    rng, n = np.random.default_rng(11), 300
    df = market_of(spark, n, "X", rng).unionByName(market_of(spark, 40, "Y", rng))
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        rows = [r.asDict() for r in indicators.export_columns(df).filter("symbol = 'X'").orderBy("bar_idx").collect()]
        assert indicators.export_columns(df).filter("symbol = 'Y'").count() == 40
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    got = {c: np.array([np.nan if r[c] is None else r[c] for r in rows], float) for c in rows[0] if c not in ("symbol", "time")}
    h, l, c, v = (got[k] for k in ("high", "low", "close", "tick_volume"))

    def ema(x, k, first=0):
        out = np.full(len(x), np.nan)
        for i in range(first, len(x)):
            out[i] = x[i] if i == first else out[i - 1] + 2 / (k + 1) * (x[i] - out[i - 1])
        return out

    def smma(x, k, first=0):
        out = np.full(len(x), np.nan)
        for i in range(first + k - 1, len(x)):
            out[i] = x[first : first + k].mean() if i == first + k - 1 else (out[i - 1] * (k - 1) + x[i]) / k
        return out

    move = np.diff(c, prepend=c[0])
    up, down = smma(np.maximum(move, 0), 14, 1), smma(np.maximum(-move, 0), 14, 1)
    tr = np.concatenate([[0], np.maximum.reduce([h[1:] - l[1:], abs(h[1:] - c[:-1]), abs(l[1:] - c[:-1])])])
    du, dd = np.maximum(np.diff(h, prepend=h[0]), 0), np.maximum(-np.diff(l, prepend=l[0]), 0)
    dp, dm = np.where(du > dd, du, 0), np.where(dd > du, dd, 0)
    part = lambda x, of: np.divide(100 * x, of, out=np.zeros(len(x)), where=of != 0)
    p, m = ema(part(dp, tr), 14), ema(part(dm, tr), 14)
    pw, mw, tw = (smma(x, 14, 1) for x in (dp, dm, tr))
    dx = np.where(np.isnan(tw), np.nan, 100 * abs(pw - mw) / (pw + mw))
    ama, er = c.copy(), np.zeros(n)
    for i in range(10, n):
        er[i] = abs(c[i] - c[i - 10]) / abs(np.diff(c[i - 10 : i + 1])).sum()
        ama[i] = ama[i - 1] + (er[i] * (2 / 3 - 2 / 31) + 2 / 31) ** 2 * (c[i] - ama[i - 1])
    lwma = np.full(n, np.nan)
    for i in range(9, n):
        lwma[i] = (c[i - 9 : i + 1] * np.arange(1, 11)).sum() / 55
    e3 = ema(ema(ema(c, 14), 14), 14)
    flow = np.cumsum((2 * c - l - h) / (h - l) * v)
    want = {
        "ma_20_ema": ema(c, 20), "ma_50_smma": smma(c, 50), "ma_10_lwma": lwma, "tema_10": 3 * ema(c, 10) - 3 * ema(ema(c, 10), 10) + ema(ema(ema(c, 10), 10), 10), "rsi_14": 100 - 100 / (1 + up / down), "adx_14": ema(part(abs(p - m), p + m), 14),
        "adxwilder_14": smma(dx, 14, 14), "ama_10_2_30": ama, "macd_12_26_9_main": ema(c, 12) - ema(c, 26), "trix_14": np.concatenate([[np.nan], e3[1:] / e3[:-1] - 1]), "chaikin_3_10": ema(flow, 3) - ema(flow, 10), "obv": v[0] + np.cumsum(np.sign(move) * v),
    }
    for name, x in want.items():
        assert np.array_equal(np.isnan(got[name]), np.isnan(x)), name
        assert np.allclose(got[name], x, rtol=2e-4, atol=2e-3, equal_nan=True), (name, np.nanmax(abs(got[name] - x)))
    assert len(got) - 7 == 82 and all(np.isfinite(got[k]).sum() > 50 for k in got)
    stop = got["sar_002_02"]
    turns = np.flatnonzero((stop[1:] < l[1:]) != (stop[:-1] < l[:-1]))
    assert 3 < len(turns) < n / 3 and all(s <= b or s >= a for s, a, b in zip(stop[1:], h[1:], l[1:]))


def test_features_have_warm_up(spark):
    df = make(spark, {"open": range(60), "high": range(1, 61), "low": range(60), "close": range(60), "atr_14": range(1, 61)})
    out = features.volatility_regime(df, 10, 5).orderBy("bar_idx").collect()
    assert out[28]["volregime_atr_pctl"] is None and out[29]["volregime_atr_pctl"] == 100 and out[29]["volregime_regime"] == 2


def test_reports():
    assert report.to_mql("a < 1 AND b crosses_above 2") == "(a < 1.0) && (b > 2.0)" and report.text_to_mql("NOT a OR b") == "!a || b"
    text = report.markdown([{"a": 1.0, "b": None, "s": True}], ["a", "b"], "T", "s")
    assert "| 1.0000 | - | <-- selected" in text
    source = outputs.advisor({"edge_id": "e1", "condition": "a < 1 AND b > c", "direction": "short", "best_horizon": 5})
    assert "trade.Sell(Lots, _Symbol);" in source and "ExitBars  = 5;" in source and "return (a < 1.0) && (b > c);" in source and f"Magic     = {report.magic_number('e1')};" in source
    with pytest.raises(ValueError):
        outputs.advisor({"edge_id": "e1", "condition": "a < 1"})
    stub = outputs.candidate_stub({"condition": "cal_min_to_next_high < 15 AND ps_gap_atr > 1", "direction": "long", "best_horizon": 3, "gate_passed": False, "reasons": ["too few trades"], "n_trades": 4, "expectancy_r": 0.5, "profit_factor": math.inf, "permutation_p": 0.2})
    assert "not recommended (too few trades)" in stub and "depends on the calendar (cal_min_to_next_high)" in stub and "custom indicators (ps_gap_atr)" in stub and "0.5000 R, profit factor inf" in stub
    windows = [{"window_label": "w1", "train": "a .. b", "test": "b .. c", "truncated": True, "n_candidates": 3, "accepted": [{"edge_id": 1, "condition": "a < 1", "direction": "long", "holding": 2, "test_exp": 0.1, "profit_factor": 2.0, "n_trades": 9}]}, {"window_label": "w2", "train": "b .. c", "test": "c .. d", "n_candidates": 0, "accepted": []}]
    text = outputs.runs_summary([{"run_label": "run_2015", "start_year": 2015, "train_years": 2, "test_years": 1, "step_years": 1, "windows": windows}])
    assert "Runs: 1, windows: 2" in text and "| w1 | a .. b | b .. c | yes | 3.0000 | 1 |".replace("3.0000", "3") in text and "before its nominal end" in text and "## w2: accepted edges\n\nnone" in text
    text = outputs.ranking_report([{"rank": 1, "condition": "a < 1", "score": 50.0, "warnings": ["low_pf"], "similar": list("abcd")}], "T", single_run=True)
    assert "#1 also stands for 4 similar: `a`; `b`; `c` (+1 more)" in text and "low_pf" in text
    assert "| 2 | 9 | 0.1000 | 0.2000 | 0.3000 | <-- selected" in outputs.holding_scan([{"horizon": 2, "n_trades": 9, "mean_r": 0.1, "std_r": 0.2, "score": 0.3}, {"horizon": 1}], 2)
    assert outputs.chart_svg([{"balance": 1.0, "low": 0.5, "high": 2.0}] * 2, "a < b").count("<path") == 2 and outputs.chart_svg([], "") == ""
