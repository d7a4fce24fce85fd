"""Queries that have no SQL to match run on the whole tables; checked by brute force."""

from bisect import bisect_left, bisect_right
from collections import defaultdict

from pyspark.sql import functions as F
from tidemark.plans import queries as plans
from tidemark.plans.base import CONDITIONS, hits, hourly, indicators

SF = "/root/testdata/sf0.001"


def events(spark):
    out = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/events.parquet").select("event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_id", "value").collect():
        out[r["event_type"]].append((r["t"], r["event_id"], r["value"]))
    return {k: sorted(v) for k, v in out.items()}


def bars(spark):
    return {(r["symbol"], r["bar_idx"]): r["t"] for r in hourly(spark, SF).select("symbol", "bar_idx", F.unix_micros(F.col("time").cast("timestamp")).alias("t")).collect()}


def test_nearest_events_and_news_are_of_all_events(spark):
    of, at = events(spark), bars(spark)
    rows = plans.QUERIES["j2_j3_asof"](spark, SF).collect()
    assert len(rows) == len(at)
    for r in rows:
        own, t = of[r["symbol"]], at[r["symbol"], r["bar_idx"]]
        times, by_id = [x[0] for x in own], {x[1]: x[0] for x in own}
        k = bisect_left(times, t)
        assert by_id.get(r["last_id"]) == (times[k - 1] if k else None)
        assert by_id.get(r["next_id"]) == (times[k] if k < len(times) else None)
    rows = plans.QUERIES["i4_news"](spark, SF).collect()
    assert len(rows) == len(at)
    for r in rows:
        times, t = [x[0] // 10**6 for x in of[r["symbol"]]], at[r["symbol"], r["bar_idx"]] // 10**6 + 3600
        k = bisect_right(times, t)
        assert r["news_count_next_24h"] == bisect_right(times, t + 86400) - k
        for got, want in ((r["news_min_to_next"], times[k] - t if k < len(times) else None), (r["news_min_since_last"], t - times[k - 1] if k else None)):
            assert (got is None) == (want is None) and (want is None or abs(got - want / 60) < 0.006)


def test_spreads_are_of_all_events(spark):
    hours = defaultdict(list)
    for symbol, own in events(spark).items():
        for t, _, value in own:
            hours[symbol, t // 3_600_000_000].append(value)
    hour = (F.unix_timestamp(F.col("time").cast("timestamp")) / 3600).cast("long")
    got = {(r["symbol"], r["h"]): r["spread"] for r in plans._spread_table(spark, SF).withColumn("h", hour).collect()}
    assert got.keys() == hours.keys()
    assert all(abs(got[k] + 40.5 - sum(v) / len(v)) < 1.001 for k, v in hours.items())
    n = {r["symbol"]: r["n"] for r in plans.QUERIES["a29_spread_calibration"](spark, SF).collect()}
    assert n == {s: sum(k[0] == s and got[k] > 0 for k in hours) for s, _ in hours}
    last = {}
    aligned = {(r["symbol"], r["bar_idx"]): r["spread"] for r in plans.QUERIES["j9_spread"](spark, SF).collect()}
    for (symbol, k), t in sorted(bars(spark).items()):
        if got[symbol, t // 3_600_000_000] > 0:
            last[symbol] = got[symbol, t // 3_600_000_000]
        assert aligned[symbol, k] == last.get(symbol, 30.0)


def test_backtests_without_sql_have_spreads_of_all_events(spark):
    _, b = plans._backtest(spark, SF)
    got = {(r["symbol"], r["bar_idx"]): r["spread"] for r in b.select("symbol", "bar_idx", "spread").collect()}
    assert got == {(r["symbol"], r["bar_idx"]): r["spread"] for r in plans.QUERIES["j9_spread"](spark, SF).collect()}


def test_backtests_and_positions_are_of_all_conditions(spark):
    every = {r["cond_id"] for r in hits(indicators(spark, SF)).filter("bar_idx + 7 < n").select("cond_id").distinct().collect()}
    assert max(every) > 5
    for name in ("m6_backtest", "m6_three_positions", "a23_a25_backtest_summary", "streaming_positions"):
        assert {r["ea_id"] for r in plans.QUERIES[name](spark, SF).select("ea_id").distinct().collect()} >= every, name


def test_sensitivity_is_of_all_conditions(spark):
    assert {r["cond_id"] for r in plans.QUERIES["v5_sensitivity"](spark, SF).select("cond_id").distinct().collect()} - set(range(5)) >= {8, 9}
    assert len(CONDITIONS) == 14
