"""Readers and writers on files of many kinds."""

import pytest
from pyspark.sql import functions as F
from tidemark.operators import generate
from tidemark.plans import outputs, runs
from tidemark.plans.research import Config
from tidemark.sources import files
from tidemark.streaming.bars import stream_bars


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def body(n=50, time="2023.01.01 {h:02d}:{m:02d}"):
    return "time,open,high,low,close,tick_volume\n" + "".join(time.format(h=i // 60, m=i % 60) + f",{100 + i}.5,{101 + i},{99 + i},{100 + i},{i}\n" for i in range(n))


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "utf-16", "cp1252"])
def test_encodings(spark, tmp_path, encoding):
    df = files.read_bars(spark, write(tmp_path / "a.csv", body(), encoding), "X", "M1").orderBy("time").collect()
    assert len(df) == 50 and df[9]["open"] == 109.5 and [r["bar_idx"] for r in df] == list(range(50))


def test_last_of_a_time_stays(spark, tmp_path):
    path = write(tmp_path / "a.csv", "time,close\n20091231 00:00,1\n20091231 00:00,2\n20091231 00:01,3\n")
    assert [r["close"] for r in files.read_bars(spark, path, "X", "M1").orderBy("time").collect()] == [2, 3]


def test_stray_quotes(spark, tmp_path):
    lines = body().split("\n")
    lines[10] = lines[10].replace(",109,", ',"109,')
    lines[20] = '"' + lines[20]
    df = files.read_bars(spark, write(tmp_path / "a.csv", "\n".join(lines)), "X", "M1").orderBy("time").collect()
    assert len(df) == 50 and df[9]["close"] == 109


def test_bad_times_and_missing_columns(spark, tmp_path):
    with pytest.raises(ValueError):
        files.read_bars(spark, write(tmp_path / "a.csv", "time,close\nx,1\ny,2\n"), "X", "M1")
    with pytest.raises(ValueError):
        files.read_bars(spark, write(tmp_path / "b.csv", "date,close\n1,1\n"), "X", "M1")


def test_nan_text_and_schema(spark, tmp_path):
    path = write(tmp_path / "a.csv", "time,open,volregime_regime,volregime_atr_pctl,volregime_atr_ratio\n20240105 00:00,NaN,3,50,1\n20240105 00:30,2,1,120,1\n")
    df = files.read_bars(spark, path, "X", "M30")
    said = files.validate_schema(df)
    assert said["groups"] == {"volregime": "present", "ps": "missing", "news": "missing"} and said["nulls"]["open"] == 1
    assert said["out_of_range"] == {"volregime_regime": 1, "volregime_atr_pctl": 1} and said["missing_ohlc"] == ["high", "low", "close"]


def test_store_and_load(spark, tmp_path):
    df = files.ingest(spark, write(tmp_path / "a.csv", body()), str(tmp_path / "store"), "X", "M1")
    assert df.count() == 50 and files.load_bars(spark, str(tmp_path / "store"), ["close", "none"]).columns == ["symbol", "timeframe", "time", "bar_idx", "n", "close"]


def test_calendar_spread_and_trades(spark, tmp_path):
    head = "time_server,event_id,importance,currency,actual\n"
    cal = files.read_calendar(spark, write(tmp_path / "c.csv", head + "2024-01-05 13:30:00,1,3,usd,216\n2024-01-05 13:30:00,1,3,usd,216\nbad,2,1,eur,\n")).collect()
    assert len(cal) == 1 and cal[0]["currency"] == "USD" and cal[0]["forecast"] is None
    with pytest.raises(ValueError):
        files.read_calendar(spark, write(tmp_path / "d.csv", "time_server,currency\n2024-01-05 13:30:00,usd\n"))
    spread = files.read_spreads(spark, write(tmp_path / "s.csv", "Time,Spread\n20240102 00:00,20\n20240102 00:00,30\n20240102 00:05,40\n")).orderBy("time").collect()
    assert [r["spread"] for r in spread] == [20, 40]
    ref = files.read_reference_trades(spark, write(tmp_path / "t.csv", "Open Time,CloseTime, open price,close_price\n2024.01.02 00:10,2024.01.02 00:25,2002.3,2005\n")).collect()
    assert ref[0]["entry_price"] == 2002.3
    with pytest.raises(ValueError):
        files.read_reference_trades(spark, write(tmp_path / "u.csv", "open_time\n2024.01.02 00:10\n"))


def test_results_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.5, ["a", "b"]), (2, 0.7, [])], "edge_id int, score double, reasons array<string>")
    for w in ("w2", "w10"):
        files.write_results(rows, str(tmp_path / "runs" / w), [F.desc("score")])
    back = outputs.read_test_periods(spark, str(tmp_path / "runs"))
    assert back.count() == 4 and {r["window_label"] for r in back.collect()} == {"w2", "w10"}
    todo = files.unfinished(spark.createDataFrame([("w1",), ("w2",)], "window_label string"), back, ["window_label"])
    assert [r["window_label"] for r in todo.collect()] == ["w1"]
    assert files.union_all([rows, rows.drop("score")]).count() == 4


def test_stream_equals_batch(spark, tmp_path):
    ticks = spark.sql("SELECT 'X' AS symbol, timestamp'2024-01-01' + make_interval(0,0,0,0,0,id * 7) AS ts, cast(id % 13 AS double) AS value FROM range(200)")
    ticks.write.parquet(str(tmp_path / "ticks"))
    batch = {tuple(r) for r in stream_bars(ticks, "symbol", "ts", "value").collect()}
    stream = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "ticks"))
    q = stream_bars(stream, "symbol", "ts", "value").writeStream.outputMode("append").format("memory").queryName("bars_out").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        closed = {tuple(r) for r in spark.sql("SELECT * FROM bars_out").collect()}
    finally:
        q.stop()
    assert closed and closed <= batch and len(closed) >= len(batch) - 3


HEADER = "time,open,high,low,close,tick_volume,real_volume,atr_14,news_min_to_next,news_next_importance,news_min_since_last,news_last_importance,news_last_surprise,news_in_window,news_count_next_24h"


def test_news_of_an_export_become_atoms(spark, tmp_path):
    """A file with the export's own header: news columns are repaired, checked, and give atoms; so do those of a calendar."""
    news = ["60.0,2,0.0,3,46.0,1,1", "30.0,2,30.0,3,46.0,1,1", "NaN,NaN,60.0,3,46.0,0,0", "90.0,3,NaN,NaN,NaN,0,2"]
    lines = [f"20240105 {13 + (i + 1) // 2}:{30 * ((i + 1) % 2):02d},1,2,0.5,1.5,9,0,5.0,{x}" for i, x in enumerate(news)]
    path = write(tmp_path / "x.csv", "\n".join([HEADER, *lines, ""]))
    raw = files.read_text_table(spark, path)
    typed = raw.select(*[files.number(F.col(c)).alias(c) for c in files.NEWS])
    assert files.news_repairs(typed) == {"boundary_rows": 1, "uncovered_rows": 2}
    rows = files.read_bars(spark, path, "XAUUSD", "M30").orderBy("bar_idx").collect()
    assert [tuple(r[c] for c in files.NEWS) for r in rows] == [(0, 3, None, None, None, 1, 2), (30, 2, 30, 3, 46, 1, 1), (None,) * 7, (None,) * 7]
    feed = write(tmp_path / "c.csv", "time_server,event_id,importance,event_type,impact_type,currency,actual,forecast\n2024-01-05 00:00:00,9,1,1,0,USD,,\n2024-01-05 13:45:00,1,3,1,1,USD,216,170\n2024-01-05 23:00:00,9,1,1,0,USD,,\n2024-01-05 14:00:00,2,3,1,1,EUR,1,1\n")
    bars = files.ingest(spark, path, str(tmp_path / "store"), "XAUUSD", "M30", calendar=feed)
    assert files.validate_schema(bars)["groups"]["news"] == "present"
    got = {r["bar_idx"]: r for r in bars.collect()}
    assert got[0]["cal_high_in_bar"] == 1 and got[0]["cal_last_impact_sym"] == -1 and got[0]["cal_min_since_last_high"] == 15 and got[0]["cal_last_surprise_absz"] is None
    levels = generate.observed_levels(bars, ["news_next_importance", "news_last_importance"])
    atoms = [str(a) for a in generate.atoms(bars.columns, levels=levels)]
    for a in ("news_min_to_next < 15.0", "news_min_since_last < 240.0", "news_in_window == 1.0", "news_count_next_24h > 2.0", "news_next_importance == 2.0", "news_last_surprise < 0.0", "cal_min_to_next_high < 120.0", "cal_last_impact_sym == -1.0", "cal_last_surprise_absz > 0.5", "cal_medplus_next_bar == 1.0"):
        assert a in atoms, a
    assert "news_last_importance == 3.0" not in atoms  # a constant column


def test_result_files_have_their_columns(spark, tmp_path):
    edges = spark.createDataFrame([("X", 0, "a < 1", "long", False, ["p", "q"], 5, True, 9, 0.1, 1.5), ("X", 1, "b < 1", "short", True, [], 3, False, 40, 0.3, float("inf"))], "symbol string, cond_id int, condition string, direction string, gate_passed boolean, reasons array<string>, best_horizon int, stable boolean, n_trades long, expectancy_r double, profit_factor double")
    outputs.write_gate(edges, str(tmp_path / "gate"))
    raw = spark.read.option("header", True).csv(str(tmp_path / "gate"))
    assert raw.columns == list(outputs.GATE_COLUMNS) and len(raw.columns) == 17 and [r["edge_id"] for r in raw.collect()] == ["X_2", "X_1"] and raw.collect()[1]["reasons"] == "p; q"
    back = outputs.read_gate(spark, str(tmp_path / "gate")).orderBy("edge_id").collect()
    assert [(r["condition"], r["holding"], r["n_trades"], r["test_passed"]) for r in back] == [("b < 1", 3, 40, True), ("a < 1", 5, 9, False)] and back[0]["profit_factor"] == float("inf")
    assert runs.ranked_rows(spark, str(tmp_path / "gate"), "gate", 1) == [{"condition": "b < 1", "direction": "short", "holding": 3}]
    with pytest.raises(ValueError):
        outputs.read_gate(spark, write(tmp_path / "bad.csv", "condition,direction\na,b\n"))
    outputs.write_gate(edges.limit(0), str(tmp_path / "none"))
    assert outputs.read_gate(spark, str(tmp_path / "none")) is None
    tests = edges.select("cond_id", "symbol", "condition", "direction", F.col("best_horizon").alias("holding"), "n_trades", F.col("expectancy_r").alias("test_exp"), "profit_factor", F.col("gate_passed").alias("test_passed"), F.concat(F.lit("run_1/window_"), "cond_id").alias("window_label"))
    outputs.write_test_periods(tests, str(tmp_path / "tests"))
    back = outputs.read_test_periods(spark, str(tmp_path / "tests")).collect()
    assert {(r["window_label"], r["condition"], r["n_trades"]) for r in back} == {("run_1/window_0", "a < 1", 9), ("run_1/window_1", "b < 1", 40)}
    assert runs.rank_run(spark, str(tmp_path / "ranked"), str(tmp_path / "tests"), title="T") == f"{tmp_path}/ranked/ranking.md"
    text = (tmp_path / "ranked" / "ranking.md").read_text()
    assert "# T: all windows" in text and "## T: window run_1/window_0" in text and "| a < 1 | long | 5 | 9 |" in text
    listed = spark.read.option("header", True).csv(str(tmp_path / "ranked" / "top"))
    assert listed.columns == list(outputs.RANK_COLUMNS) and listed.count() == 2
    runs.rank_run(spark, str(tmp_path / "single"), str(tmp_path / "no such"), str(tmp_path / "gate"))
    listed = spark.read.option("header", True).csv(str(tmp_path / "single" / "top"))
    assert listed.columns == list(outputs.SINGLE_COLUMNS) and {r["warnings"] for r in listed.collect()} == {"no_plateau", "low_frequency;no_plateau;gate_failed"}
    assert runs.ranked_rows(spark, str(tmp_path / "single" / "top"), "ranking", 5)[0]["condition"] == "b < 1"
    assert runs.rank_run(spark, str(tmp_path / "none2"), None, str(tmp_path / "none")) is None
    paths = outputs.write_edges(edges, str(tmp_path / "yaml"))
    assert len(paths) == 2 and "condition: a < 1" in open(paths[0]).read() + open(paths[1]).read()
    spread = outputs.expectancy_spread(edges).first()
    assert (spread["n"], spread["least"], spread["median"], spread["most"]) == (2, 0.1, 0.2, 0.3)


def test_a_store_resumes(spark, tmp_path):
    store, calls = runs.RunStore(spark, str(tmp_path / "store")), []

    def compute():
        calls.append(1)
        return spark.range(3)

    scope = store.scope("inner")
    assert scope.memo("windows", "a/b", compute).count() == 3 and scope.memo("windows", "a/b", compute).count() == 3 and calls == [1]
    assert scope.finished("windows", "a/b") and not scope.finished("windows", "c")
    store.bind(runs.fingerprint(Config(), {"bars": spark.range(5)}, symbol="X"))
    store.bind(runs.fingerprint(Config(), {"bars": spark.range(5).orderBy(F.desc("id"))}, symbol="X"))
    with pytest.raises(runs.Mismatch, match="config, table bars"):
        store.bind(runs.fingerprint(Config(alpha=0.1), {"bars": spark.range(6)}, symbol="X"))
    store.clear()
    assert not scope.finished("windows", "a/b")
