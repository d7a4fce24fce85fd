"""Whole runs on bars with a planted edge."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from tidemark.operators.backtest import Tester as Settings
from tidemark.operators.gate import Gate
from tidemark.operators.simulate import Costs
from tidemark.plans import outputs, research, runs

SETTINGS = dict(max_horizon=4, wf_train_bars=400, wf_test_bars=200, wf_step_bars=200, permutation_n=20, permutation_random_state=1, min_freq_per_year=1, top_n_atomic_for_combine=4, costs=Costs(0.01, 0.0), pip_value=0.01, horizon_scan_max_bars=4)


@pytest.fixture(scope="module")
def bars(spark):
    n, rng = 2400, np.random.default_rng(3)
    rsi = rng.uniform(0, 100, n).astype("f4")
    move = rng.normal(0, 0.3, n)
    move[1:] += 0.5 * (rsi[:-1] < 30)
    close = 1800 + np.cumsum(move)
    rows = [
        ("X", datetime(2020, 1, 1) + timedelta(hours=i), i, n, *map(float, (close[i] - move[i], close[i] + 0.3, close[i] - 0.3, close[i], 1.0, 10 + i % 30, rsi[i], rng.normal() * 100, rng.uniform(0, 100))))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "symbol string, time timestamp, bar_idx long, n long, open float, high float, low float, close float, atr_14 float, adx_14 float, rsi_14 float, cci_20 float, stoch_14_3_3_k float").repartition(2).persist()


def test_planted_edge_is_found(bars):
    found = research.research(bars, research.Config(**SETTINGS, gate=Gate(min_trades=10)))
    edges = {r["condition"]: r for r in found.edges.collect()}
    edge = edges["rsi_14 < 30.0"]
    assert edge["significant"] and edge["direction"] == "long" and edge["expectancy_r"] > 0.2 and edge["permutation_p"] <= 0.05 and edge["sensitivity"] is not None
    assert edge["gate_passed"] == (edge["reasons"] == [])
    with pytest.raises(ValueError):
        research.research(bars.select("symbol", "time", "bar_idx", "n", "open", "high", "low", "close", "atr_14"), research.Config(**SETTINGS))


def test_outer_windows_and_ranking(bars):
    settings = SETTINGS | dict(wf_train_bars=300, wf_test_bars=100, max_atoms_per_combo=1, plateau_min_sensitivity=-1.0)
    config = research.Config(**settings, gate=Gate(min_trades=5, require_permutation=False, require_walk_forward=False, require_stable=False))
    out = research.walk_forward(bars, 1200, 400, 800, config).persist()
    rows = out.collect()
    assert {r["window_label"] for r in rows} == {"window_0", "window_1"} and any(r["test_passed"] and r["condition"].startswith("rsi_14 <") for r in rows)
    assert research.rank_windows(out).count() >= 1 and research.rank_windows(out, over_time=True).count() >= 1
    with pytest.raises(ValueError):
        research.walk_forward(bars, 100, 50, 50, config)


def test_sequences_of_calendar_windows(bars, spark, tmp_path):
    from pyspark.sql import functions as F

    yearly = bars.withColumn("time", (F.lit(1420070400) + F.col("bar_idx") * 86400).cast("timestamp"))  # a bar a day from 2015
    settings = SETTINGS | dict(wf_train_bars=300, wf_test_bars=100, max_atoms_per_combo=1, plateau_min_sensitivity=-1.0)
    config = research.Config(**settings, gate=Gate(min_trades=5, require_permutation=False, require_walk_forward=False, require_stable=False))
    specs = [{"start_year": 2015, "train_years": 3, "test_years": 1, "step_years": 3}, {"start_year": 2040, "train_years": 3, "test_years": 1, "step_years": 1}]
    store = runs.RunStore(spark, str(tmp_path / "store"))
    rows, told = runs.sequences(yearly, specs, config, store)
    assert [r["run_label"] for r in told] == ["run_2015", "run_2040"] and told[1]["windows"] == []
    assert [(w["window_label"], w["truncated"]) for w in told[0]["windows"]] == [("run_2015/window_0000", False), ("run_2015/window_0001", True)]
    assert {r["window_label"] for r in rows.collect()} <= {"run_2015/window_0000", "run_2015/window_0001"} and rows.count() > 0
    assert store.finished("windows", "run_2015/window_0001") and "# Walk-forward runs" in outputs.runs_summary(told)
    with pytest.raises(ValueError):
        runs.sequences(yearly, [{"train_years": 1, "test_years": 1, "step_years": 1}], config)


def test_backtest_after_a_run(bars, spark, tmp_path):
    df = spark.createDataFrame([(1, "rsi_14 < 30", "long", 3), (2, "none < 1", "long", 3), (3, None, "long", 3)], "rank int, condition string, direction string, holding_bars int")
    df.coalesce(1).write.option("header", True).csv(str(tmp_path / "top"))
    out = runs.auto_backtest(spark, bars, str(tmp_path / "top"), "ranking", str(tmp_path / "bt"), Settings(spread_points=1.0)).collect()
    assert [(r["rank"], r["condition"]) for r in out] == [(1, "rsi_14 < 30")] and out[0]["n_trades"] > 50 and out[0]["equity_dd"] > 0
    assert (tmp_path / "bt" / "charts" / "X_01.svg").read_text().startswith("<svg") and spark.read.option("header", True).csv(str(tmp_path / "bt" / "curves")).count() == 2400
    assert runs.try_auto_backtest(spark, bars, str(tmp_path / "nothing"), "ranking", str(tmp_path / "b2"), Settings()) is None
    assert runs.missing_columns([{"condition": "none < 1"}], bars) == ["#1 skipped, no column none"]


def test_backtest_of_ranked_rows(bars):
    rows = [{"condition": "rsi_14 < 30", "direction": "long", "holding": 3}, {"condition": "none < 1", "direction": "long", "holding": 3}]
    trades, summary = research.backtest_conditions(bars, rows, Settings(spread_points=1.0))
    assert trades.count() > 50 and [r["ea_id"] for r in summary.collect()] == [0]


def test_settings(tmp_path, spark):
    (tmp_path / "a.yaml").write_text("max_horizon: 7\ncosts: {spread: 0.5, sessions: [[0, 7, 1.5]]}\ngate: {min_trades: 3}\n")
    config = research.Config.load(str(tmp_path / "a.yaml"))
    assert config.max_horizon == 7 and config.costs.sessions == ((0, 7, 1.5),) and config.gate.min_trades == 3
    (tmp_path / "b.yaml").write_text("what: 1\n")
    with pytest.raises(ValueError):
        research.Config.load(str(tmp_path / "b.yaml"))
    assert research.Config().check(100) == ["no inner window fits"]
    with pytest.raises(ValueError):
        research.Config(wf_step_bars=0).check(100)
    (tmp_path / "X").mkdir()
    (tmp_path / "X" / "_default.yaml").write_text("spread_points: 40\nslippage_points: 2\n")
    tester = research.find_tester(str(tmp_path), "X", "M5")
    assert research.link_tester(config, tester).costs.spread == pytest.approx(0.4) and research.link_tester(config, None) is config
    with pytest.raises(FileNotFoundError):
        research.find_tester(str(tmp_path), "Y", "M5")
    for k in (1, 2):
        research.write_run_info(str(tmp_path / "runs" / str(k)), run=k, started_at=f"2024-01-0{k}")
    assert [r["run"] for r in research.list_runs(spark, str(tmp_path / "runs")).collect()] == [2, 1]
