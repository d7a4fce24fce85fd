"""Sequences of runs, what they leave to resume from, and the backtest that follows a run."""

from __future__ import annotations

import hashlib
import json
import logging
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import backtest, gate, rank, validate
from ..operators.predicates import parse_condition
from ..session import cut
from ..sources.files import write_results
from .outputs import chart_svg, ranking_report, read_gate, read_test_periods, write_ranking
from .research import Config, backtest_conditions, research, retrade, spread_bars

log = logging.getLogger(__name__)


class Mismatch(RuntimeError):
    """What a run was started with is not what it is resumed with."""


class RunStore:
    """Results of finished steps as Parquet below a folder that Spark can reach, by stage and key.

    A step counts as finished once its write has been committed, so that one that was cut short is
    done again; nothing of it is read."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, stage: str, key: str) -> str:
        return f"{self.root}/{stage}/{hashlib.sha1(key.encode()).hexdigest()}"

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def finished(self, stage: str, key: str) -> bool:
        return self._exists(f"{self._path(stage, key)}/_SUCCESS")

    def memo(self, stage: str, key: str, compute: Callable[[], DataFrame]) -> DataFrame:
        """The stored result of a step, or that of `compute`, which is stored first."""
        path = self._path(stage, key)
        if not self.finished(stage, key):
            compute().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def scope(self, name: str) -> RunStore:
        return RunStore(self.spark, f"{self.root}/{name}")

    def bind(self, fingerprint: Mapping) -> None:
        """Tie the store to a run's inputs: the first call keeps them, later ones must agree."""
        now = {k: json.dumps(v, sort_keys=True, default=str) for k, v in fingerprint.items()}
        rows = self.memo("inputs", "fingerprint", lambda: self.spark.createDataFrame(sorted(now.items()), "name string, value string")).collect()
        then = {r["name"]: r["value"] for r in rows}
        if changed := sorted(k for k in then.keys() | now.keys() if then.get(k) != now.get(k)):
            raise Mismatch(f"changed since the run was started: {', '.join(changed)}")

    def clear(self) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def fingerprint(config: Config, tables: Mapping[str, DataFrame] | None = None, **facts) -> dict:
    """A run's settings, and for each table its columns, rows and a sum over hashes of all of them, whatever their order."""
    out: dict = {"config": asdict(config), **facts}
    for name, df in (tables or {}).items():
        row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("s")).first()
        out[f"table {name}"] = [df.columns, row["n"], str(row["s"])]
    return out


def between(bars: DataFrame, bounds: DataFrame) -> DataFrame:
    """Bars [first, end) of each symbol in bounds (symbol, first, end), numbered anew from 0."""
    part = bars.drop("n").join(bounds, "symbol").filter((F.col("bar_idx") >= F.col("first")) & (F.col("bar_idx") < F.col("end")))
    size = part.groupBy("symbol").agg(F.count("*").alias("n"))
    return part.withColumn("bar_idx", F.col("bar_idx") - F.col("first")).drop("first", "end").join(size, "symbol")


def one_window(bars: DataFrame, bounds: DataFrame, config: Config) -> DataFrame:
    """Research on each symbol's train part and its candidates on the test part. bounds: symbol, train_start, test_start, test_end."""
    part = lambda a, b: between(bars, bounds.select("symbol", F.col(a).alias("first"), F.col(b).alias("end")))
    found = research(part("train_start", "test_start"), config)
    best = cut(gate.plateau_candidates(found.edges, config.plateau_min_sensitivity, config.top_k_per_window).select(
        "symbol", "cond_id", "condition", "direction", F.col("best_horizon").alias("holding"), F.col("expectancy_r").alias("train_exp"), "sensitivity", "uses_calendar", "uses_custom"
    ))
    return retrade(part("test_start", "test_end"), best, found.conditions, config)


def sequences(bars: DataFrame, specs: Sequence[Mapping], config: Config = Config(), store: RunStore | None = None) -> tuple[DataFrame | None, list[dict]]:
    """Independent sequences of calendar windows, one for each spec (start_year or none, train_years, test_years, step_years).

    Returns the rows of all windows, labelled run_<year>/window_<k>, and a dict for each run with its
    windows (for a summary). A spec that no window fits leaves an empty run. With a store, windows
    that are there already are not computed again."""
    rows, runs = None, []
    for spec in specs:
        label = f"run_{spec.get('start_year') or 'auto'}"
        wins = cut(validate.calendar_windows(bars, spec["train_years"], spec["test_years"], spec["step_years"], spec.get("start_year")))
        # A row for each symbol and window.
        listed = sorted(wins.collect(), key=lambda r: (r["window"], r["symbol"]))
        run = dict(spec) | {"run_label": label, "windows": []}
        runs.append(run)
        for k in sorted({r["window"] for r in listed}):
            name, own = f"{label}/window_{k:04d}", [r for r in listed if r["window"] == k]
            if any(r["test_start"] - r["train_start"] < config.wf_train_bars + config.wf_test_bars for r in own):
                raise ValueError(f"the inner windows do not fit into the train part of {name}")
            make = lambda k=k, name=name: one_window(bars, wins.filter(F.col("window") == k), config).withColumn("window_label", F.lit(name))
            part = store.memo("windows", name, make) if store else cut(make())
            rows = part if rows is None else rows.unionByName(part)
            first = own[0]
            run["windows"].append({
                "window_label": name, "train": f"{first['train_from']} .. {first['test_from']}", "test": f"{first['test_from']} .. {first['test_to']}", "truncated": any(r["truncated"] for r in own),
                "n_candidates": part.count(), "accepted": [r.asDict() | {"edge_id": r["cond_id"]} for r in part.filter("test_passed").collect()],
            })
    return rows, runs


def _there(spark: SparkSession, path: str | None) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path) if path else None
    return at is not None and at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def rank_run(spark: SparkSession, folder: str, tests: str | None = None, gated: str | None = None, title: str = "Ranking", settings: rank.Ranking = rank.Ranking()) -> str | None:
    """Rank what a run left: the test periods of its windows, else its gate's results; the list as CSV and a report in Markdown.

    Windows have a list each beside that over all of them. Returns the report's path, or None if
    there is nothing to rank."""
    windows = read_test_periods(spark, tests) if _there(spark, tests) else None
    if windows is not None and not windows.isEmpty():
        windows = cut(windows)
        top = cut(rank.rank_timeframe(windows, settings))
        write_ranking(top, f"{folder}/top")
        # sort_top_n rows at most, and as many for each window.
        parts = [ranking_report([r.asDict() for r in top.orderBy("rank").collect()], f"{title}: all windows")]
        by_window: dict[str, list] = {}
        for r in rank.rank_window(windows, settings).orderBy(rank.natural_key(F.col("window_label")), "rank").collect():
            by_window.setdefault(r["window_label"], []).append(r.asDict())
        parts += [ranking_report(rows, f"{title}: window {w}").replace("# ", "## ", 1) for w, rows in by_window.items()]
    else:
        rows = read_gate(spark, gated) if _there(spark, gated) else None
        if rows is None:
            return None
        top = cut(rank.rank_window(rows.withColumn("window_label", F.lit("run")), settings, single_run=True))
        write_ranking(top, f"{folder}/top", single_run=True)
        note = "Trades, profit factors and expectancies are those of the whole data, in sample; stability and sensitivity do not count.\n"
        parts = [ranking_report([r.asDict() for r in top.orderBy("rank").collect()], title, single_run=True) + note]
    write_text(spark, {f"{folder}/ranking.md": "\n".join(parts)})
    return f"{folder}/ranking.md"


def ranked_rows(spark: SparkSession, path: str, source: str, top: int) -> list[dict]:
    """The first conditions of a ranking's or gate's file: condition, direction, holding. Rows without one of them are passed over."""
    if source == "ranking":
        df = spark.read.options(header=True, inferSchema=True).csv(path)
        df = df.withColumnsRenamed({"holding_bars": "holding"}).orderBy("rank") if "rank" in df.columns else df
    elif source == "gate":
        df = read_gate(spark, path)
        df = df.orderBy(F.desc("test_passed"), F.col("test_exp").desc_nulls_last(), "edge_id") if df is not None else None
    else:
        raise ValueError(f"unknown source {source!r}; ranking or gate")
    if df is None or not {"condition", "direction", "holding"} <= set(df.columns):
        return []
    some = df.select("condition", "direction", F.col("holding").cast("int").alias("holding")).dropna().limit(top)  # a top-k report
    return [r.asDict() for r in some.collect()]


def missing_columns(rows: Sequence[Mapping], bars: DataFrame) -> list[str]:
    """A warning for each condition that bars cannot evaluate."""
    out = []
    for k, r in enumerate(rows, 1):
        if lacking := [c for c in parse_condition(r["condition"]).columns if c not in bars.columns]:
            out.append(f"#{k} skipped, no column {', '.join(lacking)}")
    return out


def auto_backtest(spark: SparkSession, bars: DataFrame, path: str, source: str, folder: str, tester: backtest.Tester, top: int = 20, spreads: DataFrame | None = None) -> DataFrame | None:
    """Backtest a run's best conditions into a folder (trades, curves, charts, summary); None if there are none. Bars that no condition needs are not read."""
    rows = ranked_rows(spark, path, source, top)
    for w in missing_columns(rows, bars):
        log.warning("backtest: %s", w)
    if not rows or len(missing_columns(rows, bars)) == len(rows):
        return None
    bars = spread_bars(bars, tester, spreads)
    trades = cut(backtest_conditions(bars, rows, tester)[0])
    trades.write.mode("overwrite").partitionBy("symbol", "ea_id").option("header", True).csv(f"{folder}/trades")
    curve = cut(backtest.curves(trades, bars, tester))
    points = cut(decimated(curve))
    points.write.mode("overwrite").partitionBy("symbol", "ea_id").option("header", True).csv(f"{folder}/curves")
    names = spark.createDataFrame([(k, k + 1, r["condition"], r["holding"]) for k, r in enumerate(rows)], "ea_id int, rank int, condition string, holding int")
    symbols = bars.select("symbol").distinct().crossJoin(F.broadcast(names.select("ea_id")))  # a row for each symbol and condition
    summary = cut(backtest.full_summary(trades, curve, symbols, tester).join(names, "ea_id").join(trades.select("symbol", "ea_id").distinct(), ["symbol", "ea_id"], "left_semi"))
    write_results(summary, f"{folder}/summary", [F.col("rank"), F.col("symbol")])
    by_ea: dict[tuple, list] = {}
    for r in points.orderBy("symbol", "ea_id", "bucket").collect():  # CHART_POINTS at most for each
        by_ea.setdefault((r["symbol"], r["ea_id"]), []).append(r.asDict())
    write_text(spark, {f"{folder}/charts/{s}_{e + 1:02d}.svg": chart_svg(rs, f"{s} #{e + 1} {rows[e]['condition']}") for (s, e), rs in by_ea.items()})
    return summary


#: Points of a chart at most.
CHART_POINTS = 2500


def decimated(curve: DataFrame, points: int = CHART_POINTS) -> DataFrame:
    """A curve in buckets of one size, so that peaks and troughs still show: first time, last balance, least and greatest equity."""
    size = curve.groupBy("symbol", "ea_id").agg(F.greatest(F.lit(1), F.ceil((F.max("bar_idx") - F.min("bar_idx") + 1) / points)).alias("_size"))
    bucket = F.floor(F.col("bar_idx") / F.col("_size"))
    return curve.join(size, ["symbol", "ea_id"]).groupBy("symbol", "ea_id", bucket.alias("bucket")).agg(
        F.min("time").alias("time"), F.max_by("balance", "bar_idx").alias("balance"), F.min("equity").alias("low"), F.max("equity").alias("high")
    )


def write_text(spark: SparkSession, files: Mapping[str, str]) -> None:
    """Small text files where Spark writes."""
    for path, text in files.items():
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
        out.write(bytearray(text.encode()))
        out.close()


def try_auto_backtest(*args, **kwargs) -> DataFrame | None:
    """auto_backtest as the last step of a run that is done already: its failure is reported, and fails nothing."""
    try:
        return auto_backtest(*args, **kwargs)
    except Exception:
        log.exception("the backtest step failed; the run's results stand")
        return None

