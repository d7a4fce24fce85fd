"""Files that runs leave: result tables with fixed columns, YAML of edges, Markdown, charts, expert-advisor source.

What is rendered here are results, a row for each condition, as collected dicts; tables go through Spark.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.predicates import parse_condition
from ..operators.report import magic_number, markdown, to_mql
from ..sources.files import write_results

# Columns of the result files, and what they are called here.
GATE_COLUMNS = {
    "edge_id": "edge_id", "condition": "condition", "direction": "direction", "gate_passed": "gate_passed", "reasons": "reasons", "optimal_holding_bars": "best_horizon",
    "holding_bars_stable": "stable", "sim_n_trades": "n_trades", "sim_expectancy_r": "expectancy_r", "sim_expectancy_r_ci_low": "ci_low", "sim_expectancy_r_ci_high": "ci_high",
    "sim_profit_factor": "profit_factor", "sim_win_rate": "win_rate", "permutation_p_value": "permutation_p", "robust_walk_forward": "walk_forward", "uses_calendar": "uses_calendar", "uses_custom_indicators": "uses_custom",
}
TEST_COLUMNS = {
    "edge_id": "edge_id", "condition": "condition", "direction": "direction", "optimal_holding_bars": "holding", "train_expectancy_r": "train_exp", "train_sensitivity_score": "sensitivity",
    "test_n_trades": "n_trades", "test_expectancy_r": "test_exp", "test_profit_factor": "profit_factor", "test_passed": "test_passed", "uses_calendar": "uses_calendar", "uses_custom_indicators": "uses_custom",
}
RANK_COLUMNS = {
    "rank": "rank", "condition": "condition", "direction": "direction", "holding_bars": "holding", "total_trades": "n_trades", "profit_factor": "profit_factor", "test_expectancy_r": "test_exp",
    "train_expectancy_r": "train_exp", "stability": "stability", "plateau_score": "plateau", "n_neighbors": "neighbours", "windows_passed": "windows_passed", "windows_seen": "n_windows", "score": "score",
    "flags": "flags", "n_similar_removed": "similar", "warnings": "warnings",
}
SINGLE_COLUMNS = {("sim_expectancy_r" if k == "test_expectancy_r" else k): v for k, v in RANK_COLUMNS.items() if k not in ("train_expectancy_r", "stability", "windows_passed", "windows_seen")}


def _named(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """The file's columns in its order; those that df lacks are empty."""
    kinds = dict(df.dtypes)

    def value(c: str):
        if c not in kinds:
            return F.lit(None).cast("string")
        return F.size(c) if c == "similar" else F.col(c)

    return df.select(*[value(c).alias(name) for name, c in columns.items()])


def write_gate(edges: DataFrame, folder: str) -> None:
    """Gate results, those that passed first, then by expectancy."""
    df = edges if "edge_id" in edges.columns else edges.withColumn("edge_id", F.concat_ws("_", "symbol", (F.col("cond_id") + 1).cast("string")))
    write_results(_named(df, GATE_COLUMNS), folder, [F.desc("gate_passed"), F.col("sim_expectancy_r").desc_nulls_last(), F.col("edge_id")])


def write_test_periods(results: DataFrame, folder: str) -> None:
    """Test-period results, a folder for each window."""
    df = results if "edge_id" in results.columns else results.withColumn("edge_id", F.concat_ws("_", "symbol", (F.col("cond_id") + 1).cast("string")))
    _named(df.withColumn("_w", F.col("window_label")), TEST_COLUMNS | {"window_label": "_w"}).write.mode("overwrite").option("header", True).partitionBy("window_label").csv(folder)


def write_ranking(ranked: DataFrame, folder: str, single_run: bool = False) -> None:
    """The list of a ranking by place; an empty one still has its header."""
    rounded = ranked.withColumns({c: F.round(c, 2 if c == "score" else 4) for c in ("profit_factor", "test_exp", "train_exp", "stability", "plateau", "score") if c in ranked.columns})
    out = rounded.withColumn("warnings", F.array_join("warnings", ";"))
    write_results(_named(out, SINGLE_COLUMNS if single_run else RANK_COLUMNS), folder, [F.col("rank")])


def read_gate(spark: SparkSession, path: str) -> DataFrame | None:
    """Gate results by the names that the ranking reads; None for no rows, an error for a file that lacks a column."""
    raw = spark.read.options(header=True, inferSchema=True).csv(path)
    needed = ["condition", "direction", "optimal_holding_bars", "sim_n_trades", "sim_profit_factor", "sim_expectancy_r", "gate_passed"]
    if missing := [c for c in needed if c not in raw.columns]:
        raise ValueError(f"no column {', '.join(missing)} in {path}")
    if raw.isEmpty():
        return None
    names = {"optimal_holding_bars": "holding", "sim_n_trades": "n_trades", "sim_profit_factor": "profit_factor", "sim_expectancy_r": "test_exp", "gate_passed": "test_passed", "uses_custom_indicators": "uses_custom"}
    df = raw.withColumnsRenamed({k: v for k, v in names.items() if k in raw.columns})
    return _typed(df).withColumn("edge_id", F.monotonically_increasing_id())


def read_test_periods(spark: SparkSession, folder: str) -> DataFrame:
    """Test-period results of all windows below a folder by the names that the ranking reads; the label is the path below it."""
    raw = spark.read.options(header=True, recursiveFileLookup=True, pathGlobFilter="*.csv").csv(folder)
    # Below the folder: its windows' paths, without the file's own name and the folders that a writer makes of it.
    root = F.lit(folder.rstrip("/").removeprefix("file://").removeprefix("file:") + "/")
    below = F.split_part(F.col("_metadata.file_path"), root, F.lit(-1))
    label = F.regexp_replace(F.regexp_replace(below, r"/?[^/]*$", ""), r"window_label=|/?TEST_PERIOD_RESULTS[^/]*$", "")
    label = F.regexp_replace(label, "%(25)?2F", "/")  # a slash in a label, as partition folders spell it
    df = raw.withColumn("window_label", label).withColumnsRenamed({k: v for k, v in TEST_COLUMNS.items() if k in raw.columns and k != v})
    return _typed(df.drop("edge_id")).withColumn("edge_id", F.monotonically_increasing_id())


def _typed(df: DataFrame) -> DataFrame:
    kinds = {"holding": "int", "n_trades": "long", "profit_factor": "double", "test_exp": "double", "train_exp": "double", "sensitivity": "double", "test_passed": "boolean", "uses_calendar": "boolean", "uses_custom": "boolean"}
    return df.withColumns({c: F.col(c).cast("string").try_cast(t) for c, t in kinds.items() if c in df.columns})


def edge_yaml(edge: Mapping) -> str:
    """An edge (nested rows as dicts) as YAML in the order of its fields."""

    def plain(x):
        if isinstance(x, Mapping):
            return {str(k): plain(v) for k, v in x.items()}
        if isinstance(x, (list, tuple)):
            return [plain(v) for v in x]
        return x if x is None or isinstance(x, (bool, int, float, str)) else str(x)

    return yaml.safe_dump(plain(edge), sort_keys=False, allow_unicode=True)


def write_edges(edges: DataFrame, folder: str) -> list[str]:
    """A YAML file for each edge; results, not bars."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    out = []
    for r in edges.collect():
        row = r.asDict(recursive=True)
        path = Path(folder, f"{row.get('edge_id', row.get('cond_id'))}.yaml")
        path.write_text(edge_yaml(row), encoding="utf-8")
        out.append(str(path))
    return out


def expectancy_spread(stats: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """How expectancies are distributed: least, median, mean and greatest."""
    e = F.col("expectancy_r")
    return stats.groupBy(*keys).agg(F.count(e).alias("n"), F.min(e).alias("least"), F.percentile(e, 0.5).alias("median"), F.avg(e).alias("mean"), F.max(e).alias("most"))


_ACCEPTED = ["edge_id", "condition", "direction", "holding", "test_exp", "profit_factor", "n_trades"]


def window_summary(windows: Sequence[Mapping], title: str = "Walk-forward summary") -> str:
    """Markdown of windows (window_label, train, test: texts of the periods; n_candidates; accepted: rows; truncated).

    Window by window: an id counts within a window only, the condition is what names an edge."""
    rows = [{"window": w["window_label"], "train period": w["train"], "test period": w["test"], "truncated": bool(w.get("truncated")), "candidates": w["n_candidates"], "accepted": len(w["accepted"])} for w in windows]
    some = sum(bool(w["accepted"]) for w in windows)
    out = [markdown(rows, ["window", "train period", "test period", "truncated", "candidates", "accepted"], title), f"Windows: {len(windows)}, with accepted edges: {some}. Ids start anew in every window.\n"]
    for w in windows:
        note = "The test period ends with the data, before its nominal end.\n" if w.get("truncated") else ""
        out.append(markdown(list(w["accepted"]), _ACCEPTED, f"{w['window_label']}: accepted edges").replace("# ", "## ", 1) + note if w["accepted"] else f"## {w['window_label']}: accepted edges\n\nnone\n{note}")
    return "\n".join(out)


def runs_summary(runs: Sequence[Mapping]) -> str:
    """Markdown of independent sequences of windows (run_label, start_year, train_years, test_years, step_years, windows), one after the other."""
    total = sum(len(r["windows"]) for r in runs)
    out = [f"# Walk-forward runs\n\nRuns: {len(runs)}, windows: {total}\n"]
    for r in runs:
        title = f"{r['run_label']}: from {r.get('start_year') or 'the first year'}, train {r['train_years']}, test {r['test_years']}, step {r['step_years']} years"
        out.append(window_summary(r["windows"], title))
    return "\n".join(out)


def ranking_report(rows: Sequence[Mapping], title: str, single_run: bool = False) -> str:
    """Markdown of ranked rows, with what each stands for."""
    columns = ["rank", "condition", "direction", "holding", "n_trades", "profit_factor", "test_exp", *([] if single_run else ["train_exp", "stability"]), "plateau", "neighbours", *(["windows_passed"] if rows and "windows_passed" in rows[0] else []), "score", "flags", "warnings"]
    shown = [dict(r) | {"warnings": ", ".join(r.get("warnings") or []) or "-"} for r in rows]
    notes = [f"- #{r['rank']} also stands for {len(r['similar'])} similar: " + "; ".join(f"`{s}`" for s in r["similar"][:3]) + (f" (+{len(r['similar']) - 3} more)" if len(r["similar"]) > 3 else "") for r in rows if r.get("similar")]
    return markdown(shown, columns, title) + "\n".join(["", *notes, ""])


def holding_scan(rows: Sequence[Mapping], selected: int | None) -> str:
    """The horizon scan of one condition, with its choice marked."""
    return markdown([dict(r) | {"_chosen": r["horizon"] == selected} for r in sorted(rows, key=lambda r: r["horizon"])], ["horizon", "n_trades", "mean_r", "std_r", "score"], "Holding period", "_chosen")


def chart_svg(curve: Iterable[Mapping], title: str, width: int = 900, height: int = 340) -> str:
    """Balance and equity of a decimated curve (rows with balance, low, high, in order) as an SVG of two lines."""
    rows = list(curve)
    if not rows:
        return ""
    values = [v for r in rows for v in (r["balance"], r["low"], r["high"])]
    low, high = min(values), max(values)
    high = high if high > low else low + 1
    x = lambda k: 40 + (width - 60) * k / max(1, len(rows) - 1)
    y = lambda v: height - 30 - (height - 70) * (v - low) / (high - low)
    line = lambda of, colour: f'<path d="M{" L".join(f"{x(k):.1f} {y(r[of]):.1f}" for k, r in enumerate(rows))}" fill="none" stroke="{colour}"/>'
    safe = title.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    label = lambda v: f'<text x="2" y="{y(v):.0f}" font-size="10">{v:,.0f}</text>'
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"><text x="40" y="20" font-size="12">{safe}</text>{label(low)}{label(high)}{line("low", "#999")}{line("balance", "#26c")}</svg>'


def candidate_stub(edge: Mapping) -> str:
    """Comment lines that go before an edge's condition in generated source."""
    c = parse_condition(edge["condition"])
    number = lambda k, f: "-" if edge.get(k) is None else format(edge[k], f)
    verdict = "recommended" if edge.get("gate_passed") else f"not recommended ({'; '.join(edge.get('reasons') or []) or 'not judged'})"
    lines = [
        f"Condition: {edge['condition']}", f"Direction: {edge.get('direction')}", f"Holding bars: {edge.get('best_horizon')} (stable: {bool(edge.get('stable'))})", f"Strategy gate: {verdict}",
        f"Simulated: {edge.get('n_trades')} trades, expectancy {number('expectancy_r', '.4f')} R, profit factor {number('profit_factor', '.2f')}", f"Permutation test: p = {edge.get('permutation_p')}",
    ]
    if used := c.uses("cal_", "news_"):
        lines.append(f"WARNING: depends on the calendar ({', '.join(used)}), which the tester cannot read: live only")
    if used := c.uses("volregime_", "ps_"):
        lines.append(f"NOTE: reads custom indicators ({', '.join(used)})")
    return "\n".join(f"// {x}" for x in lines)


ADVISOR = """#property strict
#include <Trade/Trade.mqh>

// {name}: edge {edge_id}
// {hypothesis}

input double Lots      = 0.10;
input long   Magic     = {magic};
input int    ExitBars  = {exit_bars};  // bars from entry to exit; there is no stop and no target

CTrade   trade;
datetime last_bar = 0;

int OnInit()
{{
   trade.SetExpertMagicNumber(Magic);
   return INIT_SUCCEEDED;
}}

bool IsOwn()
{{
   return PositionGetString(POSITION_SYMBOL) == _Symbol && PositionGetInteger(POSITION_MAGIC) == Magic;
}}

int OwnPositions()
{{
   int n = 0;
   for(int i = PositionsTotal() - 1; i >= 0; i--)
      if(PositionGetTicket(i) > 0 && IsOwn())
         n++;
   return n;
}}

bool CloseDue()
{{
   bool closed = false;
   for(int i = PositionsTotal() - 1; i >= 0; i--)
   {{
      ulong ticket = PositionGetTicket(i);
      if(ticket == 0 || !IsOwn())
         continue;
      datetime opened = (datetime)PositionGetInteger(POSITION_TIME);
      if(iBarShift(_Symbol, _Period, opened) >= ExitBars)
         closed = trade.PositionClose(ticket) || closed;
   }}
   return closed;
}}

bool Signal()
{{
   return {condition};
}}

void OnTick()
{{
   datetime bar = iTime(_Symbol, _Period, 0);
   if(bar == last_bar)
      return;
   last_bar = bar;
   if(CloseDue())  // no entry on the bar of an exit
      return;
   if(OwnPositions() == 0 && Signal())
      trade.{order}(Lots, _Symbol);
}}
"""


def advisor(edge: Mapping, name: str | None = None) -> str:
    """Source of an expert advisor that trades an edge: entry on its condition, exit after its holding bars."""
    edge_id = str(edge["edge_id"])
    hold = edge.get("best_horizon") or edge.get("optimal_horizon")
    if not hold or math.isnan(hold):
        raise ValueError(f"no holding period for {edge_id}")
    return ADVISOR.format(name=name or f"EA_{edge_id}", edge_id=edge_id, hypothesis=edge.get("hypothesis", edge["condition"]), magic=magic_number(edge_id), exit_bars=int(hold), condition=to_mql(edge["condition"]), order="Sell" if edge.get("direction") == "short" else "Buy")
