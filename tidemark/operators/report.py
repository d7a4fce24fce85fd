"""Reports and expert-advisor source from collected results (a row for each condition)."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .predicates import Condition, parse_condition


def edge_report(sig: DataFrame) -> DataFrame:
    """One row for each condition with its horizons nested in order."""
    row = F.struct("horizon", "n", "prob_bull", "base_prob", "effect_size", "p_value", "p_adj", "ci_low", "ci_high", "significant")
    return sig.groupBy("symbol", "cond_id").agg(F.array_sort(F.collect_list(row)).alias("horizons"))


def summary_table(sig: DataFrame, best: DataFrame) -> DataFrame:
    """The row of each condition's optimal horizon, the largest effect first, those without one last."""
    at = sig.withColumnRenamed("horizon", "optimal_horizon")
    conds = sig.select("symbol", "cond_id").distinct().join(best, ["symbol", "cond_id"], "left")
    return conds.join(at, ["symbol", "cond_id", "optimal_horizon"], "left").orderBy(F.col("effect_size").desc_nulls_last(), "symbol", "cond_id")


def markdown(rows: list[dict], columns: list[str], title: str, selected: str | None = None) -> str:
    """A table; the row whose `selected` value is true is marked."""
    def show(v):
        return "-" if v is None else f"{v:.4f}" if isinstance(v, float) else "yes" if v is True else "no" if v is False else str(v)

    lines = [f"# {title}", "", "| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    for r in rows:
        lines.append("| " + " | ".join(show(r.get(c)) for c in columns) + " |" + (" <-- selected" if selected and r.get(selected) else ""))
    return "\n".join(lines) + "\n"


def to_mql(condition: Condition | str) -> str:
    """Condition text in MQL5 operators; names stay as they are, crosses become comparisons."""
    c = parse_condition(condition) if isinstance(condition, str) else condition
    ops = {"crosses_above": ">", "crosses_below": "<"}
    return " && ".join(f"({a.column} {ops.get(a.op, a.op)} {a.threshold})" for a in c.atoms)


def text_to_mql(text: str) -> str:
    return text.replace(" AND ", " && ").replace(" OR ", " || ").replace("NOT ", "!")


def magic_number(edge_id: str) -> int:
    return zlib.crc32(edge_id.encode()) % 1_000_000
