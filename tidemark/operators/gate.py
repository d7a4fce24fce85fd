"""The strategy gate and selection of candidates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Gate:
    alpha: float = 0.05
    min_trades: int = 30
    min_profit_factor: float = 1.1
    require_walk_forward: bool = True
    require_permutation: bool = True
    require_stable: bool = True
    require_positive_ci: bool = False


def strategy_gate(edges: DataFrame, g: Gate = Gate()) -> DataFrame:
    """Add gate_passed and reasons. Profit factor, expectancy and interval only count with enough trades.

    edges: significant, walk_forward, stable, permutation_p, n_trades, profit_factor, expectancy_r, ci_low."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    enough = F.coalesce(F.col("n_trades") >= g.min_trades, F.lit(False))
    checks = [(no(F.col("significant")), "not significant")]
    if g.require_walk_forward:
        checks.append((no(F.col("walk_forward")), "walk-forward inconsistent"))
    if g.require_stable:
        checks.append((no(F.col("stable")), "holding period unstable"))
    if g.require_permutation:
        checks.append((no(F.col("permutation_p") < g.alpha), "permutation test"))
    checks.append((~enough, "too few trades"))
    checks.append((enough & no(F.col("expectancy_r") > 0), "expectancy not positive"))
    checks.append((enough & no(F.col("profit_factor") >= g.min_profit_factor), "profit factor"))
    if g.require_positive_ci:
        checks.append((enough & no(F.col("ci_low") > 0), "interval not positive"))
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in checks]))
    return edges.withColumn("reasons", reasons).withColumn("gate_passed", F.size("reasons") == 0)


def plateau_candidates(gated: DataFrame, min_sensitivity: float = 0.7, top: int = 20, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The `top` best by expectancy that passed the gate on a plateau, for each window."""
    some = gated.filter(F.col("gate_passed") & (F.col("sensitivity") >= min_sensitivity))
    w = Window.partitionBy(*keys).orderBy(F.col("expectancy_r").desc_nulls_last(), "cond_id")
    return some.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= top).drop("_k")


def judge_test_period(stats: DataFrame, min_trades: int = 5, min_expectancy_r: float = 0.0) -> DataFrame:
    """Add test_passed: enough trades and an expectancy that is known and high enough."""
    ok = (F.col("n_trades") >= min_trades) & (F.col("expectancy_r") >= min_expectancy_r)
    return stats.withColumn("test_passed", F.coalesce(ok, F.lit(False)))
