"""Generators of atomic conditions, screening, and combinations."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .predicates import Atom, Condition

# Default thresholds by family.
THRESHOLDS = {
    "rsi": [30, 70], "cci": [-100, 100], "mom": [0], "stoch": [20, 80], "volregime_pctl": [20, 30, 70, 80], "volregime_ratio": [0.8, 1.0, 1.2],
    "ps_dist": [-2, -1, -0.5, 0.5, 1, 2], "ps_gap": [-1, -0.5, 0.5, 1], "ps_fill": [25, 50, 75], "calendar_minutes": [15, 30, 60, 120, 240], "calendar_surprise": [0.5, 1, 2], "news_count": [0, 1, 2],
}


def atoms(columns: Sequence[str], thresholds: dict | None = None, levels: dict[str, list[float]] | None = None, moving_averages: bool = False, most: int | None = None) -> list[Atom]:
    """Atoms for the columns at hand, family by family. levels: observed values of importance columns; constant ones give none."""
    t, out = THRESHOLDS | (thresholds or {}), []

    def both(cols, values, ops=("<", ">")):
        out.extend(Atom(c, op, float(v)) for c in cols for v in values for op in ops)

    named = lambda p: [c for c in columns if c.startswith(p)]
    only = lambda c: [c] if c in columns else []
    both(named("rsi_"), t["rsi"])
    both(named("cci_"), t["cci"])
    both(named("mom_"), t["mom"], (">",))
    both([c for c in named("stoch_") if "_k" in c], t["stoch"])
    both(only("volregime_atr_pctl"), t["volregime_pctl"])
    both(only("volregime_atr_ratio"), t["volregime_ratio"])
    both(only("volregime_regime"), [0, 1, 2], ("==",))
    both(named("ps_dist_"), t["ps_dist"])
    both(only("ps_gap_atr"), t["ps_gap"])
    both(only("ps_gap_fill_pct"), t["ps_fill"], (">",))
    both(named("cal_min_"), t["calendar_minutes"], ("<",))
    both([c for c in named("cal_") if c.endswith(("_in_bar", "_next_bar"))], [1], ("==",))
    both(only("cal_last_impact_sym"), [1, -1], ("==",))
    both(only("cal_last_surprise_absz"), t["calendar_surprise"], (">",))
    both(only("news_min_to_next") + only("news_min_since_last"), t["calendar_minutes"], ("<",))
    both(only("news_in_window"), [1], ("==",))
    both(only("news_count_next_24h"), t["news_count"], (">",))
    for c, seen in (levels or {}).items():
        if len(seen) > 1:
            both(only(c), sorted(seen), ("==",))
    both(only("news_last_surprise"), [0], (">", "<"))
    out = out[:most]
    if moving_averages:
        out += [Atom(c, op, "close") for c in named("ma_") for op in (">", "<")]
    return out[:most]


def observed_levels(bars: DataFrame, columns: Sequence[str]) -> dict[str, list[float]]:
    """Distinct values of importance columns (of which there are a few)."""
    if not columns:
        return {}
    row = bars.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in columns]).first()
    return {c: [float(x) for x in row[c]] for c in columns}


def family(atom: Atom) -> str:
    return atom.column.split("_")[0]


def screen(hits: DataFrame, bars: DataFrame) -> DataFrame:
    """symbol, cond_id, score: how far P(close[i+2] > open[i+1]) on triggers is from that of all bars, the last two left out."""
    up = lambda df: df.filter(F.col("bar_idx") < F.col("n") - 2)
    base = up(bars).groupBy("symbol").agg(F.avg(F.get("fwd", F.lit(1)).cast("double")).alias("base"))
    probs = up(hits).groupBy("symbol", "cond_id").agg(F.avg(F.get("fwd", F.lit(1)).cast("double")).alias("p"))
    return probs.join(base, "symbol").select("symbol", "cond_id", F.abs(F.col("p") - F.col("base")).alias("score"))


def stratified_pool(scored: DataFrame, top: int) -> DataFrame:
    """The best top // families (1 at least) of each family, filled up with the best of the rest. scored: symbol, cond_id, family, score."""
    w = Window.partitionBy("symbol")
    best = [F.desc("score"), F.asc("cond_id")]
    df = scored.join(scored.groupBy("symbol").agg(F.count_distinct("family").alias("_families")), "symbol")
    each = F.greatest(F.lit(1), F.floor(F.lit(top) / F.col("_families")))
    df = df.withColumn("_first", F.row_number().over(Window.partitionBy("symbol", "family").orderBy(*best)) <= each)
    df = df.withColumn("_k", F.count_if(F.col("_first")).over(w)).withColumn("_rest", F.row_number().over(Window.partitionBy("symbol", "_first").orderBy(*best)))
    return df.filter(F.col("_first") | (F.col("_rest") <= top - F.col("_k"))).select("symbol", "cond_id", "family", "score")


def correlations(bars: DataFrame, columns: Sequence[str]) -> dict[tuple[str, str], float | None]:
    """Pairwise correlation over rows that have both values, all pairs in one pass; 0 under two rows, None without variance."""
    pairs = list(combinations(dict.fromkeys(columns), 2))
    out: dict[tuple[str, str], float | None] = {}
    for k in range(0, len(pairs), 100):
        some = pairs[k : k + 100]
        aggs = []
        for i, (a, b) in enumerate(some):
            ok = F.col(a).isNotNull() & F.col(b).isNotNull()
            x, y = F.when(ok, F.col(a).cast("double")), F.when(ok, F.col(b).cast("double"))
            sx, sy = F.stddev_pop(x), F.stddev_pop(y)
            aggs.append(F.when(F.count_if(ok) < 2, F.lit(0.0)).otherwise(F.covar_pop(x, y) / F.nullif(sx * sy, F.lit(0.0))).alias(f"c{i}"))
        row = bars.agg(*aggs).first()
        out |= {p: row[f"c{i}"] for i, p in enumerate(some)}
    return out


def diverse(some: Sequence[Atom], corr: dict[tuple[str, str], float | None], most: float) -> bool:
    """All pairs from different families and not correlated beyond `most`; an undefined correlation is no bar."""
    for a, b in combinations(some, 2):
        r = corr.get((a.column, b.column), corr.get((b.column, a.column), 1.0 if a.column == b.column else 0.0))
        if family(a) == family(b) or (r is not None and abs(r) > most):
            return False
    return True


def combine(pool: Sequence[Atom], corr: dict, most_atoms: int = 2, most_corr: float = 0.85) -> list[Condition]:
    """Conjunctions of 2 to most_atoms atoms of the pool (35 at most by default settings), diverse ones only."""
    return [Condition(c) for k in range(2, most_atoms + 1) for c in combinations(pool, k) if diverse(c, corr, most_corr)]
