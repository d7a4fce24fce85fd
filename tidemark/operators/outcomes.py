"""Forward outcomes by horizon, and their significance.

bull(i, h): close[i+h] > open[i+1]. Horizons of a bar are one array, built by leads in one
window, so that any number of conditions is a join-free aggregation of trigger rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import adjust_p, two_sided_p, wilson, z_score
from .predicates import by_bar


def with_forward(bars: DataFrame, horizons: int, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Add fwd, an array of 0 or 1 by horizon (0 beyond the end), and valid: all horizons lie inside."""
    w = by_bar(*keys)
    entry = F.lead("open", 1).over(w)
    fwd = F.array(*[F.coalesce((F.lead("close", h).over(w) > entry).cast("int"), F.lit(0)) for h in range(1, horizons + 1)])
    return bars.withColumn("fwd", fwd).withColumn("valid", F.col("bar_idx") < F.col("n") - horizons)


def _by_horizon(df: DataFrame, keys: list[str], horizons: int) -> DataFrame:
    sums = df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(F.get("fwd", F.lit(h))).alias(f"_{h}") for h in range(horizons)])
    return sums.select(*keys, "n", F.posexplode(F.array(*[f"_{h}" for h in range(horizons)])).alias("_h", "n_bull")).select(
        *keys, (F.col("_h") + 1).alias("horizon"), "n_bull", "n", (F.col("n_bull") / F.col("n")).alias("prob_bull")
    )


def baseline(bars: DataFrame, horizons: int) -> DataFrame:
    """symbol, horizon, base_prob over all bars with whole horizons; 0.5 without any."""
    some = _by_horizon(bars.filter("valid"), ["symbol"], horizons).select("symbol", "horizon", F.col("prob_bull").alias("p"))
    every = bars.select("symbol").distinct().select("symbol", F.explode(F.sequence(F.lit(1), F.lit(horizons))).alias("horizon"))
    return every.join(some, ["symbol", "horizon"], "left").select("symbol", "horizon", F.coalesce("p", F.lit(0.5)).alias("base_prob"))


def profile(hits: DataFrame, horizons: int) -> DataFrame:
    """symbol, cond_id, horizon, n_bull, n, prob_bull. hits carry fwd and valid."""
    return _by_horizon(hits.filter("valid"), ["symbol", "cond_id"], horizons)


def significance(prof: DataFrame, base: DataFrame, alpha: float = 0.05, method: str = "fdr_bh", truncate: bool = False) -> DataFrame:
    """Two-sided tests of all conditions and horizons of a symbol, adjusted together.

    truncate: count bulls as the whole part of a single-precision share times n, which loses one
    now and then; off by default."""
    df = prof.join(base, ["symbol", "horizon"])
    k = F.floor(F.col("prob_bull").cast("float") * F.col("n").cast("float")) if truncate else F.col("n_bull")
    low, high = wilson(k, F.col("n"))
    df = df.select("*", z_score(k, F.col("n"), F.col("base_prob")).alias("z"), low.alias("ci_low"), high.alias("ci_high"))
    df = df.withColumn("p_value", two_sided_p(F.col("z"))).withColumn("effect_size", F.col("prob_bull") - F.col("base_prob"))
    df = adjust_p(df, "p_value", method=method, keys=("symbol",))
    return df.withColumn("significant", F.coalesce(F.col("p_adj") < alpha, F.lit(False)))


def optimal_horizon(sig: DataFrame) -> DataFrame:
    """Of each condition's significant horizons the one with the largest signed effect, then the narrowest interval, then the least."""
    order = F.struct("effect_size", -(F.col("ci_high") - F.col("ci_low")), -F.col("horizon"))
    return sig.filter("significant").groupBy("symbol", "cond_id").agg(F.max_by("horizon", order).alias("optimal_horizon"))


def direction(sig: DataFrame, best: DataFrame) -> DataFrame:
    """long where horizon 1's probability is at least the baseline at the optimal horizon, else short."""
    first = sig.filter("horizon = 1").select("symbol", "cond_id", "prob_bull")
    at = sig.select("symbol", "cond_id", F.col("horizon").alias("optimal_horizon"), "base_prob")
    df = best.join(first, ["symbol", "cond_id"]).join(at, ["symbol", "cond_id", "optimal_horizon"])
    return df.withColumn("direction", F.when(F.col("prob_bull") >= F.col("base_prob"), "long").otherwise("short"))
