"""Trade simulation with fixed holding periods, and the cost model.

A bar's own row carries all that a trade from it needs: entry price, ATR, hour, and prices up to
a horizon by lead, or by a join on the exit bar where horizons are many.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fold import fold_sorted, greedy
from .predicates import by_bar


@dataclass(frozen=True)
class Costs:
    """spread and slippage in price units; sessions: (first hour, end hour, factor), the first match counts."""

    spread: float = 0.0
    slippage: float = 0.0
    spread_atr_mult: float | None = None
    sessions: tuple[tuple[int, int, float], ...] = ()

    def spread_at(self, atr: Column, hour: Column) -> Column:
        base = F.lit(self.spread) if self.spread_atr_mult is None else self.spread_atr_mult * atr
        return base * session_factor(hour, self.sessions)


def session_factor(hour: Column, sessions) -> Column:
    """Factor of the first session that has the hour; a start after its end wraps midnight, an equal one holds nothing."""
    out = F.lit(1.0)
    for start, end, factor in reversed(list(sessions)):
        inside = (hour >= start) & (hour < end) if start < end else ((hour >= start) | (hour < end)) if start > end else F.lit(False)
        out = F.when(inside, F.lit(float(factor))).otherwise(out)
    return out


def _sign() -> Column:
    return F.when(F.col("direction") == "short", -1).otherwise(1)


def with_prices(bars: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Add entry (next open), atr as a double (null unless finite and positive) and hours of this and the next bar."""
    w = by_bar(*keys)
    atr = F.col("atr_14").cast("double")
    hour = F.hour(F.col("time"))
    return bars.withColumns(
        {
            "entry": F.lead("open", 1).over(w).cast("double"),
            "atr": F.when((atr > 0) & (atr < float("inf")), atr),
            "hour": hour,
            "entry_hour": F.lead(hour, 1).over(w),
        }
    )


def simulate(hits: DataFrame, bars: DataFrame, costs: Costs, hold: int, clip: bool = True) -> DataFrame:
    """One trade from every trigger: entry at the next open, exit at the close `hold` bars after it, overlap allowed.

    hits: symbol, cond_id, direction, bar_idx, n, entry, atr, entry_hour (of with_prices). A trade
    that would end behind the data is cut off at its end (outcome timeout), or left out without
    clip. Needs a next bar and a valid ATR."""
    at = F.col("bar_idx") + 1 + hold
    trades = hits.filter((F.col("bar_idx") + 1 < F.col("n")) & F.col("atr").isNotNull())
    trades = trades.withColumn("exit_idx", F.least(at, F.col("n") - 1)).withColumn("outcome", F.when(at >= F.col("n"), "timeout").otherwise("exit"))
    if not clip:
        trades = trades.filter("outcome = 'exit'")
    exits = bars.select("symbol", F.col("bar_idx").alias("exit_idx"), F.col("close").cast("double").alias("exit"))
    half = (costs.spread_at(F.col("atr"), F.col("entry_hour")) + costs.slippage) / 2
    pips = _sign() * (F.col("exit") - F.col("entry")) - 2 * half
    return (
        trades.join(exits, ["symbol", "exit_idx"])
        .select("symbol", "cond_id", "direction", "bar_idx", "exit_idx", "outcome", pips.alias("pnl"), (pips / F.col("atr")).alias("r"))
    )


def trade_stats(trades: DataFrame, keys: tuple[str, ...] = ("symbol", "cond_id")) -> DataFrame:
    """Counts, rates, expectancies, profit factor (infinite without a loss) and drawdown of each condition's trades.

    The mean win is 0 without wins, the mean loss 0 without losses. The drawdown's peak starts at
    the first trade's equity."""
    w = Window.partitionBy(*keys).orderBy("bar_idx")
    equity = F.sum("pnl").over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = trades.withColumn("_e", equity)
    df = df.withColumn("_dd", F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_e"))
    won = F.col("pnl") > 0
    zero = F.lit(0.0)
    gain, loss = F.coalesce(F.sum(F.when(won, F.col("pnl"))), zero), F.coalesce(F.sum(F.when(~won, -F.col("pnl"))), zero)
    return df.groupBy(*keys).agg(
        F.count("*").alias("n_trades"),
        F.count_if(won).alias("wins"),
        F.count_if(F.col("outcome") == "timeout").alias("timeouts"),
        F.avg(won.cast("double")).alias("win_rate"),
        F.coalesce(F.avg(F.when(won, F.col("pnl"))), zero).alias("avg_win"),
        F.coalesce(F.avg(F.when(~won, F.col("pnl"))), zero).alias("avg_loss"),
        F.avg("pnl").alias("expectancy"),
        F.avg("r").alias("expectancy_r"),
        F.when(loss > 0, gain / F.nullif(loss, zero)).otherwise(F.lit(float("inf"))).alias("profit_factor"),
        F.max("_dd").alias("max_drawdown"),
    )


def horizon_scan(hits: DataFrame, bars: DataFrame, costs: Costs, first: int, last: int) -> DataFrame:
    """symbol, cond_id, horizon, n_trades, mean_r, std_r, score by horizon; trades that would end behind the data are left out.

    A bar's row has its exits of all horizons in one array, cut at the end of the data. Triggers
    meet it once, and horizons are unfolded behind the join, where they are combined at once."""
    ahead = by_bar().rowsBetween(1 + first, 1 + last)
    exits = bars.select("symbol", "bar_idx", F.collect_list(F.struct(F.col("close").cast("double").alias("exit"))).over(ahead).alias("_exits"))
    half = (costs.spread_at(F.col("atr"), F.col("entry_hour")) + costs.slippage) / 2
    r = (_sign() * (F.col("x.exit") - F.col("entry")) - 2 * half) / F.col("atr")
    needed = hits.filter(F.col("atr").isNotNull()).select("symbol", "cond_id", "direction", "bar_idx", "entry", "atr", "entry_hour")
    trades = needed.join(exits, ["symbol", "bar_idx"]).select("*", F.posexplode("_exits").alias("_k", "x"))
    out = trades.groupBy("symbol", "cond_id", (F.col("_k") + first).alias("horizon")).agg(F.count("*").alias("n_trades"), F.avg(r).alias("mean_r"), F.stddev_samp(r).alias("std_r"))
    return out.withColumn("score", F.col("mean_r") / F.nullif(F.col("std_r") / F.sqrt("n_trades"), F.lit(0.0)))


def best_horizon(scan: DataFrame) -> DataFrame:
    """The horizon with the best score, the least on a tie; conditions without a score have none."""
    return scan.filter("score IS NOT NULL").groupBy("symbol", "cond_id").agg(F.max_by("horizon", F.struct("score", -F.col("horizon"))).alias("best_horizon"))


def open_price_trades(hits: DataFrame, bars: DataFrame, costs: Costs, hold: int) -> DataFrame:
    """Entry and exit at opens: a long pays the spread of the entry bar, a short that of the exit bar, slippage at each fill.

    Trades that do not close within the data are left out."""
    if hold < 1:
        raise ValueError("hold must be 1 or more")
    at = hits.filter(F.col("atr").isNotNull()).withColumn("exit_idx", F.col("bar_idx") + 1 + hold).filter("exit_idx < n")
    exits = bars.select("symbol", F.col("bar_idx").alias("exit_idx"), F.col("open").cast("double").alias("exit"), F.hour("time").alias("exit_hour"))
    df = at.join(exits, ["symbol", "exit_idx"])
    paid = F.when(F.col("direction") == "short", costs.spread_at(F.col("atr"), F.col("exit_hour"))).otherwise(costs.spread_at(F.col("atr"), F.col("entry_hour")))
    pnl = _sign() * (F.col("exit") - F.col("entry")) - paid - costs.slippage
    return df.select("symbol", "cond_id", "direction", "bar_idx", "exit_idx", F.lit("exit").alias("outcome"), pnl.alias("pnl"), (pnl / F.col("atr")).alias("r"))


def one_at_a_time(trades: DataFrame, hold: int, reenter: bool = False, keys: tuple[str, ...] = ("symbol", "cond_id")) -> DataFrame:
    """Greedy choice of trades that never overlap: the next entry is hold (+1 unless reenter) bars after the last one at the earliest.

    A fold over each condition's entries in order, whose state is the first free bar."""
    chosen = fold_sorted(trades.select(*keys, F.col("bar_idx").cast("long").alias("bar_idx")), keys, "bar_idx", *greedy(hold + (0 if reenter else 1)), "bar_idx long")
    return trades.join(chosen, [*keys, "bar_idx"], "left_semi")


def cost_expectancy(hits: DataFrame, bars: DataFrame, horizon: int, last_horizon: int, spread_pips: float, slippage_pips: float, pip: float, atr_mult: float | None = None) -> DataFrame:
    """gross, cost and net pips a trade of each condition, and net in units of the mean ATR. hits carry entry, exit_close, atr, direction."""
    hits = hits.filter(F.col("bar_idx") < F.col("n") - last_horizon)
    w_exit = bars.select("symbol", (F.col("bar_idx") - 1 - horizon).alias("bar_idx"), F.col("close").cast("double").alias("exit"))
    mean_atr = bars.filter("atr_14 > 0").groupBy("symbol").agg(F.avg(F.col("atr_14").cast("double")).alias("mean_atr"))
    gross = _sign() * (F.col("exit") - F.col("entry")) / pip
    spread = F.lit(spread_pips) if atr_mult is None else F.coalesce(atr_mult * F.col("atr") / pip, F.lit(spread_pips))
    out = hits.join(w_exit, ["symbol", "bar_idx"]).groupBy("symbol", "cond_id").agg(
        F.count("*").alias("n_trades"), F.avg(gross).alias("gross_pips"), F.avg(spread + slippage_pips).alias("cost_pips"), F.avg(gross - (spread + slippage_pips)).alias("net_pips")
    )
    return out.join(mean_atr, "symbol").withColumn("expectancy_r", F.coalesce(F.col("net_pips") / F.nullif(F.col("mean_atr") / pip, F.lit(0.0)), F.lit(0.0)))


def cost_prefilter(costed: DataFrame, min_r: float = 0.0) -> DataFrame:
    """Add passes and reason; an expectancy that is missing or infinite does not pass."""
    finite = F.coalesce(F.abs("expectancy_r") < float("inf"), F.lit(False))
    ok = F.coalesce(finite & (F.col("expectancy_r") >= min_r), F.lit(False))
    return costed.withColumn("passes", ok).withColumn("reason", F.when(ok, "ok").when(~finite, "no expectancy").otherwise("expectancy below the minimum"))
