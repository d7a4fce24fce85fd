"""Backtest at opens with one or more positions, money, curves and comparison with a reference list."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fold import fold_sorted


@dataclass(frozen=True)
class Tester:
    """Prices in `point` units where named points."""

    point: float = 0.01
    digits: int = 2
    contract: float = 100.0
    lots: float = 1.0
    deposit: float = 10_000.0
    spread_points: float = 30.0
    slippage_points: float = 0.0
    commission: float = 0.0
    swap_long: float = 0.0
    swap_short: float = 0.0
    rollover_hour: int = 0
    triple_weekday: int = 2
    max_positions: int = 1
    reenter_on_exit: bool = False
    close_at_end: bool = False
    exit_offset: int = 0


def swap_nights(t_in: Column, t_out: Column, rollover_hour: int, triple_weekday: int) -> Column:
    """Weighted rollovers in (t_in, t_out]: none booked on a weekend, three on the triple weekday. Monday is 0."""
    day = F.sequence(F.to_date(t_in), F.to_date(t_out))
    instant = lambda d: d.cast("timestamp") + F.expr(f"INTERVAL {rollover_hour} HOURS")
    booked = lambda d: F.weekday(F.date_sub(d, 1) if rollover_hour == 0 else d)

    def weigh(total, d):
        inside = (instant(d) > t_in.cast("timestamp")) & (instant(d) <= t_out.cast("timestamp"))
        weight = F.when(booked(d) > 4, 0).when(booked(d) == triple_weekday, 3).otherwise(1)
        return total + F.when(inside, weight).otherwise(0)

    return F.aggregate(day, F.lit(0), weigh)


def signal_fates(signals: DataFrame, bars: DataFrame, hold: int, tester: Tester = Tester(), start: str | None = None, end: str | None = None) -> DataFrame:
    """symbol, ea_id, direction, entry_idx, exit_idx and fate of each signal that counts.

    signals: symbol, ea_id, direction, bar_idx. Entry is the bar after the signal; start and end
    (inclusive) bound entries and exits by time. fate: busy with max_positions open; taken; open_end
    (the data end before the exit; it blocks all the same, unless close_at_end takes it to the last
    bar); no_price (entry or exit has no open; it blocks nothing). A fold over an EA's signals whose
    state is its open positions' exits."""
    hold += tester.exit_offset
    if hold < 1:
        raise ValueError("hold must be 1 or more")
    inside = lambda t, ok: F.when(ok(F.col("time"), F.lit(t).cast("timestamp")) if t else F.lit(True), F.col("bar_idx"))
    range_ = bars.groupBy("symbol").agg(F.min(inside(start, lambda x, y: x >= y)).alias("lo"), F.max(inside(end, lambda x, y: x <= y)).alias("last"))
    closes = F.least(F.col("bar_idx") + hold, F.col("last")) if tester.close_at_end else F.col("bar_idx") + hold
    gone = bars.filter(F.col("open").isNull() | F.isnan(F.col("open"))).select("symbol", F.col("bar_idx").alias("gap"))
    entries = signals.select("symbol", "ea_id", "direction", (F.col("bar_idx") + 1).cast("long").alias("bar_idx")).join(range_, "symbol").filter((F.col("bar_idx") >= F.col("lo")) & (F.col("bar_idx") <= F.col("last")))
    entries = entries.withColumn("exit_idx", closes)
    entries = entries.join(gone.select("symbol", F.col("gap").alias("bar_idx"), F.lit(True).alias("_e")), ["symbol", "bar_idx"], "left")
    entries = entries.join(gone.select("symbol", F.col("gap").alias("exit_idx"), F.lit(True).alias("_x")), ["symbol", "exit_idx"], "left")
    entries = entries.select("symbol", "ea_id", "direction", "bar_idx", "exit_idx", (F.col("exit_idx") > F.col("last")).alias("over"), (F.col("_e").isNotNull() | F.col("_x").isNotNull()).alias("no_price"))
    most, reenter = tester.max_positions, tester.reenter_on_exit

    def step(open_: list[int], rows) -> tuple[list[int], dict]:
        at, out, over, bad = (rows.column(c).to_pylist() for c in ("bar_idx", "exit_idx", "over", "no_price"))
        fates = []
        for e, x, beyond, lacking in zip(at, out, over, bad):
            open_ = [y for y in open_ if y > e or (y == e and not reenter)]
            fate = "busy" if len(open_) >= most else "open_end" if beyond else "no_price" if lacking else "taken"
            if fate in ("open_end", "taken"):
                open_.append(x)
            fates.append(fate)
        return open_, {"entry_idx": at, "exit_idx": out, "fate": fates}

    return fold_sorted(entries, ("symbol", "ea_id", "direction"), "bar_idx", list, step, "entry_idx long, exit_idx long, fate string")


def signal_counts(fates: DataFrame) -> DataFrame:
    """n_signals, n_busy and n_open_end of each EA."""
    count = lambda f: F.count_if(F.col("fate") == f)
    return fates.groupBy("symbol", "ea_id").agg(F.count("*").alias("n_signals"), count("busy").alias("n_busy"), count("open_end").alias("n_open_end"))


def trades_of(fates: DataFrame, bars: DataFrame, tester: Tester = Tester()) -> DataFrame:
    """Prices and money of the signals that were taken. bars carry spread (points)."""
    taken = fates.filter("fate = 'taken'").drop("fate")
    side = lambda p: bars.select("symbol", F.col("bar_idx").alias(f"{p}_idx"), F.col("time").alias(f"{p}_time"), F.col("open").cast("double").alias(f"{p}_open"), (F.col("spread") * tester.point).alias(f"spread_{p}"))
    df = taken.join(side("entry"), ["symbol", "entry_idx"]).join(side("exit"), ["symbol", "exit_idx"])
    df = df.join(bars.select("symbol", (F.col("bar_idx") + 1).alias("entry_idx"), F.col("time").alias("signal_time")), ["symbol", "entry_idx"])
    long, slip = F.col("direction") == "long", tester.slippage_points * tester.point
    entry = F.bround(F.when(long, F.col("entry_open") + F.col("spread_entry") + slip).otherwise(F.col("entry_open") - slip), tester.digits)
    exit_ = F.bround(F.when(long, F.col("exit_open") - slip).otherwise(F.col("exit_open") + F.col("spread_exit") + slip), tester.digits)
    df = df.withColumn("entry_price", entry).withColumn("exit_price", exit_)
    df = df.withColumn("price_pnl", F.when(long, F.col("exit_price") - F.col("entry_price")).otherwise(F.col("entry_price") - F.col("exit_price")))
    df = df.withColumn("nights", swap_nights(F.col("entry_time"), F.col("exit_time"), tester.rollover_hour, tester.triple_weekday))
    swap = F.col("nights") * F.when(long, tester.swap_long).otherwise(tester.swap_short) * tester.lots
    return df.select(
        "symbol", "ea_id", "direction", "entry_idx", "exit_idx", "signal_time", "entry_time", "exit_time", "entry_price", "exit_price", "spread_entry", "spread_exit", "price_pnl",
        (F.col("price_pnl") * tester.contract * tester.lots).alias("gross"), F.lit(-2.0 * tester.commission * tester.lots).alias("commission"), swap.alias("swap"), "nights",
    ).withColumn("profit", F.col("gross") + F.col("commission") + F.col("swap"))


def backtest(signals: DataFrame, bars: DataFrame, hold: int, tester: Tester = Tester(), start: str | None = None, end: str | None = None) -> DataFrame:
    """Trades of each (symbol, ea_id): signals carry direction and bar_idx, bars carry spread (points)."""
    return trades_of(signal_fates(signals, bars, hold, tester, start, end), bars, tester)


def curves(trades: DataFrame, bars: DataFrame, tester: Tester = Tester(), start: str | None = None, end: str | None = None) -> DataFrame:
    """balance (realised at the exit bar) and equity (with open trades marked at the bar's open) by symbol, ea_id, bar_idx.

    A row for each bar of the range and each EA with trades, as the curves are asked for."""
    if start:
        bars = bars.filter(F.col("time") >= F.lit(start).cast("timestamp"))
    if end:
        bars = bars.filter(F.col("time") <= F.lit(end).cast("timestamp"))
    eas = trades.select("symbol", "ea_id").distinct()
    grid = bars.select("symbol", "bar_idx", "time").join(eas, "symbol")
    booked = trades.groupBy("symbol", "ea_id", F.col("exit_idx").alias("bar_idx")).agg(F.sum("profit").alias("booked"))
    marks = trades.filter("exit_idx > entry_idx").select("symbol", "ea_id", "direction", "entry_price", F.explode(F.sequence(F.col("entry_idx"), F.col("exit_idx") - 1)).alias("bar_idx"))
    at = bars.select("symbol", "bar_idx", F.col("open").cast("double").alias("open"), "spread")
    value = F.when(F.col("direction") == "long", F.col("open") - F.col("entry_price")).otherwise(F.col("entry_price") - F.col("open") - F.col("spread") * tester.point)
    floating = marks.join(at, ["symbol", "bar_idx"]).groupBy("symbol", "ea_id", "bar_idx").agg(F.sum(value * tester.contract * tester.lots).alias("floating"))
    df = grid.join(booked, ["symbol", "ea_id", "bar_idx"], "left").join(floating, ["symbol", "ea_id", "bar_idx"], "left")
    run = F.sum(F.coalesce("booked", F.lit(0.0))).over(Window.partitionBy("symbol", "ea_id").orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("balance", tester.deposit + run).select("symbol", "ea_id", "bar_idx", "time", "balance", (F.col("balance") + F.coalesce("floating", F.lit(0.0))).alias("equity"))


def summary(trades: DataFrame) -> DataFrame:
    """Counts, money, profit factor, means and longest streaks of each (symbol, ea_id).

    A profit of 0 is no win, ends a streak of wins and counts in one of losses, and is no gross
    loss; gross_loss and its mean are not positive."""
    keys = ["symbol", "ea_id"]
    w = Window.partitionBy(*keys).orderBy("entry_idx", "exit_idx")
    win = F.col("profit") > 0
    df = trades.withColumn("_w", win).withColumn("_g", F.row_number().over(w) - F.row_number().over(Window.partitionBy(*keys, "_w").orderBy("entry_idx", "exit_idx")))
    longest = lambda c: F.coalesce(F.max(F.when(c, F.col("k"))), F.lit(0))
    streaks = df.groupBy(*keys, "_w", "_g").agg(F.count("*").alias("k")).groupBy(*keys).agg(longest(F.col("_w")).alias("max_consec_wins"), longest(~F.col("_w")).alias("max_consec_losses"))
    lost, zero = F.col("profit") < 0, F.lit(0.0)
    gain, loss = F.sum(F.when(win, F.col("profit")).otherwise(zero)), F.sum(F.when(lost, F.col("profit")).otherwise(zero))
    of = lambda total, n: F.coalesce(total / F.nullif(n, F.lit(0)), zero)
    out = trades.groupBy(*keys).agg(
        F.count("*").alias("n_trades"), F.count_if(F.col("direction") == "long").alias("long_trades"), F.count_if(F.col("direction") == "short").alias("short_trades"),
        F.count_if(win).alias("wins"), (100 * F.avg(win.cast("double"))).alias("win_pct"), F.sum("profit").alias("net_profit"), gain.alias("gross_profit"), loss.alias("gross_loss"),
        F.when(loss < 0, gain / F.nullif(-loss, zero)).when(gain > 0, F.lit(float("inf"))).otherwise(zero).alias("profit_factor"),
        F.avg("profit").alias("expected_payoff"), F.max("profit").alias("largest_profit"), F.min("profit").alias("largest_loss"),
        of(gain, F.count_if(win)).alias("avg_profit"), of(loss, F.count_if(lost)).alias("avg_loss"),
    )
    return out.join(streaks, keys)


def drawdown(curve: DataFrame, column: str = "equity") -> DataFrame:
    """Largest fall from the running peak, in money and per cent."""
    w = Window.partitionBy("symbol", "ea_id").orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, 0)
    df = curve.withColumn("_peak", F.max(column).over(w))
    fall = F.col("_peak") - F.col(column)
    return df.groupBy("symbol", "ea_id").agg(F.max(fall).alias("max_dd"), F.max(F.coalesce(100 * fall / F.nullif(F.col("_peak"), F.lit(0.0)), F.lit(0.0))).alias("max_dd_pct"))


def full_summary(trades: DataFrame, curve: DataFrame, eas: DataFrame, tester: Tester = Tester()) -> DataFrame:
    """summary of all EAs (symbol, ea_id), those without a trade too, with deposit, drawdowns of both curves, recovery and final balance."""
    keys, zero = ["symbol", "ea_id"], F.lit(0.0)
    falls = [drawdown(curve, c).withColumnsRenamed({"max_dd": f"{c}_dd", "max_dd_pct": f"{c}_dd_pct"}) for c in ("balance", "equity")]
    final = curve.groupBy(*keys).agg(F.max_by("balance", "bar_idx").alias("final_balance"))
    out = eas.select(*keys).distinct()
    for part in (summary(trades), *falls, final):
        out = out.join(part, keys, "left")
    out = out.fillna(tester.deposit, ["final_balance"]).fillna(0)
    recovery = F.when(F.col("equity_dd") > 0, F.col("net_profit") / F.nullif(F.col("equity_dd"), zero)).otherwise(zero)
    return out.withColumns({"initial_deposit": F.lit(tester.deposit), "recovery_factor": recovery})


def compare(trades: DataFrame, reference: DataFrame, keys: tuple[str, ...] = ("symbol", "ea_id")) -> DataFrame:
    """Full outer join on the entry time with an indicator, and the differences where both sides have the trade."""
    b = reference.select(*keys, "entry_time", *[F.col(c).alias(f"ref_{c}") for c in ("exit_time", "entry_price", "exit_price")], F.lit(1).alias("_r"))
    df = trades.withColumn("_l", F.lit(1)).join(b, [*keys, "entry_time"], "full_outer")
    side = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").otherwise("both")
    return df.select(
        *keys, "entry_time", side.alias("side"),
        F.abs(F.col("entry_price") - F.col("ref_entry_price")).alias("entry_diff"),
        F.abs(F.col("exit_price") - F.col("ref_exit_price")).alias("exit_diff"),
        (F.col("exit_time") != F.col("ref_exit_time")).alias("time_differs"),
    )


def comparison(compared: DataFrame, keys: tuple[str, ...] = ("symbol", "ea_id"), tolerance: float = 1e-6) -> DataFrame:
    """Counts by side, exits at other times, and how far prices of matched trades are apart."""
    side = lambda s: F.count_if(F.col("side") == s)
    exact = lambda c: F.count_if(F.col(c) <= tolerance)
    return compared.groupBy(*keys).agg(
        F.count_if(F.col("side") != "right_only").alias("n_emulated"), F.count_if(F.col("side") != "left_only").alias("n_reference"), side("both").alias("n_matched"),
        side("left_only").alias("only_emulated"), side("right_only").alias("only_reference"), F.count_if(F.col("time_differs")).alias("exit_time_mismatches"),
        F.avg("entry_diff").alias("entry_mean_diff"), F.avg("exit_diff").alias("exit_mean_diff"), exact("entry_diff").alias("entry_exact"), exact("exit_diff").alias("exit_exact"),
    )


def decimate(curve: DataFrame, size: int, column: str = "equity") -> DataFrame:
    """First, least, greatest and last value of every `size` bars."""
    return curve.groupBy("symbol", "ea_id", F.floor(F.col("bar_idx") / size).alias("bucket")).agg(
        F.min_by(column, "bar_idx").alias("first"), F.min(column).alias("low"), F.max(column).alias("high"), F.max_by(column, "bar_idx").alias("last")
    )
