"""The indicator columns of an export, by the definitions of the trading terminal that writes them.

Windows of finite length are window expressions over one shuffle and sort by symbol. What depends
on its own past value is a fold over each symbol's bars in order: exponential and smoothed means,
adaptive means with the weights that windows have worked out, and the parabolic stop. The fold's
state is one value for each column, whatever the symbol's length.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fold import fold_sorted
from .predicates import by_bar

# Periods of the exported columns.
MA_PERIODS = (5, 10, 20, 50, 100, 200)
DOUBLE_PERIODS = (10, 20, 50)
RSI_PERIODS = (7, 14, 21)
STOPS = {"sar_002_02": (0.02, 0.2), "sar_001_02": (0.01, 0.2), "sar_003_02": (0.03, 0.2)}


def _ema(x: np.ndarray, alpha: float, last: float | None) -> np.ndarray:
    """y = last + alpha (x - last), from the first value on or from `last`."""
    if last is None:
        return pd.Series(x).ewm(alpha=alpha, adjust=False).mean().to_numpy()
    return pd.Series(np.concatenate([[last], x])).ewm(alpha=alpha, adjust=False).mean().to_numpy()[1:]


def _follow(x: np.ndarray, alpha: np.ndarray, last: float | None) -> np.ndarray:
    """y = last + alpha (x - last) with a weight for each row; where it is missing, y is x."""
    out = []
    for v, a in zip(x.tolist(), alpha.tolist()):
        last = v if last is None or a != a else last + a * (v - last)
        out.append(last)
    return np.array(out)


class _Mean:
    """A mean with memory, over any number of batches. smoothed: seeded with the plain mean of its first n values."""

    def __init__(self, n: int, smoothed: bool = False):
        self.n, self.smoothed = n, smoothed
        self.alpha, self.last, self.seed = 1 / n if smoothed else 2 / (n + 1), None, []

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not self.smoothed:
            out = _ema(x, self.alpha, self.last)
            self.last = out[-1] if len(out) else self.last
            return out
        head = np.empty(0)
        if self.last is None:
            take = min(len(x), self.n - len(self.seed))
            self.seed += x[:take].tolist()
            head, x = np.full(take, np.nan), x[take:]
            if len(self.seed) == self.n:
                self.last = float(np.mean(self.seed))
                head[-1] = self.last
        if not len(x):
            return head
        out = _ema(x, self.alpha, self.last)
        self.last = out[-1]
        return np.concatenate([head, out])


class _Stop:
    """The parabolic stop and reverse."""

    def __init__(self, step: float, most: float):
        self.step, self.most, self.bars = step, most, []
        self.sar = self.peak = self.rate = None
        self.long = True

    def __call__(self, high: np.ndarray, low: np.ndarray) -> list[float]:
        out = []
        for h, l in zip(high.tolist(), low.tolist()):
            if not self.bars:
                self.bars, self.rate, self.peak, self.sar = [(h, l)], self.step, h, l
                out.append(l)
                continue
            (h1, l1), (h2, l2) = self.bars[-1], self.bars[0]
            sar = self.sar + self.rate * (self.peak - self.sar)
            sar = min(sar, l1, l2) if self.long else max(sar, h1, h2)
            if self.long and l < sar or not self.long and h > sar:  # turns, at the extreme of the way so far
                self.long, sar, self.rate = not self.long, self.peak, self.step
                self.peak = h if self.long else l
            elif self.long and h > self.peak or not self.long and l < self.peak:
                self.peak, self.rate = (h if self.long else l), min(self.most, self.rate + self.step)
            self.sar = sar
            self.bars = [self.bars[-1], (h, l)]
            out.append(sar)
        return out


def _prepared(bars: DataFrame) -> DataFrame:
    """What the fold takes: movements, true range, accumulation, and the weights of adaptive means."""
    w, d = by_bar(), lambda c: F.col(c).cast("double")
    high, low, close, volume = d("high"), d("low"), d("close"), d("tick_volume")
    over = lambda n: w.rowsBetween(1 - n, 0)
    full = lambda x, n: F.when(F.col("bar_idx") >= n, x)
    prev = lambda c, n=1: F.lag(c, n).over(w)
    zero = F.lit(0.0)
    df = bars.withColumns({"_h": high, "_l": low, "_c": close, "_pc": prev(close), "_ph": prev(high), "_pl": prev(low)})
    move = F.col("_c") - F.col("_pc")
    up, down = F.greatest(F.col("_h") - F.col("_ph"), zero), F.greatest(F.col("_pl") - F.col("_l"), zero)
    tr = F.coalesce(F.greatest(F.col("_h") - F.col("_l"), F.abs(F.col("_h") - F.col("_pc")), F.abs(F.col("_l") - F.col("_pc"))), zero)
    flow = F.coalesce((2 * F.col("_c") - F.col("_l") - F.col("_h")) / F.nullif(F.col("_h") - F.col("_l"), zero), zero) * volume
    df = df.withColumns({"_move": F.coalesce(move, zero), "_tr": tr, "_dp": F.when(up > down, up).otherwise(zero), "_dm": F.when(down > up, down).otherwise(zero), "_flow": flow})
    df = df.withColumns({"ad": F.sum("_flow").over(w.rowsBetween(Window.unboundedPreceding, 0)), "obv": F.sum(F.when(F.col("bar_idx") == 0, volume).otherwise(F.signum("_move") * volume)).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    weights = {}
    for n in (14, 20):  # fractal dimension of two halves against the whole
        span = lambda a, b: F.max("_h").over(w.rowsBetween(a, b)) - F.min("_l").over(w.rowsBetween(a, b))
        halves, whole = (span(1 - n, 0) + span(1 - 2 * n, -n)) / n, span(1 - 2 * n, 0) / (2 * n)
        weights[f"_frama_{n}"] = full(F.exp(-4.6 * ((F.ln(F.nullif(halves, zero)) - F.ln(F.nullif(whole, zero))) / math.log(2) - 1)), 2 * n - 1)
    slow, fast = 2 / 31, 2 / 3
    ratio = F.coalesce(F.abs(F.col("_c") - prev("_c", 10)) / F.nullif(F.sum(F.abs("_move")).over(over(10)), zero), zero)
    weights["_ama"] = full(F.pow(ratio * (fast - slow) + slow, F.lit(2)), 10)
    for n in (9, 12):
        turn = F.abs(F.sum("_move").over(over(n))) / F.nullif(F.sum(F.abs("_move")).over(over(n)), zero)
        weights[f"_vidya_{n}"] = full(2 / 13 * F.coalesce(turn, zero), n + 12 - 1)
    return df.withColumns(weights).drop("_pc", "_ph", "_pl", "_flow")


_FOLDED = (
    [f"ma_{n}_{k}" for n in MA_PERIODS for k in ("ema", "smma")] + [f"{k}_{n}" for k in ("dema", "tema") for n in DOUBLE_PERIODS]
    + ["frama_14", "frama_20", "ama_10_2_30", "vidya_9", "vidya_12", *STOPS, "adx_14", "adxwilder_14", *[f"rsi_{n}" for n in RSI_PERIODS], "macd_12_26_9_main", "trix_14", "_ema_13", "chaikin_3_10"]
)


class _Fold:
    def __init__(self) -> None:
        self.n = 0
        self.means = {(n, s): _Mean(n, s) for n in MA_PERIODS for s in (False, True)}
        self.more: dict = {}
        self.stops = {c: _Stop(*x) for c, x in STOPS.items()}
        self.last: dict[str, float | None] = {}
        self.third: float | None = None

    def mean(self, key: tuple, n: int, x: np.ndarray, smoothed: bool = False) -> np.ndarray:
        return self.more.setdefault(key, _Mean(n, smoothed))(x)

    def skip_first(self, x: np.ndarray) -> np.ndarray:
        """A symbol's bars less its first one, which has no movement."""
        return x[1:] if not self.n else x

    def rows(self, batch: pa.RecordBatch) -> dict:
        v = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in batch.schema.names if c.startswith("_") or c == "ad"}
        close, out = v["_c"], {}
        again = lambda x: np.concatenate([[np.nan], x]) if not self.n else x
        for (n, s), m in self.means.items():
            out[f"ma_{n}_{'smma' if s else 'ema'}"] = m(close)
        for n in DOUBLE_PERIODS:
            one = out[f"ma_{n}_ema"]
            two = self.mean(("two", n), n, one)
            three = self.mean(("three", n), n, two)
            out[f"dema_{n}"], out[f"tema_{n}"] = 2 * one - two, 3 * one - 3 * two + three
        for c, weight in (("frama_14", "_frama_14"), ("frama_20", "_frama_20"), ("ama_10_2_30", "_ama"), ("vidya_9", "_vidya_9"), ("vidya_12", "_vidya_12")):
            out[c] = _follow(close, v[weight], self.last.get(c))
            self.last[c] = out[c][-1]
        for c, stop in self.stops.items():
            out[c] = stop(v["_h"], v["_l"])
        with np.errstate(divide="ignore", invalid="ignore"):
            share = lambda x, of: np.where(of != 0, 100 * x / of, 0.0)
            plus, minus = (self.mean(("adx", c), 14, share(v[c], v["_tr"])) for c in ("_dp", "_dm"))
            out["adx_14"] = self.mean(("adx",), 14, share(abs(plus - minus), plus + minus))
            tr, plus, minus = (self.mean(("wilder", c), 14, self.skip_first(v[c]), True) for c in ("_tr", "_dp", "_dm"))
            plus, minus = share(plus, tr), share(minus, tr)
            dx = share(abs(plus - minus), plus + minus)
            known = ~np.isnan(dx)
            wilder = np.full(len(dx), np.nan)
            wilder[known] = self.mean(("wilder",), 14, dx[known], True)
            out["adxwilder_14"] = again(wilder)
            move = self.skip_first(v["_move"])
            for n in RSI_PERIODS:
                gain, loss = (self.mean(("rsi", n, k), n, x, True) for k, x in (("up", np.maximum(move, 0)), ("down", np.maximum(-move, 0))))
                out[f"rsi_{n}"] = again(np.where(np.isnan(gain), np.nan, np.where(loss != 0, 100 - 100 / (1 + gain / loss), np.where(gain != 0, 100.0, 50.0))))
            one = self.mean(("trix", 1), 14, close)
            three = self.mean(("trix", 3), 14, self.mean(("trix", 2), 14, one))
            before = np.concatenate([[np.nan if self.third is None else self.third], three[:-1]])
            out["trix_14"] = (three - before) / before
            self.third = three[-1]
        out["macd_12_26_9_main"] = self.mean(("macd", 12), 12, close) - self.mean(("macd", 26), 26, close)
        out["_ema_13"] = self.mean(("power",), 13, close)
        out["chaikin_3_10"] = self.mean(("chaikin", 3), 3, v["ad"]) - self.mean(("chaikin", 10), 10, v["ad"])
        self.n += batch.num_rows
        return {c: pa.array(x, pa.float64(), from_pandas=True) for c, x in out.items()}


def export_columns(bars: DataFrame) -> DataFrame:
    """Bars (symbol, bar_idx, prices, tick_volume) with all indicator columns of an export, as floats; null until they are known.

    Of columns that bars have already, those named like an indicator are replaced."""
    w, d = by_bar(), lambda c: F.col(c).cast("double")
    over = lambda n: w.rowsBetween(1 - n, 0)
    full = lambda x, n: F.when(F.col("bar_idx") >= n, x)
    zero, col = F.lit(0.0), F.col
    ready = _prepared(bars)
    keep = [c for c in ready.columns if c != "symbol" and c not in _FOLDED]
    types = dict(ready.dtypes)

    def step(state: _Fold, batch: pa.RecordBatch) -> tuple[_Fold, dict]:
        return state, state.rows(batch) | {c: batch.column(c) for c in keep}

    df = fold_sorted(ready, ("symbol",), "bar_idx", _Fold, step, ", ".join([f"`{c}` {types[c]}" for c in keep] + [f"{c} double" for c in _FOLDED]))
    sma = lambda x, n: full(F.avg(x).over(over(n)), n - 1)
    typical, median = (col("_h") + col("_l") + col("_c")) / 3, (col("_h") + col("_l")) / 2
    df = df.withColumns({"_tp": typical, "_mid": median, "_v": d("tick_volume"), "_co": col("_c") - d("open")})
    lag = lambda c, n=1: F.lag(c, n).over(w)
    weighted = lambda c: col(c) + 2 * lag(c) + 2 * lag(c, 2) + lag(c, 3)
    df = df.withColumns({
        "_hl": col("_h") - col("_l"), "ao": sma("_mid", 5) - full(F.avg("_mid").over(over(34)), 33), "_sd": full(F.stddev_pop("_c").over(over(20)), 19), "_m20": sma("_c", 20), "_m13": sma("_c", 13),
        "_tpd": col("_tp") - lag("_tp"), "_dmax": F.greatest(col("_h") - lag("_h"), zero), "_dmin": F.greatest(lag("_l") - col("_l"), zero),
    })
    made: dict[str, Column] = {}
    for n in MA_PERIODS:
        made[f"ma_{n}_sma"] = sma("_c", n)
        # A weighted mean of n bars: n times the sum of the bars less the sum of their ages times the price, by two windows.
        ages = F.sum((F.col("bar_idx") + 1) * col("_c")).over(over(n)) - (F.col("bar_idx") + 1 - n) * F.sum("_c").over(over(n))
        made[f"ma_{n}_lwma"] = full(ages / (n * (n + 1) / 2), n - 1)
    for k, slowing in ((5, 3), (14, 3)):
        df = df.withColumns({f"_n{k}": col("_c") - F.min("_l").over(over(k)), f"_d{k}": F.max("_h").over(over(k)) - F.min("_l").over(over(k))})
        num, den = F.sum(f"_n{k}").over(over(slowing)), F.sum(f"_d{k}").over(over(slowing))
        df = df.withColumn(f"stoch_{k}_3_3_k", full(F.coalesce(100 * num / F.nullif(den, zero), F.lit(100.0)), k + slowing - 2))
        made[f"stoch_{k}_3_3_d"] = full(F.avg(f"stoch_{k}_3_3_k").over(over(3)), k + slowing)
    for n in (14, 20):
        mean = F.avg("_tp").over(over(n))
        df = df.withColumns({f"_mt{n}": mean, f"_tps{n}": F.collect_list("_tp").over(over(n))})
        away = F.aggregate(f"_tps{n}", zero, lambda a, x: a + F.abs(x - col(f"_mt{n}"))) / n
        made[f"cci_{n}"] = full(F.coalesce((col("_tp") - col(f"_mt{n}")) / F.nullif(0.015 * away, zero), zero), n - 1)
        made[f"atr_{n}"] = full(F.avg("_tr").over(over(n)), n)
    span = F.max("_h").over(over(14)) - F.min("_l").over(over(14))
    gain, loss = (F.sum(F.when(c, col("_tp") * col("_v")).otherwise(zero)).over(over(14)) for c in (col("_tpd") > 0, col("_tpd") < 0))
    dmax, dmin = F.sum("_dmax").over(over(14)), F.sum("_dmin").over(over(14))
    made |= {
        "wpr_14": full(-100 * (F.max("_h").over(over(14)) - col("_c")) / F.nullif(span, zero), 13),
        "mom_10": 100 * col("_c") / lag("_c", 10), "mom_14": 100 * col("_c") / lag("_c", 14),
        "macd_12_26_9_signal": sma("macd_12_26_9_main", 9), "osma_12_26_9": col("macd_12_26_9_main") - sma("macd_12_26_9_main", 9),
        "demarker_14": full(F.coalesce(dmax / F.nullif(dmax + dmin, zero), zero), 14),
        "rvi_10": full(F.sum("_rn").over(over(10)) / F.nullif(F.sum("_rd").over(over(10)), zero), 12),
        "ac": full(col("ao") - F.avg("ao").over(over(5)), 37), "bears_13": col("_l") - col("_ema_13"), "bulls_13": col("_h") - col("_ema_13"),
        "stddev_20": col("_sd"), "envelope_20_01_upper": col("_m20") * 1.001, "envelope_20_01_lower": col("_m20") * 0.999,
        "mfi_14": full(F.coalesce(100 - 100 / (1 + gain / F.nullif(loss, zero)), F.lit(100.0)), 14), "force_13": col("_v") * (col("_m13") - lag("_m13")), "volumes": col("_v"),
    }
    for name, k in (("2", 2.0), ("15", 1.5), ("25", 2.5)):
        made |= {f"bb_20_{name}_upper": col("_m20") + k * col("_sd"), f"bb_20_{name}_middle": col("_m20"), f"bb_20_{name}_lower": col("_m20") - k * col("_sd")}
    df = df.withColumns({"_rn": weighted("_co"), "_rd": weighted("_hl")})
    folded = [c for c in (*_FOLDED, "ad", "obv", "ao", "stoch_5_3_3_k", "stoch_14_3_3_k") if not c.startswith("_")]
    made |= {c: col(c) for c in folded}
    own = [c for c in bars.columns if c not in made]
    return df.select(*own, *[x.cast("float").alias(c) for c, x in made.items()])
