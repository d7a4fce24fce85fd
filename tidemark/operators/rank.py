"""Ranking of conditions over windows or a single run.

Rows: edge_id (their order), condition, direction, holding, n_trades, profit_factor, test_exp,
train_exp, sensitivity, test_passed, uses_calendar, uses_custom, and keys such as window_label.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of the score's parts, and the largest profit factor that counts.
WINDOW_WEIGHTS = {"pf": 0.25, "exp": 0.15, "freq": 0.15, "plateau": 0.25, "stab": 0.20}
TIMEFRAME_WEIGHTS = {"pf": 0.20, "exp": 0.10, "freq": 0.10, "plateau": 0.20, "stab": 0.15, "consistency": 0.25}
MOST_PF = 10.0


@dataclass(frozen=True)
class Ranking:
    """Thresholds; `of` takes them from settings named ranker_<field>."""

    min_window_trades: int = 20
    min_total_trades: int = 100
    min_windows: int = 3
    min_pf: float = 1.3
    min_sensitivity: float = 0.7
    min_plateau_score: float = 0.5
    min_neighbors: int = 1
    threshold_rel_tol: float = 0.30
    holding_abs_tol: int = 2
    holding_rel_tol: float = 0.25
    sort_top_n: int = 20
    sort_dedupe: bool = True
    drop_below_floor: bool = False

    @classmethod
    def of(cls, settings: Mapping | None) -> Ranking:
        given = {f.name: (settings or {}).get(f"ranker_{f.name}") for f in fields(cls)}
        return cls(**{k: type(getattr(cls, k))(v) for k, v in given.items() if v is not None})


def _known(c: str) -> Column:
    return F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))


def with_defaults(rows: DataFrame) -> DataFrame:
    """Columns that results may lack: flags are false, numbers missing."""
    kinds = {"uses_calendar": "boolean", "uses_custom": "boolean", "test_passed": "boolean", "sensitivity": "double", "train_exp": "double"}
    have = {c: F.col(c) if c in rows.columns else F.lit(None) for c in kinds}
    return rows.withColumns({c: F.coalesce(x, F.lit(False)) if kinds[c] == "boolean" else x.cast("double") for c, x in have.items()})


def normalise(rows: DataFrame) -> DataFrame:
    """Profit factors between 0 and 10 (infinite 10, missing 0), missing expectancies and counts 0."""
    clip = F.least(F.lit(MOST_PF), F.greatest(F.lit(0.0), F.coalesce(_known("profit_factor"), F.lit(0.0))))
    zero = {c: F.coalesce(_known(c), F.lit(0.0)) for c in ("test_exp", "train_exp")} | {c: F.coalesce(F.col(c), F.lit(0)) for c in ("n_trades", "holding")}
    return with_defaults(rows).withColumns({"profit_factor": clip, **zero})


def with_atoms(rows: DataFrame) -> DataFrame:
    """Add atoms (col, op, thr, thr_col), by name, and n_atoms. Of atoms with one column and operator the last counts."""

    def atom(part: Column) -> Column:
        words = F.split(F.trim(part), r"\s+", 3)
        whole = F.size(words) == 3
        text = F.when(whole, F.trim(F.get(words, F.lit(2)))).otherwise("")
        thr = text.try_cast("double")
        return F.struct(F.when(whole, F.get(words, F.lit(0))).otherwise(F.trim(part)).alias("col"), F.when(whole, F.get(words, F.lit(1))).otherwise("").alias("op"), thr.alias("thr"), F.when(thr.isNull(), text).alias("thr_col"))

    parsed = rows.withColumn("_a", F.transform(F.split("condition", " AND "), atom))
    later = lambda a, i: F.exists(F.slice("_a", i + 2, F.size("_a")), lambda b: (b["col"] == a["col"]) & (b["op"] == a["op"]))
    return parsed.withColumns({"atoms": F.array_sort(F.filter("_a", lambda a, i: ~later(a, i))), "n_atoms": F.size("_a")}).drop("_a")


def collapse_identical(rows: DataFrame, keys: tuple[str, ...] = ("window_label",)) -> DataFrame:
    """Of rows with equal direction, holding, trades and expectancy the one with the fewest atoms, the first on a tie; the others' texts are same_as."""
    group = Window.partitionBy(*keys, "direction", "holding", "n_trades", "test_exp")
    df = rows.withColumn("_k", F.row_number().over(group.orderBy("n_atoms", "edge_id")))
    texts = F.array_sort(F.collect_list(F.when(F.col("_k") > 1, F.struct("edge_id", "condition"))).over(group))
    return df.withColumn("same_as", F.transform(texts, lambda x: x["condition"])).filter("_k = 1").drop("_k")


def _signature() -> Column:
    return F.concat_ws("&", F.col("n_atoms").cast("string"), F.transform("atoms", lambda a: F.concat_ws(" ", a["col"], a["op"], F.coalesce(a["thr_col"], F.lit("")))))


def similar(a: str, b: str, r: Ranking) -> Column:
    """Thresholds and holding within tolerance; direction and signature are the join's keys."""
    close = lambda x, y: F.coalesce((x == y) | (F.abs(x - y) <= r.threshold_rel_tol * F.greatest(F.abs(x), F.abs(y))), F.lit(True))
    both = F.zip_with(F.col(f"{a}.atoms"), F.col(f"{b}.atoms"), lambda x, y: close(x["thr"], y["thr"]))
    ha, hb = F.col(f"{a}.holding").cast("double"), F.col(f"{b}.holding").cast("double")
    return (F.abs(ha - hb) <= F.greatest(F.lit(float(r.holding_abs_tol)), r.holding_rel_tol * F.greatest(ha, hb))) & F.forall(both, lambda x: x)


def plateau(rows: DataFrame, r: Ranking = Ranking(), keys: tuple[str, ...] = ("window_label",)) -> DataFrame:
    """Add plateau and neighbours over all rows of the pool, those without trades included.

    The share of good ones (profit factor and expectancy) among a row and its similar ones, less
    the profit factors' relative spread; 0 with too few neighbours."""
    df = rows.withColumn("_sig", _signature())
    a, b = df.alias("a"), df.select(*keys, "direction", "_sig", "edge_id", "atoms", "holding", "profit_factor", "test_exp").alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in (*keys, "direction", "_sig")]
    pairs = a.join(b, [*same, (F.col("a.edge_id") == F.col("b.edge_id")) | similar("a", "b", r)])
    pf = F.col("b.profit_factor")
    good = (pf >= r.min_pf) & (F.col("b.test_exp") > 0)
    spread = F.when(F.avg(pf) > 0, F.stddev_pop(pf) / F.nullif(F.avg(pf), F.lit(0.0))).otherwise(1.0)
    value = F.avg(good.cast("double")) * (1 - F.least(F.lit(1.0), spread))
    scored = pairs.groupBy(*[F.col(f"a.{k}") for k in keys], F.col("a.edge_id")).agg((F.count("*") - 1).alias("neighbours"), value.alias("_p"))
    return rows.join(scored, [*keys, "edge_id"]).withColumn("plateau", F.when(F.col("neighbours") >= r.min_neighbors, F.col("_p")).otherwise(0.0)).drop("_p")


def stability(train: Column, test: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.abs(test - train) / F.greatest(F.abs(test), F.abs(train), F.lit(1e-9)))


def score(rows: DataFrame, weights: dict[str, float] = WINDOW_WEIGHTS, floor: int = 20) -> DataFrame:
    """Add stability and score (0 to 100), the weighted mean of parts clamped to 0..1."""
    clamp = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    parts = {
        "pf": clamp((F.col("profit_factor") - 1) / 2),
        "exp": clamp(F.col("test_exp") / 0.5),
        "freq": clamp(F.ln(F.greatest(F.col("n_trades"), F.lit(1)) / F.lit(float(max(floor, 1)))) / F.ln(F.lit(10.0))),
        "plateau": F.col("plateau"),
        "stab": F.col("stability"),
        "consistency": F.col("consistency") if "consistency" in rows.columns else F.lit(0.0),
    }
    total = sum((w * parts[p] for p, w in weights.items()), F.lit(0.0)) / sum(weights.values())
    return rows.withColumn("stability", stability(F.col("train_exp"), F.col("test_exp"))).withColumn("score", 100 * total)


def warnings(r: Ranking, floor: int, sensitivity: bool, *more: tuple[Column, str]) -> Column:
    """Names of the checks that a row does not meet."""
    checks = [(F.col("n_trades") < floor, "low_frequency"), (F.col("profit_factor") < r.min_pf, "low_pf")]
    if sensitivity:
        checks.append((~F.coalesce(_known("sensitivity") >= r.min_sensitivity, F.lit(False)), "low_sensitivity"))
    checks.append((F.col("plateau") < r.min_plateau_score, "no_plateau"))
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in [*checks, *more]]))


def flags() -> Column:
    return F.concat_ws(",", F.when(F.col("uses_calendar"), "CAL"), F.when(F.col("uses_custom"), "CUSTOM"))


def _pool(rows: DataFrame, r: Ranking, keys: tuple[str, ...]) -> DataFrame:
    return plateau(collapse_identical(with_atoms(rows), keys), r, keys)


def _listed(ranked: DataFrame, r: Ranking, keys: tuple[str, ...]) -> DataFrame:
    out = dedupe(ranked, r, keys) if r.sort_dedupe else ranked.withColumn("similar", F.col("same_as"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "edge_id"))
    return out.withColumns({"rank": place, "flags": flags()}).filter(F.col("rank") <= r.sort_top_n)


def rank_window(rows: DataFrame, r: Ranking = Ranking(), keys: tuple[str, ...] = ("window_label",), single_run: bool = False) -> DataFrame:
    """The best rows of each window, with score, rank, warnings and similar.

    single_run: results of a run without train columns, where neither stability nor sensitivity counts."""
    pool = _pool(normalise(rows), r, keys)
    floor = r.min_window_trades
    least = floor if single_run and r.drop_below_floor else 1
    weights = {k: v for k, v in WINDOW_WEIGHTS.items() if not (single_run and k == "stab")}
    failed = (~F.col("test_passed"), "gate_failed" if single_run else "test_failed")
    ranked = score(pool.filter(F.col("n_trades") >= least), weights, floor).withColumn("warnings", warnings(r, floor, not single_run, failed))
    return _listed(ranked, r, keys)


def aggregate_windows(rows: DataFrame, r: Ranking = Ranking(), keys: tuple[str, ...] = ()) -> DataFrame:
    """One row for each condition and direction over all windows: trade-weighted means, the most frequent holding, counts of windows.

    A window is passed if its row passed with enough profit factor and trades; consistency is
    their share of all windows there are, not only of those with the condition."""
    rows = with_defaults(rows).withColumns({"n_trades": F.coalesce(F.col("n_trades"), F.lit(0)), "profit_factor": F.when(_known("profit_factor").isNotNull(), F.least(F.lit(MOST_PF), F.greatest(F.lit(0.0), F.col("profit_factor"))))})
    weight = F.col("n_trades").cast("double")

    def mean(c: str) -> Column:
        x = _known(c)
        whole = F.sum(F.when(x.isNotNull(), weight))
        return F.when(whole > 0, F.sum(x * weight) / F.nullif(whole, F.lit(0.0))).otherwise(F.avg(x)).alias(c)

    passed = F.col("test_passed") & F.coalesce(F.col("profit_factor") >= r.min_pf, F.lit(False)) & (F.col("n_trades") >= r.min_window_trades)
    total = rows.groupBy(*keys).agg(F.count_distinct("window_label").alias("n_windows_total"))
    out = rows.groupBy(*keys, "condition", "direction").agg(
        mean("profit_factor"), mean("test_exp"), mean("train_exp"), F.sum("n_trades").alias("n_trades"), F.avg(_known("sensitivity")).alias("sensitivity"), F.mode("holding", True).alias("holding"),
        F.count_distinct("window_label").alias("n_windows"), F.count_if(passed).alias("windows_passed"), F.min("edge_id").alias("edge_id"),
        F.bool_or("uses_calendar").alias("uses_calendar"), F.bool_or("uses_custom").alias("uses_custom"), F.first("test_passed").alias("test_passed"),
    )
    out = out.join(total, list(keys)) if keys else out.join(F.broadcast(total))  # one row without keys
    return normalise(out).withColumn("consistency", F.col("windows_passed") / F.greatest(F.col("n_windows_total"), F.lit(1)))


def rank_timeframe(rows: DataFrame, r: Ranking = Ranking(), keys: tuple[str, ...] = ()) -> DataFrame:
    """The best conditions over all windows, with score, rank, warnings and similar."""
    own = keys or ("_all",)
    pool = aggregate_windows(rows, r, keys)
    pool = _pool(pool if keys else pool.withColumn("_all", F.lit(1)), r, own)
    floor = r.min_total_trades
    least = floor if r.drop_below_floor else 1
    few = (F.col("windows_passed") < F.least(F.lit(r.min_windows), F.col("n_windows_total")), "few_windows")
    negative = ((F.col("test_exp") <= 0) & (F.col("profit_factor") >= r.min_pf), "non_positive_expectancy")
    ranked = score(pool.filter(F.col("n_trades") >= least), TIMEFRAME_WEIGHTS, floor).withColumn("warnings", warnings(r, floor, True, few, negative))
    return _listed(ranked, r, own).drop("_all")


def natural_key(label: Column) -> Column:
    """Sort key of labels in which runs of digits compare as numbers of any length."""
    parts = F.regexp_extract_all(label, F.lit(r"(\d+|\D+)"), F.lit(1))
    digits = lambda p: F.regexp_replace(p, r"^0+(?=\d)", "")
    number = lambda p: F.struct(F.length(digits(p)).alias("n"), digits(p).alias("s"))
    return F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), number(p)).otherwise(F.struct(F.lit(2**31 - 1).alias("n"), p.alias("s"))))


def dedupe(ranked: DataFrame, r: Ranking = Ranking(), keys: tuple[str, ...] = ("window_label",)) -> DataFrame:
    """Greedy in score order: a row stays if it is similar to none that stayed; similar lists the texts that it stands for.

    Similar rows share keys, direction and signature, which is the unit of work: a part of one
    window's results."""
    df = ranked.withColumn("_sig", _signature())
    close = lambda x, y: x == y or abs(x - y) <= r.threshold_rel_tol * max(abs(x), abs(y)) if x is not None and y is not None and x == x and y == y else True
    held = lambda a, b: abs(a - b) <= max(r.holding_abs_tol, r.holding_rel_tol * max(a, b))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "edge_id"], ascending=[False, True])
        kept: list[tuple[int, float, list, list]] = []
        for i, (hold, thrs, text) in enumerate(zip(pdf["holding"], pdf["thrs"], pdf["condition"])):
            other = next((k for k in kept if held(hold, k[1]) and all(map(close, thrs, k[2]))), None)
            if other is None:
                kept.append((i, hold, list(thrs), []))
            else:
                other[3].append(text)
        out = pdf.iloc[[k[0] for k in kept]][["edge_id", *keys]].copy()
        out["_near"] = [k[3] for k in kept]
        return out

    small = df.select(*keys, "direction", "_sig", "edge_id", "holding", "score", "condition", F.transform("atoms", lambda a: a["thr"]).alias("thrs"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in small.select("edge_id", *keys).schema) + ", _near array<string>"
    stay = small.groupBy(*keys, "direction", "_sig").applyInPandas(run, schema)
    same = F.col("same_as") if "same_as" in ranked.columns else F.array().cast("array<string>")
    return ranked.join(stay, ["edge_id", *keys]).withColumn("similar", F.concat(same, "_near")).drop("_near")


def top(ranked: DataFrame, n: int) -> DataFrame:
    return ranked.orderBy(F.desc("score"), "edge_id").limit(n)
