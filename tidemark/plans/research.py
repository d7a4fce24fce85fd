"""Whole runs: a single run over bars, an outer walk-forward, re-trading of ranked conditions, and ranking.

Stages whose results decide what is built next (observed levels, the pool, the conditions that
survive) bring one row for each condition to the driver. Bars, triggers and each stage's result are
written to the shared folder, as later stages read them several times and plans stay small.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import asof, backtest, gate, generate, outcomes, predicates, rank, simulate, validate
from ..operators.outcomes import with_forward
from ..operators.predicates import Condition, parse_condition, triggers
from ..operators.simulate import Costs, with_prices
from ..session import cut


@dataclass(frozen=True)
class Config:
    """Settings of a run; the names of a profile file are those of the fields."""

    max_horizon: int = 20
    alpha: float = 0.05
    fdr_method: str = "fdr_bh"
    min_occurrence: int = 50
    min_freq_per_year: float = 10.0
    max_conditions: int | None = None
    include_ma_conditions: bool = False
    thresholds: dict = field(default_factory=dict)
    top_n_atomic_for_combine: int = 15
    max_corr_combine: float = 0.85
    max_atoms_per_combo: int = 2
    costs: Costs = Costs()
    pip_value: float = 0.0001
    precheck_enabled: bool = True
    min_precheck_expectancy_r: float = 0.0
    horizon_scan_min_bars: int = 1
    horizon_scan_max_bars: int | None = None
    horizon_min_stable_windows: int = 1
    wf_train_bars: int = 5000
    wf_test_bars: int = 1000
    wf_step_bars: int = 500
    param_shift_pct: float = 15.0
    holdout_pct: float = 0.15
    bootstrap_n: int = 0
    bootstrap_ci: float = 0.95
    bootstrap_random_state: int | None = None
    permutation_n: int = 500
    permutation_least_shift: float = 0.1
    permutation_random_state: int | None = None
    gate: gate.Gate = gate.Gate()
    plateau_min_sensitivity: float = 0.7
    top_k_per_window: int = 20
    test_min_trades: int = 5
    test_min_expectancy_r: float = 0.0

    @classmethod
    def load(cls, path: str) -> Config:
        """From a YAML file; unknown names are errors, costs and gate are mappings."""
        given = yaml.safe_load(Path(path).read_text()) or {}
        if unknown := set(given) - set(cls.__dataclass_fields__):
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        if "costs" in given:
            c = dict(given["costs"])
            given["costs"] = Costs(**c | {"sessions": tuple(tuple(s) for s in c.get("sessions", ()))})
        if "gate" in given:
            given["gate"] = gate.Gate(**given["gate"])
        return cls(**given)

    def check(self, n_bars: int) -> list[str]:
        """Errors are raised; what only leaves windows empty is returned as warnings."""
        for name in ("wf_train_bars", "wf_test_bars", "wf_step_bars", "max_horizon"):
            if not isinstance(getattr(self, name), int) or getattr(self, name) < 1:
                raise ValueError(f"{name} must be a whole number of 1 or more")
        return ["no inner window fits"] if self.wf_train_bars + self.wf_test_bars > n_bars else []


@dataclass
class Result:
    conditions: list[Condition]
    significance: DataFrame
    edges: DataFrame
    trades: DataFrame


def prepare(bars: DataFrame, config: Config) -> DataFrame:
    return with_prices(with_forward(bars, config.max_horizon))


def _hits(bars: DataFrame, conditions: list[Condition]) -> DataFrame:
    keep = [c for c in ("n", "fwd", "valid", "entry", "atr", "entry_hour", "regimes") if c in bars.columns]
    return triggers(bars, conditions, keep=keep)


def candidates(bars: DataFrame, config: Config) -> list[Condition]:
    """Atoms that occur often enough, and conjunctions of the best of each family."""
    importance = [c for c in bars.columns if c.startswith("news_") and c.endswith("importance")]
    atoms = generate.atoms(bars.columns, config.thresholds, generate.observed_levels(bars, importance), config.include_ma_conditions, config.max_conditions)
    if not atoms:
        return []
    single = [Condition((a,)) for a in atoms]
    hits = _hits(bars, single)
    often = predicates.frequency_filter(hits, bars, config.min_occurrence, config.min_freq_per_year).select("symbol", "cond_id")
    spark = bars.sparkSession
    families = spark.createDataFrame([(k, generate.family(a)) for k, a in enumerate(atoms)], "cond_id int, family string")
    scored = generate.screen(hits.join(often, ["symbol", "cond_id"], "left_semi"), bars).join(families, "cond_id")
    pool = generate.stratified_pool(scored, config.top_n_atomic_for_combine)
    # A row for each atom at most.
    chosen = [atoms[r["cond_id"]] for r in pool.groupBy("cond_id").agg(F.max("score").alias("s")).orderBy(F.desc("s"), "cond_id").collect()]
    corr = generate.correlations(bars, [a.column for a in chosen])
    frequent = {r["cond_id"] for r in often.select("cond_id").distinct().collect()}
    return [c for k, c in enumerate(single) if k in frequent] + generate.combine(chosen, corr, config.max_atoms_per_combo, config.max_corr_combine)


def research(bars: DataFrame, config: Config = Config(), conditions: list[Condition] | None = None) -> Result:
    """From bars (symbol, time, bar_idx, n, prices, features) to gated edges, for all symbols at once.

    edges has a row for each symbol and condition that is significant and passes the cost check."""
    bars = cut(prepare(validate.with_regimes(bars), config))
    conditions = candidates(bars, config) if conditions is None else conditions
    spark = bars.sparkSession
    if not conditions:
        raise ValueError("no conditions for these columns")
    hits = cut(_hits(bars, conditions))
    often = predicates.frequency_filter(hits, bars, config.min_occurrence, config.min_freq_per_year).select("symbol", "cond_id")
    hits_often = hits.join(often, ["symbol", "cond_id"], "left_semi")
    h = config.max_horizon
    sig = cut(outcomes.significance(outcomes.profile(hits_often, h), outcomes.baseline(bars, h), config.alpha, config.fdr_method))
    best = cut(outcomes.direction(sig, outcomes.optimal_horizon(sig)).select("symbol", "cond_id", "direction", "optimal_horizon"))
    directed = hits.join(best, ["symbol", "cond_id"])
    pips = config.costs.spread / config.pip_value, config.costs.slippage / config.pip_value
    # The check's horizon is each condition's own: conditions of one horizon are costed together.
    parts = [
        simulate.cost_expectancy(directed.filter(F.col("optimal_horizon") == x), bars, x, h, *pips, config.pip_value, config.costs.spread_atr_mult)
        for x in sorted(r[0] for r in best.select("optimal_horizon").distinct().collect())
    ]
    if config.precheck_enabled and parts:
        costed = parts[0]
        for p in parts[1:]:
            costed = costed.unionByName(p)
        ok = simulate.cost_prefilter(costed, config.min_precheck_expectancy_r).filter("passes").select("symbol", "cond_id")
        directed = directed.join(ok, ["symbol", "cond_id"], "left_semi")
    directed = cut(directed)

    # Holding period, trades, windows, regimes, shifts, rotations, holdout.
    scan = simulate.horizon_scan(directed, bars, config.costs, config.horizon_scan_min_bars, config.horizon_scan_max_bars or h)
    hold = cut(simulate.best_horizon(scan))
    holds = sorted(r[0] for r in hold.select("best_horizon").distinct().collect())
    with_hold = directed.join(hold, ["symbol", "cond_id"])
    trades = None
    for x in holds:
        part = simulate.simulate(with_hold.filter(F.col("best_horizon") == x), bars, config.costs, x)
        trades = part if trades is None else trades.unionByName(part)
    if trades is None:
        trades = simulate.simulate(directed.limit(0), bars, config.costs, 1)
    trades = cut(trades)
    wins = validate.windows(bars, config.wf_train_bars, config.wf_test_bars, config.wf_step_bars)
    edges = (
        best.join(hold, ["symbol", "cond_id"])
        .join(sig.filter("horizon = 1").select("symbol", "cond_id", "significant", "effect_size", "p_adj", "prob_bull"), ["symbol", "cond_id"])
        .join(simulate.trade_stats(trades), ["symbol", "cond_id"], "left")
        .join(validate.direction_consistency(directed, wins, h).select("symbol", "cond_id", F.col("consistent").alias("walk_forward")), ["symbol", "cond_id"], "left")
        .join(validate.holding_stability(trades, wins, config.horizon_min_stable_windows).select("symbol", "cond_id", "stable"), ["symbol", "cond_id"], "left")
        .join(validate.holdout(directed, config.holdout_pct, h), ["symbol", "cond_id"], "left")
    )
    if config.bootstrap_n > 0:
        edges = edges.join(validate.bootstrap(trades, config.bootstrap_n, config.bootstrap_ci, config.bootstrap_random_state), ["symbol", "cond_id"], "left")
    else:
        edges = edges.withColumns({c: F.lit(None).cast("double") for c in ("ci_low", "ci_high")})
    # Each symbol has a range of shifts of its own: a row for each symbol.
    shifts = {}
    for r in bars.groupBy("symbol").agg(F.max("n").alias("n")).collect():
        least = max(1, int(config.permutation_least_shift * r["n"]))
        if r["n"] > 2 * least:
            shifts[r["symbol"]] = validate.rotation_shifts(r["n"], config.permutation_n, least, config.permutation_random_state)
    rotated = validate.rotation_test(directed, bars, shifts).select("symbol", "cond_id", F.col("p_value").alias("permutation_p"))
    edges = edges.join(rotated, ["symbol", "cond_id"], "left")
    survivors = sorted(r[0] for r in best.select("cond_id").distinct().collect())
    if survivors:
        moved = validate.sensitivity(lambda cs: _hits(bars, cs), [conditions[k] for k in survivors], config.param_shift_pct, h)
        back = spark.createDataFrame(list(enumerate(survivors)), "cond_id int, _k int")
        edges = edges.join(moved.join(back, "cond_id").select("symbol", F.col("_k").alias("cond_id"), "sensitivity"), ["symbol", "cond_id"], "left")
    else:
        edges = edges.withColumn("sensitivity", F.lit(None).cast("double"))
    texts = spark.createDataFrame([(k, str(c), c.uses("cal_") != [], c.uses("news_", "ps_", "volregime_") != []) for k, c in enumerate(conditions)], "cond_id int, condition string, uses_calendar boolean, uses_custom boolean")
    return Result(conditions, sig, cut(gate.strategy_gate(edges, config.gate).join(texts, "cond_id")), trades)


def slice_bars(bars: DataFrame, first: int, end: int) -> DataFrame:
    """Bars [first, end) numbered anew from 0, as row 0 and the last bars count within a slice."""
    part = bars.filter((F.col("bar_idx") >= first) & (F.col("bar_idx") < end)).drop("n")
    size = part.groupBy("symbol").agg(F.count("*").alias("n"))
    return part.withColumn("bar_idx", F.col("bar_idx") - first).join(size, "symbol")


def walk_forward(bars: DataFrame, train: int, test: int, step: int, config: Config = Config()) -> DataFrame:
    """Research on each train slice; its plateau candidates, frozen, are traded on the test slice. One row for each."""
    if config.wf_train_bars + config.wf_test_bars > train:
        raise ValueError("the inner windows do not fit into the outer train window")
    n = bars.agg(F.max("n")).first()[0] or 0
    out = None
    for k, s in enumerate(range(0, n - train - test + 1, step)):
        whole = bars.filter(F.col("n") >= s + train + test)  # symbols that the window fits into
        found = research(slice_bars(whole, s, s + train), config)
        best = cut(gate.plateau_candidates(found.edges, config.plateau_min_sensitivity, config.top_k_per_window).select(
            "symbol", "cond_id", "condition", "direction", F.col("best_horizon").alias("holding"), F.col("expectancy_r").alias("train_exp"), "sensitivity", "uses_calendar", F.col("uses_custom")
        ))
        part = cut(retrade(slice_bars(whole, s + train, s + train + test), best, found.conditions, config).withColumn("window_label", F.lit(f"window_{k}")))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no outer window fits")
    return out


def retrade(bars: DataFrame, frozen: DataFrame, conditions: list[Condition], config: Config) -> DataFrame:
    """Frozen candidates (symbol, cond_id, direction, holding, ...) traded on other bars, with test_ results and test_passed."""
    bars = prepare(bars, config)
    rows = frozen.select("cond_id", "holding").distinct().collect()
    used = sorted({r["cond_id"] for r in rows})
    stats = None
    if used:
        spark = bars.sparkSession
        names = spark.createDataFrame(list(enumerate(used)), "_i int, cond_id int")
        hits = _hits(bars, [conditions[k] for k in used]).withColumnRenamed("cond_id", "_i").join(names, "_i").drop("_i").join(frozen.select("symbol", "cond_id", "direction", "holding"), ["symbol", "cond_id"])
        for x in sorted({r["holding"] for r in rows}):
            part = simulate.trade_stats(simulate.simulate(hits.filter(F.col("holding") == x), bars, config.costs, x))
            stats = part if stats is None else stats.unionByName(part)
    if stats is None:
        stats = simulate.trade_stats(simulate.simulate(bars.limit(0).withColumns({"cond_id": F.lit(0), "direction": F.lit("long")}), bars, config.costs, 1))
    judged = gate.judge_test_period(frozen.join(stats.select("symbol", "cond_id", "n_trades", "expectancy_r", "profit_factor"), ["symbol", "cond_id"], "left"), config.test_min_trades, config.test_min_expectancy_r)
    return judged.withColumnRenamed("expectancy_r", "test_exp")


def rank_windows(results: DataFrame, settings: rank.Ranking = rank.Ranking(), over_time: bool = False) -> DataFrame:
    """Ranked rows of window results, window by window, or of conditions over all windows of a symbol."""
    rows = results.withColumn("edge_id", F.col("cond_id"))
    if over_time:
        return rank.rank_timeframe(rows, settings, ("symbol",))
    return rank.rank_window(rows, settings, ("symbol", "window_label"))


def spread_bars(bars: DataFrame, tester: backtest.Tester, spreads: DataFrame | None = None) -> DataFrame:
    """Bars with their spread (points): their own column, else that of spreads (symbol, time, spread), else the tester's."""
    if "spread" in bars.columns:
        return bars
    known = spreads if spreads is not None else bars.sparkSession.createDataFrame([], "symbol string, time timestamp, spread double")
    return asof.align_spread(bars, known, tester.spread_points, ["symbol"])


def backtest_conditions(bars: DataFrame, rows: list[dict], tester: backtest.Tester, spreads: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Trades and summary of (condition, direction, holding) rows; those with columns that bars lack are left out."""
    known = [(k, r) for k, r in enumerate(rows) if set(parse_condition(r["condition"]).columns) <= set(bars.columns)]
    bars = spread_bars(bars, tester, spreads)
    trades = None
    for hold in sorted({r["holding"] for _, r in known}):
        some = [(k, r) for k, r in known if r["holding"] == hold]
        hits = triggers(bars, [parse_condition(r["condition"]) for _, r in some])
        names = bars.sparkSession.createDataFrame([(i, k, r["direction"]) for i, (k, r) in enumerate(some)], "cond_id int, ea_id int, direction string")
        part = backtest.backtest(hits.join(names, "cond_id").select("symbol", "ea_id", "direction", "bar_idx"), bars, hold, tester)
        trades = part if trades is None else trades.unionByName(part)
    if trades is None:
        raise ValueError("no condition can be evaluated on these bars")
    return trades, backtest.summary(trades)


def link_tester(config: Config, tester: backtest.Tester | None) -> Config:
    """Costs of the tester's settings in the simulation; without settings nothing changes."""
    if tester is None:
        return config
    return replace(config, costs=replace(config.costs, spread=tester.spread_points * tester.point, slippage=2 * tester.slippage_points * tester.point))


def find_tester(folder: str, symbol: str, timeframe: str) -> backtest.Tester:
    """Settings of <symbol>/<timeframe>.yaml, else <symbol>/_default.yaml."""
    for name in (timeframe, "_default"):
        path = Path(folder, symbol, f"{name}.yaml")
        if path.exists():
            given = yaml.safe_load(path.read_text()) or {}
            if unknown := set(given) - set(backtest.Tester.__dataclass_fields__):
                raise ValueError(f"unknown settings: {sorted(unknown)}")
            return backtest.Tester(**given)
    raise FileNotFoundError(f"no tester settings for {symbol} {timeframe}")


def write_run_info(folder: str, **facts) -> None:
    Path(folder).mkdir(parents=True, exist_ok=True)
    Path(folder, "RUN_INFO.json").write_text(json.dumps(facts, default=str, indent=1))


def list_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Facts of all runs below a folder, the newest first."""
    runs = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "RUN_INFO.json").json(folder)
    return runs.orderBy(F.desc("started_at")) if "started_at" in runs.columns else runs
