"""Conditions over bar columns, evaluated as sparse trigger sets.

A condition is a conjunction of atoms. Missing values make an atom false, except `!=`, which they
make true. An atom that compares two columns is true at a slice's first bar whatever the values.
All conditions of a run become one long table (symbol, cond_id, bar_idx): a projection builds
the array of those that hold on a bar, so bars are read once for any number of conditions.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPERATORS = ("<", ">", "<=", ">=", "==", "!=", "crosses_above", "crosses_below")
#: Conditions in a projection; more are worked on in further ones, to keep generated code small.
BATCH = 200


@dataclass(frozen=True)
class Atom:
    column: str
    op: str
    threshold: float | str

    def __str__(self) -> str:
        return f"{self.column} {self.op} {self.threshold}"


@dataclass(frozen=True)
class Condition:
    atoms: tuple[Atom, ...]

    def __str__(self) -> str:
        return " AND ".join(map(str, self.atoms))

    @property
    def columns(self) -> list[str]:
        found = [c for a in self.atoms for c in ([a.column, a.threshold] if isinstance(a.threshold, str) else [a.column])]
        return list(dict.fromkeys(found))

    def uses(self, *prefixes: str) -> list[str]:
        """Columns of the condition with one of the prefixes, e.g. of the calendar."""
        return [c for c in self.columns if c.startswith(prefixes)]


def parse_condition(text: str) -> Condition:
    """`a < 1.5 AND b > c`; a threshold that is no number names a column."""
    atoms = []
    for part in text.split(" AND "):
        words = part.split(None, 2)
        if len(words) < 3:
            raise ValueError(f"no condition: {part!r}")
        column, op, threshold = words[0], words[1], words[2].rstrip()
        try:
            atoms.append(Atom(column, op, float(threshold)))
        except ValueError:
            atoms.append(Atom(column, op, threshold))
    return Condition(tuple(atoms))


def by_bar(*keys: str) -> Window:
    return Window.partitionBy(*(keys or ("symbol",))).orderBy("bar_idx")


def atom_column(atom: Atom, columns: Sequence[str], keys: Sequence[str] = ("symbol",), first_bar_true: bool = True) -> Column:
    """A boolean without nulls. Thresholds are floats of the columns' own width.

    first_bar_true: with a column as threshold, bar 0 of the slice holds."""
    missing = [c for c in Condition((atom,)).columns if c not in columns]
    if missing:
        raise KeyError(missing[0])
    if atom.op not in OPERATORS:
        raise ValueError(f"unknown operator {atom.op!r}")
    x = F.col(atom.column)
    two = isinstance(atom.threshold, str)
    t = F.col(atom.threshold) if two else F.lit(float(atom.threshold)).cast("float")
    if atom.op.startswith("crosses"):
        w = by_bar(*keys)
        before_x, before_t = F.lag(x).over(w), F.lag(t).over(w) if two else t
        hold = (x > t) & (before_x <= before_t) if atom.op == "crosses_above" else (x < t) & (before_x >= before_t)
    else:
        hold = {"<": x < t, ">": x > t, "<=": x <= t, ">=": x >= t, "==": x == t, "!=": x != t}[atom.op]
    hold = F.coalesce(hold, F.lit(atom.op == "!="))
    return (hold | (F.col("bar_idx") == 0)) if two and first_bar_true else hold


def condition_column(condition: Condition, columns: Sequence[str], **options) -> Column:
    if not condition.atoms:
        raise ValueError("a condition needs an atom")
    return reduce(lambda a, b: a & b, [atom_column(a, columns, **options) for a in condition.atoms])


def triggers(bars: DataFrame, conditions: Sequence[Condition], keys: Sequence[str] = ("symbol",), keep: Sequence[str] = (), **options) -> DataFrame:
    """keys, cond_id (place in `conditions`), bar_idx and the columns of keep, for each bar on which a condition holds."""
    parts = []
    for start in range(0, len(conditions), BATCH):
        some = conditions[start : start + BATCH]
        held = F.array_compact(F.array(*[F.when(condition_column(c, bars.columns, keys=keys, **options), F.lit(start + k)) for k, c in enumerate(some)]))
        parts.append(bars.select(*keys, "bar_idx", *keep, held.alias("_held")).select(*keys, F.explode("_held").alias("cond_id"), "bar_idx", *keep))
    return reduce(DataFrame.unionByName, parts)


def frequency_filter(hits: DataFrame, bars: DataFrame, min_occurrence: int = 50, min_per_year: float = 10.0) -> DataFrame:
    """symbol, cond_id, n, per_year of conditions that occur often enough; the span counts whole days, and none gives frequency 0."""
    span = bars.groupBy("symbol").agg(F.floor((F.unix_timestamp(F.max("time").cast("timestamp")) - F.unix_timestamp(F.min("time").cast("timestamp"))) / 86_400).alias("days"))
    out = hits.groupBy("symbol", "cond_id").agg(F.count("*").alias("n")).join(span, "symbol")
    per_year = F.coalesce(F.try_divide(F.col("n"), F.col("days") / 365.25), F.lit(0.0))
    return out.select("symbol", "cond_id", "n", per_year.alias("per_year")).filter((F.col("n") >= min_occurrence) & (F.col("per_year") >= min_per_year))


def known_at(bars: DataFrame, delays: dict[str, int], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Move columns back to when their values were known: by the first pattern (* any characters) that a name matches."""
    w = by_bar(*keys)

    def delay(name: str) -> int:
        return next((d for p, d in delays.items() if re.fullmatch(re.escape(p).replace(r"\*", ".*"), name)), 0)

    return bars.select(*[F.lag(c, delay(c)).over(w).alias(c) if delay(c) else F.col(c) for c in bars.columns])
