"""Quality rules: base checks, then a learned decision list.

Sequential covering grows one rule after the other on two thirds of the labelled rows: a rule is
a conjunction of thresholds on text statistics, each chosen for the largest gain in the share of
bad texts; it is then pruned on the other third, literal by literal from the end, for precision
there. Rules that are not precise enough end the list. The list becomes an ordered CASE
expression, so that judging a text is one projection with no Python.

The fit takes a bounded sample of labelled rows (`sample`, the smallest hashes of the label id),
whose statistics alone reach the driver. All else covers all rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Labelled rows that the fit sees at most.
SAMPLE = 4000
#: A rule stands if so many of the held-out texts that it covers are bad, and no rule is tried beyond these.
PRECISION, MAX_RULES, MAX_LITERALS = 0.97, 12, 4
#: Texts a rule has to cover in the growing part.
SUPPORT = 8
#: Candidate thresholds of a statistic: quantiles of the growing part.
QUANTILES = 32

SPACES = r"\x20\x09-\x0D"
SYMBOLS = "#*$%&|<>"
FEATURES = [
    "n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "richness", "upper_share", "digit_share", "pipe_share", "mark_share", "mean_line",
]


def statistics(df: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns of `keep` and the statistics of every row's text; a null text is the empty one.

    All are expressions over one array of words. richness, the log of the distinct words over that of
    all words, hardly falls with the length of clean texts, as the share of distinct words does. Words of repeated windows: words
    become longs, 5-word windows are compared by a hash of theirs, equal neighbours in sorted order
    give their places, and each place counts the words up to the next one, five at most. That is
    worked out only where two are equal. Characters are counted in what is left of a text without
    all that is not counted."""
    df = df.select(*keep, text_of(text_col).alias("_t")).withColumn("_w", F.array_remove(F.split("_t", f"[{SPACES}]+"), ""))
    df = df.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    n = F.size("_h")
    starts = F.when(n >= 5, F.sequence(F.lit(0), n - 5)).otherwise(F.array().cast("array<int>"))
    windows = F.transform(starts, lambda i: F.xxhash64(*[F.get("_h", i + k) for k in range(5)]))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(f"[^{SPACES}]"))
    marks = F.regexp_replace("_t", f"[^{SYMBOLS}A-Z0-9!?]+", "")
    df = df.select(*keep, "_t", "_w", windows.alias("_g"), lines.alias("_l"), marks.alias("_c"), F.size(F.array_distinct("_h")).alias("_dw"))
    df = df.withColumn("_dg", F.size(F.array_distinct("_g")))
    placed = F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), (i + 1).alias("i"))))
    df = df.withColumn("_s", F.when(F.col("_dg") < F.size("_g"), placed).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    same = F.filter(
        F.transform("_s", lambda x, k: F.when((F.get("_s", k - 1)["h"] == x["h"]) | (F.get("_s", k + 1)["h"] == x["h"]), x["i"])),
        lambda i: i.isNotNull(),
    )
    df = df.withColumn("_p", F.sort_array(same))
    covered = F.aggregate(
        F.transform("_p", lambda i, k: F.least(F.lit(5), F.coalesce(F.get("_p", k + 1) - i, F.lit(5)))), F.lit(0), lambda a, b: a + b
    )
    letters = F.greatest(F.length("_t"), F.lit(1))
    share = lambda a, b: a / F.greatest(b, F.lit(1))
    df = df.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_c", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size("_l").alias("_lines"),
        F.col("_dw"),
        share(F.regexp_count("_c", F.lit("[A-Z]")), letters).alias("upper_share"),
        share(F.regexp_count("_c", F.lit("[0-9]")), letters).alias("digit_share"),
        share(F.regexp_count("_c", F.lit("[|]")), letters).alias("pipe_share"),
        share(F.regexp_count("_c", F.lit("[!?]")), letters).alias("mark_share"),
    )
    return df.select(
        "*",
        share(F.col("word_chars"), F.col("n_words")).alias("mean_word"),
        share(F.col("n_symbols"), F.col("n_words")).alias("symbol_share"),
        share(F.col("n_dup_lines"), F.col("_lines")).alias("dup_line_share"),
        share(F.col("n_repeat_words"), F.col("n_words")).alias("repeat_share"),
        F.when(F.col("n_words") > 1, F.ln("_dw") / F.ln("n_words")).otherwise(1.0).alias("richness"),
        share(F.col("n_words"), F.col("_lines")).alias("mean_line"),
    ).drop("_lines", "_dw")


@dataclass(frozen=True)
class Rule:
    """All literals (statistic, is above, threshold) hold: the text is bad."""

    literals: tuple[tuple[str, bool, float], ...]

    def covers(self, row: dict) -> bool:
        return all((row[f] > t) == above for f, above, t in self.literals)

    def expression(self) -> Column:
        out = F.lit(True)
        for f, above, t in self.literals:
            out = out & ((F.col(f) > t) if above else (F.col(f) <= t))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{f} {'>' if above else '<='} {t:.6g}" for f, above, t in self.literals)


def _grow(rows: list[dict], features: list[str], cuts: dict[str, list[float]]) -> tuple[tuple[str, bool, float], ...]:
    """Literals are added while the information gained on what is still covered grows."""
    held, literals = rows, []
    while len(literals) < MAX_LITERALS:
        bad = sum(r["_bad"] for r in held)
        if not bad or bad == len(held):
            break
        before, best = math.log2(bad / len(held)), (1e-9, None)
        for f in features:
            for t in cuts[f]:
                over_bad = over = 0
                for r in held:
                    if r[f] > t:
                        over += 1
                        over_bad += r["_bad"]
                for above, p, n in ((True, over_bad, over), (False, bad - over_bad, len(held) - over)):
                    if n >= SUPPORT and p:
                        gain = p * (math.log2(p / n) - before)
                        if gain > best[0]:
                            best = (gain, (f, above, t))
        if best[1] is None:
            break
        f, above, t = best[1]
        nearest = min((r[f] for r in held if r[f] > t), default=t)
        best = (best[0], (f, above, (max(r[f] for r in held if r[f] <= t) + nearest) / 2))  # half way between what it parts
        literals.append(best[1])
        held = [r for r in held if Rule((best[1],)).covers(r)]
    return tuple(literals)


def learn(rows: list[dict], features: list[str] = FEATURES, precision: float = PRECISION) -> list[Rule]:
    """An ordered list of rules for bad texts from labelled statistics (`_bad` is 0 or 1)."""
    grow, prune, rules = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if i % 3 == 0], []
    cuts = {}
    for f in features:
        values = sorted(r[f] for r in grow)
        cuts[f] = sorted({values[len(values) * q // QUANTILES] for q in range(QUANTILES)} | {values[-1]}) if values else []

    def score(literals) -> tuple[float, int]:
        hit = [r["_bad"] for r in prune if Rule(literals).covers(r)]
        return (sum(hit) + 1) / (len(hit) + 2), len(hit)

    while len(rules) < MAX_RULES:
        literals = _grow(grow, features, cuts)
        if not literals:
            break
        best = max((literals[:k] for k in range(len(literals), 0, -1)), key=lambda x: score(x)[0])
        hit = [r["_bad"] for r in prune if Rule(best).covers(r)]
        inside = [r["_bad"] for r in grow if Rule(best).covers(r)]
        if sum(inside) < precision * len(inside) or sum(hit) < precision * len(hit) or not inside:
            break
        rules.append(Rule(best))
        grow = [r for r in grow if not rules[-1].covers(r)]
        prune = [r for r in prune if not rules[-1].covers(r)]
    return rules


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> list[Rule]:
    """Learn a list from at most `sample` labelled rows; without any, the list is empty."""
    chosen = (
        labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
        .dropna()
        .dropDuplicates(["_id"])
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(sample)
    )
    known = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")  # `sample` rows at most
    # Statistics have fixed size; where an id repeats, `sample` labels may meet more texts, so the bound is set again.
    rows = statistics(known, ["_id", "_y"], "_text").orderBy(F.xxhash64("_id"), "_id", *FEATURES).limit(sample).collect()
    return learn([r.asDict() | {"_bad": int(r["_y"] == 0)} for r in rows])


def apply(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add base_failed, rule (1-based place of the first rule that fits, else 0) and kept."""
    verdict = F.lit(0)
    for k, rule in reversed(list(enumerate(rules, 1))):
        verdict = F.when(rule.expression(), F.lit(k)).otherwise(verdict)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumn("rule", verdict).withColumn("kept", ~failed & (verdict == 0))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, the base statistics, base_failed, rule and kept of every row of docs.

    A null text has no words, and so fails. A null id is carried along; repeated rows are judged
    each; an empty table gives no rows; labels may be empty, then the base checks alone decide."""
    rules = fit(docs, labels, id_col=id_col, text_col=text_col)
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    out = apply(statistics(named, ["doc_id"], "_text"), rules)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", "kept")
