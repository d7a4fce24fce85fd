"""The pipeline against brute force, stage by stage, each on its own input."""

from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from tidemark.llm import packing, quality_rules

from .cases import documents, empty
from .test_dedup import near_brute, roots, run_brute, shingle_set
from .test_layout import check_packing
from .test_text import base_of

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
STAGES = dict(corpus_pipeline.STAGES)
SF = "/root/testdata/sf0.001"


def sample(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_quality_stage(spark):
    docs = sample(spark)
    out = STAGES["quality rules"](spark, docs, SF)
    assert out.columns == docs.columns
    rules = quality_rules.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    stats = {r["doc_id"]: r.asDict() for r in quality_rules.statistics(docs, ["doc_id"]).collect()}
    want = {r["doc_id"] for r in docs.collect() if not base_of(r["text"])[5] and not any(x.covers(stats[r["doc_id"]]) for x in rules)}
    assert {r["doc_id"] for r in out.collect()} == want


def test_line_stage(spark):
    line = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"a\n{line}\nb", "en", "s", 1), (2, line, "en", "s", 2), (3, f"c\n{line}", None, None, None), (4, None, "en", "s", 4), (5, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = STAGES["line dedup"](spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == [(1, f"a\n{line}\nb", "en", "s", 1), (3, "c", None, None, 1), (4, None, "en", "s", 4), (5, "", "en", "s", 0)]


def test_near_stage_leaves_one_of_each_group(spark):
    docs = sample(spark)
    out = [r["doc_id"] for r in STAGES["minhash near-dedup"](spark, docs, SF).collect()]
    assert sorted(out) == sorted(r[0] for r in near_brute(docs.collect()).elements() if r[3])
    twice = docs.limit(30).unionByName(docs.limit(30))
    assert STAGES["minhash near-dedup"](spark, twice, SF).count() == 30 - (30 - len(set(near_of(docs.limit(30).collect()))))


def test_near_stage_leaves_one_of_each_group_without_ids(spark):
    """Groups are told apart by themselves: ids may be null, or repeat over unlike texts."""
    text = lambda name: " ".join(f"{name}{k}" for k in range(60))
    rows = [(None, text(f"n{i}g")) for i in range(6)]  # six groups without any id
    rows += [(None, text("n0g") + " more"), (None, text("n1g") + " more"), (None, text("n2g")), (8, text("n3g") + " more")]
    rows += [(7, text(f"s{i}g")) for i in range(4)] + [(7, text("s0g") + " more"), (9, text("s1g") + " more"), (7, text("s2g"))]
    rows += [(5, text("lone"))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for of in (docs, documents(spark).select(*COLUMNS)):
        every = of.collect()
        groups = defaultdict(list)
        for r, g in zip(every, near_of(every)):
            groups[g if shingle_set(r["text"]) else (r["doc_id"], r["text"] or "")].append(r)
        out = STAGES["minhash near-dedup"](spark, of, SF).collect()
        assert len(out) == len(groups)
        for members in groups.values():
            least = min((r["doc_id"] is None, r["doc_id"] or 0) for r in members)
            stay = {(r["doc_id"], r["text"]) for r in members if (r["doc_id"] is None, r["doc_id"] or 0) == least}
            assert sum((r["doc_id"], r["text"]) in stay for r in out) == 1


def near_of(rows):
    sets = [shingle_set(r["text"]) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(x := sets[i] & sets[j]) >= 75 * (len(sets[i]) + len(sets[j]) - len(x))]
    return list(roots(range(len(rows)), links).values())


CLASHES = ["_id", "_none", "_key", "_at", "_at_", "_ord", "_runs", "_doc", "n_lines", "n_removed", "kept", "doc", "none", "id", "tkey", "runs", "ord", "rule"]


def clashing(docs):
    """Columns named like those that stages make, each with a value that tells its row."""
    return docs.withColumns({c: F.concat_ws("|", F.lit(c), "doc_id", F.xxhash64(F.coalesce("text", F.lit("")))) for c in CLASHES})


def left_of(name, rows):
    """(doc_id, text) that a stage leaves, by brute force; None where it takes one of several."""
    if name == "quality rules":  # no rule fits them: see the test
        return Counter((r["doc_id"], r["text"]) for r in rows if not base_of(r["text"])[5])
    docs, lines, may = run_brute(rows, 50)
    out = Counter()
    for r in rows:
        key = (2**63 - 1 if r["doc_id"] is None else r["doc_id"], r["text"] or "")
        left = [x for i, x in enumerate((r["text"] or "").split("\n")) if i not in may[key]]
        text = "\n".join(left) if may[key] else r["text"]
        if not may[key] or text.split():
            out[r["doc_id"], text] += 1
    return out


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_stand_odd_tables(spark, name, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "fit", lambda *_: [])
    odd = documents(spark).select(*COLUMNS)
    line = " ".join(f"p{i}" for i in range(60))
    more = spark.createDataFrame([(500, f"a\n{line}", None, None, None), (501, f"{line}\nb", "en", "s", 1), (502, line, "en", "s", 2), (None, line, "en", "s", 2)], odd.schema)
    for docs in (odd.unionByName(more), empty(spark).select(*COLUMNS), clashing(odd.unionByName(more))):
        rows, out = docs.collect(), STAGES[name](spark, docs, SF)
        got = out.collect()
        if name == "packing":
            assert {r["doc_id"] for r in got} == {r["doc_id"] for r in rows}
            continue
        assert out.columns == docs.columns
        if name != "minhash near-dedup":
            assert Counter((r["doc_id"], r["text"]) for r in got) == left_of(name, rows)
        else:
            groups = {g if shingle_set(r["text"]) else (r["doc_id"], r["text"] or "") for r, g in zip(rows, near_of(rows))}
            assert len(got) == len(groups)
        if "_id" in docs.columns:
            sources = Counter((r["doc_id"], *[r[c] for c in CLASHES]) for r in rows)
            assert all(sources[(r["doc_id"], *[r[c] for c in CLASHES])] for r in got)
            assert all(r[c].startswith(f"{c}|") for r in got for c in CLASHES)


def test_run(spark):
    docs = sample(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
    rows = corpus_pipeline.run(spark, SF).collect()
    assert check_packing(rows, docs.collect(), packing.CAPACITY) > 0.85
