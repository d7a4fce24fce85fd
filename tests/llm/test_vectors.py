"""Embedding near-duplicates against brute force."""

import math
from collections import Counter

import numpy as np
import pytest
from tidemark.llm import embedding_dedup

from .test_dedup import roots

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def brute(rows, cosine=0.98):
    ok = [
        i for i, r in enumerate(rows)
        if r["label"] is not None and r["embedding"] and all(x is not None and math.isfinite(x) for x in r["embedding"]) and any(r["embedding"])
    ]
    links, n = [], Counter()
    u = {i: np.array(rows[i]["embedding"], float) / np.linalg.norm(np.array(rows[i]["embedding"], float)) for i in ok}
    for a in ok:
        for b in ok:
            if b < a and rows[a]["label"] == rows[b]["label"] and len(u[a]) == len(u[b]) and u[a] @ u[b] >= cosine:
                links.append((a, b))
                n.update((a, b))
    of = roots(range(len(rows)), links)
    least = {}
    for i, c in of.items():
        least[c] = min([x for x in (least.get(c), rows[i]["vec_id"]) if x is not None], default=None)
    return Counter((r["vec_id"], n[i], least[of[i]], r["vec_id"] == least[of[i]]) for i, r in enumerate(rows))


@pytest.mark.parametrize("options", [{}, {"cell": 20, "block": 16}, {"cell": 8, "most_pivots": 5, "block": 1000}])
def test_links_equal_brute_force(spark, options):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(260):
        v = rng.normal(size=8)
        for _ in range(rng.integers(1, 4)):
            rows.append((len(rows), (v + rng.normal(size=8) * 0.12).tolist(), int(rng.integers(0, 3)) if i % 9 else None))
    centre = rng.normal(size=8)
    rows += [(5000 - i, (centre + rng.normal(size=8) * 0.15).tolist(), 1) for i in range(150)]
    rows += [(6000 + i, rows[0][1], rows[5][2]) for i in range(30)]
    rows += [(1, [0.0] * 8, 1), (2, [float("nan")] + [1.0] * 7, 1), (3, None, 1), (4, [], 1), (5, [None] + [1.0] * 7, 1), (6, [float("inf")] * 8, 1), (7, [1.0, 1.0], 1), (8, [2.0, 2.0], 1), (None, [1.0, 1.0], 1), (None, [9.0], 2)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_vectors(df, **options).collect())
    assert got == brute(df.collect())


def test_no_vectors(spark):
    assert embedding_dedup.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_cells_hold_all_that_is_near():
    rng = np.random.default_rng(1)
    u = embedding_dedup._unit(rng.normal(size=(600, 6)))
    pivots = embedding_dedup.far_apart(u[:80], 12)
    radius = math.sqrt(2 - 2 * 0.9)
    home, held, _ = embedding_dedup.cells_of(u, pivots, radius)
    near = u @ u.T >= 0.9
    for a, b in zip(*np.nonzero(near)):
        assert held[b, home[a]]
    assert held.mean() < 0.9


def test_blocks_out_of_reach_do_not_meet(spark):
    """On an arc most blocks lie apart: copies stay few, and no link is lost."""
    angles = np.linspace(0, 3, 2000)
    rows = [(i, [math.cos(a), math.sin(a), 0.1], 1) for i, a in enumerate(angles)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_vectors(df, block=100).collect()}
    u = np.array([r["embedding"] for r in df.orderBy("vec_id").collect()], float)
    u /= np.sqrt((u * u).sum(axis=1, keepdims=True))
    counts = (u @ u.T >= 0.98).sum(axis=1) - 1
    assert [got[i] for i in range(2000)] == [(int(n), 0) for n in counts]
    held = spark.createDataFrame([(1, 3, 0, i, 1, True, 2 * math.sin(a / 2), b"") for i, a in enumerate(angles)], embedding_dedup.CELLS)
    copies = embedding_dedup._in_blocks(held, math.sqrt(0.04), 100).count()
    assert copies < 15 * 2000  # all pairs of 20 blocks are 39 each
