"""Embedding near-duplicates by an exact metric range join.

On unit vectors a cosine threshold is a radius. A few vectors far from one another are pivots;
each vector's home is the cell of its nearest pivot p. A vector y within radius r of x can have
its home at q only if d(x, q) - d(x, p) <= 2 r by the triangle inequality, and, more tightly, if
x lies no farther than r behind the plane half way between p and q; x is copied to the cells q for
which both hold. So a vector's links all lie in its home cell, cells join independently, and each
link is counted once at each of its ends.

Equal vectors of one label are one class, with its number of copies. A cell that is too large for
one task is dealt into blocks by the distance to its pivot; two blocks whose distances lie farther
apart than the radius hold no link, by the triangle inequality again, and do not meet. Pairs of
blocks are joined tile by tile; a pair emits one count for each class at home and a forest of its
links, never the links themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components

COSINE = 0.98
#: Classes of the largest label for each pivot, and pivots at most (their vectors are sent to every task).
CELL, PIVOTS = 16_384, 64
#: Classes in a block of a cell, fewer where their components are more than BLOCK_VALUES.
BLOCK, BLOCK_VALUES = 8192, 1 << 20
#: Ranges of distance that a cell is dealt into at most; blocks of one range are dealt by hash.
RANGES = 64
#: Rows of a tile.
TILE = 512

CELLS = "label long, dim int, cell int, c long, w long, home boolean, dist double, vec binary"


def far_apart(vectors: np.ndarray, n: int) -> np.ndarray:
    """n of the unit vectors, each the farthest from those chosen before."""
    chosen, near = [0], vectors @ vectors[0]
    while len(chosen) < min(n, len(vectors)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, vectors @ vectors[chosen[-1]])
    return vectors[chosen]


def _unit(v: np.ndarray) -> np.ndarray:
    scaled = v / np.abs(v).max(axis=1, keepdims=True)  # no square leaves the range of doubles
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def cells_of(u: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home cell of each unit vector, the cells (a boolean row each) that hold it, and the distance to each pivot."""
    if not len(pivots):
        # One cell, whose pivot is the first axis.
        return np.zeros(len(u), np.int64), np.ones((len(u), 1), bool), np.sqrt(np.maximum(0, 2 - 2 * u[:, :1]))
    dots = u @ pivots.T
    home = dots.argmax(axis=1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * (pivots @ pivots.T)))[home]
    away = np.sqrt(np.maximum(0, 2 - 2 * dots))
    best = np.arange(len(u))
    held = (away - away[best, home][:, None] <= 2 * radius + 1e-6) & (dots[best, home][:, None] - dots <= radius * apart + 1e-6)
    held[best, home] = True
    return home, held, away


def _in_cells(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, radius: float) -> Iterator[pa.RecordBatch]:
    """label, c, w, vec to a row for each cell that holds the vector. Other dimensions than the pivots' have one cell."""
    for batch in batches:
        for k in range(0, batch.num_rows, 2048):
            part = batch.slice(k, 2048)
            vecs = part.column(3)
            dims = np.diff(vecs.offsets.to_numpy())
            flat = vecs.flatten().to_numpy()
            starts = np.concatenate([[0], np.cumsum(dims)])
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                u = _unit(flat[starts[rows][:, None] + np.arange(dim)])
                home, held, away = cells_of(u, pivots if len(pivots) and pivots.shape[1] == dim else np.empty((0, dim)), radius)
                at, cell = np.nonzero(held)
                take = pa.array(rows[at])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(take),
                        pa.array(np.full(len(at), dim), pa.int32()),
                        pa.array(cell, pa.int32()),
                        part.column(1).take(take),
                        part.column(2).take(take),
                        pa.array(home[at] == cell),
                        pa.array(away[at, cell]),
                        pa.array([u[i].tobytes() for i in at.tolist()], pa.binary()),
                    ],
                    [x.split()[0] for x in CELLS.split(", ")],
                )


def join_block(c: np.ndarray, w: np.ndarray, role: np.ndarray, u: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """(classes at home, copies each is linked with, forest of links). role: 1 at home, 2 a member of the cell, 3 both."""
    homes, members = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
    of, tree, links = u[members].T, np.arange(len(members)), []
    counts = np.zeros(len(homes), np.int64)
    for k in range(0, len(homes), TILE):
        rows = homes[k : k + TILE]
        near = u[rows] @ of >= cosine
        near &= c[rows][:, None] != c[members][None, :]
        counts[k : k + TILE] = near @ w[members]
        for i in np.flatnonzero(near.any(axis=1)).tolist():
            hit = np.flatnonzero(near[i])
            groups, first = np.unique(tree[hit], return_index=True)
            links += [(int(c[rows[i]]), int(c[members[hit[j]]])) for j in first.tolist()]
            if len(groups) > 1:
                tree[np.isin(tree, groups)] = groups[0]
    return c[homes], counts, links


def _in_blocks(held: DataFrame, radius: float, block: int) -> DataFrame:
    """Rows of cells dealt into blocks and copied to each pair (x, y) of blocks that may hold a link: x the home's, y the member's."""
    key = ["label", "dim", "cell"]
    rows = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.lit(max(BLOCK_VALUES, block)) / F.greatest(F.col("dim"), F.lit(1)))))
    shares = F.percentile_approx("dist", [k / RANGES for k in range(1, RANGES)], 2000)
    cells = held.groupBy(*key).agg(F.ceil(F.count("*") / F.first(rows)).alias("m"), shares.alias("q"))
    ranges = F.least(F.lit(RANGES), F.col("m")).cast("int")
    cuts = F.when(ranges > 1, F.transform(F.sequence(F.lit(1), ranges - 1), lambda i: F.get("q", F.floor(i * RANGES / ranges).cast("int") - 1))).otherwise(F.array().cast("array<double>"))
    dealt = held.join(cells.select(*key, cuts.alias("cuts")), key).withColumn("range", F.size(F.filter("cuts", lambda x: x < F.col("dist")))).drop("cuts")
    sizes = dealt.groupBy(*key, "range").agg(F.min("dist").alias("lo"), F.max("dist").alias("hi"), F.ceil(F.count("*") / F.first(rows)).cast("int").alias("subs"))
    spans = sizes.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("range", "lo", "hi", "subs"))).alias("spans"))  # RANGES at most
    own = F.filter("spans", lambda s: s["range"] == F.col("range"))[0]
    number = lambda r, k: (r.cast("long") * 2**32 + k).alias("b")
    df = dealt.join(spans, key).withColumn("own", own).withColumn("b", number(F.col("range"), F.pmod(F.xxhash64("c", F.lit(5)), F.col("own.subs"))))
    reach = F.filter("spans", lambda s: (s["lo"] - F.col("own.hi") <= radius + 1e-6) & (F.col("own.lo") - s["hi"] <= radius + 1e-6))
    df = df.withColumn("near", F.flatten(F.transform(reach, lambda s: F.transform(F.sequence(F.lit(0), s["subs"] - 1), lambda k: number(s["range"], k)))))
    both = F.col("home").cast("int")
    as_member = F.transform("near", lambda o: F.struct(o.alias("x"), F.col("b").alias("y"), (F.when(o == F.col("b"), both).otherwise(0) + 2).alias("role")))
    as_home = F.transform(F.filter("near", lambda o: F.col("home") & (o != F.col("b"))), lambda o: F.struct(F.col("b").alias("x"), o.alias("y"), F.lit(1).alias("role")))
    return df.withColumn("p", F.explode(F.concat(as_member, as_home))).select(*key, "p.x", "p.y", "p.role", "c", "w", "vec")


def near_vectors(df: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cell: int = CELL, most_pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Vectors link within a label if their cosine in double precision is at least `cosine`. Null
    labels, and vectors that are null, empty, zero or hold null or non-finite components, link
    with nothing, and so do vectors of different length. A null id counts as a link's end but
    numbers no component. Repeated rows link with one another; an empty table gives no rows;
    other columns are not read."""
    spark = df.sparkSession
    radius = math.sqrt(max(0.0, 2 - 2 * cosine))
    v = F.col("_v")
    sound = F.col("_l").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("_l"), F.col(vec_col).cast("array<double>").alias("_v"))
    # Two hashes tell vectors apart; classes are numbered as they are stored, so that no number is shared.
    known = F.coalesce(sound, F.lit(False))
    rows = rows.withColumn("h1", F.when(known, F.xxhash64("_l", "_v"))).withColumn("h2", F.when(known, F.xxhash64(F.lit(11), "_v", "_l")))
    classes = rows.filter("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.first("_l").alias("label"), F.count("*").alias("w"), F.min("vec_id").alias("least"), F.first("_v").alias("vec"))
    classes = cut(classes.withColumn("c", F.monotonically_increasing_id()))
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    n_pivots = min(most_pivots, -(-largest // cell))
    pivots = np.empty((0, 0))
    if n_pivots > 1:
        dim = classes.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()["d"]
        some = classes.filter(F.size("vec") == dim).orderBy("h1", "h2").limit(8 * n_pivots).select("vec").collect()  # by hash
        pivots = far_apart(_unit(np.array([r["vec"] for r in some])), n_pivots)
    held = classes.select("label", "c", "w", "vec").mapInArrow(lambda b: _in_cells(b, pivots, radius), CELLS)
    pairs = _in_blocks(held, radius, block)

    def join(t: pa.Table) -> pa.Table:
        u = np.frombuffer(b"".join(t.column("vec").to_pylist())).reshape(t.num_rows, -1)
        homes, counts, links = join_block(*(t.column(k).to_numpy() for k in ("c", "w", "role")), u, cosine)
        some = np.flatnonzero(counts)
        c = [*homes[some].tolist(), *[a for a, _ in links]]
        n = [*counts[some].tolist(), *[0] * len(links)]
        return pa.table({"c": pa.array(c, pa.int64()), "n": pa.array(n, pa.int64()), "o": pa.array([*[None] * len(some), *[b for _, b in links]], pa.int64())})

    joined = cut(pairs.groupBy("label", "dim", "cell", "x", "y").applyInArrow(join, "c long, n long, o long"))
    found = components(joined.filter("o IS NOT NULL").select(F.col("c").alias("u"), F.col("o").alias("v")))
    counts = joined.groupBy("c").agg(F.sum("n").alias("others"))
    of_class = (
        classes.select("c", "h1", "h2", "w", "least").join(counts, "c", "left").join(found.select(F.col("u").alias("c"), "component"), "c", "left").withColumn("root", F.coalesce("component", "c"))
    )
    least = of_class.groupBy("root").agg(F.min("least").alias("component_id"))
    named = of_class.join(least, "root").select("h1", "h2", (F.coalesce("others", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component_id")
    return (
        rows.select("vec_id", "h1", "h2")
        .join(named, ["h1", "h2"], "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.when(F.col("h1").isNotNull(), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"),
        )
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )


#: All pairs of a label, and what links reach; for small tables.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM least LEFT JOIN n USING (vec_id)
"""
