"""Connected components by alternating large-star and small-star steps.

Every step deals the links by node once: a node's least neighbour is a window over them, and each
link makes one link of the next step, so that no step has more links than the one before it. What a
step makes is dealt by node too, which serves the removal of doubles and the next window alike. A
node's links are sorted by one task, which spills. Nothing but two sums per round reaches the
driver. Each round is cut through the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


def _with_least(links: DataFrame) -> DataFrame:
    """Add m, the least of u and its neighbours v."""
    return links.withColumn("m", F.least("u", F.min("v").over(Window.partitionBy("u"))))


def _made(u: Column, links: DataFrame) -> DataFrame:
    """Links of u to m, each once, dealt by u."""
    return links.select(u.alias("u"), F.col("m").alias("v")).repartition("u").distinct()


def _large(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to its smallest neighbour. edges: u > v."""
    both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
    return _made(F.col("v"), _with_least(both).filter("v > u"))


def _small(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them. edges: u > v, each once.

    The link to the smallest stands for the node itself; the other links stand for the neighbours."""
    return _made(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")), _with_least(edges))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Columns u, v of one ordered type; returns u and component, its smallest node, for all nodes but those smallest ones."""
    now = edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    # Stars when every node has one link, to a node that itself has none: a fixed point of both steps.
    mark = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"))
    tasks = edges.sparkSession.sparkContext.defaultParallelism
    marked = lambda df: df.coalesce(tasks).agg(mark.alias("x")).first()["x"]  # noqa: E731  # a task a core reads the stored links
    now = cut(now)
    last = marked(now)
    for _ in range(rounds):
        if not last["n"]:
            break
        now = cut(_small(_large(now)))
        this = marked(now)
        if this == last:
            return now.select("u", F.col("v").alias("component"))
        last = this
    if last["n"]:
        raise RuntimeError("components did not settle")
    return now.select("u", F.col("v").alias("component"))
