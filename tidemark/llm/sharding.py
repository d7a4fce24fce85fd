"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

A row's place on the ring is a hash of its text, so equal texts start at the same place. Each
shard owns virtual nodes; a row belongs to the first node clockwise from its place. A shard
that has reached its capacity takes no more, and what overflows continues clockwise to the
next node whose shard has room. With `slack` 0 the capacities are n/k rounded down or up, so
counts differ by one at most; a larger slack trades balance for fewer moves.

Which rows of an arc overflow is settled by their rank in the arc. All that the driver sees is
the row count of each arc (shards x virtual nodes, a parameter), never rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CELL_ROWS, cut, text_of, with_rank

#: The ring is split evenly by the leading bits of a place, to find its node in few steps.
LEAD_BITS = 10


def ring(n_shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(place, shard) of all virtual nodes in ring order; places have 63 bits."""
    at = lambda s, v: int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big") >> 1
    return sorted((at(s, v), s) for s in range(n_shards) for v in range(vnodes))


def fill(nodes: list[tuple[int, int]], arc_counts: dict[int, int], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Runs (arc, first rank, end rank, shard, first slot): where the rows of each arc go.

    Round r offers what is left of every arc, in ring order, to the r-th node after it."""
    left, done, used, runs = dict(arc_counts), dict.fromkeys(arc_counts, 0), [0] * len(capacity), []
    for step in range(len(nodes)):
        for arc in sorted(a for a, n in left.items() if n):
            shard = nodes[(arc + step) % len(nodes)][1]
            take = min(left[arc], capacity[shard] - used[shard])
            if take > 0:
                runs.append((arc, done[arc], done[arc] + take, shard, used[shard]))
                left[arc] -= take
                done[arc] += take
                used[shard] += take
        if not any(left.values()):
            break
    return runs


def shard(df: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", vnodes: int = 64, slack: float = 0.0, cell_rows: int = CELL_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of df.

    A null text has size 1 and the checksum of the empty string; rows with a null id are placed
    like others; repeated rows each get a slot; an empty table gives no rows. Other columns are
    not read. With slack 0 law is `rows` (counts at most one apart), else `bounded`. grown_shard
    is null, as the loads of all rows decide."""
    nodes = ring(n_shards, vnodes)
    places = [p for p, _ in nodes]
    shift = 63 - LEAD_BITS
    first = [bisect_left(places, b << shift) for b in range(2**LEAD_BITS + 1)]
    longs = lambda xs: F.lit([int(x) for x in xs]).cast("array<bigint>")
    body = text_of(text_col)
    rows = cut(
        df.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(body) + 1).cast("long").alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            F.shiftrightunsigned(F.xxhash64(F.col(text_col).cast("string")), 1).alias("_place"),
        )
        .withColumn("_lead", F.shiftright("_place", shift).cast("int"))
        .withColumn("_from", F.get(longs(first[:-1]), F.col("_lead")).cast("int"))
        .withColumn("_near", F.get(longs([b - a for a, b in zip(first, first[1:])]), F.col("_lead")).cast("int"))
        .withColumn(
            "_arc",
            F.pmod(F.col("_from") + F.size(F.filter(F.slice(longs(places), F.col("_from") + 1, F.col("_near")), lambda x: x < F.col("_place"))), F.lit(len(nodes))),
        )
        .select("doc_id", "size", "text_crc32", "_arc")
    )
    n = rows.count()
    ranked, totals = with_rank(rows, "_arc", ["doc_id", "text_crc32", "size"], "_rank", n, cell_rows)
    counts = {r["_arc"]: r["total"] for r in totals.collect()}  # a row for each virtual node at most
    room = int(n * (1 + slack))
    capacity = [room // n_shards + (s < room % n_shards) for s in range(n_shards)]
    runs = df.sparkSession.createDataFrame(
        fill(nodes, counts, capacity) or [(-1, 0, 0, 0, 0)], "_to long, _lo long, _hi long, shard int, _slot0 long"
    )
    # As many runs as virtual nodes and shards at most: a bound set by parameters.
    placed = ranked.join(F.broadcast(runs), (F.col("_arc") == F.col("_to")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bounded" if slack else "rows").alias("law"),
        "shard",
        (F.col("_slot0") + F.col("_rank") - F.col("_lo")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
