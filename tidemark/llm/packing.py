"""Harmonic packing of token pieces into sequences.

With a capacity C the classes are the reciprocals: class j takes pieces of more than C/(j+1) and
at most C/j tokens, and exactly j of them make a sequence, whatever they are; so classes fill
their sequences without looking at one another, and workers fill theirs without talking. What
pieces leave free is kept small by cuts: a document's rest is cut to the largest reciprocal that
fits, as often as `cuts` allows, and such pieces fill their sequences with nothing left.

Pieces under C/(J+1) tokens, J the last class, lie one behind the other on a line that is dealt
into sequences by where a piece starts; a start before C minus the largest such piece keeps it
whole. The pieces of the last, part-filled sequence of each class, J(J-1)/2 at most, go onto the
line's end as first-fit bins.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CELL_ROWS, cut, text_of, with_rank
from .tokens import encoder, slices

CAPACITY = 2048
#: The last class that counts pieces.
CLASSES = 32
#: Cuts to a reciprocal's size that a document's rest gets at most.
CUTS = 3

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces_of(n: int, capacity: int = CAPACITY, classes: int = CLASSES, cuts: int = CUTS) -> list[int]:
    """The lengths into which n tokens are cut; the length alone decides."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    for _ in range(cuts):
        j = -(-capacity // rest) if rest else classes + 1
        if j > classes:
            break
        size = capacity // j
        if size > rest:
            break
        out.append(size)
        rest -= size
    return out + [rest] * (rest > 0)


def cut_pieces(df: DataFrame, tokenizer: str, end_id: int, capacity: int, classes: int, cuts: int, id_col: str, text_col: str) -> DataFrame:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            ids = batch.column(0)
            for first, texts in slices(batch.column(1)):
                rows: list[tuple] = []
                for k, tokens in enumerate(enc.encode(texts)):
                    data = np.concatenate([tokens, end]).astype("<u4")
                    doc_id, at = ids[first + k].as_py(), 0
                    for n in pieces_of(len(data), capacity, classes, cuts):
                        rows.append((doc_id, at, n, zlib.crc32(data[at : at + n]), len(data)))
                        at += n
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(encode, PIECES)


def first_fit(tails: list[tuple[int, int, int]], capacity: int) -> list[tuple[int, int, int, int]]:
    """(class, rank, bin, offset) of (class, rank, length), longest first."""
    bins: list[int] = []
    out = []
    for j, rank, n in sorted(tails, key=lambda t: (-t[2], t[0], t[1])):
        k = next((i for i, used in enumerate(bins) if used + n <= capacity), len(bins))
        if k == len(bins):
            bins.append(0)
        out.append((j, rank, k, bins[k]))
        bins[k] += n
    return out


def pack(df: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, classes: int = CLASSES, cuts: int = CUTS, id_col: str = "doc_id", text_col: str = "text", cell_rows: int = CELL_ROWS) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Sequence ids have no gaps. A null text is empty and still has its end id; a null doc_id is
    carried along; repeated rows are packed each; an empty table gives no rows. Other columns are
    not read. The driver sees the piece count of each class and the J(J-1)/2 tail pieces."""
    spark = df.sparkSession
    pieces = cut(cut_pieces(df, tokenizer, end_id, capacity, classes, cuts, id_col, text_col))
    small = classes + 1
    n = pieces.count()
    grouped = pieces.withColumn("_class", F.least(F.floor(F.lit(capacity) / F.col("length")), F.lit(small)).cast("int"))
    ranked, totals = with_rank(grouped, "_class", ["doc_id", "start", "ids_crc32"], "_rank", n, cell_rows)
    ranked = cut(ranked)
    count = {r["_class"]: r["total"] for r in totals.collect()}  # a row for each class
    # Sequences: those of whole classes, then the line's, then the tails'.
    first, at = {}, 0
    for j in range(1, classes + 1):
        first[j] = at
        at += count.get(j, 0) // j
    whole = {j: count.get(j, 0) // j * j for j in range(1, classes + 1)}
    table = lambda d: F.get(F.lit([int(d.get(j, 0)) for j in range(small + 1)]).cast("array<bigint>"), F.col("_class"))
    fixed = ranked.filter((F.col("_class") <= classes) & (F.col("_rank") < table(whole)))
    fixed = fixed.withColumn("sequence_id", table(first) + F.expr("_rank div _class"))
    own = Window.partitionBy("sequence_id").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(own), F.lit(0)).alias("offset")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id"]

    # The line of small pieces: dealt by where they start on it, cell by cell as the ranks were.
    step = capacity - capacity // small + 1
    line = ranked.filter(F.col("_class") == small).withColumn("_cell", F.expr(f"_rank div {cell_rows}"))
    sums = line.groupBy("_cell").agg(F.sum("length").alias("_s"))
    before = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("_cell").alias("_c"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"))
    in_cell = Window.partitionBy("_cell").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    line = line.withColumn("_in", F.coalesce(F.sum("length").over(in_cell), F.lit(0))).join(sums, F.col("_cell") == F.col("_c"))
    line = line.withColumn("_deal", F.floor((F.col("_base") + F.col("_in")) / step).cast("long"))
    # Every step on the line has a piece that starts there, as pieces are shorter than a step.
    line = line.withColumn("sequence_id", F.lit(at) + F.col("_deal"))
    small_total, end = ranked.filter(F.col("_class") == small).agg(F.sum("length"), F.max_by("length", "_rank")).first()
    lines = (small_total - end) // step + 1 if small_total else 0
    tails_df = ranked.filter((F.col("_class") <= classes) & (F.col("_rank") >= table(whole)))
    tails = [(r["_class"], r["_rank"], r["length"]) for r in tails_df.select("_class", "_rank", "length").collect()]
    placed = spark.createDataFrame(
        [(j, k, at + lines + b, o) for j, k, b, o in first_fit(tails, capacity)] or [(-1, -1, 0, 0)], "_j int, _k long, sequence_id long, offset long"
    )
    rest = tails_df.join(F.broadcast(placed), (F.col("_class") == F.col("_j")) & (F.col("_rank") == F.col("_k")))
    return (
        fixed.select(*columns, offset)
        .unionByName(line.select(*columns, offset))
        .unionByName(rest.select(*columns, "offset"))
    )
