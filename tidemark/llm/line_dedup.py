"""Line dedup by winnowing over line hashes.

A window is the shortest run of lines, from each line on and up to each line, that has at least
`least_words` words. Its fingerprint is the least line hash in it, so that windows select few
lines, and two equal windows select the same one. Fingerprints that stand at one place alone in
all documents are done with; for the rest, windows are joined by a key of all their lines, each to
its first occurrence in the order of documents (by id, then text hash, then line), never to all
others. A line's hash alone would lead to first occurrences in other surroundings.

A match is as long as the windows that match: those from a line on extend it to the right, those up
to a line to the left, so that what two texts share is covered to both of its ends. Exactly those
lines go that are in a run of `least_words` words that stands earlier. A line is only ever deleted
if the same line stands earlier, so the earliest one stays, whatever else is deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_of
from .minhash_dedup import slices_of

#: Words of the shortest repeated run that is sure to be found, and that is deleted.
LEAST_WORDS = 50
OUTER = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
WINDOWS = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64())]))


def lines_of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash (of the line without outer white space) and word count of every line."""
    lines = text.split(b"\n")
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(x.strip()) for x in lines), np.uint64, len(lines))
    return hashes, np.fromiter((len(x.split()) for x in lines), np.int64, len(lines))


def windows(counts: np.ndarray, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First line and end of each shortest run, from each line on and up to each, that has least_words words."""
    total = np.concatenate([[0], np.cumsum(counts)])
    ahead = np.flatnonzero(total[:-1] + least_words <= total[-1])
    back = np.flatnonzero(total[1:] >= least_words) + 1
    first = np.concatenate([ahead, np.searchsorted(total, total[back] - least_words, side="right") - 1])
    end = np.concatenate([np.searchsorted(total, total[ahead] + least_words, side="left"), back])
    both = np.unique(first * len(total) + end)
    return both // len(total), both % len(total)


def selected(hashes: np.ndarray, counts: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Place of the least hash of a line with words (the last one if equal) in each window, by tables over runs of powers of two."""
    size = end - first
    level = np.floor(np.log2(size)).astype(np.int64) if len(size) else np.zeros(0, np.int64)
    value = np.where(counts > 0, hashes, np.uint64(2**64 - 1))
    lower = lambda a, b: np.where(value[a] < value[b], a, b)
    least = np.arange(len(value))
    out = np.empty(len(first), np.int64)
    for k in range(int(level.max(initial=-1)) + 1):
        at = np.flatnonzero(level == k)
        out[at] = lower(least[first[at]], least[end[at] - (1 << k)])
        if len(least) > 1 << k:
            least = lower(least[: -(1 << k)], least[1 << k :])
    return out


def keys_of(hashes: np.ndarray, counts: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Two hashes of each window. Outer lines without words are counted, not hashed, so that many of them stay cheap."""
    total = np.concatenate([[0], np.cumsum(counts)])
    a, b = np.searchsorted(total, total[first], side="right") - 1, np.searchsorted(total, total[end], side="left")
    cores, at = np.unique(a * len(total) + b, return_inverse=True)
    held = memoryview(hashes.tobytes())
    digests = [xxhash.xxh3_128_digest(held[8 * x : 8 * y]) for x, y in zip((cores // len(total)).tolist(), (cores % len(total)).tolist())]
    out = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)[at]
    out[:, 1] += (a - first).astype(np.uint64) * OUTER[0] + (end - b).astype(np.uint64) * OUTER[1]
    return out.view(np.int64)


def _scanned(batches: Iterator[pa.RecordBatch], least_words: int) -> Iterator[pa.RecordBatch]:
    """A row for each selected line of a text, with the windows that selected it."""
    for batch in batches:
        for start, texts in slices_of(batch.column(2)):
            rows, places, prints, columns = [], [], [], []
            for row, text in enumerate(texts):
                hashes, counts = lines_of(text)
                first, end = windows(counts, least_words)
                place = selected(hashes, counts, first, end)
                rows.append(np.full(len(first), start + row))
                places.append(place)
                prints.append(hashes[place].view(np.int64))
                columns.append((first, end, keys_of(hashes, counts, first, end)))
            row, place = np.concatenate(rows), np.concatenate(places)
            order = np.lexsort((place, row))
            row, place, print_ = row[order], place[order], np.concatenate(prints)[order]
            heads = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (place[1:] != place[:-1])])) if len(row) else np.empty(0, np.int64)
            first, end, key = (np.concatenate(x)[order] for x in zip(*columns))
            values = pa.StructArray.from_arrays([pa.array(first, pa.int32()), pa.array(end, pa.int32()), pa.array(np.ascontiguousarray(key[:, 0])), pa.array(np.ascontiguousarray(key[:, 1]))], fields=list(WINDOWS.value_type))
            at = pa.array(row[heads], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(print_[heads]), pa.ListArray.from_arrays(pa.array(np.append(heads, len(row)), pa.int32()), values)], ["ord", "tkey", "fp", "windows"]
            )


def repeated_windows(df: DataFrame, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """ord, tkey, first, end of each window that stands earlier too.

    ord is the id, the largest long for null. Rows equal in id and text are one document here."""
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1))
    keyed = df.select(order.alias("ord"), F.xxhash64(text_of(text_col)).alias("tkey"), text_of(text_col).alias("text"))
    scanned = cut(keyed.mapInArrow(lambda b: _scanned(b, least_words), "ord long, tkey long, fp long, windows array<struct<first:int,end:int,k1:bigint,k2:bigint>>"))
    # Equal windows select equal lines at different places, be it in one text or in two.
    shared = scanned.groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1").select("fp")
    found = scanned.join(shared, "fp", "left_semi").select("ord", "tkey", F.inline("windows"))
    place = F.struct("ord", "tkey", "first")
    # Equal rows come out equal; their windows have one place.
    earliest = found.groupBy("k1", "k2").agg(F.min(place).alias("f"), F.count("*").alias("n")).filter("n > 1").select("k1", "k2", "f")
    return found.join(earliest, ["k1", "k2"]).filter(place != F.col("f")).select("ord", "tkey", "first", "end")


def repeated_runs(df: DataFrame, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """ord, tkey and runs (disjoint [first, end) lines to delete, in order) of documents that repeat earlier ones.

    Windows that touch are one run: a running greatest end over each document's windows in order."""
    found = repeated_windows(df, least_words, id_col, text_col)
    of = Window.partitionBy("ord", "tkey").orderBy("first", "end")
    before = F.max("end").over(of.rowsBetween(Window.unboundedPreceding, -1))
    islands = found.withColumn("_new", F.coalesce((F.col("first") > before).cast("int"), F.lit(0))).withColumn("_run", F.sum("_new").over(of.rowsBetween(Window.unboundedPreceding, 0)))
    runs = islands.groupBy("ord", "tkey", "_run").agg(F.min("first").alias("first"), F.max("end").alias("end"))
    return runs.groupBy("ord", "tkey").agg(F.array_sort(F.collect_list(F.struct("first", "end"))).alias("runs"))


def dedup_lines(df: DataFrame, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of df with the text's repeated runs deleted, and n_lines, n_removed of every row.

    The other columns come out as they are, whatever their names, but for two that clash with the
    new columns: those are replaced. A null text stays null with no lines. A null id comes after all
    others in the order of documents; rows equal in id and text are treated as one and come out
    alike; empty tables give no rows. Texts whose lines are all repeats come out empty."""
    rest = [c for c in df.columns if c not in ("n_lines", "n_removed")]
    runs = repeated_runs(df, least_words, id_col, text_col)
    docs = df.select(F.struct(*rest).alias("doc"), F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("ord"), F.xxhash64(text_of(text_col)).alias("tkey"))
    found = docs.join(runs, ["ord", "tkey"], "left").select("doc", "runs", F.col(f"doc.{text_col}").cast("string").alias("text"))
    lines = F.split("text", "\n")
    gone = F.flatten(F.transform("runs", lambda r: F.sequence(r["first"], r["end"] - 1)))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    left = F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))
    removed = F.when(F.col("runs").isNull(), 0).otherwise(F.size(gone))
    return found.select(*[left.alias(c) if c == text_col else F.col(f"doc.`{c}`").alias(c) for c in rest], n_lines.cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"))
