"""MinHash near-duplicates: one-permutation hashing with optimal densification, bands, stars.

A text's set is that of its distinct word shingles. One hash of each shingle gives its bin and its
value; the least value of each bin is the signature, and an empty bin takes the value of a bin
that a fixed sequence of probes, the same for all texts, finds filled first. Rows of the signature
make bands, and equal bands a bucket. Texts with equal sets are one class from here on.

A bucket's members are compared by their signatures, a byte a row, and each part that stays
connected becomes a star around its least class: fewer candidate edges than members, whatever
the bucket holds. The bound on signatures is far below the threshold, so that a link passes it but
for a chance below that of sharing no band, while texts that merely share a passage do not hang
together. Sets of a few shingles, whose signatures vary too much for that, have exact keys beside
the bands: hashes of the set less any of its parts that a link leaves out. The components of the
stars are groups that hold every link whole.

Links are then confirmed on full sets inside each group, so that no link is lost because a
star's centre is not near both its ends. A large bucket or group is starred first: those near the
centre hang together by it and need not meet, so that only what is left over meets all, in pairs
of blocks of a fixed number of classes; in a group the centre is the one nearest to a first, and
what is farther from it than two links (a metric) does not meet those near it. Each pair emits a
forest of what it found connected, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_of
from .components import components
from .kernels import mix, shingles, words

WORDS = 5
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: 32 bands of 4 rows: a pair at the threshold shares no band with a chance of about 5 in a million.
BINS, BANDS = 128, 32
#: Equal rows of two signatures (of BINS) for a candidate: 3/4 of BINS are expected at the threshold.
LEAST_EQUAL = 64
#: Sets of so many shingles at most have exact keys.
SMALL = 11
#: Classes in a block of a group, and of a bucket.
BLOCK, BUCKET_BLOCK = 512, 1024
#: Text bytes worked on at a time.
BATCH_BYTES = 4 << 20

_PROBES = np.random.default_rng(7).integers(0, BINS, (4096, BINS))
_BAND = np.random.default_rng(8).integers(0, 2**63, (BANDS, BINS // BANDS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Densified one-permutation signatures (a row for each set) of sorted, non-empty hash arrays."""
    out, filled = np.zeros((len(sets), BINS), np.uint64), np.zeros((len(sets), BINS), bool)
    for i, s in enumerate(sets):
        bins = (s >> np.uint64(57)).astype(np.intp)
        head = np.concatenate([[True], bins[1:] != bins[:-1]])  # sorted: the first of a bin is its least
        out[i, bins[head]] = s[head]
        filled[i, bins[head]] = True
    rows, cols = np.nonzero(~filled)
    for probe in _PROBES:
        if not len(rows):
            break
        to = probe[cols]
        hit = filled[rows, to]
        out[rows[hit], cols[hit]] = out[rows[hit], to[hit]]
        rows, cols = rows[~hit], cols[~hit]
    for r, c in zip(rows.tolist(), cols.tolist()):  # after all probes: the next filled bin
        out[r, c] = out[r, (c + 1 + int(np.argmax(np.roll(filled[r], -c - 1)))) % BINS]
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    rows = signature.reshape(len(signature), BANDS, -1)
    return mix((mix(rows) * _BAND).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


@lru_cache(maxsize=64)
def _left_out(n: int, most: int) -> np.ndarray:
    """A row for each choice of up to `most` of n, as 0 and 1."""
    rows = [c for k in range(most + 1) for c in combinations(range(n), k)]
    out = np.zeros((len(rows), n), np.uint64)
    for i, c in enumerate(rows):
        out[i, list(c)] = 1
    return out


def exact_keys(shingles_: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Hashes of the set less each part that a link may leave out of it: two linked sets share that of their intersection."""
    values = mix(shingles_ * WINDOW_2)
    most = len(shingles_) * (100 - percent) // 100
    return mix(values.sum(dtype=np.uint64) - _left_out(len(shingles_), most) @ values)


def slices_of(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of a string column as bytes, a bounded number of bytes at a time."""
    start, held, out = 0, 0, []
    for x in column.cast(pa.large_binary()):
        out.append(x.as_py() or b"")
        held += len(out[-1])
        if held >= BATCH_BYTES:
            yield start, out
            start, held, out = start + len(out), 0, []
    if out:
        yield start, out


def sets_of(texts: list[bytes], k: int) -> list[np.ndarray]:
    h, first = words(texts)
    return [np.unique(shingles(h[a:b], k)) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]


def _signed(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, texts in slices_of(batch.column(1)):
            sets = sets_of(texts, k)
            some = [i for i, s in enumerate(sets) if len(s)]
            full: list = [None] * len(texts)
            short: list = [None] * len(texts)
            exact = [exact_keys(s, percent).view(np.int64) if 0 < len(s) <= SMALL else None for s in sets]
            if some:
                signed = signatures([sets[i] for i in some])
                for i, m, b in zip(some, bands(signed).view(np.int64), mix(signed).astype(np.uint8)):
                    full[i], short[i] = m, b.tobytes()
            digest = [(int(np.bitwise_xor.reduce(s).view(np.int64)), int(mix(s * WINDOW_2).sum(dtype=np.uint64).view(np.int64))) if len(s) else (None, None) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(start, len(texts)),
                    batch.column(2).slice(start, len(texts)),
                    pa.array(list(map(len, sets)), pa.int64()),
                    pa.array([d[0] for d in digest], pa.int64()),
                    pa.array([d[1] for d in digest], pa.int64()),
                    pa.array(full, pa.list_(pa.int64())),
                    pa.array(short, pa.binary()),
                    pa.array(exact, pa.list_(pa.int64())),
                ],
                ["doc_id", "tkey", "n_shingles", "s1", "s2", "bands", "sig", "exact"],
            )


WINDOW_2 = np.uint64(0xD6E8FEB86659FD93)


def _sized(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Class columns as they are, and the set of the class's text."""
    for batch in batches:
        for start, texts in slices_of(batch.column(0)):
            yield pa.RecordBatch.from_arrays(
                [batch.column(i).slice(start, len(texts)) for i in range(1, 4)] + [pa.array([s.tobytes() for s in sets_of(texts, k)], pa.binary())],
                ["c", "grp", "n", "shingles"],
            )


def alike(sigs: np.ndarray, side: np.ndarray, c: np.ndarray) -> list[tuple[int, int]]:
    """Stars (class, least class of its part) of signatures connected by LEAST_EQUAL equal rows; across sides only if there are two."""
    n = len(c)
    part = np.arange(n)
    both = bool(side.any() and not side.all())
    left = np.ones(n, bool)
    for i in range(n):
        # Bit by bit from one member: those near any member of the part so far.
        if not left[i]:
            continue
        todo = [i]
        left[i] = False
        while todo:
            k = todo.pop()
            at = np.flatnonzero(left & (side != side[k])) if both else np.flatnonzero(left)
            if not len(at):
                continue
            near = at[(sigs[at] == sigs[k]).sum(axis=1) >= LEAST_EQUAL]
            left[near] = False
            part[near] = part[i]
            todo += near.tolist()
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, part, c)
    return [(a, b) for a, b in zip(c.tolist(), least[part].tolist()) if a != b]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows bucket, x, y, side, c, sig sorted by the first three, to the stars of each bucket's pair of blocks."""
    held: list[pa.RecordBatch] = []

    def emit(t: pa.Table) -> pa.RecordBatch:
        key = np.stack([t.column(i).to_numpy() for i in range(3)], axis=1)
        side, c = t.column(3).to_numpy(), t.column(4).to_numpy()
        sigs = np.frombuffer(b"".join(t.column(5).to_pylist()), np.uint8).reshape(-1, BINS)
        heads = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
        sizes = np.diff(np.concatenate([heads, [len(c)]]))
        two = heads[sizes == 2]  # most buckets; all at once
        two = two[(sigs[two] == sigs[two + 1]).sum(axis=1) >= LEAST_EQUAL]
        u, v = [np.maximum(c[two], c[two + 1])], [np.minimum(c[two], c[two + 1])]
        for a, n in zip(heads[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            if found := alike(sigs[a : a + n], side[a : a + n], c[a : a + n]):
                pairs = np.array(found, np.int64)
                u.append(pairs[:, 0])
                v.append(pairs[:, 1])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(u), pa.int64()), pa.array(np.concatenate(v), pa.int64())], ["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        t = pa.Table.from_batches(held)
        last = [t.column(i)[t.num_rows - 1].as_py() for i in range(3)]
        same = np.logical_and.reduce([t.column(i).to_numpy() == last[i] for i in range(3)])
        cut_at = int(np.argmax(same))  # a bucket's rows may go on in the next batch
        if cut_at:
            yield emit(t.slice(0, cut_at))
        held = t.slice(cut_at).combine_chunks().to_batches()
    if held:
        yield emit(pa.Table.from_batches(held))


class Forest:
    """Union-find over a block's members; keeps the links that joined two trees."""

    def __init__(self, n: int):
        self.up, self.links = list(range(n)), []

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.links.append((a, b))


def linked(sets: list[np.ndarray], side: list[int], percent: int) -> list[tuple[int, int]]:
    """A forest of the links among sets; with members on both sides (0, 1) only links across count.

    Overlaps are counted by shingle: each member, in turn, adds up its shared shingles with the
    members before it, which a sorted list of all (shingle, member) gives as runs."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    every, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    _, code = np.unique(every, return_inverse=True)
    order = np.lexsort((owner, code))
    code, owner = code[order], owner[order]
    heads = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    run = np.cumsum(np.concatenate([[0], (code[1:] != code[:-1]).astype(np.int64)]))
    back = np.arange(len(code)) - heads[run]  # members before in the run
    by_owner = np.argsort(owner, kind="stable")
    cuts_at = np.concatenate([[0], np.cumsum(sizes)])
    forest, sides = Forest(n), np.array(side)
    both = len(set(side)) > 1
    for i in range(1, n):
        at = by_owner[cuts_at[i] : cuts_at[i + 1]]
        m = back[at]
        if not m.any():
            continue
        lead = np.repeat(heads[run[at]], m)
        inner = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
        shared = np.bincount(owner[lead + inner], minlength=i)
        near = 100 * shared >= percent * (sizes[i] + sizes[: len(shared)] - shared)
        near &= shared > 0
        if both:
            near &= sides[: len(shared)] != side[i]
        for j in np.flatnonzero(near).tolist():
            forest.join(i, j)
    return forest.links


def _paired(df: DataFrame) -> DataFrame:
    """Copies of rows to the pairs (x, y) of blocks that they are part of; side tells which of the two.

    Rows are dealt into `rest` blocks or, if they are near their centre, into `close` ones; blocks
    of the rest meet all, but near ones not each other (`cross` marks pairs of a near block with one
    of the rest). Rows that are `far` from the centre meet no near ones."""
    zero = F.lit(0)
    upto = lambda n: F.when(n > 0, F.sequence(zero, n - 1)).otherwise(F.array().cast("array<int>"))
    own = F.pmod(F.xxhash64("c", F.lit(3)), F.greatest(F.when(F.col("near"), F.col("close")).otherwise(F.col("rest")), F.lit(1))).cast("int")
    df = df.withColumn("b", own)
    b, rest = F.col("b"), F.col("rest")
    pair = lambda x, y, side, cross: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), side.cast("int").alias("side"), F.lit(cross).alias("cross"))
    among = F.transform(upto(rest), lambda o: pair(F.least(b, o), F.greatest(b, o), b > o, False))
    across = F.transform(upto(F.when(F.col("far"), zero).otherwise(F.col("close"))), lambda o: pair(b, rest + o, zero, True))
    from_near = F.transform(upto(rest), lambda o: pair(o, rest + b, F.lit(1), True))
    return df.withColumn("p", F.explode(F.when(F.col("near"), from_near).otherwise(F.concat(among, across)))).select("*", "p.*").drop("p", "b", "near", "far", "close", "rest")


def _blocks(n: Column, size: int) -> Column:
    return F.ceil(n / size).cast("int")


def _starred_buckets(entries: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Of large buckets (bucket, c, sig): the edges to each bucket's least class, and the rows for _paired."""
    centres = entries.groupBy("bucket").agg(F.min("c").alias("centre"), F.min_by("sig", "c").alias("csig"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sig, centre = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, BINS) for k in ("sig", "csig"))
                near = (sig == centre).sum(axis=1) >= LEAST_EQUAL
                yield pa.RecordBatch.from_arrays([batch.column(k) for k in ("bucket", "c", "sig", "centre")] + [pa.array(near)], ["bucket", "c", "sig", "centre", "near"])

    judged = cut(entries.join(centres, "bucket").select("bucket", "c", "sig", "centre", "csig").mapInArrow(judge, "bucket long, c long, sig binary, centre long, near boolean"))
    counts = judged.groupBy("bucket").agg(_blocks(F.count_if("near"), size).alias("close"), _blocks(F.count_if(~F.col("near")), size).alias("rest"))
    rows = judged.join(counts, "bucket").select("bucket", "c", "sig", "near", F.lit(False).alias("far"), "close", "rest")
    return judged.filter("near AND c != centre").select(F.col("c").alias("u"), F.col("centre").alias("v")), rows


def _compared(sets: DataFrame, centres: DataFrame, percent: int) -> DataFrame:
    """Rows of sets (c, grp, shingles) with their similarity to the group's centre (grp, centre, cset), and whether it is a link, or too far for one link more."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for own, other in zip(batch.column("shingles"), batch.column("cset")):
                a, b = np.frombuffer(own.as_py(), np.uint64), np.frombuffer(other.as_py(), np.uint64)
                shared = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
                union = len(a) + len(b) - shared
                rows.append((shared / union, 100 * shared >= percent * union, 100 * shared < (2 * percent - 100) * union))
            made = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.float64(), pa.bool_(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in ("c", "grp", "centre")] + made, ["c", "grp", "centre", "like", "near", "far"])

    rows = sets.join(centres, "grp").select("c", "grp", "shingles", "centre", "cset")
    return cut(rows.mapInArrow(judge, "c long, grp long, centre long, like double, near boolean, far boolean"))


def _starred_groups(sets: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of large groups (c, grp, shingles): links to two centres, and the rows for _paired.

    The second centre is the class nearest to the first, which is any: where texts are copies of
    one, that is the one they are copies of."""
    pick = lambda of, best: of.groupBy("grp").agg(best.alias("centre")).join(sets.select(F.col("grp"), F.col("c").alias("centre"), F.col("shingles").alias("cset")), ["grp", "centre"])
    first = _compared(sets, pick(sets, F.min("c")), percent)
    second = _compared(sets, pick(first.filter("c != centre"), F.max_by("c", F.struct("like", "c"))), percent)
    links = first.unionByName(second).filter("near AND c != centre").select(F.col("c").alias("u"), F.col("centre").alias("v"))
    counts = second.groupBy("grp").agg(_blocks(F.count_if("near"), size).alias("close"), _blocks(F.count_if(~F.col("near")), size).alias("rest"))
    rows = second.select("c", "grp", "near", "far").join(counts, "grp").filter("rest > 0").join(sets, ["c", "grp"])
    return links, rows.select("c", "grp", "shingles", "near", "far", "close", "rest")


def near_duplicates(df: DataFrame, percent: int = PERCENT, k: int = WORDS, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tkey (hash of the text), n_shingles, component_id, kept of every row.

    component_id: the smallest doc_id that links reach, the row's own included. Texts without
    words (null ones too) have an empty set and link with nothing: their component is their own
    id. Null ids are passed over; a component without any id has a null one. kept: the row's id
    is the component's; where an id repeats within a component, all its rows are kept here, and
    who removes documents takes one of them (by tkey).
    An empty table gives no rows; other columns are not read."""
    return rooted_duplicates(df, percent, k, block, id_col, text_col).drop("root")


def rooted_duplicates(df: DataFrame, percent: int = PERCENT, k: int = WORDS, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """near_duplicates with root, the component's own key: unlike ids, which may be null or repeat, no two components
    share it. Null for texts without words."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    keyed = rows.select("doc_id", "text", F.xxhash64("text").alias("tkey"))
    columns = "doc_id long, tkey long, n_shingles long, s1 long, s2 long, bands array<long>, sig binary, exact array<long>"
    signed = cut(keyed.mapInArrow(lambda b: _signed(b, k, percent), columns))

    # Classes of equal sets, told apart by two digests and the size, and numbered as they are stored. tkey finds a text.
    same = ["s1", "s2", "n_shingles"]
    first = lambda c: F.first(c).alias(c)
    classes = signed.filter("n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("least"), F.min("tkey").alias("tkey"), first("bands"), first("sig"), first("exact"))
    classes = cut(classes.withColumn("c", F.monotonically_increasing_id()))

    # Candidates: stars of buckets, and of exact keys.
    entries = classes.select("c", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    entries = entries.join(shared, "bucket").join(classes.select("c", "sig"), "c")
    whole = {"near": F.lit(False), "far": F.lit(False), "close": F.lit(0), "rest": F.lit(1)}
    large = cut(entries.filter(F.col("n") > BUCKET_BLOCK).select("bucket", "c", "sig"))
    few, stars = entries.filter(F.col("n") <= BUCKET_BLOCK).select("bucket", "c", "sig").withColumns(whole), None
    if not large.isEmpty():
        stars, left = _starred_buckets(large, BUCKET_BLOCK)
        few = few.unionByName(left)
    paired = _paired(few).select("bucket", "x", "y", "side", "c", "sig").repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
    keys = classes.filter("exact IS NOT NULL").select("c", F.explode("exact").alias("key"))
    centres = keys.groupBy("key").agg(F.min("c").alias("v"), F.count("*").alias("n")).filter("n > 1").select("key", "v")
    small = keys.join(centres, "key").select(F.col("c").alias("u"), "v")
    candidates = paired.mapInArrow(_stars, "u long, v long").unionByName(small)
    groups = components(candidates.unionByName(stars) if stars else candidates)
    # A group's classes and their number; the one that others link to comes with the least of those.
    of = Window.partitionBy("component")
    sized = groups.select("u", "component", (F.count("*").over(of) + 1).alias("n"), (F.min("u").over(of) == F.col("u")).alias("head"))
    both = F.when(F.col("head"), F.array("u", "component")).otherwise(F.array("u"))
    members = cut(sized.select(F.explode(both).alias("c"), F.col("component").alias("grp"), "n"))
    wanted = members.join(classes.select("c", "tkey"), "c").select("tkey", "c", "grp", "n")
    # One text of each class in a group; texts equal to it are left out by the distinct.
    texts = keyed.select("tkey", "text").join(wanted, "tkey").dropDuplicates(["c"]).select("text", "c", "grp", "n")
    sets_of_texts = lambda some: some.mapInArrow(lambda b: _sized(b, k), "c long, grp long, n long, shingles binary").select("c", "grp", "shingles")
    if members.filter(F.col("n") > block).isEmpty():
        few, links = sets_of_texts(texts).withColumns(whole), None
    else:
        texts = cut(texts)  # read twice, while all texts are dealt but once
        links, left = _starred_groups(cut(sets_of_texts(texts.filter(F.col("n") > block))), block, percent)
        few = sets_of_texts(texts.filter(F.col("n") <= block)).withColumns(whole).unionByName(left)
    copies = _paired(few)

    def confirm(t: pa.Table) -> pa.Table:
        ids, side = t.column("c").to_numpy(), t.column("side").to_pylist()
        lone = t.column("cross")[0].as_py() and len(set(side)) < 2
        found = [] if lone else linked([np.frombuffer(s.as_py(), np.uint64) for s in t.column("shingles")], side, percent)
        return pa.table({"u": pa.array([int(ids[a]) for a, _ in found], pa.int64()), "v": pa.array([int(ids[b]) for _, b in found], pa.int64())})

    linked_pairs = copies.groupBy("grp", "x", "y").applyInArrow(confirm, "u long, v long")
    found = components(linked_pairs.unionByName(links) if links else linked_pairs)

    # Components are numbered by the least id in them.
    of_class = classes.select("c", *same, "least").join(found.select(F.col("u").alias("c"), "component"), "c", "left").withColumn("root", F.coalesce("component", "c"))
    named = of_class.select(*same, "root", F.min("least").over(Window.partitionBy("root")).alias("component_id"))
    return (
        signed.select("doc_id", "tkey", *same)
        .join(named, same, "left")
        .select("doc_id", "tkey", "n_shingles", "root", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


#: All pairs that share a shingle, and what links reach; for small tables.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n_shingles FROM s GROUP BY 1),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n_shingles + y.n_shingles - i)),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n_shingles, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM least LEFT JOIN n USING (doc_id)
"""
