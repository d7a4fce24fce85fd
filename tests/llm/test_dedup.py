"""Line dedup, near-duplicates and components against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tidemark.llm import kernels, line_dedup, minhash_dedup
from tidemark.llm.components import _large, _small, components

from .cases import documents, empty


def roots(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)] + [(7, 7)]
    rows = components(spark.createDataFrame(links, "u long, v long")).collect()
    want = roots({x for e in links for x in e}, links)
    assert {r["u"]: r["component"] for r in rows} == {n: c for n, c in want.items() if n != c}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_a_round_of_components_deals_links_three_times(spark):
    # What each exchange leaves on disk besides its rows grows with the tasks before and behind it, however few the links.
    links = spark.createDataFrame([(3, 1), (3, 2), (5, 3)], "u long, v long")
    made = _small(_large(links))
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 3
    assert {tuple(r) for r in made.collect()} == {(2, 1), (3, 1), (5, 1)}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=40) | st.text(alphabet="aB é\t\n\x0b\x1c", max_size=30).map(str.encode), max_size=6))
def test_word_hashes(texts):
    h, first = kernels.words(texts)
    words = [t.lower().split() for t in texts]
    assert np.diff(first).tolist() == list(map(len, words))
    flat = [w for ws in words for w in ws]
    pairs = set(zip(flat, h.tolist()))
    assert len(pairs) == len(set(flat)) == len(set(h.tolist()))


def shingle_set(text, k=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def near_brute(rows):
    sets = [shingle_set(r["text"]) for r in rows]
    links = [
        (i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(x := sets[i] & sets[j]) >= 75 * (len(sets[i]) + len(sets[j]) - len(x))
    ]
    of = roots(range(len(rows)), links)
    least = {}
    for i, c in of.items():
        ids = [x for x in (least.get(c), rows[i]["doc_id"]) if x is not None]
        least[c] = min(ids, default=None)
    return Counter((r["doc_id"], len(sets[i]), least[of[i]], r["doc_id"] == least[of[i]]) for i, r in enumerate(rows))


def near_got(df, **options):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(df, **options).collect())


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(4)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 5, 6, 8, 30, 120]))] for _ in range(60)]
    texts = [" ".join(b) for b in base]
    for b in base:
        for _ in range(rng.randrange(4)):
            c = list(b)
            for _ in range(rng.randrange(1, 4)):
                c[rng.randrange(len(c))] = f"n{rng.randrange(99)}"
            texts.append(" ".join(c))
    hot = [f"h{i}" for i in range(80)]
    for i in range(120):  # copies of copies, around the threshold
        c = list(hot)
        for _ in range(rng.randrange(4)):
            c[rng.randrange(80)] = f"x{i}"
        texts.append(" ".join(c).upper() if i % 2 else " ".join(c))
    rows = [(len(texts) - i, t, "x", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string, c long")
    want = near_brute(df.collect())
    assert near_got(df) == want
    assert near_got(df, block=16) == want


def test_near_duplicates_of_odd_tables(spark):
    assert near_got(documents(spark)) == near_brute(documents(spark).collect())
    assert minhash_dedup.near_duplicates(empty(spark)).count() == 0


def test_near_duplicates_of_the_small_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert near_got(df) == near_brute(df.collect())


def test_large_buckets_and_groups_are_starred(spark, monkeypatch):
    """Copies of one text that are not near one another, near ones around the threshold, and a far corner, in blocks of a few."""
    monkeypatch.setattr(minhash_dedup, "BUCKET_BLOCK", 8)
    rng = random.Random(8)
    base = [f"b{i}" for i in range(120)]
    texts = [" ".join(base)]
    for i in range(90):
        c = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 5])):
            c[rng.randrange(120)] = f"x{i}y{rng.randrange(9)}"
        texts.append(" ".join(c))
    far = texts[7].split()
    for i in range(40):  # a chain that leads away
        far[(i * 3) % 120] = f"z{i}"
        texts.append(" ".join(far))
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = near_brute(df.collect())
    for block in (8, 30, 500):
        assert near_got(df, block=block) == want


def test_exact_keys_of_small_sets():
    rng, n = np.random.default_rng(5), 0
    for _ in range(3000):
        every = rng.integers(0, 2**64, rng.integers(1, 12), dtype=np.uint64)
        a, b = (np.unique(every[rng.random(len(every)) < 0.9]) for _ in range(2))
        if len(a) and len(b) and 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b)):
            assert set(minhash_dedup.exact_keys(a).tolist()) & set(minhash_dedup.exact_keys(b).tolist())
            n += 1
    assert n > 1000


def test_recall_near_the_threshold(spark):
    """Pairs of similarity 0.75 to 0.80, of 3 to 5,000 shingles: at least 99 of 100 are linked."""
    rng, texts = random.Random(12), []
    sizes = [3, 4, 7, 8, 9, 11, 12, 13, 16, 24, 40, 100, 400, 1500, 5000]
    for t in range(600):
        n = sizes[t % len(sizes)]
        words = [f"t{t}w{k}" for k in range(n + 4)]  # n shingles
        # k new words at the end: n - k shingles shared of n + k.
        k = next((k for k in range(n // 4 + 1, 0, -1) if 75 * (n + k) <= 100 * (n - k)), 0)
        other = words[: n + 4 - k] + [f"t{t}n{j}" for j in range(k)] if k else words + [f"t{t}more"]
        texts += [" ".join(words), " ".join(other)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = df.collect()
    linked = [100 * len((a := shingle_set(rows[i]["text"])) & (b := shingle_set(rows[i + 1]["text"]))) >= 75 * len(a | b) for i in range(0, len(rows), 2)]
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(df).collect()}
    found = [got[2 * i + 1] == 2 * i for i in range(len(linked))]
    assert sum(linked) > 550 and not any(f and not l for f, l in zip(found, linked))
    assert sum(f for f, l in zip(found, linked) if l) >= 0.99 * sum(linked)


def test_densified_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    for n in (6, 40, 900):
        a = rng.integers(0, 2**64, n, dtype=np.uint64)
        b = np.concatenate([a[: n * 5 // 6], rng.integers(0, 2**64, n // 6, dtype=np.uint64)])
        s = minhash_dedup.signatures([np.unique(a), np.unique(b)])
        assert abs((s[0] == s[1]).mean() - 5 / 7) < 0.2


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=25), st.integers(1, 10), st.integers(0, 99))
def test_every_window_selects_its_least_line(counts, least, seed):
    rng = random.Random(seed)
    h, counts = np.array([rng.randrange(5) for _ in counts], np.uint64), np.array(counts, np.int64)
    first, end = line_dedup.windows(counts, least)
    got = line_dedup.selected(h, counts, first, end).tolist()
    assert got == [min((i for i in range(a, b) if counts[i]), key=lambda i: (h[i], -i)) for a, b in zip(first, end)]
    # Shortest windows, from each line on and up to each line.
    whole = {(s, e) for s in range(len(counts)) for e in range(s + 1, len(counts) + 1) if sum(counts[s:e]) >= least}
    want = {(s, min(e for a, e in whole if a == s)) for s, _ in whole} | {(max(a for a, b in whole if b == e), e) for _, e in whole}
    assert set(zip(first.tolist(), end.tolist())) == want


def run_brute(rows, least):
    """All repeated runs that hold a whole window, line by line over all pairs of places."""
    docs = sorted({(2**63 - 1 if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in rows})
    lines = {d: [x.strip() for x in d[1].encode().split(b"\n")] for d in docs}
    sure, may = defaultdict(set), defaultdict(set)
    for n, d in enumerate(docs):
        for f in docs[: n + 1]:
            for shift in range(-len(lines[f]), len(lines[d]) + 1):
                if f == d and shift <= 0:
                    continue
                i = 0
                while i < len(lines[d]):
                    e = i
                    while e < len(lines[d]) and 0 <= e - shift < len(lines[f]) and lines[d][e] == lines[f][e - shift]:
                        e += 1
                    if e > i and sum(len(x.split()) for x in lines[d][i:e]) >= least:
                        may[d] |= set(range(i, e))
                    i = max(e, i + 1)
    return docs, lines, may


def test_line_runs(spark):
    rng = random.Random(9)
    stock = [" ".join(f"s{rng.randrange(30)}" for _ in range(rng.randrange(9))) for _ in range(40)] + [" ".join(f"l{k}" for k in range(25))]
    rows = []
    for i in range(40):
        at = rng.randrange(len(stock))
        body = [f"own {i} {k}" for k in range(rng.randrange(4))] + stock[at : at + rng.randrange(12)] + [f"end {i}"] * rng.randrange(2)
        rows.append((i, "\n".join(body + [stock[-1]] * (i % 7 == 0))))
    rows += [(50, rows[3][1]), (50, rows[3][1]), (None, rows[4][1])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_lines int, lang string")
    got = line_dedup.dedup_lines(df, least_words=20).collect()
    docs, lines, may = run_brute(df.collect(), 20)
    bodies = {(2**63 - 1 if i is None else i): t for i, t in rows}
    assert len(got) == len(rows) and sum(map(len, may.values())) > 100
    for r in got:  # exactly the lines of runs that stand earlier go
        body = bodies[2**63 - 1 if r["doc_id"] is None else r["doc_id"]]
        gone = may[(2**63 - 1 if r["doc_id"] is None else r["doc_id"], body)]
        own = body.split("\n")
        assert (r["n_lines"], r["n_removed"], r["lang"]) == (len(own), len(gone), "x")
        assert r["text"] == "\n".join(x for i, x in enumerate(own) if i not in gone)
    # No window of 20 words of the input's own text stands twice in what is left of it.
    left = Counter()
    for d in docs:
        gone, own = may[d], lines[d]
        for s in range(len(own)):
            e = next((e for e in range(s, len(own) + 1) if sum(len(x.split()) for x in own[s:e]) >= 20), None)
            if e and own[s] and not gone & set(range(s, e)):
                left[tuple(own[s:e])] += 1
    assert left and max(left.values()) == 1


def doc_of(*parts):
    return "\n".join(p for part in parts for p in ([part] if isinstance(part, str) else part))


def test_a_frequent_line_does_not_hide_a_repeated_run(spark):
    """Whatever line of a run stands elsewhere before, the run's later copy goes whole, and no window of the input is left twice."""
    least, rng = 50, random.Random(17)
    rows = []
    for t in range(20):  # doc 1 has the common line in other surroundings; docs 2 and 3 share 28 + 4 + 28 words around it
        line = lambda name, n: " ".join(f"{name}{t}x{k}" for k in range(n))
        c, x1, x2 = line("c", 4), line("a", 28), line("b", 28)
        rows += [(3 * t, doc_of(c, line("o", 30))), (3 * t + 1, doc_of(line("p", 5), x1, c, x2)), (3 * t + 2, doc_of(x1, c, x2, line("q", 5)))]
    # A run whose head stands alone before: its tail, too short for a window from it on, goes with it.
    head, tail = " ".join(f"h{k}" for k in range(60)), " ".join(f"t{k}" for k in range(10))
    rows += [(100, doc_of(head, "else")), (101, doc_of(head, tail, "end one")), (102, doc_of("begin", head, tail, "end two"))]
    stock = [" ".join(f"s{i}y{k}" for k in range(rng.choice([1, 3, 9, 20, 60]))) for i in range(25)] + ["", " "]
    for i in range(60):  # dense repeats in changing order
        runs = [stock[(at := rng.randrange(len(stock))) : at + rng.randrange(1, 8)] for _ in range(rng.randrange(1, 6))]
        rows.append((200 + i, doc_of(*runs)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    docs, lines, may = run_brute(df.collect(), least)
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(df, least).collect()}
    # Document order is by id here, as no id repeats.
    for d in docs:
        own = [x.encode() for x in d[1].split("\n")]
        want = [x for i, x in enumerate(own) if i not in may[d]]
        assert got[d[0]]["text"].encode() == b"\n".join(want) and got[d[0]]["n_removed"] == len(may[d])
    left = Counter()
    for d in docs:
        gone, own = may[d], lines[d]
        for s in range(len(own)):
            e = next((e for e in range(s, len(own) + 1) if sum(len(x.split()) for x in own[s:e]) >= least), None)
            if e and own[s] and not gone & set(range(s, e)):
                left[tuple(own[s:e])] += 1
    assert left and max(left.values()) == 1


def test_a_long_line_that_repeats_is_deleted_once_kept(spark):
    line = " ".join(f"p{i}" for i in range(60))
    df = spark.createDataFrame([(i, f"first {i}\n{line}\nlast {i}") for i in range(5)] + [(9, f"{line}\nx\n{line}")], "doc_id long, text string")
    rows = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df).collect()}
    assert rows[0] == f"first 0\n{line}\nlast 0"
    assert all(rows[i] == f"first {i}\nlast {i}" for i in range(1, 5)) and rows[9] == "x"


def test_lines_of_odd_tables(spark):
    rows = line_dedup.dedup_lines(documents(spark)).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in documents(spark).collect())
    texts = {(r["doc_id"], r["text"]) for r in documents(spark).collect() if r["text"] is None or len(r["text"].split()) < 50}
    assert texts <= {(r["doc_id"], r["text"]) for r in rows}
    assert line_dedup.dedup_lines(empty(spark)).count() == 0
