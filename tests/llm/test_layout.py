"""Sharding, token planes, packing and url filters against plain Python."""

import io
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tidemark.llm import packing, sharding, token_planes, tokens, url_filter

from .cases import documents, empty

BPE = public_tokenizers.path("byte_bpe_50k.json")


@lru_cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


def library_ids(text, end):
    return [*library().encode(text or "", add_special_tokens=False).ids, end]


def packed(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_shards_are_even_and_slots_gapless(spark):
    rows = sharding.shard(documents(spark), 8, cell_rows=5).collect()
    source = documents(spark).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter(
        (r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in source
    )
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(8)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(empty(spark), 8).count() == 0


def test_overflow_goes_clockwise():
    """The runs equal what rows do that arrive one by one, each arc's turn after the other's."""
    nodes = [(10, 0), (20, 1), (30, 0), (40, 2)]
    runs = sharding.fill(nodes, {0: 5, 1: 1, 3: 2}, [3, 3, 2])
    assert runs == [(0, 0, 3, 0, 0), (1, 0, 1, 1, 0), (3, 0, 2, 2, 0), (0, 3, 5, 1, 1)]


def test_one_group_may_hold_all_rows(spark):
    df = spark.range(1000).selectExpr("id AS doc_id", "'same' AS text")
    counts = [r["count"] for r in sharding.shard(df, 8, cell_rows=50).groupBy("shard").count().collect()]
    assert sorted(counts) == [125] * 8


@pytest.mark.parametrize("slack,most,beside", [(0.0, 0.2, 0.06), (0.25, 0.15, 0.02)])
def test_few_rows_move_when_a_shard_is_added(spark, slack, most, beside):
    """A ninth shard has to take a ninth of all rows; few others move, with room to spare hardly any."""
    df = spark.range(6000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    before, after = ({r["doc_id"]: r["shard"] for r in sharding.shard(df, k, slack=slack).collect()} for k in (8, 9))
    moved = [i for i in before if before[i] != after[i]]
    assert len(moved) < most * 6000 and sum(after[i] != 8 for i in moved) < beside * 6000


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=40), max_size=12), st.sampled_from(["byte", "bit"]), st.sampled_from([8, 16]))
def test_planes_round_trip(docs, unit, block):
    class Keep(io.BytesIO):
        pass

    out = Keep()
    writer = token_planes.Writer(out, unit, block)
    for i, d in enumerate(docs):
        writer.add(None if i == 3 else i * 7, np.array(d, np.uint32))
    writer.close()
    reader = token_planes.Reader(out, len(out.getvalue()))
    got = [(i, s, [x for p in parts for x in p.tolist()]) for i, s, parts in reader.documents()]
    starts = np.cumsum([0, *map(len, docs)]).tolist()
    assert got == [(None if i == 3 else i * 7, starts[i], d) for i, d in enumerate(docs)]


@pytest.mark.parametrize("unit", ["byte", "bit"])
def test_token_files_hold_every_document_in_order(spark, unit):
    rows = token_planes.round_trip(documents(spark), BPE, 0, unit=unit, block_ids=1000, files=3).collect()
    source = sorted(documents(spark).collect(), key=lambda r: (-1 if r["doc_id"] is None else r["doc_id"], r["text"] or ""))
    want, at = [], 0
    for r in source:
        ids = library_ids(r["text"], 0)
        want.append((r["doc_id"], at, len(ids), packed(ids)))
        at += len(ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want
    assert token_planes.round_trip(empty(spark), BPE, 0).count() == 0


SPECIAL = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>  x", "a <|endoftext |> b", "  <|endoftext|>\n"]


def test_special_strings_are_what_the_library_makes_of_them(spark):
    df = spark.createDataFrame(list(enumerate(SPECIAL * 3)), "doc_id long, text string")
    rows = sorted(map(tuple, token_planes.round_trip(df, BPE, 0, files=2).collect()))
    assert [(i, n, c) for i, _, n, c in rows] == [(i, len(ids), packed(ids)) for i, ids in enumerate(library_ids(t, 0) for t in SPECIAL * 3)]
    assert rows[0][2] == 5
    check_packing(packing.pack(df, BPE).collect(), df.collect(), packing.CAPACITY)
    assert tokens.Encoder(BPE, special_as_text=True).encode(SPECIAL)[0].tolist() == [64, 1279, 91, 437, 1659, 5239, 91, 29, 275]


def test_a_difference_fails_the_task_and_the_library_takes_over(monkeypatch):
    enc = tokens.Encoder(BPE)
    enc.fast = tiktoken.Encoding("broken", pat_str=r"\S+|\s+", mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    with pytest.raises(RuntimeError):
        enc.encode(["some words"])
    assert [x.tolist() for x in tokens.Encoder(BPE, alone=True).encode(["some words", ""])] == [library().encode("some words").ids, []]
    monkeypatch.setattr(tokens, "run_again", lambda: True)
    assert tokens.encoder(BPE).alone


def test_files_end_early_is_noticed():
    with pytest.raises(ValueError):
        token_planes.Reader(io.BytesIO(b"x" * 50), 50)


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 10_000))
def test_pieces_cover(n):
    out = packing.pieces_of(n)
    assert sum(out) == n and all(0 < x <= packing.CAPACITY for x in out)


def check_packing(rows, source, capacity):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    want = defaultdict(Counter)
    for r in source:
        ids = library_ids(r["text"], 1)
        at = 0
        for n in packing.pieces_of(len(ids), capacity):
            want[r["doc_id"]][(at, n, packed(ids[at : at + n]), len(ids))] += 1
            at += n
    assert {d: Counter((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rs) for d, rs in by_doc.items()} == want
    assert sorted(by_seq) == list(range(len(by_seq)))
    for spans in by_seq.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return sum(r["length"] for r in rows) / (len(by_seq) * capacity)


def test_packing(spark):
    rows = packing.pack(documents(spark), BPE, cell_rows=7).collect()
    assert check_packing(rows, documents(spark).collect(), 2048) > 0.9
    assert packing.pack(empty(spark), BPE).count() == 0


def test_packing_of_many_small_documents(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "repeat('word ', cast(id % 37 as int)) AS text")
    assert check_packing(packing.pack(df, BPE, capacity=256, cell_rows=100).collect(), df.collect(), 256) > 0.9


URLS = [None, "", "nothing", "http://COM/", "https://Example.com/en/x?y#z", "http://www.example.com/en/", "http://a.www.example.com/en/b", "http://xexample.com/en/", "http://example.com", "ftp://a.net/es/1", "http://net/fr/", "http://anet/fr/", "http://a.net?/fr/", "http://a.net/fr#/", "http://a.net:80/fr/", "x://://com/", "http://a..net/es/", "http://.net/es/"] * 2


def judge(url, rules):
    rest = url.partition("://")[2] if url and "://" in url else ""
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:][: min([rest[cut:].index(c) for c in "?#" if c in rest[cut:]], default=len(rest))]
    fits = [(len(h + p), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


NESTED = [("block", "org", "/"), ("allow", "b.org", "/"), ("block", "a.b.org", "/"), ("allow", "c.a.b.org", "/q"), ("block", "z.org", "/")]


@pytest.mark.parametrize("rules", [url_filter.RULES, NESTED])
def test_urls(spark, rules):
    urls = URLS + [f"http://{h}/{p}" for h in ("org", "b.org", "a.b.org", "c.a.b.org", "d.c.a.b.org", "a.org", "ab.org", "y.z.org", "zz.org") for p in ("", "q", "q/r")]
    df = spark.createDataFrame([(i if i else None, u, "x", "x") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = sorted(((r["page_id"] or 0, *tuple(r)[1:]) for r in url_filter.judge_urls(df, rules).collect()))
    assert got == [(i, *judge(u, rules)) for i, u in enumerate(urls)]
    assert url_filter.judge_urls(df.limit(0), rules).count() == 0
