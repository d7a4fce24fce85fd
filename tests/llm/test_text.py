"""Piece codec, license scan and quality rules against plain Python and the library."""

import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tidemark.llm import license_scan, piece_codec, quality_rules

from .cases import documents, empty

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab ▁the  \n\té日😀x0"), max_size=60) | st.text(max_size=40), min_size=1, max_size=6))
def test_ids_are_the_librarys(texts):
    codec = piece_codec.codec(MODEL)
    assert codec.own
    right = [codec.v.library.encode(t) for t in texts]
    assert [ids for ids, _ in codec.encode(texts)] == right
    for t, want in zip(texts, right):  # the agendas themselves, without the check by the library
        for w in codec.split(t):
            if w:
                ids = codec.v.words(["▁" + w, "▁"])[0]
                assert ids == codec.v.alone("▁" + w) == codec.v.library.encode(w)


def test_codec_digest(spark, library):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter()
    for r in documents(spark).collect():
        ids = library.encode(r["text"] or "") + [2]
        want[(r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))] += 1
    assert Counter(map(tuple, piece_codec.digest(documents(spark), MODEL).collect())) == want
    assert piece_codec.digest(empty(spark), MODEL).count() == 0


def test_codec_columns(spark, library):
    coded = piece_codec.encode(documents(spark), MODEL)
    back = piece_codec.decode(coded, MODEL)
    want = Counter((r["doc_id"], library.decode(library.encode(r["text"] or ""))) for r in documents(spark).collect())
    assert Counter(map(tuple, back.collect())) == want


def scan_one(text):
    words = re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = []
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_license_base(spark):
    rng = random.Random(5)
    bits = ["GNU", "general", "Public", "license", "apache", "mit", "CC", "by", "x", "éLicense", "gnu general public license", "CC-BY", "MIT License.", "\n"]
    texts = [" ".join(rng.choices(bits, k=rng.randrange(30))) for _ in range(150)] + ["mit license " * 500]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, labels string, score string")
    for frame in (df, documents(spark)):
        got = Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in license_scan.scan(frame).collect())
        assert got == Counter((r["doc_id"], *scan_one(r["text"])) for r in frame.collect())
    assert license_scan.scan(empty(spark)).count() == 0


def test_license_texts_are_found_with_changes(spark):
    mit = license_scan.TEMPLATES["mit-text"].split()
    changed = mit[:20] + ["indeed", "so"] + mit[20:40] + mit[43:]
    texts = [" ".join(mit), "some words before " + " ".join(changed) + " and after", " ".join(mit[:15]), "of the to the in the and to use copy"]
    rows = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["labels"] for r in rows] == ["mit-text", "mit-text", "", ""]
    assert rows[0]["score"] == 1.0 and 0.6 <= rows[1]["score"] < 1 and rows[2]["score"] == 0
    assert rows[1]["spans"][0]["first_word"] == 3


def test_a_hash_alone_is_no_vote(spark, monkeypatch):
    """With a hash that all k-grams share, words still decide."""
    text = "x mit license y gnu general public license"
    df = spark.createDataFrame([(1, text), (2, "mit y license gnu general public")], "doc_id long, text string")
    want = {r["doc_id"]: (r["n_base"], r["labels"]) for r in license_scan.scan(df).collect()}
    real = F.xxhash64
    monkeypatch.setattr(license_scan.F, "xxhash64", lambda *c: real(F.lit(0)) if len(c) > 1 else real(*c))
    assert {r["doc_id"]: (r["n_base"], r["labels"]) for r in license_scan.scan(df).collect()} == want == {1: (2, "gpl,mit"), 2: (0, "")}


def base_of(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


def test_quality_base(spark):
    rng = random.Random(3)
    texts = ["\n".join(" ".join(rng.choices("aé bb #c *|d e".split(), k=rng.randrange(9))) for _ in range(rng.randrange(8))) + rng.choice(["", "\n", " \t\x0b\r"]) for _ in range(200)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words long")
    for frame in (df, documents(spark)):
        rows = quality_rules.judge(frame, labels_of(spark, [(None, None, None, None)])).collect()
        assert Counter(tuple(r)[:7] for r in rows) == Counter((r["doc_id"], *base_of(r["text"])) for r in frame.collect())
        assert all(r["kept"] != r["base_failed"] for r in rows)  # no labels, no rules
    assert quality_rules.judge(empty(spark), labels_of(spark, [(1, 0, 0, "x")])).count() == 0


def test_learned_list_on_held_out_texts(spark):
    path = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    train, test = labels.filter("doc_id % 5 != 0"), labels.filter("doc_id % 5 = 0")
    rules = quality_rules.fit(docs, train)
    assert rules and all(r.literals for r in rules)
    rows = quality_rules.apply(quality_rules.statistics(docs.join(test, "doc_id"), ["doc_id", "quality"]), rules).collect()
    bad = [r for r in rows if r["quality"] == 0]
    good = [r for r in rows if r["quality"] == 1]
    assert sum(r["rule"] == 0 for r in good) >= 0.99 * len(good)
    assert sum(not r["kept"] for r in bad) >= 0.8 * len(bad)
    print([str(r) for r in rules], len(bad), sum(not r["kept"] for r in bad), len(good), sum(r["kept"] for r in good))


def test_rules_cover_what_was_planted():
    rng = random.Random(1)
    rows = [{"a": rng.random(), "b": rng.random()} for _ in range(900)]
    for r in rows:
        r["_bad"] = int((r["a"] > 0.7 and r["b"] <= 0.4) or r["b"] > 0.9)
    rules = quality_rules.learn(rows, ["a", "b"])
    found = [any(x.covers(r) for x in rules) for r in rows]
    assert sum(f == bool(r["_bad"]) for f, r in zip(found, rows)) > 0.93 * len(rows)
    assert not [r for r, f in zip(rows, found) if f and not r["_bad"]][10:]
