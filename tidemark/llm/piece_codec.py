"""SentencePiece encoding and decoding for merge-type vocabularies.

Encoding keeps an agenda of adjacent symbol pairs ordered by the score of the piece they make,
then from left to right, and merges from its top until no pair makes a piece. No piece of such a
vocabulary has a space mark behind another character, so what lies between two marks never
merges across them: a text is the sequence of its words, each with the marks before it, and equal
words have equal ids. Words of one length are merged together, a step of every agenda at a time;
long ones have an agenda of their own. A character that no piece has is spelled in bytes.

Every word that a worker meets for the first time is checked against the library, and so is one
whole text of every slice. A word that differs gets the library's ids; a whole text that differs
fails the task, and a task that is run again uses the library alone from its first row on.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .tokens import run_again, slices

MARK = "▁"
NONE = np.int32(2**31 - 1)
#: Words up to so many characters are merged in step.
STEP_LENGTH = 64
#: Words whose ids a worker remembers; it starts afresh beyond that.
REMEMBERED = 250_000


class Vocabulary:
    """The pieces of a model and the pairs that make one."""

    def __init__(self, model: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=model)
        n = lib.get_piece_size()
        plain = [i for i in range(n) if not (lib.is_control(i) or lib.is_byte(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.piece = {lib.id_to_piece(i): i for i in plain}
        self.unknown = next(i for i in range(n) if lib.is_unknown(i))
        self.bytes = {lib.id_to_piece(i): i for i in range(n) if lib.is_byte(i)}
        self.splits_at_marks = not any(MARK in p.lstrip(MARK) for p in self.piece)
        order = {s: k for k, s in enumerate(sorted({lib.get_score(i) for i in plain}, reverse=True))}
        self.rank = {p: order[lib.get_score(i)] for p, i in self.piece.items()}
        self.size = n
        self.decimals = list(map(str, range(n)))
        # Characters that no piece has are the symbol n, which makes no pair; those that only longer pieces have are n + 1.
        self.chars = np.full(0x110000, n, np.int32)
        self.chars[[ord(c) for c in {c for p in self.piece for c in p}]] = n + 1
        for p, i in self.piece.items():
            if len(p) == 1:
                self.chars[ord(p)] = i
        pairs = {}
        for p, i in self.piece.items():
            for k in range(1, len(p)):
                a, b = self.piece.get(p[:k]), self.piece.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * (n + 1) + b] = (self.rank[p], i)
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int32)
        self.made = np.array([pairs[k][1] for k in self.keys.tolist()], np.int32)

    def look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of the piece that each pair makes; rank NONE if none."""
        key = a.astype(np.int64) * (self.size + 1) + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE), self.made[at]

    def in_step(self, words: list[str], places: list[int], out: list[list[int]]) -> None:
        """Put the ids of words of one length, without odd characters, in their places of out."""
        length = len(words[0])
        at = np.arange(len(words))
        s = self.chars[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)].reshape(-1, length)
        foreign = (s == self.size).any(axis=1)
        ranks, made = self.look(s[:, :-1], s[:, 1:])
        while len(at):
            if s.shape[1] > 1:
                best = ranks.argmin(axis=1)
                going = ranks[np.arange(len(at)), best] != NONE
            else:
                best, going = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
            for k, ids, f in zip(at[~going].tolist(), s[~going].tolist(), foreign[at[~going]].tolist()):
                out[places[k]] = self._spelled(words[k], ids) if f else ids
            at, s, ranks, made, best = at[going], s[going], ranks[going], made[going], best[going]
            if not len(at):
                return
            rows, cols = np.arange(len(at)), np.arange(s.shape[1] - 1)
            s[rows, best] = made[rows, best]
            s = np.take_along_axis(s, cols + (cols > best[:, None]), axis=1)
            if s.shape[1] == 1:
                continue
            drop = cols[:-1] + (cols[:-1] >= best[:, None])
            ranks, made = np.take_along_axis(ranks, drop, axis=1), np.take_along_axis(made, drop, axis=1)
            for side in (best - 1, best):
                ok = np.flatnonzero((side >= 0) & (side < s.shape[1] - 1))
                k = side[ok]
                ranks[ok, k], made[ok, k] = self.look(s[ok, k], s[ok, k + 1])

    def _spelled(self, word: str, symbols: list[int]) -> list[int]:
        """Ids of symbols, of which the foreign ones stand for the word's foreign characters in order."""
        foreign = iter([c for c in word if self.chars[ord(c)] == self.size])
        return [i for x in symbols for i in (self._bytes(next(foreign)) if x == self.size else (x,))]

    def _bytes(self, c: str) -> list[int]:
        return [self.bytes[f"<0x{b:02X}>"] for b in c.encode()] if self.bytes else [self.unknown]

    def alone(self, word: str) -> list[int]:
        """The agenda of one word, as a heap."""
        sym, prev, nxt = list(word), list(range(-1, len(word) - 1)), [*range(1, len(word)), -1]
        agenda: list[tuple[int, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and nxt[i] >= 0 and (r := self.rank.get(p := sym[i] + sym[nxt[i]])) is not None:
                heapq.heappush(agenda, (r, i, p))

        for i in range(len(word)):
            offer(i)
        while agenda:
            _, i, p = heapq.heappop(agenda)
            if not sym[i] or nxt[i] < 0 or sym[i] + sym[nxt[i]] != p:
                continue
            j = nxt[i]
            sym[i], sym[j] = p, ""
            nxt[i] = nxt[j]
            if nxt[j] >= 0:
                prev[nxt[j]] = i
            offer(prev[i])
            offer(i)
        ids: list[int] = []
        for p in filter(None, sym):
            if p in self.piece:
                ids.append(self.piece[p])
            else:
                ids += self._bytes(p)
        return ids

    def words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word."""
        out: list[list[int]] = [[]] * len(words)
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_length.setdefault(len(w), []).append(k)
        for length, places in by_length.items():
            if length > STEP_LENGTH:
                for k in places:
                    out[k] = self.alone(words[k])
            elif length:
                same = [words[k] for k in places]
                codes = np.frombuffer("".join(same).encode("utf-32-le"), np.uint32).reshape(-1, length)
                odd = (self.chars[codes] > self.size).any(axis=1)
                if odd.any():
                    for k in np.flatnonzero(odd).tolist():
                        out[places[k]] = self.alone(same[k])
                    left = np.flatnonzero(~odd).tolist()
                    same, places = [same[k] for k in left], [places[k] for k in left]
                if same:
                    self.in_step(same, places, out)
        return out


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer; messages and strings are bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


def identity_normal_form(model: bytes) -> bool:
    """Whether the model only puts marks for spaces and one before the text, and has no pieces that are cut out first."""
    # Field numbers of sentencepiece's model file. Pieces: 1 (3 type, 4 of it user-defined); trainer: 2 (24 suffix marks); normalizer: 3.
    fields: dict[int, bytes] = {}
    for number, value in _fields(model):
        if number == 1 and dict(_fields(value)).get(3) == 4:
            return False
        fields[number] = value
    trainer, n = dict(_fields(fields.get(2, b""))), dict(_fields(fields.get(3, b"")))
    # 2 the character map, 3 mark before the text, 4 extra white space goes, 5 spaces become marks.
    return not n.get(2) and n.get(3, 1) == 1 and n.get(4, 1) == 0 and n.get(5, 1) == 1 and not trainer.get(24, 0)


class Codec:
    def __init__(self, model: str):
        self.v = Vocabulary(model)
        self.own = self.v.splits_at_marks and identity_normal_form(self.v.library.serialized_model_proto())
        self.ids: dict[str, list[int]] = {}
        self.checked = self.differed = 0

    def split(self, text: str) -> list[str]:
        """Words of a text, without the mark that each begins with."""
        if not text:
            return []
        if "  " not in text and MARK not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [w[1:] for w in re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))]

    def _meet(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.ids]
        if not new:
            return
        if len(self.ids) + len(new) > REMEMBERED:
            self.ids = {w: self.ids[w] for w in words if w in self.ids}
        found = self.v.words([MARK + w for w in new])
        # The library puts the mark before a text; the empty word is the mark alone, which it gives to no text.
        some = [k for k, w in enumerate(new) if w]
        wanted = self.v.library.encode([new[k] for k in some], num_threads=1) if some else []
        for k, want in zip(some, wanted):
            if found[k] != want:
                self.differed += 1
                found[k] = want
        self.checked += len(some)
        self.ids.update(zip(new, found))

    def encode(self, texts: list[str]) -> list[tuple[list[int], str]]:
        """Ids of each text, and their decimals joined by a space."""
        if not self.own or run_again():
            return [(ids, " ".join(map(str, ids))) for ids in self.v.library.encode(texts, num_threads=1)]
        was = gc.isenabled()
        gc.disable()  # nothing here makes cycles, and the words remembered are many to visit
        try:
            split = [self.split(t) for t in texts]
            self._meet(set(chain.from_iterable(split)))
            ids, decimal = self.ids.__getitem__, self.v.decimals.__getitem__
            out = [(found, " ".join(map(decimal, found))) for found in (list(chain.from_iterable(map(ids, words))) for words in split)]
        finally:
            if was:
                gc.enable()
        probe = min(range(len(texts)), key=lambda i: abs(len(texts[i]) - 2000), default=None)
        if probe is not None and out[probe][0] != self.v.library.encode(texts[probe]):
            raise RuntimeError("the agenda differs from the sentencepiece library; the task is to be run again by the library alone")
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return [self.v.library.decode(x) for x in ids]


@lru_cache(maxsize=2)
def codec(model: str) -> Codec:
    """One for each worker process and model."""
    return Codec(model)


def _over(df: DataFrame, model: str, id_col: str, text_col: str, schema: str, row) -> DataFrame:
    names = ["doc_id", *[x.split()[0] for x in schema.split(", ")[1:]]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            for first, texts in slices(batch.column(1)):
                rows = row(c, texts)
                arrays = [batch.column(0).slice(first, len(texts))] + [pa.array([r[k] for r in rows], t) for k, t in enumerate(_types(schema))]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, schema)


def _types(schema: str) -> list[pa.DataType]:
    kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    return [kinds[x.split()[1]] for x in schema.split(", ")[1:]]


def encode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2) -> DataFrame:
    """doc_id and ids of every row; a null text is the empty one, which has the end id only."""
    tail = [] if end_id is None else [end_id]
    return _over(df, model, id_col, text_col, "doc_id long, ids array<int>", lambda c, texts: [(ids + tail,) for ids, _ in c.encode(texts)])


def decode(df: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of every row of ids; null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(c.decode([x or [] for x in part.column(1).to_pylist()]), pa.string())], ["doc_id", "text"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def digest(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, encoded and decoded in one pass.

    A null text is the empty one; a null id is carried along; repeated rows give repeated rows;
    an empty table gives none; other columns are not read."""

    def row(c: Codec, texts: list[str]) -> list[tuple]:
        coded = c.encode(texts)
        texts = c.decode([ids + [end_id] for ids, _ in coded])
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return [(len(ids) + 1, sha(f"{s} {end_id}" if s else str(end_id)), sha(t)) for (ids, s), t in zip(coded, texts)]

    return _over(df, model, id_col, text_col, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", row)
