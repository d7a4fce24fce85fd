"""Byte-level BPE ids in Arrow batches, from the vocabulary file of the tokenizers library.

The ids are those of the library's plain call. As it needs about four times the time, texts are
encoded by the same merges in tiktoken; texts that hold the string of an added token, and one text
of every slice, which is compared, go to the library itself. A difference fails the task, and a
task that is run again uses the library alone from its first row on, so that no row of the other
kind stays. A file that is not of the shape that tiktoken reproduces is left to the library too.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np

# Fixed value: the split pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Bytes of text that a worker encodes at a time.
SLICE_BYTES = 4 << 20


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def reproducible(path: str) -> bool:
    """Whether the file is byte-level BPE with the usual pattern and nothing before or beside it."""
    spec = json.loads(open(path, encoding="utf-8").read())
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = not (spec.get("normalizer") or model.get("dropout") or model.get("unk_token") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or spec.get("truncation"))
    return plain and model["type"] == "BPE" and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)


class Encoder:
    """special_as_text: strings of special tokens in a text are ordinary text. alone: the library does it all."""

    def __init__(self, path: str, special_as_text: bool = False, alone: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = special_as_text
        self.alone = alone or not reproducible(path)
        letters = byte_alphabet()
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        ranks = {bytes(letters[c] for c in t): i for t, i in self.library.get_vocab(with_added_tokens=False).items() if all(c in letters for c in t)}
        ranks = {k: v for k, v in ranks.items() if k.decode("utf-8", "replace") not in self.added}
        self.fast = tiktoken.Encoding("tidemark", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _slow(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.alone or not texts:
            return self._slow(texts)
        out = [self.fast.encode_to_numpy(t, disallowed_special=()) for t in texts]
        probe = min(range(len(texts)), key=lambda i: abs(len(texts[i]) - 2000))
        held = [i for i, t in enumerate(texts) if i != probe and any(c in t for c in self.added)]
        for i, ids in zip(held, self._slow([texts[i] for i in held])):
            out[i] = ids
        want = self._slow([texts[probe]])[0]
        if any(c in texts[probe] for c in self.added):
            out[probe] = want
        if not np.array_equal(out[probe], want):
            raise RuntimeError("the fast merges differ from the tokenizers library; the task is to be run again by the library alone")
        return out


@lru_cache(maxsize=4)
def _encoder(path: str, special_as_text: bool, alone: bool) -> Encoder:
    return Encoder(path, special_as_text, alone)


def run_again() -> bool:
    """Whether this task has failed before."""
    from pyspark import TaskContext

    task = TaskContext.get()
    return task is not None and task.attemptNumber() > 0


def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """One for each worker process and file; the library alone in a task that is run again."""
    return _encoder(path, special_as_text, run_again())


def slices(column, most: int = SLICE_BYTES):
    """(first row, texts) of an Arrow string column, in order, a bounded number of bytes each; null is the empty text."""
    start, held, texts = 0, 0, []
    for i, x in enumerate(column):
        t = x.as_py() or ""
        texts.append(t)
        held += len(t)
        if held >= most:
            yield start, texts
            start, held, texts = i + 1, 0, []
    if texts:
        yield start, texts
