"""Token ids in files of compressed planes.

A file holds the ids of a range of documents, in ascending id order, in blocks of a fixed
number of ids. A block is transposed into planes: plane p holds byte p (or bit p) of every id of
the block, so that the high planes, which are nearly constant, shrink to almost nothing; each
plane is compressed by zstandard on its own. Behind the blocks come the document ids and
lengths, the chunk index (place, size and id count of each block, and the sizes of its planes)
and a footer with the place of both.

    b"TPLN" | blocks | documents | index | footer (json) | footer size (u32) | b"TPLN"

Files are written by the tasks of a range-partitioned job, under names that no other attempt of
a task shares; the manifest that the job returns lists those of the attempts that counted, so a
lost executor leaves at most a file that nothing points to. They are written through
pyarrow.fs, which takes the scheme of the shared folder's URI.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, text_of, width
from .tokens import encoder, slices

MAGIC = b"TPLN"
#: Ids in a block.
BLOCK_IDS = 1 << 16
LEVEL = 3
PLANES = {"byte": 4, "bit": 32}


def to_planes(ids: np.ndarray, unit: str) -> list[bytes]:
    """The planes of uint32 ids, lowest first."""
    rows = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if unit == "byte":
        return [np.ascontiguousarray(rows[:, p]).tobytes() for p in range(4)]
    bits = np.unpackbits(rows, axis=1, bitorder="little")
    return [np.packbits(bits[:, p], bitorder="little").tobytes() for p in range(32)]


def from_planes(planes: list[bytes], n: int, unit: str) -> np.ndarray:
    if unit == "byte":
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).reshape(-1).view("<u4")
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")


class Writer:
    """Takes documents one after the other; holds less than a block of ids, and one number for each document."""

    def __init__(self, out, unit: str = "byte", block_ids: int = BLOCK_IDS, level: int = LEVEL):
        import zstandard

        self.out, self.unit, self.block_ids = out, unit, block_ids
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.at, self.held, self.n_held, self.n_ids = 0, [], 0, 0
        self.index, self.ids, self.known, self.lengths = [], [], [], []
        self._put(MAGIC)

    def _put(self, data: bytes) -> tuple[int, int]:
        self.out.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id or 0)
        self.known.append(doc_id is not None)
        self.lengths.append(len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= self.block_ids:
            every = np.concatenate(self.held)
            full = len(every) // self.block_ids * self.block_ids
            for k in range(0, full, self.block_ids):
                self._block(every[k : k + self.block_ids])
            self.held, self.n_held = [every[full:]], len(every) - full

    def _block(self, ids: np.ndarray) -> None:
        planes = [self.pack(p) for p in to_planes(ids, self.unit)]
        self.index.append([self.at, len(ids), *map(len, planes)])
        self._put(b"".join(planes))

    def close(self) -> None:
        if self.n_held:
            self._block(np.concatenate(self.held))
        docs = [np.diff(np.array(self.ids, "<i8"), prepend=0).astype("<i8"), np.array(self.lengths, "<u8"), np.array(self.known, np.uint8)]
        documents = [self._put(self.pack(x.tobytes())) for x in docs]
        index = self._put(self.pack(np.array(self.index, "<i8").tobytes()))
        footer = json.dumps({"unit": self.unit, "block_ids": self.block_ids, "docs": len(self.ids), "ids": self.n_ids, "documents": documents, "index": index, "blocks": len(self.index)}).encode()
        self._put(footer + struct.pack("<I", len(footer)) + MAGIC)


class Reader:
    """Reads a file of random access; `block` reads one block only, by the chunk index."""

    def __init__(self, source, size: int):
        import zstandard

        self.source, self.unpack = source, zstandard.ZstdDecompressor().decompress
        tail = self._get(size - 8, 8)
        if tail[4:] != MAGIC:
            raise ValueError("not a file of token planes, or cut short")
        n = struct.unpack("<I", tail[:4])[0]
        self.footer = json.loads(self._get(size - 8 - n, n))
        self.index = np.frombuffer(self.unpack(self._get(*self.footer["index"])), "<i8").reshape(self.footer["blocks"], 2 + PLANES[self.footer["unit"]])

    def _get(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def block(self, k: int) -> np.ndarray:
        at, n, *sizes = map(int, self.index[k])
        data, planes = self._get(at, sum(sizes)), []
        for size in sizes:
            planes.append(self.unpack(data[:size]))
            data = data[size:]
        return from_planes(planes, n, self.footer["unit"])

    def documents(self) -> Iterator[tuple[int | None, int, list[np.ndarray]]]:
        """(doc id, place of its first id in the file, its ids in parts), a block in memory at a time."""
        deltas, lengths, known = (self.unpack(self._get(*x)) for x in self.footer["documents"])
        doc_ids, lengths, known = np.cumsum(np.frombuffer(deltas, "<i8")), np.frombuffer(lengths, "<u8"), np.frombuffer(known, np.uint8)
        k, block, used, start = 0, np.empty(0, "<u4"), 0, 0
        for doc_id, length, has in zip(doc_ids.tolist(), lengths.tolist(), known.tolist()):
            parts, need = [], length
            while need:
                if used == len(block):
                    block, used, k = self.block(k), 0, k + 1
                take = min(need, len(block) - used)
                parts.append(block[used : used + take])
                used += take
                need -= take
            yield (doc_id if has else None), start, parts
            start += length


MANIFEST = "part int, path string, docs long, ids long, bytes long"


def write_planes(df: DataFrame, tokenizer: str, folder: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", unit: str = "byte", block_ids: int = BLOCK_IDS, files: int | None = None) -> DataFrame:
    """Encode every text, add end_id, and write files in ascending order of ids (nulls first, then ties by text).

    Returns the manifest, a row for each file, as a table that no longer depends on the job. A
    null text is the empty one. An empty table writes no file."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    rows = rows.repartitionByRange(files or width(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        part, writer, out, path = TaskContext.get().partitionId(), None, None, f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.tpl"
        enc = encoder(tokenizer)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            ids = batch.column(0)
            for first, texts in slices(batch.column(1)):
                if writer is None:
                    files_at, at = fs.FileSystem.from_uri(folder)
                    files_at.create_dir(at, recursive=True)
                    out = files_at.open_output_stream(f"{at}/{path.rpartition('/')[2]}")
                    writer = Writer(out, unit, block_ids)
                for k, tokens in enumerate(enc.encode(texts)):
                    writer.add(ids[first + k].as_py(), np.concatenate([tokens, end]))
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [path], "docs": [len(writer.ids)], "ids": [writer.n_ids], "bytes": [writer.at]})

    manifest = rows.mapInArrow(write, MANIFEST).collect()  # a row for each file, of which there are as many as partitions at most
    return spark.createDataFrame([tuple(r) for r in sorted(manifest)], MANIFEST)


def read_planes(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files, each file read by one task in blocks."""
    listed = sorted(manifest.collect())
    bases, total = [], 0
    for r in listed:
        bases.append((r["part"], r["path"], r["bytes"], total))
        total += r["ids"]
    todo = spark.createDataFrame(bases, "part int, path string, bytes long, base long").repartition(max(1, len(bases)), "part")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for r in batch.to_pylist():
                files_at, at = fs.FileSystem.from_uri(r["path"])
                with files_at.open_input_file(at) as source:
                    out: list[tuple] = []
                    for doc_id, start, parts in Reader(source, r["bytes"]).documents():
                        crc = 0
                        for p in parts:
                            crc = zlib.crc32(p, crc)
                        out.append((doc_id, r["base"] + start, sum(map(len, parts)), crc))
                        if len(out) == 10_000:
                            yield _rows(out)
                            out = []
                    yield _rows(out)

    return todo.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])


def round_trip(df: DataFrame, tokenizer: str, end_id: int = 0, **options) -> DataFrame:
    """Write every text's ids to files and return what the files hold."""
    folder = new_folder(df.sparkSession, "planes")
    return read_planes(df.sparkSession, write_planes(df, tokenizer, folder, end_id, **options))
