"""Documents in written blocks, and arrays of 64-bit keys as compressed binary values.

Operators whose keys are many times the words or bytes of the corpus deal them out packed: a row
is what one block of documents has for one bucket of keys. Spark partitions and shuffles those
rows; numpy sorts and counts inside them.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.llm.common import stored

#: Bytes of text in a block at most (one longer document is a block of its own), and per bucket.
BLOCK, BUCKET = 32_000_000, 16_000_000


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def buckets(total: int) -> int:
    return max(4, math.ceil(total / BUCKET))


def write_blocks(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """(block, payload): rows (doc_id, text, ...) in table order; written, so that a block's content is final."""

    def packed(k: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, parts[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            for part in parts:
                writer.write_batch(part)
        number = (TaskContext.get().partitionId() << 32) + k
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "payload"])

    def run(batches):
        k, waiting, held = 0, [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sizes = sum(len(t.as_py() or "") for t in part.column("text"))
                if held and held + sizes > size:
                    yield packed(k, waiting)
                    k, waiting, held = k + 1, [], 0
                waiting.append(part)
                held += sizes
        if waiting:
            yield packed(k, waiting)

    return stored(docs.mapInArrow(run, "block bigint, payload binary"), "blocks")


def open_block(payload: bytes):
    """The block's parts of up to 256 rows, one at a time."""
    with pa.ipc.open_stream(payload) as reader:
        for batch in reader:
            yield batch


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as bytes, byte planes together; the first may be sorted and is then stored as differences."""
    out = []
    for a in arrays:
        raw = np.ascontiguousarray(a)
        planes = raw.view(np.uint8).reshape(len(raw), raw.dtype.itemsize).T.tobytes()
        out.append(zlib.compress(planes, 1))
    head = np.array([len(arrays[0]), *map(len, out)], dtype="<u4").tobytes()
    return bytes([len(arrays)]) + head + b"".join(out)


def unsqueeze(blob: bytes, *kinds: str) -> list[np.ndarray]:
    n = blob[0]
    head = np.frombuffer(blob, "<u4", n + 1, 1)
    at, out = 1 + 4 * (n + 1), []
    for size, kind in zip(head[1:].tolist(), kinds):
        planes = np.frombuffer(zlib.decompress(blob[at : at + size]), np.uint8)
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(planes.reshape(width, int(head[0])).T).reshape(-1).view(kind))
        at += size
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit keys."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def deal(keys: np.ndarray, n: int, *rest: np.ndarray, by: np.ndarray | None = None):
    """(bucket, keys, rest...) for sorted keys, dealt by themselves or by `by`; inside a bucket they stay sorted."""
    to = (mix(keys if by is None else by) % np.uint64(n)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    cuts = np.searchsorted(to[order], np.arange(n + 1))
    for b in range(n):
        if cuts[b] < cuts[b + 1]:
            pick = order[cuts[b] : cuts[b + 1]]
            yield b, keys[pick], *[r[pick] for r in rest]


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with their counts added up."""
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k)
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.empty(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c
