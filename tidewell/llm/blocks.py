"""Packed text blocks and packed key exchange.

``pack`` writes documents once, in compressed blocks of about ``BLOCK_BYTES`` of text that
keep their number for the rest of the job. Operators that need a global fact about every
k-mer or word of a block then send one row per (bucket, block) holding the block's distinct
keys, instead of one row per occurrence: the keys of a bucket meet in one task (each block
contributes a key once, so no key is hot), and one row per (bucket, block) travels back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import importable, staged, text_slices

BLOCK_BYTES = 8 << 20
KEYS_PER_BUCKET = 1 << 20


def pack(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """(block, n_bytes, data): documents in blocks; data holds id and text (and
    the columns ``more``), sorted by id (null ids last), as a compressed Arrow stream."""
    importable(docs.sparkSession)

    def blocks(batches):
        part = TaskContext.get().partitionId()
        for k, b in enumerate(merged(text_slices(batches, "text", BLOCK_BYTES), BLOCK_BYTES)):
            b = pa.Table.from_batches([b]).sort_by([("id", "ascending")]).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(b)
            size = int(pc.sum(pc.binary_length(b.column("text"))).as_py() or 0)
            yield pa.RecordBatch.from_arrays([pa.array([f"{part:08d}-{k:06d}"]), pa.array([size], pa.int64()),
                                              pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                                             ["block", "n_bytes", "data"])
    return staged(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *more)
                  .mapInArrow(blocks, "block string, n_bytes long, data binary"))


def merged(batches, size: int):
    """Join small record batches until they hold about ``size`` bytes."""
    held, total = [], 0
    for b in batches:
        if held and total + b.nbytes > size * 1.25:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, total = [], 0
        held.append(b)
        total += b.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def unpack(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(data)).read_all().combine_chunks()


def squeeze(*arrays: np.ndarray) -> bytes:
    """Compress equally long integer arrays; each is stored as byte planes of its
    differences, so sorted and small values take little room."""
    out = [np.array([len(arrays), len(arrays[0])], dtype=np.int64).tobytes()]
    for a in arrays:
        code = np.frombuffer(a.dtype.str.encode().ljust(8), dtype=np.uint8)
        d = a.copy()
        d[1:] = a[1:] - a[:-1]
        out += [code.tobytes(), np.ascontiguousarray(d.view(np.uint8).reshape(len(a), -1).T).tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unsqueeze(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    k, n = np.frombuffer(raw, np.int64, 2)
    at, out = 16, []
    for _ in range(k):
        kind = np.dtype(raw[at:at + 8].decode().strip())
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at + 8).reshape(kind.itemsize, n)
        d = np.ascontiguousarray(planes.T).view(kind).reshape(n)
        out.append(np.cumsum(d, dtype=kind))
        at += 8 + int(n) * kind.itemsize
    return out


def bucket_count(units: int, per_unit: float) -> int:
    """Buckets so that one holds about KEYS_PER_BUCKET keys (grows with the input)."""
    return int(max(16, -(-int(units * per_unit) // KEYS_PER_BUCKET)))


def dealt(block: str, keys: np.ndarray, buckets: int, *more: np.ndarray, by: np.ndarray | None = None):
    """(bucket, order) pairs of sorted-by-bucket keys as a batch of (bucket, block, data)."""
    b = ((keys if by is None else by) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    edges = np.searchsorted(b[order], np.arange(buckets + 1))
    at = [k for k in range(buckets) if edges[k] < edges[k + 1]]
    parts = [order[edges[k]:edges[k + 1]] for k in at]
    return pa.RecordBatch.from_arrays(
        [pa.array(at, pa.int64()), pa.array([block] * len(at), pa.string()),
         pa.array([squeeze(keys[p], *[m[p] for m in more]) for p in parts], pa.binary())],
        ["bucket", "block", "data"])


def collected(answers: pa.Table, keys: np.ndarray, buckets: int, by: np.ndarray | None = None) -> list[np.ndarray]:
    """The answers of a block put back in the order of its keys (the order ``dealt`` used)."""
    b = ((keys if by is None else by) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    got = sorted(zip(answers["bucket"].to_pylist(), answers["data"].to_pylist()))
    parts = [unsqueeze(d) for _, d in got]
    if not parts:
        return []
    out = []
    for col in zip(*parts):
        col = np.concatenate(col)
        back = np.empty_like(col)
        back[order] = col
        out.append(back)
    return out


REQUEST = "bucket long, block string, data binary"
ANSWER = "bucket long, block string, data binary"


def answers(requests: DataFrame, merge) -> DataFrame:
    """Run ``merge(list of columns with the row's block number, blocks)`` once per bucket.

    ``merge`` gets the concatenated arrays and the index of the block each key came from and
    returns arrays aligned with them; they are cut up again and sent back to their blocks."""
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("block", "ascending")])
        parts = [unsqueeze(d) for d in t["data"].to_pylist()]
        size = [len(p[0]) for p in parts]
        cols = [np.concatenate(c) for c in zip(*parts)]
        back = merge(cols, np.repeat(np.arange(len(parts)), size))
        cut = np.cumsum([0, *size])
        return pa.table({"bucket": t["bucket"], "block": t["block"],
                         "data": pa.array([squeeze(*[c[a:b] for c in back]) for a, b in zip(cut[:-1], cut[1:])],
                                          pa.binary())})
    return requests.groupBy("bucket").applyInArrow(run, ANSWER)
