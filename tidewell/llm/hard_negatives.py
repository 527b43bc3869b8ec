"""Hard-negative mining by a secondary sort of packed (anchor, descending score, id) keys.

Rows and anchors are dealt to a grid of cells by hash; a cell holds at most about
``CELL_ROWS`` rows and ``CELL_ANCHORS`` anchors, so every (anchor, row) pair is scored in
exactly one bounded task (a stated query set against all rows, in blocks). Scores are exact
integers. A cell sends on only what can still matter, which is the partial aggregation before
the shuffle:

1. its first ``positives`` same-label rows per anchor. Keys are sorted by
   ``repartitionAndSortWithinPartitions``; a streaming iterator keeps the first of each anchor.
2. with these positives known, its first ``negatives`` rows of every positive's score window.
   Positives and candidates are packed into keys (anchor, descending score, positive before
   negative, id) and sorted again; the iterator opens a window at each positive it meets and
   emits the negatives that fall into open windows, holding the windows only, never an anchor's
   rows. A window lies below its positive, or at the same score 0, so it is open in time.

Defined cases: rows with null id, null label or a vector that takes no part (vectors.usable)
are neither anchors nor candidates. Repeated rows are rows of their own: a second row of an
anchor's id is another row and another anchor. Ties go to the smaller id, then to input order.
Positives of negative score have an empty window. An empty table gives no rows. Scores beyond
long's range count as its nearest end. Other input columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm import vectors
from tidewell.llm.common import staged

CELL_ROWS = 8192
CELL_ANCHORS = 8192
SLICE_ANCHORS = 256         # anchors scored at once inside a cell
KEY = ">QQQBQQ"
SIGN = 1 << 63
POSITIVE, NEGATIVE = 0, 1
LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1


def pack(anchor: int, anchor_row: int, score: int, kind: int, id_: int, row: int) -> bytes:
    """Bytes that sort as (anchor id, anchor row, descending score, kind, id, row)."""
    return struct.pack(KEY, anchor + SIGN, anchor_row, LONG_MAX - score, kind, id_ + SIGN, row)


def unpack(key: bytes) -> tuple[int, int, int, int, int, int]:
    anchor, anchor_row, score, kind, id_, row = struct.unpack(KEY, key)
    return anchor - SIGN, anchor_row, LONG_MAX - score, kind, id_ - SIGN, row


def _scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products: through doubles while every sum stays under 2**53."""
    reach = [max(abs(int(m.min())), abs(int(m.max()))) if m.size else 0 for m in (a, x)]
    if a.shape[1] * reach[0] * reach[1] < 1 << 53:
        return (a.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    exact = a.astype(object) @ x.astype(object).T if a.shape[1] else np.zeros((len(a), len(x)), object)
    return np.clip(exact, LONG_MIN, LONG_MAX).astype(np.int64)


def _first(score: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The first ``k`` of the row numbers ``at`` (rising ids) by falling score, ties by id."""
    s = score[at]
    if len(at) > 4 * k:
        edge = np.partition(s, len(s) - k)[len(s) - k]
        at = at[s >= edge]
        s = score[at]
    return at[np.argsort(-s, kind="stable")[:k]] if len(at) else at


def _cell(d: int, choose):
    """Cogroup function: packed keys of the rows that ``choose`` picks for each anchor."""
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        keys: list[bytes] = []
        if anchors.num_rows and rows.num_rows:
            rows = rows.sort_by([("id", "ascending"), ("row", "ascending")])
            ids, uid = rows["id"].to_numpy(), rows["row"].to_numpy()
            a_ids, a_uid = anchors["id"].to_numpy(), anchors["row"].to_numpy()
            code: dict[str, int] = {}
            label = np.array([code.setdefault(v, len(code)) for v in rows["label"].to_pylist()])
            a_label = [code.setdefault(v, len(code)) for v in anchors["label"].to_pylist()]
            x, a = vectors.matrix(rows["q"], d, np.int64), vectors.matrix(anchors["q"], d, np.int64)
            known = anchors["known"].to_pylist()
            for begin in range(0, len(a), SLICE_ANCHORS):
                for i, score in enumerate(_scores(a[begin:begin + SLICE_ANCHORS], x), begin):
                    same = (label == a_label[i]) & (uid != a_uid[i])
                    for kind, at in choose(score, same, label != a_label[i], known[i]):
                        keys += [pack(int(a_ids[i]), int(a_uid[i]), int(score[p]), kind, int(ids[p]), int(uid[p]))
                                 for p in at]
        return pa.table({"key": pa.array(keys, pa.binary())})
    return run


def _meet(anchors: DataFrame, rows: DataFrame, grid: tuple[int, int], d: int, choose) -> DataFrame:
    """Keys chosen over all (anchor, row) pairs, cell by cell of the grid."""
    down, across = grid
    left = anchors.select("id", "row", "label", "q", "known", vectors.block_of("row", across).alias("h"),
                          F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("g"))
    right = rows.select("id", "row", "label", "q", vectors.block_of("row", down).alias("g"),
                        F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("h"))
    return left.groupBy("g", "h").cogroup(right.groupBy("g", "h")).applyInArrow(_cell(d, choose), "key binary")


def _anchor_hash(key: bytes) -> int:
    return zlib.crc32(key[:16])


def _sorted_keys(keys: DataFrame):
    """Secondary sort: an anchor's keys in one partition, in key order, spilled by Spark."""
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = keys.rdd.map(lambda r: (bytes(r[0]), None))
    return pairs.repartitionAndSortWithinPartitions(parts, _anchor_hash)


def mine(df: DataFrame, anchors: Column, id_column: str = "vec_id", vector_column: str = "embedding",
         label_column: str = "label", *, scale: int = 256, positives: int = 5, negatives: int = 10,
         low: int = 30, high: int = 90) -> DataFrame:
    """Per anchor (rows where ``anchors`` holds) and each of its first ``positives`` other rows of
    the same label, the first ``negatives`` rows of another label with
    low * positive_score <= 100 * negative_score <= high * positive_score: ``anchor_id``,
    ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``."""
    spark = df.sparkSession
    label = F.col(f"`{label_column}`")
    rows = vectors.usable(df.where(label.isNotNull() & F.col(f"`{id_column}`").isNotNull()), vector_column,
                          id=F.col(f"`{id_column}`").cast("long"), label=label.cast("string"), anchor=anchors)
    rows = staged(rows.select("id", "label", "anchor", vectors.quantised(scale).alias("q"),
                              F.monotonically_increasing_id().alias("row")))
    chosen = staged(rows.where("anchor").withColumn("known", F.lit(None).cast("array<long>")))
    sample = rows.first()
    d = len(sample["q"]) if sample else 0
    grid = (vectors.blocks(rows, CELL_ROWS), vectors.blocks(chosen, CELL_ANCHORS))

    def near_same(score, same, other, known):
        yield POSITIVE, _first(score, np.flatnonzero(same), positives)

    def first_of_anchor(keys) -> Iterator[tuple[bytes, int, int]]:
        current, taken = None, 0
        for key, _ in keys:
            if key[:16] != current:
                current, taken = key[:16], 0
            if taken < positives:
                taken += 1
                anchor_row, score = struct.unpack(KEY, key)[1:3]
                yield key, anchor_row, LONG_MAX - score

    found = _sorted_keys(_meet(chosen, rows, grid, d, near_same)).mapPartitions(first_of_anchor)
    found = staged(spark.createDataFrame(found, "key binary, row long, score long"))
    bounds = found.where("score >= 0").groupBy("row").agg(F.array_sort(F.collect_set("score")).alias("known"))
    open_anchors = staged(chosen.drop("known").join(bounds, "row"))

    def in_windows(score, same, other, known):
        picked: list[np.ndarray] = []
        for p in known:
            least, most = -((-low * p) // 100), (high * p) // 100
            at = np.flatnonzero(other & (score >= least) & (score <= most))
            picked.append(_first(score, at, negatives))
        yield NEGATIVE, np.unique(np.concatenate(picked))

    def windows(keys) -> Iterator[tuple[int, int, int, int, int, int]]:
        current, opened = None, []
        for key, _ in keys:
            if key[:16] != current:
                current, opened = key[:16], []
            anchor, _row, score, kind, id_, _uid = unpack(key)
            if kind == POSITIVE:
                opened.append([id_, score, 0])
                continue
            for w in opened:
                if w[2] < negatives and low * w[1] <= 100 * score <= high * w[1]:
                    w[2] += 1
                    yield anchor, w[0], w[2], id_, w[1], score

    candidates = _meet(open_anchors, rows, grid, d, in_windows)
    out = _sorted_keys(found.select("key").union(candidates)).mapPartitions(windows)
    return spark.createDataFrame(out, "anchor_id long, positive_id long, rank int, negative_id long, "
                                      "positive_score long, negative_score long")
