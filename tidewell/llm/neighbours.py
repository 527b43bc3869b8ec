"""Approximate nearest neighbours by cross-polytope hashing.

Each of ``TABLES`` tables has a fast pseudo-rotation: three rounds of random signs and a
Walsh-Hadamard transform over the dimension padded to a power of two. A unit vector's bucket
in a table is the signed axis nearest to its rotation. A query visits the axes in the order of
nearness to its own rotation (multiprobe): at least ``PROBES`` (a share of all signed axes)
and on until ``SEEN`` vectors lie in the visited buckets, so small tables are searched whole.
Candidates are reranked by the inner product of the original vectors in double precision.

Vectors of different norms: buckets are kept per norm class (half octaves), and a query
visits every class, because the largest inner product depends on norm and direction.

Equal vectors form one class that keeps its ``k`` + 1 smallest ids (more can't be among a
query's ``k`` nearest); equal query vectors are searched once. Buckets are dealt to cells of
about ``CELL_ROWS`` vectors by their counted sizes: small buckets share a cell, a larger one is
split over several by hash. A cell meets its queries in blocks of about ``CELL_QUERIES`` and
sends on the first ``k`` + 1 per query only, so no pair list is shuffled and no group grows
with the input. Task closures hold the bucket sizes: norm classes (bounded by the exponents of
doubles) x tables x signed axes.

Defined cases: rows with null id, or a vector that is null, zero, broken or of another length
than most, are neither queries nor candidates. A query's own row is left out once; another row
with its id is a candidate. Repeated query rows repeat their results. Ties go to the smaller id.
An empty table gives no rows. Other input columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm import vectors
from tidewell.llm.common import staged

TABLES = 4
PROBES = 0.25               # least share of a table's signed axes that a query visits
SEEN = 256                  # least number of vectors in the buckets it visits, per norm class
CELL_ROWS = 1 << 15
CELL_QUERIES = 1 << 12
SLICE_QUERIES = 512
SALTS = 8
SEED = 20


def signs(table: int, width: int) -> np.ndarray:
    """Random signs of a table's three rounds."""
    return np.random.RandomState(SEED + table).choice([-1.0, 1.0], (3, width))


def rotate(x: np.ndarray, table: int) -> np.ndarray:
    """Pseudo-rotation of the rows of ``x``, padded with zeros to a power of two."""
    width = 1 << max(0, (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), width))
    y[:, :x.shape[1]] = x
    for flips in signs(table, width):
        y *= flips
        step = 1
        while step < width:
            v = y.reshape(len(y), -1, 2, step)
            y = np.concatenate([v[:, :, :1] + v[:, :, 1:], v[:, :, :1] - v[:, :, 1:]], axis=2).reshape(len(y), -1)
            step *= 2
        y /= np.sqrt(width)
    return y


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows at length one, and their norms as logarithms of base 2 (safe at any exponent)."""
    top = np.abs(x).max(axis=1, initial=0.0)
    top = np.where(top > 0, top, 1.0)
    y = x / top[:, None]
    size = np.sqrt((y * y).sum(1))
    size = np.where(size > 0, size, 1.0)
    return y / size[:, None], np.log2(top) + np.log2(size)


def nearest_axis(y: np.ndarray) -> np.ndarray:
    """Number of the nearest signed axis: 2 * axis, plus 1 on its negative side."""
    axis = np.abs(y).argmax(1)
    return 2 * axis + (y[np.arange(len(y)), axis] < 0)


def axis_order(y: np.ndarray) -> np.ndarray:
    """Signed axes of each row from nearest to farthest."""
    both = np.stack([y, -y], axis=2).reshape(len(y), -1)
    return np.argsort(-both, axis=1, kind="stable")


def _classes(rows: DataFrame, k: int) -> DataFrame:
    """Distinct vectors with their k + 1 smallest ids; Spark limits each group before it shuffles."""
    first = Window.partitionBy("vec").orderBy("id")
    few = rows.withColumn("at", F.row_number().over(first)).where(F.col("at") <= k + 1)
    return few.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def _dim(df: DataFrame) -> int:
    got = df.first()
    return len(got["vec"]) if got else 0


class Layout:
    """Cells of the buckets, from their counted sizes: key (norm class, table)."""

    def __init__(self, counts: list, axes: int):
        self.sizes: dict[tuple[int, int], np.ndarray] = {}
        for r in counts:
            self.sizes.setdefault((r["norm"], r["tab"]), np.zeros(axes, np.int64))[r["axis"]] = r["count"]
        self.first: dict[tuple[int, int], np.ndarray] = {}       # first cell of an axis
        self.parts: dict[tuple[int, int], np.ndarray] = {}       # cells it is split over
        cell = 0
        for key in sorted(self.sizes):
            first, parts, filled = np.zeros(axes, np.int64), np.ones(axes, np.int64), 0
            for axis, size in enumerate(self.sizes[key]):
                if filled and filled + size > CELL_ROWS:
                    cell, filled = cell + 1, 0
                first[axis], parts[axis] = cell, max(1, -(-int(size) // CELL_ROWS))
                filled += int(size)
                if parts[axis] > 1:
                    cell, filled = cell + int(parts[axis]), 0
            self.first[key], self.parts[key] = first, parts
            cell += 1

    def probes(self, key: tuple[int, int], order: np.ndarray, share: float, seen: int) -> np.ndarray:
        """Which signed axes each query visits (boolean matrix)."""
        sizes = self.sizes[key]
        before = np.cumsum(sizes[order], axis=1) - sizes[order]
        rank = np.arange(order.shape[1])
        near = (rank < share * order.shape[1]) | (before < seen)
        out = np.zeros(order.shape, bool)
        np.put_along_axis(out, order, near, 1)
        return out & (sizes > 0)


def _buckets(d: int):
    """Norm class, table and nearest signed axis of each distinct vector, a row per table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, size = unit(vectors.matrix(b.column("vec"), d))
            norm = np.rint(2 * size).astype(np.int32)
            for t in range(TABLES):
                axis = nearest_axis(rotate(x, t)).astype(np.int32)
                yield pa.record_batch({"class": b.column("class"), "norm": pa.array(norm),
                                       "tab": pa.array(np.full(len(x), t, np.int32)), "axis": pa.array(axis)})
    return run


def _members(d: int, layout: Layout, blocks: int):
    """Distinct vectors sent to their cell of every table, once per block of queries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, size = unit(vectors.matrix(b.column("vec"), d))
            norm = np.rint(2 * size).astype(int)
            spread = b.column("class").to_numpy() * 2654435761 % (1 << 32)
            for t in range(TABLES):
                axis = nearest_axis(rotate(x, t))
                cell = np.array([layout.first[n, t][a] + s % layout.parts[n, t][a]
                                 for n, a, s in zip(norm.tolist(), axis.tolist(), spread.tolist())], np.int64)
                for h in range(blocks):
                    yield pa.record_batch([pa.array(cell), pa.array(np.full(len(x), h, np.int32)),
                                           pa.array(axis.astype(np.int32)), b.column("class"), b.column("ids"),
                                           b.column("vec")], names=["cell", "h", "axis", "class", "ids", "vec"])
    return run


def _probes(d: int, layout: Layout, share: float, seen: int):
    """Queries sent to every cell that holds one of their visited buckets, with those axes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, _ = unit(vectors.matrix(b.column("vec"), d))
            for key in layout.sizes:
                visit = layout.probes(key, axis_order(rotate(x, key[1])), share, seen)
                row, axis = np.nonzero(visit)
                first, parts = layout.first[key][axis], layout.parts[key][axis]
                row, axis = np.repeat(row, parts), np.repeat(axis, parts)
                cell = np.repeat(first, parts) + np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                by = np.lexsort((axis, row, cell))
                row, axis, cell = row[by], axis[by], cell[by]
                start = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(cell) != 0)][:len(row)])
                take = pa.array(row[start])
                axes = pa.ListArray.from_arrays(pa.array(np.r_[start, len(row)], pa.int32()),
                                                pa.array(axis.astype(np.int32)))
                yield pa.record_batch([pa.array(cell[start]), b.column("h").take(take), b.column("query").take(take),
                                       axes, b.column("vec").take(take)],
                                      names=["cell", "h", "query", "axes", "vec"])
    return run


def _rerank(d: int, k: int):
    """Cogroup function of a cell: exact scores of the members in each query's visited buckets,
    the first k + 1 kept."""
    def run(queries: pa.Table, members: pa.Table) -> pa.Table:
        out = {"query": [], "class": [], "score": [], "at": []}
        ids = pa.chunked_array([], pa.list_(pa.int64()))
        if queries.num_rows and members.num_rows:
            members = members.append_column("least", pa.array([v[0] for v in members["ids"].to_pylist()], pa.int64()))
            members = members.sort_by([("least", "ascending"), ("class", "ascending")])
            axis, x = members["axis"].to_numpy(), vectors.matrix(members["vec"], d)
            q_all, qid = vectors.matrix(queries["vec"], d), queries["query"].to_numpy()
            visited = queries["axes"].to_pylist()
            of_axis = {a: np.flatnonzero(axis == a) for a in np.unique(axis).tolist()}
            klass = members["class"].to_numpy()
            for begin in range(0, len(qid), SLICE_QUERIES):
                q = q_all[begin:begin + SLICE_QUERIES]
                score = np.full((len(q), len(x)), -np.inf)
                asks: dict[int, list[int]] = {}
                for i, axes in enumerate(visited[begin:begin + SLICE_QUERIES]):
                    for a in axes:
                        asks.setdefault(a, []).append(i)
                hit = np.zeros((len(q), len(x)), bool)
                for a, who in asks.items():
                    at = of_axis.get(a)
                    if at is not None:
                        score[np.ix_(who, at)] = q[who] @ x[at].T
                        hit[np.ix_(who, at)] = True
                for i in range(len(q)):
                    at = np.flatnonzero(hit[i])
                    s = score[i, at]
                    if len(at) > 2 * k + 2:
                        edge = np.partition(s, len(s) - k - 1)[len(s) - k - 1]
                        at = at[s >= edge - 1e-9 * abs(edge)]
                    exact = np.zeros(len(at))
                    for j in range(d):                     # left to right: the same sum in every cell
                        exact += q[i, j] * x[at, j]
                    best = np.argsort(-exact, kind="stable")[:k + 1]
                    out["query"].append(np.full(len(best), qid[begin + i]))
                    out["class"].append(klass[at[best]])
                    out["score"].append(exact[best])
                    out["at"].append(at[best])
            ids = members["ids"].take(pa.array(np.concatenate(out["at"])))
        none = np.array([], np.int64)
        return pa.table({"query": np.concatenate(out["query"]) if out["query"] else none,
                         "class": np.concatenate(out["class"]) if out["class"] else none,
                         "score": np.concatenate(out["score"]) if out["score"] else none.astype(float), "ids": ids})
    return run


def search(df: DataFrame, queries: Column, k: int = 20, id_column: str = "vec_id",
           vector_column: str = "embedding", *, probes: float = PROBES, seen: int = SEEN) -> DataFrame:
    """The ``k`` nearest found of each row where ``queries`` holds, by inner product, among all
    other rows: ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``."""
    rows = vectors.usable(df.where(F.col(f"`{id_column}`").isNotNull()), vector_column,
                          id=F.col(f"`{id_column}`").cast("long"), asks=queries)
    rows = staged(rows.where(F.exists("vec", lambda x: x != 0)).select("id", "asks", "vec"))
    d = _dim(rows)
    classes = staged(_classes(rows, k).withColumn("class", F.monotonically_increasing_id()))
    asked = staged(rows.where("asks").select("vec").distinct()
                   .withColumn("query", F.monotonically_increasing_id()))
    axes = 2 << max(0, (d - 1).bit_length())
    counts = (classes.select("class", "vec").mapInArrow(_buckets(d), "class long, norm int, tab int, axis int")
              .groupBy("norm", "tab", "axis").count().collect())
    layout = Layout(counts, axes)
    blocks = vectors.blocks(asked, CELL_QUERIES)
    vec = dict(rows.dtypes)["vec"]
    members = classes.mapInArrow(_members(d, layout, blocks),
                                 f"cell long, h int, axis int, class long, ids array<long>, vec {vec}")
    visits = (asked.withColumn("h", vectors.block_of("query", blocks))
              .mapInArrow(_probes(d, layout, probes, seen), f"cell long, h int, query long, axes array<int>, vec {vec}"))
    found = (visits.groupBy("cell", "h").cogroup(members.groupBy("cell", "h"))
             .applyInArrow(_rerank(d, k), "query long, class long, score double, ids array<long>"))
    # a class met in several tables or norm classes once; then the first k + 1 ids of each query
    best = Window.partitionBy("query").orderBy(F.desc("score"), "least", "class")
    found = (found.groupBy("query", "class").agg(F.max("score").alias("score"), F.first("ids").alias("ids"))
             .withColumn("least", F.col("ids")[0])
             .withColumn("at", F.row_number().over(best)).where(F.col("at") <= k + 1))
    found = found.select("query", "score", F.explode("ids").alias("id"))
    nearest = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    found = found.withColumn("at", F.row_number().over(nearest)).where(F.col("at") <= k + 1)
    lists = (found.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("at", "id", "score"))).alias("near"))
             .join(asked, "query").select("vec", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), "near"))
    asking = rows.where("asks").select("id", "vec", block_salt("id"))
    # the row itself leaves its list once; without it in the list, the list ends one later than needed
    own = F.array_position(F.transform("near", lambda p: p["id"]), F.col("id"))
    kept = F.slice(F.when(own > 0, F.filter("near", lambda p, i: i != own - 1)).otherwise(F.col("near")), 1, k)
    out = asking.join(lists, ["vec", "salt"]).select(F.col("id").alias("query_id"), F.posexplode(kept).alias("at", "p"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("p.id").alias("vec_id"), F.col("p.score").alias("score"))


def block_salt(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int").alias("salt")
