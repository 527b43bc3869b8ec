"""Whitening, hard negatives and nearest neighbours against brute force on small vector
tables with nulls, broken and odd-length vectors, ties, repeated rows, clashing columns."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import hard_negatives, neighbours, vectors, whitening
from tidewell.llm.common import importable

SCHEMA = ("vec_id long, embedding array<float>, label int, id long, vec string, x string, q string, row long, "
          "at int, known string, anchor string, near string, salt int, cell string")
CLASH = (1, "v", "x", "q", 2, 3, "k", "a", "n", 4, "c")


def table(dim=8, n=160, seed=3):
    rnd = random.Random(seed)
    rows = [(i, [float(np.float32(rnd.gauss(0, 1))) for _ in range(dim)], i % 3) for i in range(n)]
    hot = rows[7][1]
    rows += [(1000 + i, hot, i % 3) for i in range(80)]                    # a third are copies
    rows += [(5, rows[5][1], 2), (20, rows[20][1], 2), (100, rows[100][1], 0)]   # repeated ids
    rows += [(300, None, 1), (400, [1.0] * (dim - 1) + [None], 1), (500, [float("nan")] * dim, 1),
             (600, [float("inf")] + [0.0] * (dim - 1), 1), (700, [1.0] * (dim + 1), 1), (900, [0.0] * dim, 0),
             (None, [1.0] * dim, 1), (800, [0.5] * dim, None), (-100, [0.25] * dim, 1), (1200, [], 1)]
    return rows


def frame(spark, rows):
    importable(spark)
    return spark.createDataFrame([(*r, *CLASH) for r in rows], SCHEMA).repartition(4)


def kept(rows):
    dim = len(rows[0][1])
    return [r for r in rows if r[1] is not None and len(r[1]) == dim
            and all(c is not None and math.isfinite(c) for c in r[1])]


def quantise(v):
    return [math.floor(256 * c) for c in v]


def test_whitening_against_eigh(spark):
    rows = table()
    got = whitening.whiten(frame(spark, rows)).collect()
    good = kept(rows)
    x = np.array([quantise(r[1]) for r in good], dtype=np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    values, axes = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, axes = values[::-1], axes[:, ::-1]
    assert len(got) == 4 * len(good) and {r["n"] for r in got} == {n}
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-10
    expect = Counter()
    sign = {}
    first = next(r for r in good if r[0] == 0)
    for k in range(4):
        y = (np.array(quantise(first[1])) - s / n) @ axes[:, k] / math.sqrt(values[k])
        own = next(r["whitened"] for r in got if r["vec_id"] == 0 and r["component"] == k + 1)
        sign[k] = 1 if y * own > 0 else -1
    for r, q in zip(good, x):
        for k in range(4):
            y = sign[k] * ((q - s / n) @ axes[:, k]) / math.sqrt(values[k])
            expect[(r[0], k + 1, int(((n * q - s) ** 2).sum()), round(y, 8), round(values[k] / values.sum(), 10))] += 1
    assert Counter((r["vec_id"], r["component"], r["deviation"], round(r["whitened"], 8), round(r["explained"], 10))
                   for r in got) == expect


def test_whitening_rank_and_empty(spark):
    flat = frame(spark, [(i, [float(i), 2.0 * i, 1.0], 0) for i in range(6)])     # rank 1
    assert {r["component"] for r in whitening.whiten(flat).collect()} == {1}
    same = frame(spark, [(i, [1.0, 2.0], 0) for i in range(4)])
    none = frame(spark, [])
    for df in (same, none, frame(spark, [(1, None, 0), (2, [], 0)])):
        out = whitening.whiten(df)
        assert out.count() == 0
        assert dict(out.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint",
                                    "whitened": "double", "explained": "double", "identity_error": "double"}


def test_whitening_deviation_beyond_long(spark):
    df = frame(spark, [(1, [1e15, 0.0], 0), (2, [-1e15, 3.0], 0), (3, [1e30, 1.0], 0)])
    got = whitening.whiten(df).collect()
    assert {r["vec_id"] for r in got} == {1, 2, 3} and all(r["deviation"] is None for r in got)


@pytest.mark.parametrize("d", [1, 2, 5, 16, 33])
def test_cholesky_and_jacobi(d):
    rnd = np.random.RandomState(d)
    for rank in {1, max(1, d // 2), d}:
        b = rnd.randn(d, rank) * 10.0 ** rnd.uniform(-3, 3, rank)
        v = b @ b.T
        factor, order = whitening.pivoted_cholesky(v)
        assert np.allclose((factor @ factor.T)[np.ix_(np.argsort(order), np.argsort(order))], v, rtol=1e-12, atol=1e-12 * v.max())
        assert np.allclose(np.triu(factor, 1), 0)
        values, unit = whitening.eigen(v)
        assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:len(values)], rtol=1e-9, atol=1e-12 * v.max())
        assert np.allclose(unit.T @ unit, np.eye(len(values)), atol=1e-10)
        assert np.allclose(unit * values @ unit.T, v, atol=1e-10 * abs(v).max())


def mined(rows, rule, positives=5, negatives=10):
    """Brute force over row positions."""
    good = [(i, r[0], r[2], np.array(quantise(r[1]), dtype=object)) for i, r in enumerate(kept(rows))
            if r[0] is not None and r[2] is not None]
    out = Counter()
    for i, vid, label, v in good:
        if not rule(vid):
            continue
        scored = sorted((-int(v @ w), wid, k, wl) for k, wid, wl, w in good if k != i)
        pos = [s for s in scored if s[3] == label][:positives]
        for p in pos:
            neg = [s for s in scored if s[3] != label and 30 * -p[0] <= 100 * -s[0] <= 90 * -p[0]][:negatives]
            for rank, s in enumerate(neg, 1):
                out[(vid, p[1], rank, s[1], -p[0], -s[0])] += 1
    return out


@pytest.mark.parametrize("cell", [(8192, 8192), (50, 2)])
def test_hard_negatives_against_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(hard_negatives, "CELL_ROWS", cell[0])
    monkeypatch.setattr(hard_negatives, "CELL_ANCHORS", cell[1])
    rows = table()
    got = hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 20 == 0)
    want = mined(rows, lambda i: i % 20 == 0)
    assert want and Counter(tuple(r) for r in got.collect()) == want


def test_hard_negatives_zero_scores_few_rows_and_empty(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [0.0, 1.0], 1), (3, [-1.0, 0.0], 1), (-1, [0.0, 2.0], 1)]
    got = Counter(tuple(r) for r in hard_negatives.mine(frame(spark, rows), F.col("vec_id") == 0).collect())
    assert got == mined(rows, lambda i: i == 0) and sum(got.values()) == 2     # 0 <= score <= 0
    assert hard_negatives.mine(frame(spark, []), F.col("vec_id") == 0).count() == 0
    assert hard_negatives.mine(frame(spark, rows), F.lit(False)).count() == 0


def test_packed_keys_sort_as_specified():
    rnd = random.Random(1)
    keys = [(rnd.choice([-5, 0, 9]), rnd.randrange(3), rnd.choice([-(1 << 63), -7, 0, 7, (1 << 63) - 1]), rnd.randrange(2),
             rnd.choice([-(1 << 63), -1, 0, 1, (1 << 63) - 1]), rnd.randrange(4)) for _ in range(300)]
    packed = sorted(hard_negatives.pack(*k) for k in keys)
    assert [hard_negatives.unpack(p) for p in packed] == sorted(keys, key=lambda k: (k[0], k[1], -k[2], *k[3:]))


def nearest(rows, rule, k):
    good = [r for r in kept(rows) if r[0] is not None and any(r[1])]
    out = {}
    for i, r in enumerate(good):
        if rule(r[0]):
            scored = sorted((-sum(a * b for a, b in zip(r[1], s[1])), s[0]) for j, s in enumerate(good) if j != i)
            out.setdefault(r[0], []).append([(s[1], -s[0]) for s in scored[:k]])
    return out


def by_query(df):
    got = {}
    for r in df.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return got


@pytest.mark.parametrize("cell", [(1 << 15, 1 << 12), (16, 3)])
def test_neighbours_whole_search_equals_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(neighbours, "CELL_ROWS", cell[0])
    monkeypatch.setattr(neighbours, "CELL_QUERIES", cell[1])
    rows = table()                                       # under 256 distinct vectors: searched whole
    got = by_query(neighbours.search(frame(spark, rows), F.col("vec_id") % 20 == 0, k=20))
    want = nearest(rows, lambda i: i % 20 == 0, 20)
    assert set(got) == set(want)
    for q, lists in want.items():
        expect = Counter((n, i, round(s, 9)) for near in lists for n, (i, s) in enumerate(near, 1))
        assert Counter((n, i, round(s, 9)) for n, i, s in got[q]) == expect


def test_neighbours_recall_with_few_probes_and_mixed_norms(spark, monkeypatch):
    rnd = np.random.RandomState(4)
    rows = [(i, [float(np.float32(c)) for c in rnd.randn(24) * (100.0 if i % 50 == 0 else 1.0)], 0) for i in range(1500)]
    got = by_query(neighbours.search(frame(spark, rows), F.col("vec_id") % 20 == 0, k=20, seen=64))
    want = nearest(rows, lambda i: i % 20 == 0, 20)
    hits = sum(len({i for i, _ in want[q][0]} & {i for _, i, _ in got[q]}) for q in want)
    assert all(len(got[q]) == 20 for q in want) and hits >= 0.9 * 20 * len(want)


def test_neighbours_few_rows_and_empty(spark):
    rows = [(0, [1.0, 0.0, 0.5], 0), (20, [0.5, 1.0, 0.0], 0), (3, [-1.0, 0.0, 0.0], 0)]
    got = by_query(neighbours.search(frame(spark, rows), F.col("vec_id") % 20 == 0, k=20))
    assert {q: [(n, i) for n, i, _ in sorted(v)] for q, v in got.items()} == {0: [(1, 20), (2, 3)], 20: [(1, 0), (2, 3)]}
    for df in (frame(spark, []), frame(spark, [(0, [0.0, 0.0], 0)]), frame(spark, [(0, [1.0, 2.0], 0)])):
        out = neighbours.search(df, F.col("vec_id") % 20 == 0, k=20)
        assert out.count() == 0 and dict(out.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint",
                                                         "score": "double"}


def test_rotation_keeps_lengths_and_axes_cover():
    x = np.random.RandomState(0).randn(20, 12)
    y = neighbours.rotate(x, 1)
    assert y.shape == (20, 16) and np.allclose((y * y).sum(1), (x * x).sum(1))
    order = neighbours.axis_order(y)
    assert (order[:, 0] == neighbours.nearest_axis(y)).all() and (np.sort(order, 1) == np.arange(32)).all()


def test_usable_keeps_commonest_length(spark):
    df = frame(spark, [(1, [1.0], 0), (2, [1.0, 2.0], 0), (3, [2.0], 0), (4, [0.0, 2.0], 0)])
    assert sorted(r["id"] for r in vectors.usable(df, "embedding", id=F.col("vec_id")).collect()) == [1, 3]
