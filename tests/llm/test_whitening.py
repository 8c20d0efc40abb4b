"""Whitening against numpy's eigenvectors of the whole covariance, and exact sums against Python's integers."""

import math

import numpy as np
import pytest

from corpusloom.llm import whitening
from corpusloom.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, component int, x string"
SF = "/root/testdata/sf0.01"


def brute(vectors, k):
    """x vectors, n, S and the first k values and vectors, from integers."""
    good = [(i, v) for i, v in vectors if v and all(c is not None and math.isfinite(c) and abs(c) < 2**46 for c in v)]
    xs = [(i, tuple(math.floor(64 * c) + 1000000 for c in v)) for i, v in good]
    distinct = sorted({x for _, x in xs})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct, strict=True)]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, sums, strict=True)] for x in distinct])
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    return xs, n, sums, cov, values[::-1][:k], vectors[:, ::-1][:, :k]


def compare(rows, vectors, k, tolerance=1e-7):
    xs, n, sums, cov, values, axes = brute(vectors, k)
    many = int((values > values[0] * 1e-12).sum())
    assert len(rows) == len(xs) * many
    by_key = {}
    for r in rows:
        by_key.setdefault((r.vec_id, r.component), []).append(r)
    signs = {}
    for i, x in xs:
        off = [n * c - s for c, s in zip(x, sums, strict=True)]
        for j in range(many):
            r = by_key[i, j + 1][0]
            assert r.n == n and r.deviation == sum(o * o for o in off)
            assert abs(r.explained / (values[j] / np.trace(cov)) - 1) < 1e-9 and r.identity_error < 1e-9
            want = float(np.array([o / n for o in off]) @ axes[:, j] / math.sqrt(values[j]))
            if abs(want) > 1e-3:
                assert signs.setdefault(j, math.copysign(1, want * r.whitened)) == math.copysign(1, want * r.whitened)
            assert abs(abs(want) - abs(r.whitened)) < tolerance


def test_small_table_with_odd_rows(spark):
    r = np.random.default_rng(5)
    base = (r.standard_normal((60, 6)) * [5, 4, 3, 2, 1, 0.5]).astype(np.float32)
    vectors = [(i, v.tolist()) for i, v in enumerate(base)]
    vectors += [(100, vectors[0][1]), (101, vectors[0][1]), (102, None), (103, []), (104, [None] + [1.0] * 5), (105, [float("nan")] * 6), (106, [float("inf")] + [0.0] * 5), (107, [1e30] + [0.0] * 5)]
    odd = [(200, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 9, "x") for i, v in vectors + odd], SCHEMA)
    rows = whitening.whitened(df, k=4).collect()
    compare(rows, vectors, 4)
    assert {r.vec_id for r in rows} == {*range(60), 100, 101}


def test_large_entries_are_exact(spark):
    vectors = [(i, [float(2**45 - 3 * i * i), float(-(2**40)) * i, 0.25 * i]) for i in range(9)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    rows = {(r.vec_id, r.component): r for r in whitening.whitened(df, k=2).collect()}
    _, n, sums, *_ = brute(vectors, 2)
    assert n == 9 and sums[0] == sum(math.floor(64 * v[0]) + 1000000 for _, v in vectors)
    assert rows[0, 1].deviation is None  # beyond a long
    assert whitening.deviations(np.array([[3 << 29, 1], [1, 2]], object)) == [(9 << 58) + 1, 5]


def test_iterated_blocks(spark):
    """Fewer columns than dimensions: certified by residuals with a falling spectrum; doubled to the end with a flat one."""
    r = np.random.default_rng(6)
    falling = (r.standard_normal((300, 40)) * (8.0 * 0.6 ** np.arange(40) + 0.05)).astype(np.float32)
    vectors = [(i, v.tolist()) for i, v in enumerate(falling)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    found = whitening.fit(df, 3, block=12)
    assert 2 < found.passes <= whitening.ROUNDS
    compare(whitening.whitened(df, 3, block=12).collect(), vectors, 3)
    flat = [(i, v.tolist()) for i, v in enumerate(r.standard_normal((120, 20)).astype(np.float32))]
    compare(whitening.whitened(spark.createDataFrame(flat, "vec_id long, embedding array<float>"), 3, block=4).collect(), flat, 3)


def test_no_variance_and_no_rows(spark):
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert whitening.whitened(same).collect() == [] == whitening.whitened(same.limit(0)).collect()
    line = spark.createDataFrame([(None, [1.0, 2.0]), (2, [3.0, 4.0])], "vec_id long, embedding array<float>")
    rows = whitening.whitened(line).collect()
    assert [r.component for r in rows] == [1, 1] and sorted(round(r.whitened, 9) for r in rows) == [-1.0, 1.0] and {r.vec_id for r in rows} == {None, 2}


def test_whole_table(spark):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    found = QUERIES["op11_whitening"](spark, SF)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    compare(found.collect(), vectors, 16, 1e-6)


@pytest.mark.parametrize("kind", ["float64", "object"])
def test_off_mean_kinds(kind):
    x = np.array([[5, 1 << 40]], np.int64)
    n = 3 if kind == "float64" else 1 << 40
    assert whitening.off_mean(x, n, [1, 2]).tolist() == [[5 * n - 1, (n << 40) - 2]]
