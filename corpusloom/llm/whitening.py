"""Embedding whitening: block subspace iteration on the covariance, which is never formed over all dimensions unless the block holds them all."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stage, map_arrow, stage

SCALE, SHIFT = 64, 1_000_000
LARGEST = 1 << 46  # entries from here on have no exact long in a double
OVERSAMPLING = 3  # the block holds so many times k columns besides the k
ROUNDS = 12  # without a certificate, then the block is doubled
_LOW = 26  # bits of the low part of a long in sums


@dataclass
class Whitening:
    """The fit: n distinct vectors with sums S (exact), components in columns by falling eigenvalue, their share of the trace, the error of the identity."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float
    passes: int

    @property
    def projection(self) -> np.ndarray:
        return self.components / np.sqrt(self.values)


def longs(column: str) -> Column:
    """floor(64*c)+1000000 of every entry, or null where the vector is null or empty or an entry is null, not finite, or of 2**46 or more."""
    entries = F.col(column).cast("array<double>")
    good = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float(LARGEST))))
    return F.when(good & (F.size(entries) > 0), F.transform(entries, lambda c: F.floor(c * F.lit(float(SCALE))) + F.lit(SHIFT)))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, width)


def off_mean(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n*x-S, exact: in longs where they can hold it, else in Python's integers."""
    most = max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0
    if n * most + max(map(abs, sums)) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def deviations(off: np.ndarray) -> list[int | None]:
    """The exact sum of squares of each row; None where a long can't hold it."""
    if off.dtype != object and (not off.size or int(np.abs(off).max()) ** 2 * off.shape[1] < 1 << 62):
        return (off * off).sum(axis=1).tolist()
    return [total if total < 1 << 63 else None for total in (sum(int(v) * int(v) for v in row) for row in off)]


def _sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """The number of rows and the exact sums of each dimension: a row for each dimension and task is shuffled."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            x = matrix(batch.column(0), width)
            if not len(x):
                return None
            total = [(int(h) << _LOW) + int(low) for h, low in zip((x >> _LOW).sum(axis=0), (x & ((1 << _LOW) - 1)).sum(axis=0), strict=True)]
            rows = [pa.array(range(width), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0)), pa.array([len(x)] * width, pa.int64())]
            return pa.RecordBatch.from_arrays(rows, ["i", "total", "n"])

        return each

    # a batch sums at most some thousands of rows, so its two parts stay within a long
    rows = map_arrow(fit, make, "i int, total decimal(38,0), n long").groupBy("i").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    by_place = {r.i: r for r in rows}
    return int(by_place[0].n), [int(by_place[i].total) for i in range(width)]


def _product(fit: DataFrame, n: int, sums: list[int], left: np.ndarray | None, right: np.ndarray) -> tuple[np.ndarray, float]:
    """One pass: (X left)'(X right)/n of the centred rows X (left None: the identity), and the trace of X'X/n. Tasks send one matrix each, which Spark sums."""
    width = len(sums)
    high, wide = (width if left is None else left.shape[1]), right.shape[1]

    def run(batches):
        total, squares = np.zeros((high, wide)), 0.0
        for batch in batches:
            x = matrix(batch.column(0), width)
            if len(x):
                c = off_mean(x, n, sums).astype(np.float64) / n
                squares += float(np.vdot(c, c))
                total += (c if left is None else c @ left).T @ (c @ right)
        rows = [pa.array(range(high + 1), pa.int32()), pa.array([*total.tolist(), [squares]], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(rows, ["i", "v"])

    parts = fit.mapInArrow(run, "i int, v array<double>").select("i", F.posexplode("v").alias("j", "v"))
    out, trace = np.zeros((high, wide)), 0.0
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        if r.i == high:
            trace = r.v / n
        else:
            out[r.i, r.j] = r.v / n
    return out, trace


def fit(embeddings: DataFrame, k: int = 16, column: str = "embedding", block: int | None = None) -> Whitening | None:
    """The first k unit eigenvectors of the covariance of the distinct vectors of longs, without forming that covariance.

    Each Spark pass computes X'(XQ)/n of the centred rows for a block Q of orthonormal columns (block, or four times k, at most all dimensions).
    Rayleigh-Ritz on it gives values, vectors and the residuals |Vq - eq|. Where all k residuals are at rounding, they certify the k components; else QR
    of the product is the next block. Where a block is not certified in ROUNDS passes, its columns are doubled; a block of all dimensions is exact, so
    this ends for spectra without gaps too. The driver holds a few matrices of dimensions x block.

    Vectors of another length than most distinct ones have (ties: the longer) are left out; None where no vector is left. Components without variance
    are left out, so fewer than k may come back.
    """
    distinct = embeddings.select(longs(column).alias("x")).where("x is not null").distinct()
    rows = stage(distinct, "whitening")
    most = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    if not most:
        drop_stage(rows)
        return None
    width = most[0].width
    same = rows.where(F.size("x") == width)
    n, sums = _sums(same, width)
    columns = min(width, block or (1 + OVERSAMPLING) * k)
    random = np.random.default_rng(20_11)
    q = np.linalg.qr(random.standard_normal((width, columns)))[0] if columns < width else np.eye(width)
    near, passes, since, k = 8 * np.finfo(float).eps * np.sqrt(width), 0, 0, min(k, width)
    while True:
        z, trace = _product(same, n, sums, None, q)
        passes, since = passes + 1, since + 1
        small = q.T @ z
        values, y = np.linalg.eigh((small + small.T) / 2)
        values, y = values[::-1][:k], y[:, ::-1][:, :k]
        components = q @ y
        residuals = np.linalg.norm(z @ y - components * values, axis=0)
        if q.shape[1] == width or residuals.max() <= near * max(values[0], 0):
            break
        if since == ROUNDS:
            more = min(width, 2 * q.shape[1]) - q.shape[1]
            z, since = np.hstack([z, random.standard_normal((width, more)) * np.linalg.norm(z, axis=0).mean()]), 0
        q = np.linalg.qr(z)[0]
    components /= np.linalg.norm(components, axis=0)
    kept = values > max(values[0], 0) * width * np.finfo(float).eps * 16
    components, values = components[:, kept], values[kept]
    found = Whitening(n, sums, components, values, trace, 0.0, passes)
    if len(values):
        covariance = _product(same, n, sums, found.projection, found.projection)[0]
        found.identity_error = float(np.abs(covariance - np.eye(len(values))).max())
    drop_stage(rows)
    return found


def whitened(embeddings: DataFrame, k: int = 16, column: str = "embedding", key: str = "vec_id", block: int | None = None) -> DataFrame:
    """Per row and component: the key, component, n, deviation, whitened, explained, identity_error; see fit().

    Rows whose vector is null or empty, holds null, non-finite entries or entries of 2**46 or more, or is of another length than the fit's, give none.
    Repeated rows are each given; the fit has each distinct vector once. deviation is null beyond a long. One vector, equal vectors, or an empty table give
    no rows, as there is no variance. Other columns are not read.
    """
    found = fit(embeddings, k, column, block)
    kind = embeddings.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if found is None or not len(found.values):
        return embeddings.sparkSession.createDataFrame([], schema)
    n, sums, projection, many = found.n, found.sums, found.projection, len(found.values)
    share, error = found.values / found.trace, found.identity_error

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            off = off_mean(matrix(batch.column(1), len(sums)), n, sums)
            rows = len(off)
            at = np.repeat(np.arange(rows), many)
            values = (off.astype(np.float64) / n) @ projection
            total = pa.array(deviations(off), pa.int64())
            cells = [batch.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), rows)), pa.array(np.full(rows * many, n)), total.take(pa.array(at)), pa.array(values.ravel()), pa.array(np.tile(share, rows)), pa.array(np.full(rows * many, error))]
            return pa.RecordBatch.from_arrays(cells, [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

        return each

    good = embeddings.select(F.col(key), longs(column).alias("x")).where(F.size("x") == len(sums))
    return map_arrow(good, make, schema)
