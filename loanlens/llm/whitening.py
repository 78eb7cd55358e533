"""Embedding whitening: components of a distributed covariance, refined to double precision.

Tasks add up counts, sums and centred products of their vectors; the driver sees sums of one
row a dimension.  The covariance's eigenvectors are found in float32 and corrected by the
iterations of Ogita and Aishima, which are matrix products in higher precision and square the
error each time.  Eigenvalues too close for the current error to part are a cluster: its
vectors are turned by the eigenvectors of the small matrix that the covariance is inside the
cluster, and the iterations go on.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Components returned; an entry c becomes floor(SCALE * c) + SHIFT.
COMPONENTS, SCALE, SHIFT = 32, 64, 1_000_000
#: Entries beyond this (after SCALE) are held at it, so that they stay whole numbers of 64 bits.
LIMIT = 1 << 60
#: A component with less than this share of the variance can't be told from rounding: there is nothing to scale it by.
NO_VARIANCE = 1e-10
#: Rows that a task handles at once.
ROWS = 4096

#: What products and sums of the refinement are done in; 64 bits of mantissa on x86.
HIGH = np.longdouble


def refine(a: np.ndarray, x: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors of the symmetric ``a`` from approximate ones in the columns of ``x``.

    A round computes how far x is from orthogonal and from diagonalising a, and corrects both:
    entry (i, j) of the correction divides by the gap of the eigenvalues.  Where the gap is not
    larger than the error (a cluster), only orthogonality is corrected, and the cluster's block
    is solved by itself, with its mean eigenvalue taken off first so that no digits are lost.
    """
    a, x = a.astype(HIGH), x.astype(HIGH)
    eye = np.eye(len(a), dtype=HIGH)
    norm = max(float(np.abs(a).sum(axis=1).max()), np.finfo(float).tiny)
    value = np.zeros(len(a), HIGH)
    best = np.inf
    for _ in range(rounds):
        r = eye - x.T @ x
        s = x.T @ a @ x
        value = np.diag(s) / (1 - np.diag(r))
        order = np.argsort(-value, kind="stable")
        x, r, s, value = x[:, order], r[np.ix_(order, order)], s[np.ix_(order, order)], value[order]
        off = s - np.diag(value)
        error = float(np.sqrt((off ** 2).sum()) + norm * np.sqrt((r ** 2).sum()))
        gap = value[None, :] - value[:, None]
        close = np.abs(gap) <= 2 * error
        e = np.where(close, r / 2, (s + value[None, :] * r) / np.where(close, 1, gap))
        x = x + x @ e
        for first, last in clusters(value, 2 * error):
            x = solve_cluster(a, x, first, last)
        if error >= best / 2 and best < 1e-8 * norm:  # rounding is reached
            break
        best = min(best, error)
    x = x + x @ (eye - x.T @ x) / 2  # a cluster's turn is known to a double's digits only
    value = np.diag(x.T @ a @ x)
    order = np.argsort(-value, kind="stable")
    x = x / np.sqrt((x ** 2).sum(axis=0))
    return value[order].astype(float), x[:, order].astype(float)


def clusters(value: np.ndarray, width: float) -> list[tuple[int, int]]:
    """Runs (first, past the last) of falling values whose neighbours are at most ``width`` apart."""
    cut = np.flatnonzero(value[:-1] - value[1:] > width) + 1
    edge = [0, *cut.tolist(), len(value)]
    return [(i, j) for i, j in zip(edge, edge[1:]) if j - i > 1]


def solve_cluster(a: np.ndarray, x: np.ndarray, first: int, last: int) -> np.ndarray:
    """``x`` with columns first to last turned into eigenvectors inside the space that they span."""
    v = x[:, first:last]
    mean = np.trace(v.T @ a @ v) / (last - first)
    inner = v.T @ (a @ v - mean * v)
    size = float(np.abs(inner).max())
    if size:
        turn = np.linalg.eigh(((inner + inner.T) / (2 * size)).astype(float))[1][:, ::-1]
        x = x.copy()
        x[:, first:last] = v @ turn.astype(HIGH)
    return x


def components(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of a covariance: float32 first, then refined."""
    size = float(np.abs(a).max()) if a.size else 0.0
    if not size:
        return np.zeros(len(a)), np.eye(len(a))
    value, x = refine(a / size, np.linalg.eigh((a / size).astype(np.float32))[1])
    return value * size, x


def whole(column: pa.Array, dim: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows that take part (vectors without null or non-finite entries, of ``dim`` entries), and their floor(SCALE * c) + SHIFT."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.asarray(pc.fill_null(pc.list_value_length(column), -1), np.int64)
    rows = np.flatnonzero(size == dim) if dim is not None else np.flatnonzero(size > 0)
    if not len(rows):
        return rows, np.zeros((0, dim or 0), np.int64)
    flat = column.take(pa.array(rows)).flatten()
    entries = np.asarray(pc.fill_null(flat.cast(pa.float64()), np.nan), np.float64)
    if dim is None:  # only which rows are whole
        ends = np.cumsum(size[rows])
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(entries))])
        return rows[bad[ends] == bad[ends - size[rows]]], np.zeros((0, 0), np.int64)
    entries = entries.reshape(len(rows), dim)
    fine = np.isfinite(entries).all(axis=1)
    with np.errstate(over="ignore"):
        scaled = np.clip(np.floor(SCALE * entries[fine]), -float(LIMIT), float(LIMIT))
    return rows[fine], scaled.astype(np.int64) + SHIFT


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


def dimension(vectors: DataFrame) -> int:
    """The length that most whole vectors have (the longer of equally frequent ones); 0 without any."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter()
        for batch in _slices(batches):
            column = batch.column("v")
            rows, _ = whole(column, None)
            seen.update(np.asarray(pc.list_value_length(column.take(pa.array(rows))), np.int64).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["d", "n"])

    counted = vectors.mapInArrow(lengths, "d long, n long").groupBy("d").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), F.desc("d")).first()
    return top.d if top else 0


def sums(vectors: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of vectors and, for each dimension, the sum of the whole numbers, exactly."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dim, object), np.zeros(dim, np.int64)
        for batch in _slices(batches):
            x = whole(batch.column("v"), dim)[1]
            n += len(x)
            # 30 bits at a time, as a column of large entries may not fit in 64 bits
            high = high + (x >> 30).sum(axis=0).astype(object)
            low += (x & ((1 << 30) - 1)).sum(axis=0)
        total = [(int(h) << 30) + int(b) for h, b in zip(high, low)]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, dim), pa.int64()), pa.array([n, *total], pa.decimal128(38, 0))], ["i", "s"])

    rows = vectors.mapInArrow(add, "i long, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()  # one row a dimension
    total = {r.i: int(r.s) for r in rows}
    return total.get(-1, 0), [total.get(i, 0) for i in range(dim)]


def centred(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """x - s / n in doubles: whole numbers first, so that a large common part costs no digits."""
    floor = np.array([v // n for v in s], np.int64)
    rest = np.array([(v % n) / n for v in s])
    return (x - floor).astype(float) - rest


def product(vectors: DataFrame, dim: int, width: int, of) -> np.ndarray:
    """Sum over all rows of m.T @ m, where m = ``of`` (whole numbers of some rows) has ``width`` columns.

    A task sends one row for each column, whatever it has read; a row of the sum is added up in
    order of the tasks, so reruns agree.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros((width, width))
        for batch in _slices(batches):
            m = of(whole(batch.column("v"), dim)[1])
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int64()), pa.array([TaskContext.get().partitionId()] * width, pa.int64()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "task", "row"])

    def add_rows(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("task")["row"]
        return pd.DataFrame({"i": group["i"].iloc[:1], "row": [np.sum(np.stack(rows.to_list()), axis=0)]})

    out = np.zeros((width, width))
    for r in vectors.mapInArrow(add, "i long, task long, row array<double>").groupBy("i").applyInPandas(add_rows, "i long, row array<double>").collect():
        out[r.i] = r.row
    return out


def deviations(x: np.ndarray, n: int, s: list[int]) -> list[int]:
    """Sum over the dimensions of (n * x - s) ** 2 of each row, exactly."""
    floor, rest = np.array([v // n for v in s], np.int64), [v % n for v in s]
    y = x - floor
    most, dim = float(np.abs(y).max()) if y.size else 0.0, max(1, x.shape[1])
    if (most + 1) * n * dim ** 0.5 < 1 << 31:
        return ((n * y - np.array(rest, np.int64)) ** 2).sum(axis=1).tolist()
    if most < 1 << 24 and n < 1 << 48 and dim < 1 << 14:
        # (n * y - rest)**2 = n**2 * y**2 - 2 * n * y * rest + rest**2; the sums of y**2 and y * rest in parts that fit
        low, high = (np.array([f(r) for r in rest], np.int64) for f in (lambda r: r & ((1 << 24) - 1), lambda r: r >> 24))
        squares = sum(r * r for r in rest)
        return [n * n * a - 2 * n * ((h << 24) + b) + squares for a, b, h in zip((y * y).sum(axis=1).tolist(), (y @ low).tolist(), (y @ high).tolist())]
    return [sum((n * v - r) ** 2 for v, r in zip(row, rest)) for row in y.tolist()]


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) for each whole vector and component.

    Rows whose vector is null, empty or holds null or non-finite entries take no part, nor do
    vectors of another length than most have.  Entries become whole numbers, floor(64 * c) +
    1,000,000 (held at 2**60 before the shift).  Components are numbered from 1 by falling eigenvalue,
    at most ``count`` and one a dimension; one without variance (all vectors equal in it) has null
    in ``whitened`` and is left out of ``identity_error`` (null if all are).  ``deviation`` is
    null where it has more than 63 bits.  Repeated rows and keys count each, null keys stay,
    no vectors give no rows, and other columns are not read.
    """
    rows = vectors.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").alias("v"))
    only = rows.select("v")
    schema = f"`{key}` {dict(vectors.dtypes)[key]}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    dim = dimension(only)
    n, s = sums(only, dim) if dim else (0, [])
    if not n:
        return vectors.sparkSession.createDataFrame([], schema)
    covariance = product(only, dim, dim, lambda x: centred(x, n, s)) / n
    value, direction = components(covariance)
    count, trace = min(count, dim), float(np.trace(covariance))
    varies = int((value[:count] > NO_VARIANCE * trace).sum())
    turn = direction[:, :varies] / np.sqrt(value[:varies])
    error = None
    if varies:
        # the mean of the whitened vectors is zero but for rounding; it is taken off all the same
        gram = product(only, dim, varies + 1, lambda x: np.hstack([centred(x, n, s) @ turn, np.ones((len(x), 1))])) / n
        error = float(np.abs(gram[:-1, :-1] - np.outer(gram[-1, :-1], gram[-1, :-1]) - np.eye(varies)).max())
    explained = value[:count] / trace if trace else np.zeros(count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            at, x = whole(batch.column("v"), dim)
            m = len(at)
            out = np.zeros((m, count))
            out[:, :varies] = centred(x, n, s) @ turn if m else 0
            none = np.zeros((m, count), bool)
            none[:, varies:] = True
            far = pa.array([d if d < 1 << 63 else None for d in deviations(x, n, s)], pa.int64())
            each = pa.array(np.repeat(np.arange(m), count))
            yield pa.RecordBatch.from_arrays([
                batch.column("key").take(pa.array(at)).take(each), pa.array(np.tile(np.arange(1, count + 1), m), pa.int32()), pa.array(np.full(m * count, n)), far.take(each),
                pa.array(out.ravel(), mask=none.ravel()), pa.array(np.tile(explained, m)), pa.array([error] * (m * count), pa.float64())],
                [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``embeddings``: up to 32 components of each vector."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
