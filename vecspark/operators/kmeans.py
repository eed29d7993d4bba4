"""Deterministic distributed Lloyd iterations over the subspaces of a table of vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import ingest
from . import search

#: Sums travel as whole numbers of this fraction of the largest possible sum, so that their order cannot change them.
FIXED = 1 << 61


def split(m: np.ndarray, subspaces: int) -> np.ndarray:
    """[row, dim] as [subspace, row, part]."""
    return np.ascontiguousarray(m.reshape(len(m), subspaces, -1).transpose(1, 0, 2))


def assign(parts: np.ndarray, books: np.ndarray) -> np.ndarray:
    """[subspace, row]: the nearest of [subspace, centroid, part], the first on ties."""
    out = np.empty(parts.shape[:2], np.int64)
    for s in range(len(parts)):
        for lo in range(0, parts.shape[1], 1024):
            x = parts[s, lo : lo + 1024]
            d = ((x[:, None, :] - books[s][None, :, :]) ** 2).sum(axis=2) if books[s].size <= 1024 else x @ (-2 * books[s].T) + (books[s] ** 2).sum(1)
            out[s, lo : lo + 1024] = d.argmin(axis=1)
    return out


def _sums(parts: np.ndarray, books: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Of some rows: the sum (in whole numbers of 1 / scale) and number of each centroid's."""
    m, k, w = books.shape
    now = assign(parts, books)
    n = np.stack([np.bincount(now[s], minlength=k) for s in range(m)])
    whole = np.rint(parts * scale).astype(np.int64)
    high, low = whole >> 26, whole & (1 << 26) - 1  # either half adds up exactly in floating point
    add = lambda x: np.stack([np.stack([np.bincount(now[s], weights=x[s, :, d], minlength=k) for d in range(w)], axis=1) for s in range(m)]).astype(np.int64)
    return (add(high) << 26) + add(low), n


_PARTIAL = "s int, total binary, n binary"


def _packed(s: list[int], total: list[np.ndarray], n: list[np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch({"s": pa.array(s, pa.int32()), "total": pa.array([x.tobytes() for x in total], pa.binary()), "n": pa.array([x.tobytes() for x in n], pa.binary())})


def _partial(prepare: Callable, books: np.ndarray, scale: float) -> Callable:
    """A row for each subspace: all centroids' sums and numbers over a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, k, w = books.shape
        total, n = np.zeros((m, k, w), np.int64), np.zeros((m, k), np.int64)
        for batch in batches:
            if batch.num_rows:
                t, c = _sums(split(prepare(batch), m), books, scale)
                total, n = total + t, n + c
        yield _packed(list(range(m)), list(total), list(n))

    return run


def _added(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One subspace's sums over all tasks."""
    total = n = None
    for batch in batches:
        for t, c in zip(batch.column("total").to_pylist(), batch.column("n").to_pylist(), strict=True):
            t, c = np.frombuffer(t, np.int64), np.frombuffer(c, np.int64)
            total, n = (t, c) if total is None else (total + t, n + c)
    yield _packed([key[0].as_py()], [total], [n])


def _gathered(rows: DataFrame, prepare: Callable, books: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    m, k, w = books.shape
    total, n = np.zeros((m, k, w), np.int64), np.zeros((m, k), np.int64)
    for r in rows.mapInArrow(_partial(prepare, books, scale), _PARTIAL).groupBy("s").applyInArrow(_added, _PARTIAL).collect():
        total[r.s], n[r.s] = np.frombuffer(r.total, np.int64).reshape(k, w), np.frombuffer(r.n, np.int64)
    return total, n


def lloyd(rows: DataFrame, prepare: Callable, first: np.ndarray, iterations: int, spherical: bool, spare: np.ndarray | None = None) -> np.ndarray:
    """Centroids [subspace, centroid, part] after at most `iterations` steps.

    prepare turns a batch of rows into a matrix. spherical: centroids are normalised means (raw where the norm is tiny), all
    rows start in cluster 0 and a first step that moves none ends the run at the initial centroids; a dead centroid becomes
    its row of spare. Otherwise the first step always updates and a dead centroid stays. A subspace ends when a step changes no
    centroid's sum and number. Each step is one pass over the rows, which are kept for the time of the run, with sums for each
    centroid from each task, whatever the table's size; a row for each subspace reaches the driver.
    """
    rows = rows.persist()
    try:
        return _lloyd(rows, prepare, first.copy(), iterations, spherical, spare)
    finally:
        rows.unpersist()


def _lloyd(rows: DataFrame, prepare: Callable, books: np.ndarray, iterations: int, spherical: bool, spare: np.ndarray | None) -> np.ndarray:
    m = len(books)
    count, largest = _measured(rows, prepare)
    scale = FIXED / max(count * largest, 1e-300)
    active = np.ones(m, bool)
    sums = counts = None
    for step in range(iterations):
        whole, n = _gathered(rows, prepare, books, scale)
        if sums is not None:
            active &= (whole != sums).any(axis=(1, 2)) | (n != counts).any(axis=1)
        elif spherical:
            active &= n[:, 1:].sum(axis=1) > 0
        if not active.any():
            break
        sums, counts = whole, n
        total = whole / scale
        mean = total / np.maximum(n, 1)[:, :, None]
        if spherical:
            norm = np.sqrt((mean * mean).sum(axis=2, keepdims=True))
            mean = np.where(norm > 1e-12, mean / np.where(norm > 1e-12, norm, 1.0), mean)
        dead = spare if spherical and spare is not None else books
        new = np.where((n > 0)[:, :, None], mean, dead)
        books = np.where(active[:, None, None], new, books)
    return books


def _measured(rows: DataFrame, prepare: Callable) -> tuple[int, float]:
    """The number of rows and their largest absolute element."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, top = 0, 0.0
        for batch in batches:
            if batch.num_rows:
                n, top = n + batch.num_rows, max(top, float(np.abs(prepare(batch)).max(initial=0.0)))
        yield pa.record_batch({"n": pa.array([n], pa.int64()), "x": pa.array([top])})

    row = rows.mapInArrow(run, "n long, x double").agg(F.sum("n").alias("n"), F.max("x").alias("x")).first()
    return row.n or 0, row.x or 1.0


def prepared(column: str = "vector", dim: int | None = None, unit: bool = False) -> Callable:
    """Rows of a list column as a matrix, filled up or cut to dim, and of unit length (rows of a tiny norm as they are)."""

    def run(batch: pa.RecordBatch) -> np.ndarray:
        m = search.matrix(batch.column(column))
        if dim is not None and m.shape[1] != dim:
            out = np.zeros((len(m), dim))
            out[:, : min(dim, m.shape[1])] = m[:, :dim]
            m = out
        return search.unit(m, on_zero="keep", tiny=1e-12) if unit else m

    return run


def rows_at(df: DataFrame, places: list[int], column: str = "vector") -> list[np.ndarray]:
    """The vectors at given places of the order of ord; ord is taken as the place where it runs from 0 without gaps."""
    span = df.agg(F.count("*").alias("n"), F.min("ord").alias("lo"), F.max("ord").alias("hi")).first()
    wanted = sorted(set(places))
    if span.lo == 0 and span.hi == span.n - 1:
        rows = {r.ord: r.v for r in df.where(F.col("ord").isin(wanted)).select("ord", F.col(column).alias("v")).collect()}
    else:
        numbered = ingest.numbered(df.select("ord", F.col(column).alias("v")).orderBy("ord"), "place", kept=True)
        rows = {r.place: r.v for r in numbered.where(F.col("place").isin(wanted)).collect()}
    return [np.array(rows[p], np.float64) for p in places]
