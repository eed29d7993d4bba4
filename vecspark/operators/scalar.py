"""The 8-bit scalar codec: one range per dimension, fitted by an aggregate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from . import grid, search


def fit(df: DataFrame) -> DataFrame:
    """The ranges (d, mn, mx) of each dimension; aggregated in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo = hi = np.empty(0)
        for batch in batches:
            if not batch.num_rows:
                continue
            size, m = search.lengths(batch.column(0)), search.matrix(batch.column(0))
            out = np.arange(m.shape[1]) >= size[:, None]
            low, high = np.where(out, np.inf, m).min(axis=0, initial=np.inf), np.where(out, -np.inf, m).max(axis=0, initial=-np.inf)
            w = max(len(lo), len(low))
            grow = lambda a, x: np.concatenate([a, np.full(w - len(a), x)])
            lo, hi = np.fmin(grow(lo, np.inf), grow(low, np.inf)), np.fmax(grow(hi, -np.inf), grow(high, -np.inf))
        yield pa.record_batch({"d": pa.array(np.arange(len(lo)), pa.int32()), "mn": pa.array(lo, pa.float32()), "mx": pa.array(hi, pa.float32())})

    ranges = df.select("vector").mapInArrow(run, "d int, mn float, mx float")
    return ranges.groupBy("d").agg(F.min("mn").alias("mn"), F.max("mx").alias("mx"))


def fit_arrays(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The ranges as arrays: a row for each dimension reaches the driver."""
    rows = sorted(fit(df).collect(), key=lambda r: r.d)
    return np.array([r.mn for r in rows], np.float64), np.array([r.mx for r in rows], np.float64)


def _lit(a: np.ndarray):
    return F.array(*[F.lit(float(x)) for x in a])


def encode(df: DataFrame, ranges: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """ord, id and codes (array of 0 to 255), a projection."""
    mn, mx = _lit(ranges[0]), _lit(ranges[1])
    codes = F.transform("vector", lambda x, i: X.scalar_code(x, F.get(mn, i), F.get(mx, i)))
    return df.select("ord", "id", codes.alias("codes"))


def decode(codes: DataFrame, ranges: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    mn, mx = _lit(ranges[0]), _lit(ranges[1])
    return codes.select("ord", "id", F.transform("codes", lambda q, i: X.scalar_value(q, F.get(mn, i), F.get(mx, i))).alias("vector"))


def to_bytes(codes: DataFrame) -> DataFrame:
    """The stored form, a byte for each dimension."""
    return codes.select("ord", "id", F.unhex(F.array_join(F.transform("codes", lambda q: F.lpad(F.hex(q), 2, "0")), "")).alias("qvec"))


def encode_bytes(df: DataFrame, ranges: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """to_bytes(encode(df, ranges)) batch by batch in NumPy: the form for large tables."""
    mn, mx = ranges
    flat = mx <= mn

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = search.lengths(batch.column("vector"))
            m = search.matrix(batch.column("vector"))
            w = m.shape[1]
            t = np.clip((m - mn[:w]) / np.where(flat, 1.0, mx - mn)[:w], 0.0, 1.0)
            q = np.where(flat[:w] | np.isnan(t), 0, np.floor(t * 255 + 0.5)).astype(np.uint8)
            yield pa.record_batch({"ord": batch.column("ord"), "id": batch.column("id"), "qvec": pa.array([x[:n].tobytes() for x, n in zip(q, size.tolist(), strict=True)], pa.binary())})

    return df.select("ord", "id", "vector").mapInArrow(run, "ord long, id string, qvec binary")


def from_bytes(stored: DataFrame) -> DataFrame:
    h = F.hex("qvec")
    codes = F.transform(F.sequence(F.lit(0), F.octet_length("qvec") - 1), lambda i: F.conv(F.substring(h, (i * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int"))
    return stored.select("ord", "id", F.when(F.octet_length("qvec") == 0, F.array().cast("array<int>")).otherwise(codes).alias("codes"))


def batch_top_k(codes: DataFrame, ranges: tuple[np.ndarray, np.ndarray], queries: DataFrame, k: int, cached: bool = False) -> DataFrame:
    """Top-k over codes, decoded batch by batch. A row that decodes to zeros scores -1, or 0 in the cached (pre-normalised) form."""
    mn, mx = ranges
    span = np.where(mx > mn, mx - mn, 0.0)

    def scorer(vectors):
        able = [i for i, v in enumerate(vectors) if len(v) == len(mn) and (v * v).sum() > 0]
        q = search.unit(np.array([vectors[i] for i in able])) if able else None

        def score(batch: pa.RecordBatch) -> np.ndarray:
            m = mn + search.matrix(batch.column("codes")) / 255.0 * span
            s = search.unit(m) @ q.T
            return s if cached else np.where(((m * m).sum(axis=1) == 0)[:, None], -1.0, s)

        return able, score

    return grid.top_k(codes.select("ord", "id", "codes"), queries, k, scorer)


def byte_batch(data: list[float], dim: int) -> list[int]:
    """Codes of a flat row-major array, its ranges taken from itself; a constant dimension is 128, a bad shape gives none."""
    if dim <= 0 or not data or len(data) % dim:
        return []
    m = np.array(data, np.float64).reshape(-1, dim)
    lo, hi = m.min(axis=0), m.max(axis=0)
    flat = np.abs(hi - lo) < 1e-12
    t = np.clip((m - lo) / np.where(flat, 1.0, hi - lo), 0.0, 1.0)
    return np.where(flat, 128, np.floor(t * 255 + 0.5)).astype(int).ravel().tolist()


def byte_codes(df: DataFrame, ranges: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """byte_batch over a table with given ranges."""
    mn, mx = _lit(ranges[0]), _lit(ranges[1])
    one = lambda x, i: F.when(F.abs(F.get(mx, i) - F.get(mn, i)) < 1e-12, 128).otherwise(X.scalar_code(x, F.get(mn, i), F.get(mx, i)))
    return df.select("ord", "id", F.transform("vector", one).alias("codes"))


COMPRESSION_RATIO = 4.0
