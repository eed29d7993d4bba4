"""Residual quantisation: passes of product quantisation, each of what the passes before left over."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from . import kmeans


@dataclass
class ResidualQuantizer:
    """books[p] is [subspace, centroid, part] of pass p; dim is the padded dimension."""

    books: list[np.ndarray]
    m: int
    dim: int
    orig_dim: int

    def compression_ratio(self) -> float:
        return 4.0 * self.dim / (len(self.books) * self.m) if self.books and self.m else 1.0

    def codebook(self, spark) -> DataFrame:
        rows = [(p, s, c, [float(x) for x in b[s, c]]) for p, b in enumerate(self.books) for s in range(self.m) for c in range(b.shape[1])]
        return spark.createDataFrame(rows, "p int, s int, c int, centroid array<double>")

    def encode(self, df: DataFrame) -> DataFrame:
        """ord, id and codes (a binary of m bytes for each pass); vectors are filled up or cut to the model's dimension."""
        books, m, ready = self.books, self.m, kmeans.prepared(dim=self.dim)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                codes = [c.T.astype(np.uint8) for c in chained(ready(batch), books, m)[1]]
                rows = [[c[i].tobytes() for c in codes] for i in range(batch.num_rows)]
                yield pa.record_batch({"ord": batch.column("ord"), "id": batch.column("id"), "codes": pa.array(rows, pa.list_(pa.binary()))})

        return df.select("ord", "id", "vector").mapInArrow(run, "ord long, id string, codes array<binary>")

    def decode(self, codes: DataFrame, trim: bool = True) -> DataFrame:
        """ord, id and the sum of the passes' centroids, cut to the original dimension unless trim is off; a code without a centroid adds zeros."""
        books, dim, keep = self.books, self.dim, self.orig_dim if trim else self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = batch.column("codes").to_pylist()
                out = np.zeros((len(rows), dim))
                for p, b in enumerate(books):
                    c = np.frombuffer(b"".join(r[p] for r in rows), np.uint8).reshape(len(rows), -1).astype(np.int64)
                    there = c < b.shape[1]
                    part = b[np.arange(len(b))[None, :], np.where(there, c, 0)] * there[:, :, None]
                    out += part.reshape(len(rows), -1)
                yield pa.record_batch({"ord": batch.column("ord"), "id": batch.column("id"), "vector": pa.array(list(out[:, :keep]), pa.list_(pa.float64()))})

        return codes.select("ord", "id", "codes").mapInArrow(run, "ord long, id string, vector array<double>")

    def mean_cosine(self, df: DataFrame) -> DataFrame:
        back = self.decode(self.encode(df)).select("ord", F.col("vector").alias("back"))
        return df.join(back, "ord").agg(F.avg(X.cosine("vector", "back", on_mismatch="truncate", clamp=True)).alias("mean_cosine"))


def chained(x: np.ndarray, books: list[np.ndarray], m: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """What is left of rows after the passes, and each pass's [subspace, row] codes."""
    codes = []
    for b in books:
        c = kmeans.assign(kmeans.split(x, m), b)
        x = x - b[np.arange(m)[:, None], c].transpose(1, 0, 2).reshape(len(x), -1)
        codes.append(c)
    return x, codes


def _residual(ready: Callable, books: list[np.ndarray], m: int) -> Callable:
    return lambda batch: chained(ready(batch), books, m)[0]


def train(df: DataFrame, passes: int = 2, m: int = 8, k: int = 256, iterations: int = 15) -> ResidualQuantizer:
    """Raw k-means on residuals, from the first k rows of the order; residuals are recomputed from the books so far, not stored."""
    if k > 256:
        raise ValueError("k may be 256 at most")
    from ..schema import dimension

    orig = dimension(df)
    n = df.count()
    if not n:
        raise ValueError("no vectors to train on")
    dim = -(-orig // m) * m
    ready = kmeans.prepared(dim=dim)
    start = np.zeros((min(k, n), dim))
    for i, v in enumerate(kmeans.rows_at(df, list(range(min(k, n))))):
        start[i, : min(dim, len(v))] = v[:dim]
    books: list[np.ndarray] = []
    rows = df.select("vector")
    for _ in range(passes):
        first = kmeans.split(chained(start, books, m)[0], m)
        books.append(kmeans.lloyd(rows, _residual(ready, list(books), m), first, iterations, spherical=False) if iterations else first)
    return ResidualQuantizer(books, m, dim, orig)
