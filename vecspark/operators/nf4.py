"""The 4-bit NormalFloat codec: a scale for each row and a level for each element; a stateless projection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from . import grid, search

_LEVELS = np.array(X.NF4_LEVELS)


def encode(df: DataFrame) -> DataFrame:
    """ord, id, dim, scale (the largest absolute value, 1 for a zero row) and codes 0 to 15."""
    return df.select("ord", "id", F.size("vector").alias("dim"), X.nf4_scale("vector").alias("scale"), X.nf4_codes("vector").alias("codes"))


def pack(encoded: DataFrame) -> DataFrame:
    """The stored form: two codes a byte."""
    packed = X.nf4_pack("codes")
    return encoded.select("ord", "id", "dim", F.col("scale").cast("float").alias("scale"), F.unhex(F.array_join(F.transform(packed, lambda b: F.lpad(F.hex(b), 2, "0")), "")).alias("packed"))


def encode_packed(df: DataFrame) -> DataFrame:
    """pack(encode(df)) batch by batch in NumPy: the form for large tables."""
    middles = np.array(X.NF4_MIDPOINTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = search.lengths(batch.column("vector"))
            m = search.matrix(batch.column("vector"))
            top = np.abs(m).max(axis=1, initial=0.0)
            scale = np.where(top == 0, 1.0, top)
            codes = np.searchsorted(middles, m / scale[:, None], side="left").astype(np.uint8)
            codes[np.arange(codes.shape[1]) >= size[:, None]] = 0
            if codes.shape[1] % 2:
                codes = np.concatenate([codes, np.zeros((len(codes), 1), np.uint8)], axis=1)
            packed = codes[:, 0::2] | codes[:, 1::2] << 4
            yield pa.record_batch({"ord": batch.column("ord"), "id": batch.column("id"), "dim": pa.array(size, pa.int32()), "scale": pa.array(scale.astype(np.float32)), "packed": pa.array([p[: (n + 1) // 2].tobytes() for p, n in zip(packed, size.tolist(), strict=True)], pa.binary())})

    return df.select("ord", "id", "vector").mapInArrow(run, "ord long, id string, dim int, scale float, packed binary")


def unpack(stored: DataFrame) -> DataFrame:
    h = F.hex("packed")
    values = F.transform(F.sequence(F.lit(0), F.octet_length("packed") - 1), lambda i: F.conv(F.substring(h, (i * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int"))
    values = F.when(F.octet_length("packed") == 0, F.array().cast("array<int>")).otherwise(values)
    return stored.select("ord", "id", "dim", F.col("scale").cast("double").alias("scale"), X.nf4_unpack(values, F.col("dim")).alias("codes"))


def decode(encoded: DataFrame) -> DataFrame:
    return encoded.select("ord", "id", F.transform("codes", lambda c: X.nf4_level(c) * F.col("scale")).alias("vector"))


def batch_top_k(encoded: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Top-k over codes: the scale cancels in the cosine, so only levels are looked up."""

    def scorer(vectors):
        able = [i for i, v in enumerate(vectors) if (v * v).sum() > 0]

        def score(batch: pa.RecordBatch) -> np.ndarray:
            m = search.unit(_LEVELS[search.matrix(batch.column("codes")).astype(np.int64)])
            out = np.full((len(m), len(able)), np.nan)
            for j, i in enumerate(able):
                if len(vectors[i]) == m.shape[1]:
                    out[:, j] = m @ (vectors[i] / np.sqrt((vectors[i] ** 2).sum()))
            return out

        return able, score

    return grid.top_k(encoded.select("ord", "id", "codes"), queries, k, scorer)


def mean_cosine(df: DataFrame) -> DataFrame:
    """The mean similarity of rows and their decoded forms."""
    both = df.select("vector", F.transform(X.nf4_codes("vector"), lambda c: X.nf4_level(c)).alias("back"))  # the scale cancels
    return both.agg(F.avg(X.cosine("vector", "back", on_mismatch="truncate", clamp=True)).alias("mean_cosine"))


def compression_ratio(dim: int) -> float:
    return 4.0 * dim / (-(-dim // 2) + 4)
