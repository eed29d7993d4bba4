"""Synthetic vectors, made on the executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hnsw import xorshift
from ..schema import EMBEDDING

# Fixed value: the seed of the sequence.
XORSHIFT_SEED = 0xDEADBEEFCAFEBABE


#: A linear map of 64 bits: what each bit alone becomes.
Bits = list[int]


def _mapped(m: Bits, x: int) -> int:
    out = 0
    while x:
        low = x & -x
        out ^= m[low.bit_length() - 1]
        x ^= low
    return out


def jump(state: int, draws: int) -> int:
    """The state after so many draws: a draw is linear in the state's bits, so powers of its map are squared ones."""
    m: Bits = [xorshift(1 << i) for i in range(64)]
    while draws:
        if draws & 1:
            state = _mapped(m, state)
        draws >>= 1
        if draws:
            m = [_mapped(m, x) for x in m]
    return state


def _draws(dim: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, next_ = seed, 0
        for batch in batches:
            ords = batch.column("id").to_pylist()
            out = []
            for i in ords:
                state = state if i == next_ else jump(seed, i * dim)
                next_, v = i + 1, []
                for _ in range(dim):
                    state = xorshift(state)
                    v.append((state >> 11) / float(1 << 53))
                out.append(v)
            yield pa.record_batch({"ord": pa.array(ords, pa.int64()), "id": pa.array([f"v{i}" for i in ords], pa.string()), "vector": pa.array(out, pa.list_(pa.float32()))})

    return run


def xorshift_cube(spark: SparkSession, n: int, dim: int, seed: int = XORSHIFT_SEED) -> DataFrame:
    """n vectors of [0, 1) from one sequence of draws, row by row; ids v0, v1 and so on. Each task starts at its own place in the sequence."""
    return spark.range(n).mapInArrow(_draws(dim, seed), EMBEDDING)


def _normal(dim: int, seed: int, prefix: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ords = batch.column("id").to_pylist()
            v = np.array([np.random.default_rng((seed, i)).standard_normal(dim) for i in ords]).reshape(len(ords), dim)
            v /= np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-300)
            yield pa.record_batch({"ord": pa.array(ords, pa.int64()), "id": pa.array([f"{prefix}_{i:06d}" for i in ords], pa.string()), "vector": pa.array(list(v.astype(np.float32)), pa.list_(pa.float32()))})

    return run


def random_unit(spark: SparkSession, n: int, dim: int, seed: int = 0, prefix: str = "emb") -> DataFrame:
    """n random directions; a row follows from the seed and its number, whatever task makes it."""
    return spark.range(n).mapInArrow(_normal(dim, seed, prefix), EMBEDDING)


# Each theme's id prefix, categories and spread around a category's centre, and the products' names.
THEMES = {
    "products": ("", ("electronics", "clothing", "food", "books", "toys", "sports"), 0.15),
    "movies": ("movie_", ("action", "comedy", "drama", "scifi", "horror", "romance"), 0.20),
    "documents": ("doc_", ("tech", "business", "science", "health", "politics", "entertainment"), 0.18),
}
PRODUCTS = {
    "electronics": ("laptop", "smartphone", "tablet", "headphones", "camera", "monitor"),
    "clothing": ("shirt", "pants", "dress", "jacket", "shoes", "hat"),
    "food": ("apple", "bread", "cheese", "pasta", "rice", "coffee"),
    "books": ("novel", "textbook", "magazine", "comic", "manual", "dictionary"),
    "toys": ("doll", "puzzle", "lego", "robot", "ball", "game"),
    "sports": ("basketball", "tennis_racket", "running_shoes", "yoga_mat", "dumbbell", "bike"),
}


def _themed_id(theme: str, category: str, i: int) -> str:
    own = f"_{PRODUCTS[category][i % len(PRODUCTS[category])]}" if theme == "products" else ""
    return f"{THEMES[theme][0]}{category}{own}__{i:04d}"


def _themed(theme: str, each: int, dim: int, seed: int):
    _, names, noise = THEMES[theme]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = np.array([np.random.default_rng((seed, c)).standard_normal(dim) for c in range(len(names))])
        centres /= np.sqrt((centres * centres).sum(axis=1, keepdims=True))
        for batch in batches:
            ords = batch.column("id").to_pylist()
            v = np.array([np.clip(centres[i // each] + np.random.default_rng((seed, 1000 + i)).standard_normal(dim) * noise, -1, 1) for i in ords]).reshape(len(ords), dim)
            v /= np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-300)
            yield pa.record_batch({"ord": pa.array(ords, pa.int64()), "id": pa.array([_themed_id(theme, names[i // each], i % each) for i in ords], pa.string()), "vector": pa.array(list(v.astype(np.float32)), pa.list_(pa.float32()))})

    return run


def themed(spark: SparkSession, theme: str, n: int, dim: int = 128, seed: int = 42) -> DataFrame:
    """Clusters of n / 6 vectors around six centres of a theme; `mixed` is a third of each theme, `random` has no centres."""
    if theme == "random":
        return random_unit(spark, n, dim, seed)
    if theme == "mixed":
        out, at = None, 0
        for t in THEMES:
            part = themed(spark, t, n // 3, dim, seed).withColumn("ord", F.col("ord") + at)
            at += n // 3 // 6 * 6
            out = part if out is None else out.unionByName(part)
        return out
    each = n // 6
    return spark.range(each * 6).mapInArrow(_themed(theme, max(each, 1), dim, seed), EMBEDDING)
