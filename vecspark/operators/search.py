"""Exact cosine top-k, for one query or many, over plain or decoded vectors."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from . import grid

#: Queries that one plan of the relational form takes.
RELATIONAL = 2048


def matrix(column: pa.Array) -> np.ndarray:
    """A list column as a two-dimensional array of doubles; shorter vectors are filled up with zeros, nulls are zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.asarray(column.value_lengths().fill_null(0))
    width = int(size.max())
    if (size == width).all():
        return flat.reshape(n, width)
    out = np.zeros((n, width))
    inside = np.arange(width) < size[:, None]
    out[inside] = flat
    return out


def lengths(column: pa.Array) -> np.ndarray:
    return np.asarray(column.value_lengths().fill_null(0))


def unit(m: np.ndarray, on_zero: str = "zeros", tiny: float = 0.0) -> np.ndarray:
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    small = n <= tiny
    out = m / np.where(small, 1.0, n)
    return np.where(small, 0.0, out) if on_zero == "zeros" else out


def batch_top_k(corpus: DataFrame, queries: DataFrame, k: int, naive: bool = False, dim: int | None = None, block: int | None = None, column: int | None = None) -> DataFrame:
    """Each query's k most similar rows.

    naive: every row has a score, -1 where lengths differ or a norm is 0. Otherwise, as over a normalised index, a query of
    another dimension than the index's first vector or of norm 0 has no results, and a row of norm 0 scores 0. The corpus is
    read once for `column` blocks of `block` queries, or for more where a task can hold them.
    """
    return grid.top_k(corpus.select("ord", "id", "vector"), queries, k, _scorer(corpus, naive, dim), block, column)


def batch_totals(corpus: DataFrame, queries: DataFrame, naive: bool = False, dim: int | None = None, block: int | None = None, column: int | None = None) -> DataFrame:
    """What batch_top_k with all rows as k comes to: qid, best score, n rows, and of these `least` with a score of -1; without ranking or handing on a row for each pair."""
    return grid.totals(corpus.select("ord", "id", "vector"), queries, _scorer(corpus, naive, dim), block, column)


def _scorer(corpus: DataFrame, naive: bool, dim: int | None) -> grid.Scorer:
    if not naive and dim is None:
        from ..schema import dimension

        dim = dimension(corpus)

    def scorer(vectors: list[np.ndarray]):
        able = [i for i, v in enumerate(vectors) if naive or (len(v) == dim and (v * v).sum() > 0)]
        if not able:
            return able, None
        width = max(len(vectors[i]) for i in able)
        q = np.zeros((len(able), width))
        for j, i in enumerate(able):
            q[j, : len(vectors[i])] = vectors[i]
        size = np.array([len(vectors[i]) for i in able])
        norms = np.sqrt((q * q).sum(axis=1))
        q = unit(q)

        def score(batch: pa.RecordBatch) -> np.ndarray:
            col = batch.column("vector")
            m = matrix(col)
            n = min(m.shape[1], q.shape[1])
            s = unit(m)[:, :n] @ q[:, :n].T
            if naive:
                bad = (lengths(col)[:, None] != size[None, :]) | ((m * m).sum(axis=1) == 0)[:, None] | (norms == 0)[None, :]
                s = np.where(bad, -1.0, s)
            return s

        return able, score

    return scorer


def top_k(corpus: DataFrame, query: list[float], k: int, naive: bool = True) -> DataFrame:
    """One query's k most similar rows, as one expression: ord, id, score. The sort and limit are one bounded heap in each task."""
    lit = F.array(*[F.lit(float(x)) for x in query]).cast("array<double>")
    if not naive:
        from ..schema import dimension

        if k <= 0 or not any(query) or dimension(corpus) != len(query):
            return corpus.select("ord", "id", F.lit(0.0).alias("score")).limit(0)
        score = X.cosine("vector", lit, on_zero="zero", on_mismatch="truncate")
    else:
        score = X.cosine("vector", lit)
    return corpus.select("ord", "id", score.alias("score")).orderBy(F.desc("score"), "ord").limit(max(k, 0))


def batch_top_k_sql(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """batch_top_k in naive mode as one relational plan, for at most RELATIONAL queries; more are an error."""
    q = queries.select(F.col("qid").cast("string").alias("qid"), F.col("vector").cast("array<double>").alias("vector"))
    if q.limit(RELATIONAL + 1).count() > RELATIONAL:
        raise ValueError(f"more than {RELATIONAL} queries; batch_top_k_relational takes any number")
    return grid.merged(near_pairs(corpus, q, k), k)


def batch_top_k_relational(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """batch_top_k_sql for any number of queries: a plan for each RELATIONAL of them, run one after the other into the shared folder."""
    spark = corpus.sparkSession
    return grid.over_columns(spark, queries, k, lambda files: near_pairs(corpus, spark.read.schema("qid string, vector array<double>").parquet(*files), k), RELATIONAL, 1)


def near_pairs(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The pairs (grid.RESULT) that can be among a query's k best, from a cross join.

    Vectors' elements are columns, so that the product of a pair is compiled. A query's k-th best pair with about the root of
    n * k rows bounds its pairs with all rows, so that few of them are sorted. Pairs whose score isn't finite are left out.
    """
    n = max(corpus.count(), 1)
    width = queries.agg(F.max(F.size("vector"))).first()[0] or 0
    rows = _elements(corpus, ["ord", "id"], "x", width, -1)
    asked = _elements(queries, ["qid"], "q", width, -2)
    score = F.when(F.col("xn") != F.col("qn"), -1.0).otherwise(_total([F.col(f"x{i}") * F.col(f"q{i}") for i in range(width)]))

    def scored(some: DataFrame, q: DataFrame, kept: Column) -> DataFrame:
        return some.join(F.broadcast(q), kept & (score <= 2.0)).select("qid", "ord", "id", score.alias("score")).withColumn("part", F.spark_partition_id())

    some = rows.where(F.pmod(F.xxhash64("ord"), F.lit(n)) < max(4 * k, math.isqrt(n * max(k, 0))))
    bound = grid.merged(scored(some, asked, score >= -2.0), k).where(F.col("rn") == k).select(F.col("qid").alias("of"), F.col("score").alias("least"), F.col("ord").alias("last"))
    bounded = asked.join(bound, F.col("qid").eqNullSafe(F.col("of")), "left").withColumn("least", F.coalesce("least", F.lit(-2.0)))
    # the score comes first: the rest is for the few pairs that reach the bound
    kept = (score >= F.col("least")) & ((score > F.col("least")) | F.col("last").isNull() | (F.col("ord") <= F.col("last")))
    return scored(rows, bounded, kept)


def _elements(df: DataFrame, names: list[str], tag: str, width: int, none: int) -> DataFrame:
    """Each vector's length, `none` where it is null or its norm is 0, and the elements of its unit form up to `width`."""
    one = df.select(*names, F.coalesce(F.when(X.l2_norm("vector") == 0, none).otherwise(F.size("vector")), F.lit(none)).alias(f"{tag}n"), X.normalize("vector").alias("unit"))
    return one.select(*names, f"{tag}n", *[F.coalesce(F.get("unit", F.lit(i)), F.lit(0.0)).alias(f"{tag}{i}") for i in range(width)])


def _total(terms: list[Column]) -> Column:
    """The terms' sum as a balanced tree."""
    if len(terms) < 2:
        return terms[0] if terms else F.lit(0.0)
    return _total(terms[: len(terms) // 2]) + _total(terms[len(terms) // 2 :])
