"""Recall, reconstruction quality and the choice of a codec."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from . import nf4, pq, rq, scalar, search


def recall_at_k(exact: DataFrame, approx: DataFrame, k: int) -> DataFrame:
    """qid, recall: how many of a query's first k approximate ids are among its first k exact ones, over k; 0 for k = 0.

    Repeated approximate ids count each time; lists may be shorter than k. Both have qid, rn and id.
    """
    if k <= 0:
        return exact.select("qid").distinct().withColumn("recall", F.lit(0.0))
    truth = exact.where(F.col("rn") <= k).select("qid", "id").distinct().withColumn("hit", F.lit(1))
    hits = approx.where(F.col("rn") <= k).select("qid", "id").join(truth, ["qid", "id"]).groupBy("qid").agg(F.count("*").alias("hits"))
    return exact.select("qid").distinct().join(hits, "qid", "left").select("qid", (F.coalesce("hits", F.lit(0)) / F.lit(float(k))).alias("recall"))


def mean_recall(exact: DataFrame, approx: DataFrame, k: int) -> DataFrame:
    return recall_at_k(exact, approx, k).agg(F.avg("recall").alias("recall"))


def kurtosis_by_dim(df: DataFrame) -> DataFrame:
    """d, variance and excess kurtosis (population) of each dimension; one aggregate over the exploded elements."""
    x = df.select(F.posexplode("vector").alias("d", "x")).select("d", F.col("x").cast("double").alias("x"))
    return x.groupBy("d").agg(F.var_pop("x").alias("variance"), F.kurtosis("x").alias("kurtosis"), F.count("*").alias("n"))


def mean_kurtosis(df: DataFrame) -> DataFrame:
    """The mean over dimensions with a variance of at least 1e-10; 0 for fewer than four rows."""
    by = kurtosis_by_dim(df).where("variance >= 1e-10")
    return by.agg(F.coalesce(F.when(F.max("n") >= 4, F.avg("kurtosis")), F.lit(0.0)).alias("kurtosis"))


def int8_mean_cosine(df: DataFrame) -> DataFrame:
    """The mean similarity of rows and their forms rounded to 127ths of the largest absolute value."""
    scale = F.when(X.abs_max("vector") == 0, F.lit(1.0)).otherwise(X.abs_max("vector") / 127)
    back = F.transform("vector", lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.round(x.cast("double") / scale))) * scale)
    return df.select("vector", back.alias("back")).agg(F.avg(X.cosine("vector", "back", on_mismatch="truncate", clamp=True)).alias("mean_cosine"))


def scalar_mean_cosine(df: DataFrame, ranges=None) -> DataFrame:
    ranges = ranges or scalar.fit_arrays(df)
    mn, mx = scalar._lit(ranges[0]), scalar._lit(ranges[1])
    back = F.transform("vector", lambda x, i: X.scalar_value(X.scalar_code(x, F.get(mn, i), F.get(mx, i)), F.get(mn, i), F.get(mx, i)))
    return df.select("vector", back.alias("back")).agg(F.avg(X.cosine("vector", "back", clamp=True)).alias("mean_cosine"))


def pq_mean_cosine(model: pq.ProductQuantizer, df: DataFrame) -> float:
    back = model.decode(model.encode(df)).select("ord", F.col("vector").alias("back"))
    return df.join(back, "ord").agg(F.avg(X.cosine("vector", "back", on_mismatch="truncate", clamp=True)).alias("c")).first().c


@dataclass
class Choice:
    format: str
    cosine: float
    ratio: float
    params: dict


def auto_select(df: DataFrame, target_cosine: float = 0.95, target_ratio: float = 8.0, max_sample: int | None = 1000) -> Choice:
    """The first codec that meets both targets on the first max_sample rows by ord (all if None), heavy-tailed data trying product quantisation first.

    Else the most similar of those that meet the ratio, else scalar. The scalar codec is judged as it is written, by
    ranges of each dimension. An empty table is `stream`.
    """
    sample = (df if max_sample is None else df.orderBy("ord").limit(max_sample)).persist()
    try:
        if not sample.take(1):
            return Choice("stream", 1.0, 1.0, {})
        from ..schema import dimension

        dim = dimension(sample)
        heavy = mean_kurtosis(sample).first().kurtosis > 4.0
        best: Choice | None = None
        for kind in ("pq", "rq", "nf4", "scalar") if heavy else ("nf4", "rq", "pq", "scalar"):
            found = _judge(kind, sample, dim)
            if found.ratio >= target_ratio:
                if found.cosine >= target_cosine:
                    return found
                if best is None or found.cosine > best.cosine:
                    best = found
        return best or Choice("scalar", 0.99, 4.0, {})
    finally:
        sample.unpersist()


def _judge(kind: str, sample: DataFrame, dim: int) -> Choice:
    if kind == "nf4":
        return Choice(kind, nf4.mean_cosine(sample).first().mean_cosine, nf4.compression_ratio(dim), {})
    if kind == "scalar":
        return Choice(kind, scalar_mean_cosine(sample).first().mean_cosine, scalar.COMPRESSION_RATIO, {})
    if kind == "rq":
        m = pq.choose_m(dim, 8, 4)
        model = rq.train(sample, 2, m, 64, 15)
        return Choice(kind, model.mean_cosine(sample).first().mean_cosine, model.compression_ratio(), {"passes": 2, "m": m, "k": 64, "iterations": 15})
    m = pq.choose_m(dim, 8, 4)
    model = pq.train(sample, m, 256, 25)
    return Choice(kind, pq_mean_cosine(model, sample), model.compression_ratio(), {"m": m, "k": 256, "iterations": 25})


def quality_report(df: DataFrame, codes: DataFrame, ranges, samples: int = 1000) -> DataFrame:
    """One row on the scalar codec: similarity of the first rows' best matches, ratio, savings, grade, advice and true sizes."""
    queries = df.orderBy("ord").limit(samples).select(F.col("ord").cast("string").alias("qid"), "vector")
    top = scalar.batch_top_k(codes, ranges, queries, 1)
    sizes = df.agg(F.sum(F.size("vector") * 4.0).alias("plain"), F.sum(F.size("vector") * 1.0).alias("coded"))
    out = top.agg(F.avg("score").alias("average_similarity"), F.greatest(F.max("score"), F.lit(0.0)).alias("max_similarity"), F.least(F.min("score"), F.lit(1.0)).alias("min_similarity"), F.count("*").alias("samples_analyzed"))
    avg = F.col("average_similarity")
    return out.crossJoin(F.broadcast(sizes)).select(  # one row each
        "average_similarity", "max_similarity", "min_similarity", "samples_analyzed", (F.col("plain") / F.col("coded")).alias("compression_ratio"),
        ((1 - F.col("coded") / F.col("plain")) * 100).alias("memory_savings_percent"), X.grade(avg).alias("quality_grade"), X.recommendation(avg, F.col("plain") / F.col("coded")).alias("recommendation"),
        (F.col("coded") / 1048576).alias("memory_usage_mb"), (F.col("plain") / 1048576).alias("original_size_estimate_mb"),
    )


def change_percent(current, previous):
    """Per cent by which current exceeds previous, null for a previous of 0."""
    return F.try_divide(current - previous, previous) * 100


def bench(df: DataFrame, n_queries: int = 100, k: int = 10, shards: int = 8, m: int = 16, ef_construction: int = 200, ef_search: int = 50) -> list[dict]:
    """Recall, queries a second and build time of exact, graph and product-quantised search with evenly spaced rows as queries."""
    from . import hnsw

    n = df.count()
    q = min(n_queries, n)
    picks = [i * n // q for i in range(q)]
    queries = df.where(F.col("ord").isin(picks)).select(F.col("ord").cast("string").alias("qid"), "vector").persist()
    out = []

    def timed(run):
        t = time.time()
        rows = run()
        return rows, time.time() - t

    exact, s = timed(lambda: _kept(search.batch_top_k(df, queries, k)))
    out.append({"algorithm": "exact", "recall_at_k": 1.0, "qps": q / s, "latency_ms": 1000 * s / q, "build_ms": 0.0})
    index, b = timed(lambda: _kept(hnsw.build(df, shards, m, ef_construction)))
    got, s = timed(lambda: _kept(hnsw.batch_top_k(index, queries, k, ef_search)))
    out.append({"algorithm": "hnsw", "recall_at_k": mean_recall(exact, got, k).first().recall, "qps": q / s, "latency_ms": 1000 * s / q, "build_ms": 1000 * b})
    from ..schema import dimension

    dim = dimension(df)
    model, b = timed(lambda: pq.train(df, 8 if dim % 8 == 0 else 1, min(256, n), 25))
    codes = _kept(model.encode(df))
    got, s = timed(lambda: _kept(model.batch_top_k(codes, queries, k)))
    out.append({"algorithm": "pq", "recall_at_k": mean_recall(exact, got, k).first().recall, "qps": q / s, "latency_ms": 1000 * s / q, "build_ms": 1000 * b})
    return out


def _kept(df: DataFrame) -> DataFrame:
    df = df.persist()
    df.count()
    return df
