"""Compression to a codec and its decoded table, and the end-to-end chain to graph search results."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import hnsw, nf4, pq, quality, rq, scalar
from ..schema import dimension
from ..sources import vecstream

FORMATS = ("stream", "scalar", "nf4", "pq", "rq")


@dataclass
class Compressed:
    """The chosen format, the stored rows, the codec's model and the decoded rows."""

    format: str
    stored: DataFrame
    model: object
    dim: int
    decoded: DataFrame

    def write_file(self, path: str) -> int:
        model = np.stack(self.model, axis=1) if self.format == "scalar" else self.model
        return vecstream.write_file(self.stored, path, self.format, model, self.dim)

    def write_table(self, path: str) -> None:
        """The stored rows as Parquet: the form for large data."""
        self.stored.write.mode("overwrite").parquet(path)


def compress(df: DataFrame, format: str = "stream", m: int = 8, k: int = 256, passes: int = 2, pq_iterations: int = 25, rq_iterations: int = 15) -> Compressed:
    """df in a format; an unknown one is `stream`, `auto` is chosen on all rows and trained with the parameters that were judged."""
    if format == "auto":
        choice = quality.auto_select(df, max_sample=None)
        p = choice.params
        return compress(df, choice.format, p.get("m", m), p.get("k", k), p.get("passes", passes), p.get("iterations", pq_iterations), p.get("iterations", rq_iterations))
    dim = dimension(df)
    if format == "scalar":
        ranges = scalar.fit_arrays(df)
        stored = scalar.encode_bytes(df, ranges)
        return Compressed(format, stored, ranges, dim, scalar.decode(scalar.from_bytes(stored), ranges))
    if format == "nf4":
        stored = nf4.encode_packed(df)
        return Compressed(format, stored, None, dim, nf4.decode(nf4.unpack(stored)))
    if format == "pq":
        model = pq.train(df, m, k, pq_iterations)
        codes = model.encode(df)
        return Compressed(format, codes, model, dim, model.decode(codes))
    if format == "rq":
        model = rq.train(df, passes, m, k, rq_iterations)
        codes = model.encode(df)
        return Compressed(format, codes, model, dim, model.decode(codes))
    return Compressed("stream", df, None, dim, df)


def search_lines(index: DataFrame, queries: DataFrame, k: int, ef_search: int = 50) -> DataFrame:
    """A JSON line for each query that has results: query_id and its ranked results."""
    top = hnsw.batch_top_k(index, queries, k, ef_search)
    lists = top.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rn", "id", "score"))).alias("all"))  # k rows a query
    results = F.transform("all", lambda r: F.struct(r["id"].alias("id"), r["score"].alias("score")))
    return lists.select(F.to_json(F.struct(F.col("qid").alias("query_id"), results.alias("results"))).alias("line"))


def run(df: DataFrame, out: str, format: str = "stream", shards: int | None = None, m: int = 16, ef_construction: int = 200, ef_search: int = 50, queries: DataFrame | None = None, k: int = 10) -> DataFrame | None:
    """Compresses df, builds the graph index on the decoded rows, keeps both under out, and answers the queries, if any."""
    done = compress(df, format)
    done.write_table(f"{out}/compressed")
    hnsw.save(hnsw.build(done.decoded, shards, m, ef_construction), f"{out}/index")
    index = hnsw.load(df.sparkSession, f"{out}/index")
    return search_lines(index, queries, k, ef_search) if queries is not None else None
