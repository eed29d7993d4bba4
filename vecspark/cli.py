"""Command line: compress, search, index build, index search, bench, pipeline, serve."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import hnsw, quality, search
from .plans import workflow
from .schema import toy_dataset
from .sources import generators, ingest, vecstream


def load(spark: SparkSession, path: str | None) -> DataFrame:
    """Parquet, JSONL/CSV or a binary file by content; the toy data only where no path is given, a missing path is an error."""
    if path is None:
        return toy_dataset(spark)
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    if os.path.isdir(path) or path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith((".jsonl", ".csv", ".json", ".txt")):
        return ingest.read_lines(spark, path)
    return vecstream.read(spark, path)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vecspark")
    sub = p.add_subparsers(dest="verb", required=True)
    c = sub.add_parser("compress")
    c.add_argument("input")
    c.add_argument("output")
    c.add_argument("--format", default="stream")
    c.add_argument("--pq-subspaces", type=int, default=8)
    c.add_argument("--pq-centroids", type=int, default=256)
    c.add_argument("--rq-passes", type=int, default=2)
    c.add_argument("--table", action="store_true", help="write a Parquet table instead of one file")
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("--top-k", type=int, default=10)
    s.add_argument("--dataset")
    b = sub.add_parser("index-build")
    b.add_argument("dataset")
    b.add_argument("output")
    b.add_argument("--shards", type=int)
    b.add_argument("--m", type=int, default=16)
    b.add_argument("--ef-construction", type=int, default=200)
    i = sub.add_parser("index-search")
    i.add_argument("index")
    i.add_argument("query")
    i.add_argument("--top-k", type=int, default=10)
    i.add_argument("--ef", type=int, default=50)
    g = sub.add_parser("bench")
    g.add_argument("--dataset")
    g.add_argument("--count", type=int, default=10_000)
    g.add_argument("--dim", type=int, default=128)
    g.add_argument("--queries", type=int, default=100)
    g.add_argument("--k", type=int, default=10)
    g.add_argument("--strict", action="store_true", help="fail where a recall is below 0.9")
    w = sub.add_parser("pipeline")
    w.add_argument("input")
    w.add_argument("output")
    w.add_argument("--format", default="stream")
    w.add_argument("--queries")
    w.add_argument("--top-k", type=int, default=10)
    v = sub.add_parser("serve")
    v.add_argument("--port", type=int, default=8080)
    v.add_argument("--dataset")
    return p


def _print(top: DataFrame) -> None:
    for r in top.orderBy("rn").collect():
        print(f"{r.rn}. {r.id} -> {r.score:.6f}")


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    query = lambda text: spark.range(1).select(F.lit("q").alias("qid"), ingest.parse_query(F.lit(text)).alias("vector"))
    if a.verb == "compress":
        done = workflow.compress(load(spark, a.input), a.format, a.pq_subspaces, a.pq_centroids, a.rq_passes)
        print(f"format {done.format}")
        done.write_table(a.output) if a.table else print(f"{done.write_file(a.output)} rows")
    elif a.verb == "search":
        _print(search.batch_top_k(load(spark, a.dataset), query(a.query), a.top_k))
    elif a.verb == "index-build":
        hnsw.save(hnsw.build(load(spark, a.dataset), a.shards, a.m, a.ef_construction), a.output)
    elif a.verb == "index-search":
        _print(hnsw.batch_top_k(hnsw.load(spark, a.index), query(a.query), a.top_k, a.ef))
    elif a.verb == "bench":
        df = load(spark, a.dataset) if a.dataset else generators.xorshift_cube(spark, a.count, a.dim)
        rows = quality.bench(df, a.queries, a.k)
        print(json.dumps({"queries": a.queries, "k": a.k, "algorithms": rows}))
        return int(a.strict and any(r["recall_at_k"] < 0.9 for r in rows))
    elif a.verb == "pipeline":
        queries = ingest.parse_queries(ingest.lines(spark, a.queries)) if a.queries else None
        out = workflow.run(load(spark, a.input), a.output, a.format, queries=queries, k=a.top_k)
        for r in out.toLocalIterator() if out is not None else []:
            print(r.line)
    else:
        from .plans.http import serve
        from .plans.session import VectorSession

        session = VectorSession(spark)
        if a.dataset:
            session.upload(load(spark, a.dataset))
        serve(session, a.port).serve_forever()
    return 0


if __name__ == "__main__":
    sys.exit(main())
