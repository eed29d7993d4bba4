"""The serving facade: a data set, its exact index and its graph index."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession

from .. import schema
from ..operators import hnsw, search

VERSION = "0.1.0"


class BadRequest(ValueError):
    status = 400


class NotFound(LookupError):
    status = 404


class VectorSession:
    """What the service's routes do; state changes replace whole DataFrames."""

    def __init__(self, spark: SparkSession):
        self.spark, self.data, self.index, self.dim, self.count = spark, None, None, 0, 0

    def health(self) -> dict:
        return {"status": "ok", "version": VERSION}

    def stats(self) -> dict:
        return {"count": self.count, "dimensions": self.dim or None, "index_loaded": self.data is not None, "graph_loaded": self.index is not None}

    def upload(self, df: DataFrame) -> dict:
        """Replaces the data; an empty or ragged table is refused, and a graph of the old data is dropped."""
        try:
            self.dim = schema.validate_dims(df)
        except ValueError as e:
            raise BadRequest(str(e)) from e
        if self.data is not None:
            self.data.unpersist()
        self.data, self.index = df.persist(), None
        self.count = self.data.count()
        return {"count": self.count, "dimensions": self.dim}

    def load(self, path: str) -> dict:
        """Loads a Parquet table of (ord, id, vector)."""
        if not path:
            raise BadRequest("no path")
        return self.upload(self.spark.read.parquet(path))

    def _rows(self, top: DataFrame, began: float) -> dict:
        rows = [{"id": r.id, "score": r.score} for r in top.orderBy("rn").collect()]
        return {"results": rows, "query_time_ms": 1000 * (time.time() - began)}

    def _query(self, query: list[float]) -> DataFrame:
        return self.spark.createDataFrame([("q", [float(x) for x in query])], "qid string, vector array<float>")

    def search(self, query: list[float], k: int = 10) -> dict:
        """Exact top-k; a query of another dimension has no results."""
        if self.data is None:
            raise NotFound("no data is loaded")
        began = time.time()
        return self._rows(search.batch_top_k(self.data, self._query(query), k, dim=self.dim), began)

    def build_index(self, shards: int | None = None, m: int = 16, ef_construction: int = 200) -> dict:
        if not self.count:
            raise BadRequest("no data is loaded")
        began = time.time()
        self.index = hnsw.build(self.data, shards, m, ef_construction).persist()
        return {"nodes": sum(hnsw.graphs(self.index)), "build_time_ms": 1000 * (time.time() - began)}

    def index_search(self, query: list[float], k: int = 10, ef: int = 50) -> dict:
        if self.index is None:
            raise NotFound("no graph index is built")
        if not query:
            raise BadRequest("an empty query")
        began = time.time()
        return self._rows(hnsw.batch_top_k(self.index, self._query(query), k, ef), began)
