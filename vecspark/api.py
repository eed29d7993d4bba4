"""Python classes and functions over arrays and DataFrames."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import quality, scalar, search
from .plans.session import VERSION
from .schema import EMBEDDING, dimension, from_arrays
from .sources import formats


def _spark() -> SparkSession:
    return SparkSession.builder.getOrCreate()


class Embedding:
    def __init__(self, id: str, vector):
        self.id, self.vector = id, np.asarray(vector, np.float32)


class EmbeddingDataset:
    """An ordered collection; ids need not be unique."""

    def __init__(self, rows: list[Embedding] | None = None):
        self.rows = list(rows or [])

    def add_embedding(self, e: Embedding) -> None:
        self.rows.append(e)

    def add_vector(self, id: str, vector) -> None:
        self.rows.append(Embedding(id, vector))

    def get_embedding(self, i: int) -> Embedding:
        return self.rows[i]

    def get_vectors(self) -> np.ndarray:
        return np.array([r.vector for r in self.rows], np.float32)

    def get_ids(self) -> list[str]:
        return [r.id for r in self.rows]

    def __len__(self) -> int:
        return len(self.rows)

    def is_empty(self) -> bool:
        return not self.rows

    def save(self, path: str) -> None:
        with open(path, "wb") as f:
            f.write(formats.encode_dataset((r.id, r.vector) for r in self.rows))

    @classmethod
    def load(cls, path: str) -> EmbeddingDataset:
        with open(path, "rb") as f:
            return cls([Embedding(i, v) for i, v in formats.decode_file(f.read())])

    @staticmethod
    def stream_from_file(path: str) -> Iterator[Embedding]:
        return stream_embeddings(path)

    def to_df(self, spark: SparkSession | None = None) -> DataFrame:
        return (spark or _spark()).createDataFrame([(i, r.id, [float(x) for x in r.vector]) for i, r in enumerate(self.rows)], EMBEDDING)


def stream_embeddings(path: str) -> Iterator[Embedding]:
    """The records of one plain stream, one at a time; another kind of file is an error."""
    import struct

    with open(path, "rb") as f:
        head = formats.read_header(f.read(64))
        if head.kind != "STREAM1":
            raise ValueError(f"{path} is no stream")
        f.seek(head.start)
        while len(size := f.read(4)) == 4:
            n = struct.unpack("<I", size)[0]
            data = f.read(n)
            if len(data) < n:
                raise EOFError("a record ends early")
            c = formats.Cursor(data)
            yield Embedding(c.blob().decode(), c.floats())


class _Index:
    def __init__(self, df: DataFrame):
        self.df = df.persist()
        self.dim = dimension(self.df)

    def _queries(self, vectors) -> DataFrame:
        return self.df.sparkSession.createDataFrame([(f"{i:09d}", [float(x) for x in v]) for i, v in enumerate(vectors)], "qid string, vector array<float>")

    def _top(self, queries: DataFrame, k: int) -> DataFrame:
        raise NotImplementedError

    def search_vector(self, query, k: int = 10) -> tuple[np.ndarray, np.ndarray]:
        """Positions and similarities; a query of another dimension, or k = 0, is an error."""
        query = np.asarray(query, np.float32)
        if k <= 0:
            raise ValueError("k must be positive")
        if len(query) != self.dim:
            raise ValueError(f"the query has {len(query)} elements, the index {self.dim}")
        return self.batch_search([query], k)[0]

    def batch_search(self, queries, k: int = 10) -> list[tuple[np.ndarray, np.ndarray]]:
        """The same for several queries, none of which is refused."""
        queries = list(queries)
        found: dict[str, list] = {}
        for r in self._top(self._queries(queries), k).orderBy("qid", "rn").collect() if queries else []:
            found.setdefault(r.qid, []).append((r.ord, r.score))
        rows = [found.get(f"{i:09d}", []) for i in range(len(queries))]
        return [(np.array([o for o, _ in r], np.int64), np.array([s for _, s in r], np.float32)) for r in rows]


class SearchIndex(_Index):
    @classmethod
    def from_dataset(cls, data: EmbeddingDataset | DataFrame) -> SearchIndex:
        return cls(data if isinstance(data, DataFrame) else data.to_df())

    def _top(self, queries: DataFrame, k: int) -> DataFrame:
        return search.batch_top_k(self.df, queries, k, dim=self.dim)


class QuantizedIndex(_Index):
    def __init__(self, df: DataFrame, cached: bool = False):
        super().__init__(df)
        self.ranges = scalar.fit_arrays(self.df)
        self.codes = scalar.encode(self.df, self.ranges).persist()
        self.cached = cached

    @classmethod
    def from_dataset(cls, data: EmbeddingDataset | DataFrame) -> QuantizedIndex:
        return cls(data if isinstance(data, DataFrame) else data.to_df())

    def precompute_normalized(self) -> None:
        self.cached = True

    def _top(self, queries: DataFrame, k: int) -> DataFrame:
        return scalar.batch_top_k(self.codes, self.ranges, queries, k, self.cached)

    def compression_ratio(self) -> float:
        return scalar.COMPRESSION_RATIO

    def memory_usage_bytes(self) -> int:
        """A byte for each element and the ranges."""
        return int(self.codes.agg(F.sum(F.size("codes"))).first()[0] or 0) + 8 * self.dim


def load_embeddings_from_array(vectors, ids=None, spark: SparkSession | None = None) -> DataFrame:
    return from_arrays(spark or _spark(), vectors, ids)


@dataclass
class IndexConfig:
    """Settings that the constructors accept. They choose nothing here: Spark's own configuration sets parallelism and memory."""

    compression_method: str = "quantized"
    quantization_bits: int = 8
    search_threads: int | None = None
    memory_map: bool = True


def create_index(vectors, ids=None, config: IndexConfig | None = None) -> SearchIndex:
    return SearchIndex(load_embeddings_from_array(vectors, ids))


def create_quantized_index(vectors, ids=None, config: IndexConfig | None = None) -> QuantizedIndex:
    return QuantizedIndex(load_embeddings_from_array(vectors, ids))


def compress_embeddings(vectors, ids=None) -> tuple[SearchIndex, QuantizedIndex]:
    df = load_embeddings_from_array(vectors, ids)
    return SearchIndex(df), QuantizedIndex(df)


def search_similar(index: _Index, query, k: int = 10) -> tuple[np.ndarray, np.ndarray]:
    return index.search_vector(query, k)


def batch_search(index: _Index, queries, k: int = 10) -> list[tuple[np.ndarray, np.ndarray]]:
    return index.batch_search(queries, k)


#: What `analyze_compression_quality` returns; the report has more.
_ANALYSIS = ("average_similarity", "max_similarity", "min_similarity", "compression_ratio", "memory_savings_percent", "samples_analyzed")


def analyze_compression_quality(vectors, index: QuantizedIndex, num_samples: int = 100) -> dict:
    """How similar the index's best match is to each of the first num_samples original vectors, and what the index saves."""
    report = generate_quality_report(vectors, index, num_samples)
    return {k: report[k] for k in _ANALYSIS}


def generate_quality_report(vectors, index: QuantizedIndex | None = None, num_samples: int = 1000) -> dict:
    """That analysis with a grade, advice and sizes in MB. vectors: an array or a table; an index alone is judged by its own vectors."""
    if isinstance(vectors, QuantizedIndex):
        vectors, index = vectors.df, vectors
    df = vectors if isinstance(vectors, DataFrame) else load_embeddings_from_array(vectors, spark=index.df.sparkSession)
    return quality.quality_report(df, index.codes, index.ranges, num_samples).first().asDict()


def benchmark_search_performance(index: _Index, queries, k: int = 10, runs: int = 3) -> dict:
    import time

    queries = list(queries)
    began = time.time()
    for _ in range(runs):
        index.batch_search(queries, k)
    s = time.time() - began
    return {"queries_per_second": runs * len(queries) / s, "average_latency_ms": 1000 * s / max(1, runs * len(queries)), "total_time_s": s}


def save_index(index: _Index, path: str) -> None:
    index.df.write.mode("overwrite").parquet(path)


def load_index(path: str, quantized: bool = False, spark: SparkSession | None = None) -> _Index:
    return (QuantizedIndex if quantized else SearchIndex)((spark or _spark()).read.parquet(path))


def version() -> str:
    return VERSION


def info() -> dict:
    return {"version": VERSION, "formats": ["stream", "scalar", "nf4", "pq", "rq", "auto"], "indices": ["exact", "scalar", "hnsw", "ivf"]}
