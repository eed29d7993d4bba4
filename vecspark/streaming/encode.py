"""Streams of text lines: stateless encoding, and top-k against a static corpus micro-batch by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import nf4, scalar, search
from ..sources import ingest


def read_lines(spark: SparkSession, path: str, per_trigger: int = 64) -> DataFrame:
    """A stream of (ord, id, vector) from text files as they arrive; ord is a hash of the line, since a stream has no order."""
    lines = spark.readStream.option("maxFilesPerTrigger", per_trigger).text(path)
    return ingest.parse_lines(lines.select(F.xxhash64("value").alias("ord"), F.col("value").alias("line")))


def encode(rows: DataFrame, codec: str = "nf4", ranges=None) -> DataFrame:
    """Stored rows of a stream; both codecs are projections, so nothing is kept between batches."""
    return nf4.pack(nf4.encode(rows)) if codec == "nf4" else scalar.to_bytes(scalar.encode(rows, ranges))


def write(rows: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    out = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if once else out).start()


def search_stream(queries: DataFrame, corpus: DataFrame, k: int, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch of queries (id, vector) against the corpus; a global rank isn't defined on a stream, so each batch is ranked by itself."""

    def batch(part: DataFrame, number: int) -> None:
        sink(search.batch_top_k(corpus, part.select(F.col("id").alias("qid"), "vector"), k), number)

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
