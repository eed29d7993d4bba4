"""An inverted-file index: rows partitioned by their nearest coarse centroid; an alternative physical form of approximate search."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grid, kmeans, search

SAMPLE = 100_000


@dataclass
class CellIndex:
    """Coarse centroids [cell, dim] and the rows (cell, ord, id, vector)."""

    centroids: np.ndarray
    rows: DataFrame

    def save(self, path: str) -> None:
        self.rows.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
        self.rows.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(self.centroids)], "cell int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")

    def batch_top_k(self, queries: DataFrame, k: int, probes: int = 8) -> DataFrame:
        """Each query's k best in its `probes` nearest cells; cells that no query of a column probes are not read."""
        centroids, spark = self.centroids, self.rows.sparkSession

        def probed(vectors: list[np.ndarray]) -> tuple[list[int], np.ndarray, np.ndarray]:
            """The queries that can have results, their unit vectors and nearest cells."""
            able = [i for i, v in enumerate(vectors) if len(v) == centroids.shape[1] and (v * v).sum() > 0]
            q = search.unit(np.array([vectors[i] for i in able]).reshape(len(able), centroids.shape[1]))
            return able, q, np.argsort(-(q @ centroids.T), axis=1, kind="stable")[:, :probes]

        def scorer(vectors: list[np.ndarray]):
            able, q, near = probed(vectors)
            asked = np.zeros((len(centroids), len(able)), bool)
            asked[near, np.arange(len(able))[:, None]] = True
            return able, lambda batch: np.where(asked[batch.column("cell").to_numpy(zero_copy_only=False)], search.unit(search.matrix(batch.column("vector"))) @ q.T, np.nan)

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = np.zeros(len(centroids), bool)
            for batch in batches:
                seen[probed([np.array(v or [], np.float64) for v in batch.column("vector").to_pylist()])[2]] = True
            yield pa.record_batch({"cell": pa.array(np.nonzero(seen)[0], pa.int32())})

        def found_by(files: list[str]) -> DataFrame:
            wanted = [r.cell for r in spark.read.parquet(*files).select("vector").mapInArrow(cells, "cell int").distinct().collect()]
            part = self.rows.where(F.col("cell").isin(wanted)).select("cell", "ord", "id", "vector")
            return part.mapInArrow(grid.task_top_k(files, k, scorer), grid.RESULT)

        return grid.over_columns(spark, queries, k, found_by)


def load(spark, path: str) -> CellIndex:
    cells = sorted(spark.read.parquet(f"{path}/cells").collect(), key=lambda r: r.cell)
    return CellIndex(np.array([r.centroid for r in cells]), spark.read.parquet(f"{path}/rows"))


def build(df: DataFrame, cells: int = 64, iterations: int = 10, sample: int = SAMPLE) -> CellIndex:
    """Cells fitted on about `sample` rows by a hash of ord; every row is put into its nearest one."""
    n = df.count()
    fitted = df.where(F.pmod(F.xxhash64("ord", F.lit("cell")), F.lit(max(n, 1))) < sample).persist()
    k = min(cells, n)
    unit = kmeans.prepared(unit=True)
    first = np.array([r.vector for r in fitted.orderBy(F.xxhash64("ord")).limit(k).collect()], np.float64)
    first = search.unit(first, on_zero="keep")[None]
    books = kmeans.lloyd(fitted.select("vector"), unit, first, iterations, spherical=True, spare=first)
    fitted.unpersist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = kmeans.assign(unit(batch)[None], books)[0]
                yield pa.record_batch({"cell": pa.array(cell, pa.int32()), "ord": batch.column("ord"), "id": batch.column("id"), "vector": batch.column("vector")})

    return CellIndex(books[0], df.select("ord", "id", F.col("vector").cast("array<float>").alias("vector")).mapInArrow(run, "cell int, ord long, id string, vector array<float>"))
