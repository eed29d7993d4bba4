"""Batch searches as a grid: partitions of the corpus against columns of query blocks.

Queries lie in blocks in the shared folder and are read by the tasks; a column of blocks costs one scan of the corpus. A
task leaves its k best rows of each query, and these heaps are merged in two steps, so that no task sees more than a share
of one query's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import store

#: Queries of a block, and blocks of a column: a task holds a column's queries and their heaps. Smaller blocks share a scan up to as many queries.
QUERY_BLOCK = 2048
COLUMN = 8
#: Shares of one query's heaps that are merged apart before they meet.
WAYS = 32
#: Scores of a block that a task computes at once.
SCORES = 1 << 22
RESULT = "qid string, part int, ord long, id string, score double"
TOTALS = "qid string, best double, n long, least long"
#: Rows that a task's heaps of a block hold; beyond, they are handed on and begun anew.
HELD = 1 << 21

#: Of a block's vectors: those that can have results, and their score function; it gives [row, query] of a batch, NaN where a pair has none.
Scorer = Callable[[list[np.ndarray]], tuple[list[int], Callable[[pa.RecordBatch], np.ndarray]]]


def deal(queries: DataFrame, block: int | None = None, column: int | None = None) -> list[list[str]]:
    """Writes the queries (qid, vector) to the shared folder; the files of each column, one for each block."""
    block, column = block or QUERY_BLOCK, column or COLUMN
    asked = queries.select(F.col("qid").cast("string").alias("qid"), F.col("vector").cast("array<double>").alias("vector"))
    n = asked.count()
    if not n:
        return []
    path = store.scratch(queries.sparkSession, "queries")
    asked.repartition(-(-n // block)).write.option("maxRecordsPerFile", block).parquet(path)
    where, at = store.located(path)
    found = where.get_file_info(fs.FileSelector(at))
    files = sorted(f"{path}/{x.base_name}" for x in found if x.base_name.endswith(".parquet"))
    return [files[i : i + column] for i in range(0, len(files), column)]


def block_of(file: str) -> tuple[list[str], list[np.ndarray]]:
    """A block's query names and vectors (none for null)."""
    where, at = store.located(file)
    rows = pyarrow.parquet.ParquetFile(where.open_input_file(at)).read(["qid", "vector"])
    return rows["qid"].to_pylist(), [np.array(v if v is not None else [], np.float64) for v in rows["vector"].to_pylist()]


def joined(files: list[str]) -> Iterator[tuple[list[str], list[np.ndarray]]]:
    """The blocks of a column; small ones that fit in one block come as one, to be scored together."""
    qids, vectors = [], []
    for more, found in map(block_of, files):
        if qids and len(qids) + len(more) > QUERY_BLOCK:
            yield qids, vectors
            qids, vectors = [], []
        qids, vectors = qids + more, vectors + found
    if qids:
        yield qids, vectors


def shared(block: int | None, column: int | None) -> tuple[int, int]:
    """A block's queries and a scan's blocks: `column` at least, and as many as a task can hold."""
    block = block or QUERY_BLOCK
    return block, max(column or COLUMN, QUERY_BLOCK * COLUMN // block)


class Heaps:
    """The k best rows of each query of a block by score, then ord."""

    def __init__(self, qids: list[str], k: int):
        self.qids, self.k = qids, k
        self.least = np.full(len(qids), -np.inf)
        self.held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0))

    def add(self, ords: np.ndarray, ids: pa.Array, scores: np.ndarray) -> None:
        """Rows with their scores [row, query]; those that aren't finite have none."""
        scores = np.where(np.isfinite(scores), scores, -np.inf)
        n, floor = len(scores), self.least
        if n > self.k and np.isneginf(floor).any():
            floor = np.maximum(floor, np.partition(scores, n - self.k, axis=0)[n - self.k])
        rows, qs = np.nonzero((scores >= floor) & (scores > -np.inf))
        if not len(rows):
            return
        new = (qs, ords[rows], np.array(ids.take(pa.array(rows)).to_pylist(), object), scores[rows, qs])
        q, o, i, s = (np.concatenate(x) for x in zip(self.held, new, strict=True))
        order = np.lexsort((o, -s, q))
        q = q[order]
        first = np.searchsorted(q, np.arange(len(self.qids)))
        place = np.arange(len(q)) - first[q]
        self.least[q[place == self.k - 1]] = s[order[place == self.k - 1]]
        order = order[place < self.k]
        self.held = (q[place < self.k], o[order], i[order], s[order])

    def full(self) -> bool:
        return len(self.held[0]) > HELD

    def rows(self, part: int) -> pa.RecordBatch:
        q, o, i, s = self.held
        return result([self.qids[x] for x in q], part, pa.array(o, pa.int64()), pa.array(i.tolist(), pa.string()), s)


class Totals:
    """Of each query of a block the best score, the number of scores and of those that are -1."""

    def __init__(self, qids: list[str]):
        self.qids = qids
        self.best, self.n, self.least = np.full(len(qids), -np.inf), np.zeros(len(qids), np.int64), np.zeros(len(qids), np.int64)

    def add(self, ords: np.ndarray, ids: pa.Array, scores: np.ndarray) -> None:
        there = np.isfinite(scores)
        self.best = np.maximum(self.best, np.where(there, scores, -np.inf).max(axis=0))
        self.n += there.sum(axis=0)
        self.least += (scores == -1).sum(axis=0)

    def full(self) -> bool:
        return False

    def rows(self, part: int) -> pa.RecordBatch:
        some = np.flatnonzero(self.n)
        return pa.record_batch({"qid": pa.array([self.qids[x] for x in some], pa.string()), "best": pa.array(self.best[some]), "n": pa.array(self.n[some]), "least": pa.array(self.least[some])})


def result(qids: list[str], part: int, ords: pa.Array, ids: pa.Array, scores) -> pa.RecordBatch:
    return pa.record_batch({"qid": pa.array(qids, pa.string()), "part": pa.array([part] * len(qids), pa.int32()), "ord": ords, "id": ids, "score": pa.array(scores, pa.float64())})


def task_top_k(files: list[str], k: int, scorer: Scorer, bounded: bool = False) -> Callable:
    """A mapInArrow function that scores each batch against all blocks of a column and leaves the task's k best rows of each query, or more where k is so large that heaps fill up.

    bounded: the score function also takes each query's k-th best score so far, -inf where there are fewer.
    """
    return task_rows(files, lambda qids: Heaps(qids, k), scorer, bounded)


def task_rows(files: list[str], keeper: Callable[[list[str]], Heaps | Totals], scorer: Scorer, bounded: bool = False) -> Callable:
    """task_top_k with what each block's keeper leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, part = None, TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            if blocks is None:
                blocks = []
                for qids, vectors in joined(files):
                    able, score = scorer(vectors)
                    if able:
                        blocks.append([keeper([qids[i] for i in able]), score])
            for block in blocks:
                kept, score = block
                step = max(1024, SCORES // len(kept.qids))
                for lo in range(0, batch.num_rows, step):
                    some = batch.slice(lo, step)
                    kept.add(some.column("ord").to_numpy(zero_copy_only=False), some.column("id"), score(some, kept.least) if bounded else score(some))
                    if kept.full():
                        yield kept.rows(part)
                        block[0] = kept = keeper(kept.qids)
        for kept, _ in blocks or []:
            yield kept.rows(part)

    return run


def merged(rows: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, from tasks' heaps (RESULT): first within shares of the tasks, then over these."""
    w = Window.partitionBy("qid", F.pmod("part", F.lit(WAYS))).orderBy(F.desc("score"), "ord")
    return ranked(rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k), k)


def ranked(rows: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query by score, then ord: qid, rn (from 1), ord, id, score."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "ord")
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).select("qid", "rn", "ord", "id", "score")


def over_columns(spark: SparkSession, queries: DataFrame, k: int, found_by: Callable[[list[str]], DataFrame], block: int | None = None, column: int | None = None) -> DataFrame:
    """found_by gives the tasks' heaps (RESULT) for a column's files.

    One column is a lazy plan. Several are run one after the other into the shared folder, so that the plan doesn't grow with
    the queries.
    """
    columns = deal(queries, block, column) if k > 0 else []
    if not columns:
        return ranked(spark.createDataFrame([], RESULT), 0)
    if len(columns) == 1:
        return merged(found_by(columns[0]), k)
    path = store.scratch(spark, "found")
    for files in columns:
        merged(found_by(files), k).write.mode("append").parquet(path)
    return ranked(spark.read.parquet(path), k)


def top_k(corpus: DataFrame, queries: DataFrame, k: int, scorer: Scorer, block: int | None = None, column: int | None = None) -> DataFrame:
    """Each query's k best rows of corpus (ord, id and what the score function reads): qid, rn, ord, id, score."""
    return over_columns(corpus.sparkSession, queries, k, lambda files: corpus.mapInArrow(task_top_k(files, k, scorer), RESULT), *shared(block, column))


def totals(corpus: DataFrame, queries: DataFrame, scorer: Scorer, block: int | None = None, column: int | None = None) -> DataFrame:
    """Of each query the best score with the rows of corpus, the number of scores, and of those that are -1 (TOTALS): tasks leave one row for each."""
    spark = corpus.sparkSession

    def added(rows: DataFrame) -> DataFrame:
        return rows.groupBy("qid").agg(F.max("best").alias("best"), F.sum("n").alias("n"), F.sum("least").alias("least"))

    columns = deal(queries, *shared(block, column))
    if not columns:
        return spark.createDataFrame([], TOTALS)
    found_by = lambda files: added(corpus.mapInArrow(task_rows(files, Totals, scorer), TOTALS))
    if len(columns) == 1:
        return found_by(columns[0])
    path = store.scratch(spark, "found")
    for files in columns:
        found_by(files).write.mode("append").parquet(path)
    return added(spark.read.parquet(path))
