"""Benchmark decontamination by winnowing: selected k-gram hashes meet, and hits are extended to whole windows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import LOWER, WORD, Hasher, U, chunks, durable, grams, words, plainly_named

WINDOW = 10
GRAM = 5
#: Words of benchmark text that one pass over the documents takes; a larger benchmark takes more passes.
BLOCK_WORDS = 2_000_000
_hash = Hasher(31)


def _hashed(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    buf = LOWER[raw]
    s, e, first = words(buf, off, WORD)
    return _hash.ranges(_hash.prefix(buf), s, e), first


def _selected(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The winnowed k-grams: of each run of WINDOW - GRAM + 1 k-grams in a text the least hash, rightmost on ties. Hashes and their places in all grams."""
    g, at, gfirst = grams(h, first, GRAM, whole=False)
    run = WINDOW - GRAM + 1
    if len(g) < run:
        return g[:0], at[:0]
    least = g[: len(g) - run + 1].copy()
    where = np.zeros(len(least), np.int64)
    for j in range(1, run):
        x = g[j : len(g) - run + 1 + j]
        better = x <= least
        least[better] = x[better]
        where[better] = j
    text = np.repeat(np.arange(len(gfirst) - 1), np.diff(gfirst))
    inside = text[: len(least)] == text[run - 1 :]
    picked = np.unique((np.arange(len(least)) + where)[inside])
    return g[picked], at[picked]


class Benchmark:
    """A block of items in arrays: selected 5-grams, and for each window length the windows' hashes with the numbers of their items."""

    def __init__(self, items: list[tuple[str | None, str | None]]):
        self.names = [name for name, _ in items]
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        prints = [np.empty(0, U)]
        for lo, hi, raw, off in chunks(pa.array([t or "" for _, t in items], pa.string())):
            h, first = _hashed(raw, off)
            prints.append(_selected(h, first)[0])
            size = np.diff(first)
            g, _, gf = grams(h, first, WINDOW, whole=False)
            found.setdefault(WINDOW, []).append((g, lo + np.repeat(np.arange(hi - lo), np.diff(gf))))
            for i in np.flatnonzero((size < WINDOW) & (size > 0)).tolist():
                own, _, _ = grams(h[first[i] : first[i + 1]], np.array([0, size[i]]), int(size[i]))
                found.setdefault(int(size[i]), []).append((own, np.array([lo + i])))
        self.prints = np.unique(np.concatenate(prints))
        self.bitmap = np.zeros(1 << 20, bool)
        self.bitmap[(self.prints >> U(44)).astype(np.int64)] = True
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n, parts in found.items():
            h, item = (np.concatenate(x) for x in zip(*parts, strict=True))
            if len(h):
                order = np.lexsort((item, h))
                self.windows[n] = h[order], item[order]

    def items(self, n: int, window: np.uint64) -> set:
        h, item = self.windows[n]
        return {self.names[k] for k in item[np.searchsorted(h, window) : np.searchsorted(h, window, side="right")].tolist()}


def _in(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _hits(bench: Benchmark, h: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]], set]]:
    """For each text with a hit: its number, word ranges of all window occurrences and the items."""
    sel, at = _selected(h, first)
    if len(bench.prints):
        may = bench.bitmap[(sel >> U(44)).astype(np.int64)]
        may[may] = _in(sel[may], bench.prints)
        hit = set((np.searchsorted(first, at[may], side="right") - 1).tolist())
    else:
        hit = set()
    ranges: dict[int, list] = {}
    items: dict[int, set] = {}

    def note(g: np.ndarray, at: np.ndarray, n: int, doc: Callable[[int], int], base: int) -> None:
        for k in np.flatnonzero(_in(g, bench.windows[n][0])).tolist():
            i = doc(int(at[k]))
            ranges.setdefault(i, []).append((int(at[k]) + base - int(first[i]), int(at[k]) + base - int(first[i]) + n))
            items.setdefault(i, set()).update(bench.items(n, g[k]))

    if WINDOW in bench.windows:
        for i in hit:  # extended: all windows of the text are looked up
            g, p, _ = grams(h[first[i] : first[i + 1]], np.array([0, first[i + 1] - first[i]]), WINDOW, whole=False)
            note(g, p, WINDOW, lambda _, i=i: i, int(first[i]))
    for n in sorted(bench.windows.keys() - {WINDOW}):
        g, p, _ = grams(h, first, n, whole=False)
        note(g, p, n, lambda k: int(np.searchsorted(first, k, side="right") - 1), 0)
    for i in sorted(ranges):
        yield i, ranges[i], items[i]


def _covered(ranges: list[tuple[int, int]]) -> int:
    total, end = 0, 0
    for a, b in sorted(ranges):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


_FOUND = "doc_id long, n_words long, ranges array<struct<a:int,b:int>>, items array<string>, body long"


def scan(docs: DataFrame, items: list[tuple[str | None, str | None]]) -> DataFrame:
    """Every document with its word count, the word ranges that the items' windows cover and those items' ids."""
    shared = docs.sparkSession.sparkContext.broadcast(Benchmark(items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = shared.value
        for batch in batches:
            for lo, hi, raw, off in chunks(batch.column("text")):
                h, first = _hashed(raw, off)
                ranges: list = [[] for _ in range(hi - lo)]
                names: list = [[] for _ in range(hi - lo)]
                for i, r, s in _hits(bench, h, first):
                    ranges[i] = [{"a": a, "b": b} for a, b in r]
                    names[i] = sorted(x for x in s if x is not None)
                yield pa.record_batch({"doc_id": batch.column("doc_id").slice(lo, hi - lo), "n_words": pa.array(np.diff(first), pa.int64()), "ranges": pa.array(ranges, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), "items": pa.array(names, pa.list_(pa.string())), "body": batch.column("body").slice(lo, hi - lo)})

    return docs.select("doc_id", "text", F.xxhash64("text").alias("body")).mapInArrow(run, _FOUND)


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[str | None, str | None]]]:
    rows, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("id"), "text").orderBy("id", "text").toLocalIterator():
        rows.append((r.id, r.text))
        size += len(r.text or "") // 4 + 1
        if size >= BLOCK_WORDS:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated and the hit word ranges.

    Windows are 10 consecutive item words (an item of fewer words is one window); words are runs of ASCII letters, digits and
    non-ASCII bytes, A-Z lower-cased. Any shared run of 10 words holds a selected 5-gram in both texts, so none is missed;
    documents with such a hit have all their windows looked up by a 64-bit hash of 64-bit word hashes. Items of fewer than 10
    words are looked up by all runs of their length. A null text has no words, an item of none no windows; items without an
    id hit words but are not counted. The benchmark is taken in blocks of BLOCK_WORDS, one pass over the documents each; rows
    of several blocks are merged by doc_id and text, so equal rows stay equal. Further columns are ignored.
    """
    passes = [scan(docs, block) for block in _blocks(benchmark)] or [scan(docs, [])]
    if len(passes) == 1:
        found = passes[0]
    else:
        found = None
        for p in passes:
            p = durable(p.withColumn("twin", F.row_number().over(_twins())))
            found = p if found is None else durable(found.alias("a").join(p.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.body") == F.col("b.body")) & (F.col("a.twin") == F.col("b.twin"))).select(
                "a.doc_id", "a.n_words", F.concat("a.ranges", "b.ranges").alias("ranges"), F.array_union("a.items", "b.items").alias("items"), "a.body", "a.twin"))
    return found.select("doc_id", "n_words", "ranges", "items").mapInArrow(_report, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, ranges array<struct<a:int,b:int>>")


def _twins():
    from pyspark.sql import Window

    return Window.partitionBy("doc_id", "body").orderBy(F.lit(1))


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hit = [_covered([(r["a"], r["b"]) for r in x]) if x else 0 for x in batch.column("ranges").to_pylist()]
        items = [sorted(x) for x in batch.column("items").to_pylist()]
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_words": batch.column("n_words"), "n_hit": pa.array(hit, pa.int64()), "n_items": pa.array([len(x) for x in items], pa.int64()), "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()), "contaminated": pa.array([x > 0 for x in hit], pa.bool_()), "ranges": batch.column("ranges")})


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs, all columns, without documents that hold a window of the benchmark; each block of it is one step over the rows, no shuffle."""
    sc = docs.sparkSession.sparkContext
    rows = plainly_named(docs, "text")
    for block in _blocks(benchmark):
        rows = rows.mapInArrow(_keep(sc.broadcast(Benchmark(block))), rows.schema)
    return rows.toDF(*docs.columns)


def _keep(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for lo, _, raw, off in chunks(batch.column("text")):
                h, first = _hashed(raw, off)
                for i, _, _ in _hits(shared.value, h, first):
                    keep[lo + i] = False
            yield batch.filter(pa.array(keep))

    return run
