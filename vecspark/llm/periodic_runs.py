"""Periodic runs of words: grid points a period apart are compared for every period, what survives is extended word by word."""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A run has at least so many words, and so many periods.
LEAST_WORDS = 24
LEAST_PERIODS = 3
#: Parts of a period at which grid points that agree are probed again before they are extended.
PROBES = (1 / 2, 1 / 4, 3 / 4, 1 / 8, 3 / 8, 5 / 8, 7 / 8)
#: Words compared in one step of an extension: from the first number up to the second, doubling.
STEP, STEPS = 64, 1 << 16
#: Agreeing grid points that are looked at together.
HELD = 1 << 13


def _right(w: np.ndarray, at: int, p: int) -> int:
    """The first place from `at` on whose word differs from that p words on, or the last place with such a word."""
    end, step = len(w) - p, STEP
    while at < end:
        top = min(at + step, end)
        differ = w[at:top] != w[at + p : top + p]
        first = int(differ.argmax())
        if differ[first]:
            return at + first
        at, step = top, min(2 * step, STEPS)
    return end


def _left(w: np.ndarray, at: int, p: int) -> int:
    """The least place from which on all words up to `at` equal those p words on."""
    step = STEP
    while at > 0:
        low = max(at - step, 0)
        differ = (w[low:at] != w[low + p : at + p])[::-1]
        first = int(differ.argmax())
        if differ[first]:
            return at - first
        at, step = low, min(2 * step, STEPS)
    return 0


class _Search:
    """The runs of one text; periods come in ascending order, so a stretch is first met with its smallest period."""

    def __init__(self, w: np.ndarray, least_words: int, least_periods: int):
        self.w, self.least_words, self.least_periods = w, least_words, least_periods
        self.found: dict[tuple[int, int], int] = {}
        self.period = np.zeros(len(w), np.int64)  # of the newest run over each word
        self.end = np.zeros(len(w), np.int64)  # of that run

    def settle(self, p: np.ndarray, at: np.ndarray) -> None:
        """Extends the grid points at, at + p and at + 2 p that agree, ascending by p, then at; those inside known runs of a divisor of p are skipped."""
        w = self.w
        own = self.period[at]
        new = (own == 0) | (p % np.maximum(own, 1) != 0) | (self.end[at] <= at + 2 * p)
        p, at = p[new], at[new]
        for part in PROBES:
            x = at + (p * part).astype(np.int64)
            same = w[x] == w[x + p]
            p, at = p[same], at[same]
        for q, a in zip(p.tolist(), at.tolist(), strict=True):
            own = int(self.period[a])
            if own and q % own == 0 and self.end[a] > a + 2 * q:
                continue
            start, end = _left(w, a, q), _right(w, a, q) + q
            if end - start >= max(self.least_words, self.least_periods * q) and (start, end) not in self.found:
                self.found[start, end] = q
                self.period[start:end] = q
                self.end[start:end] = end


def _agreeing(w: np.ndarray, top: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Periods p up to top, ascending, and the multiples of p at which three grid points in a row agree, ascending for each."""
    n = len(w)
    root = min(isqrt(n), top)
    for p in range(1, root + 1):
        grid = w[::p]
        same = grid[1:] == grid[:-1]
        at = np.flatnonzero(same[1:] & same[:-1]) * p
        if len(at):
            yield np.full(len(at), p), at
    low = root + 1
    while low <= top:
        high = min(2 * low - 1, top)
        periods, places = [], []
        for j in range(n // low - 1):
            last = min(high, (n - 1) // (j + 2))
            if last < low:
                break
            first = w[j * low : j * last + 1 : j] if j else w[0]
            second, third = (w[i * low : i * last + 1 : i] for i in (j + 1, j + 2))
            hit = np.flatnonzero((second == third) & (first == second)) + low
            if len(hit):
                periods.append(hit)
                places.append(hit * j)
        if periods:
            p, at = np.concatenate(periods), np.concatenate(places)
            by = np.argsort(p, kind="stable")  # the places of one period come in ascending order
            yield p[by], at[by]
        low = high + 1


def find_runs(w: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of each run of equal numbers, by start, then period.

    A run of three periods p or more holds three multiples of p in a row and all between them. Up to the root of the length
    the grid of one period is a slice; beyond it the j-th grid points of all periods of a band are one: 2 * sqrt(n) slices a band
    at most, n * ln(n) comparisons together.
    """
    if least_periods < 3:
        raise ValueError("the grid finds runs of three periods or more")
    n = len(w)
    top = n // least_periods
    if n < least_words or top < 1:
        return []
    search = _Search(w, least_words, least_periods)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for p, at in _agreeing(w, top):
        held.append((p, at))
        size += len(at)
        if size >= HELD:
            search.settle(*map(np.concatenate, zip(*held, strict=True)))
            held, size = [], 0
    if held:
        search.settle(*map(np.concatenate, zip(*held, strict=True)))
    return sorted((start, end - start, p) for (start, end), p in search.found.items())


def _kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, p in runs:
        change[start + p] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def periodic_runs(docs: DataFrame, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, its runs (start, length, period; by start, then period) and the collapsed text.

    Words stand between ASCII white space and are compared as such, not by hash. A run is a longest stretch of words, at least
    least_words and least_periods (three or more) times its smallest period; the collapsed text has the words that no run holds after its first period,
    joined by one space. A null, empty or blank text has no words and no runs; an empty table gives no rows; repeated rows are
    each reported; further columns are ignored. A text is read whole by one task; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count, runs, texts = [], [], []
            for text in batch.column("text").cast(pa.large_string()).cast(pa.large_binary()):
                words = (text.as_py() or b"").split()
                number: dict[bytes, int] = {}
                w = np.fromiter((number.setdefault(x, len(number)) for x in words), np.int32, len(words))
                found = find_runs(w, least_words, least_periods)
                count.append(len(words))
                runs.append(found)
                texts.append(b" ".join(_kept(words, found)))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_words": pa.array(count, pa.int64()), "runs": pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in x] for x in runs], pa.list_(_RUN)), "collapsed": pa.array([x.decode() for x in texts], pa.string())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SCHEMA)


def strongest(runs: Column) -> Column:
    """The run of the greatest exact length / period, of equal ones the first by start, then period; null where there is none."""
    more = lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best)
    return F.when(F.size(runs) > 0, F.reduce(runs, F.get(runs, F.lit(0)), more))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, where the words of every tenth text or so (by the crc32 of its doc_id) repeat from some place on.

    With h the crc32, g = floor(h / 10) and n words, each word i from a = g % n on becomes word a + (i - a) % p, where
    p = 1 + floor((n - a) / (3 + g % 8)). Texts of other documents, of null doc_ids and without words stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.when(h % 10 == 0, words).alias("w"), F.floor(h / 10).alias("g"))
    rows = rows.withColumn("a", F.when(F.size("w") > 0, F.col("g") % F.size("w")))
    rows = rows.withColumn("p", 1 + F.floor((F.size("w") - F.col("a")) / (3 + F.col("g") % 8)))
    planted = F.transform("w", lambda x, i: F.when(i >= F.col("a"), F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))).otherwise(x))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.concat_ws(" ", planted)).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The number of runs, the strongest one, and digests of all runs and of the collapsed text."""
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    best = found.withColumn("best", strongest(F.col("runs")))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform("runs", line)).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
