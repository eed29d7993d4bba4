"""What several operators share: durable tables, order-preserving buckets and words as byte segments."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------- durable tables


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and all runs on one machine (tests)."""
    sc = spark.sparkContext
    at = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="vecspark-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, so that a lost executor loses nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def plainly_named(docs: DataFrame, *needed: str) -> DataFrame:
    """docs with every column but the needed ones under a name without dots, quotes or clashes; toDF(*docs.columns) brings them back."""
    return docs.toDF(*(c if c in needed else f"further_{i}" for i, c in enumerate(docs.columns)))


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns of a row, of whatever type (maps can't be hashed as such)."""
    return F.xxhash64(F.to_json(F.struct(*(F.col(c) for c in docs.columns))))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- order-preserving buckets

CUTS = 64


class Buckets:
    """A monotone map from a long column to buckets 0..n-1 of about equal row counts; nulls go to bucket -1.

    The cut points are CUTS approximate quantiles (a bounded sketch); between two of them the map is linear.
    """

    def __init__(self, df: DataFrame, col: str, n: int):
        row = df.agg(
            F.percentile_approx(col, [i / CUTS for i in range(CUTS + 1)], 1000).alias("q"), F.min(col).alias("lo"), F.max(col).alias("hi")
        ).first()
        self.each = max(1, -(-n // CUTS))
        cuts = sorted({int(x) for x in (row.q or [])} | {int(row.lo), int(row.hi)}) if row.lo is not None else [0]
        self.cuts, self.n = cuts, len(cuts) * self.each

    def of(self, col: str) -> Column:
        c = F.col(col)
        level = sum((F.when(c >= F.lit(x), 1).otherwise(0) for x in self.cuts[1:]), F.lit(0))
        if len(self.cuts) == 1:
            return F.when(c.isNull(), -1).otherwise(0).cast("int")
        lo = F.array(*[F.lit(float(x)) for x in self.cuts])
        width = F.array(*[F.lit(float(b - a)) for a, b in zip(self.cuts, self.cuts[1:], strict=False)], F.lit(1.0))
        sub = F.least(F.floor((c.cast("double") - F.get(lo, level)) * self.each / F.get(width, level)), F.lit(self.each - 1))
        return F.when(c.isNull(), -1).otherwise(level * self.each + sub).cast("int")


# ---------------------------------------------------------------- byte segments

#: Bytes of text looked at in one go; a longer text makes a chunk of its own.
CHUNK = 1 << 20
#: Rows whose texts are unpacked at once.
ROWS = 1024

ASCII_SPACE = [0x20, *range(0x09, 0x0E)]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Words between ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[ASCII_SPACE] = False
#: Words of ASCII letters, digits and all bytes from 0x80 (after lower-casing).
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed)) | U(1)


class Hasher:
    """Polynomial hashes modulo 2**64 of byte ranges, through prefix sums; hashers differ in what a byte counts."""

    BASE = 0x5851F42D4C957F2B
    _pow = _back = np.ones(1, U)

    def __init__(self, seed: int = 1):
        self.table = _table(seed)

    @classmethod
    def powers(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The first n powers of the base and of its inverse; those for a chunk are kept."""
        if len(cls._pow) >= n:
            return cls._pow[:n], cls._back[:n]
        size = max(n, CHUNK + 1)
        out = []
        for base in (cls.BASE, pow(cls.BASE, -1, 1 << 64)):
            p = np.full(size, U(base))
            p[0] = 1
            out.append(np.cumprod(p, dtype=U))
        if size == CHUNK + 1:
            cls._pow, cls._back = out
        return out[0][:n], out[1][:n]

    def prefix(self, buf: np.ndarray) -> np.ndarray:
        out = np.empty(len(buf) + 1, U)
        out[0] = 0
        np.cumsum(self.table[buf] * self.powers(len(buf))[0], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of each range, wherever it lies; empty ranges have hash mix(0)."""
        return mix((prefix[end] - prefix[start]) * self.powers(len(prefix))[1][start] + (end - start).astype(U))


def chunks(texts: pa.Array, sep: bytes = b" ") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes with a separator after each text, start of each text and the end) for chunks of a column; nulls are empty."""
    for top in range(0, len(texts), ROWS):
        rows = [x or b"" for x in texts.slice(top, ROWS).cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]
        lo = 0
        while lo < len(rows):
            size, hi = 0, lo
            while hi < len(rows) and (hi == lo or size + len(rows[hi]) < CHUNK):
                size += len(rows[hi]) + 1
                hi += 1
            off = np.zeros(hi - lo + 1, np.int64)
            np.cumsum([len(x) + 1 for x in rows[lo:hi]], out=off[1:])
            yield top + lo, top + hi, np.frombuffer(sep.join([*rows[lo:hi], b""]), np.uint8), off
            lo = hi


def words(buf: np.ndarray, off: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text (and the end) the number of its first word."""
    edge = np.flatnonzero(np.diff(kind[buf].view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    start, end = edge[0::2], edge[1::2]
    return start, end, np.searchsorted(start, off)


SHINGLE = 5
_COEF = [U(int(x)) for x in mix(np.arange(100, 164, dtype=U)) | U(1)]


def grams(h: np.ndarray, first: np.ndarray, n: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of n words that stay in a text, where each starts, and for each text (and the end) the number of its first run.

    whole: a text of fewer words, but not none, is one run.
    """
    count = np.diff(first)
    if not len(h):
        return np.empty(0, U), np.empty(0, np.int64), np.zeros(len(first), np.int64)
    m = max(len(h) - n + 1, 0)
    total = h[:m] * _COEF[0]
    for j in range(1, n):
        total += h[j : m + j] * _COEF[j]
    total += U(n)
    keep = np.ones(len(h), bool)
    for j in range(1, n):  # the last n - 1 words of each text start no run
        ends = first[1:][count >= j] - j
        keep[ends] = False
    total = mix(total)
    if m < len(h):
        total = np.concatenate([total, np.zeros(len(h) - m, U)])
    if whole:
        for i in np.flatnonzero((count < n) & (count > 0)).tolist():
            a, k = int(first[i]), int(count[i])
            total[a] = mix(np.array([sum(int(x) * int(c) for x, c in zip(h[a : a + k], _COEF, strict=False)) + k & (1 << 64) - 1], U))[0]
            keep[a] = True
    kept = np.flatnonzero(keep)
    return total[kept], kept, np.searchsorted(kept, first)


_words = Hasher(11)


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, ascending distinct 5-word shingle hashes of all rows, start of each row's and the end): A-Z lower-cased, words between ASCII space."""
    for lo, hi, raw, off in chunks(texts):
        buf = LOWER[raw]
        s, e, first = words(buf, off, NOT_SPACE)
        g, _, at = grams(_words.ranges(_words.prefix(buf), s, e), first, SHINGLE)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a > 1:
                g[a:b].sort()
        fresh = np.ones(len(g), bool)
        fresh[1:] = g[1:] != g[:-1]
        fresh[at[:-1][at[:-1] < len(g)]] = True
        kept = np.flatnonzero(fresh)
        yield lo, hi, g[kept], np.searchsorted(kept, at)
