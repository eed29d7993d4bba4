"""Line dedup: two Bloom filters find lines that may repeat; only those are shuffled, for exact counts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import ASCII_SPACE, LOWER, Hasher, U, chunks, durable, mix

#: Bits of each Bloom filter (8 MB) and places of a line in it. A fuller filter suspects more lines; results stay exact.
BITS = 1 << 26
#: Lines in more documents than HOT are spread over tasks: broadcast (24 bytes each) up to BROADCAST_KEYS of them, else salted.
HOT = 4_096
BROADCAST_KEYS = 200_000
SALTS = 64
PLACES = 3
BLOCK = 1 << 14
_one, _two = Hasher(21), Hasher(22)
_SPACE = np.zeros(256, bool)
_SPACE[[x for x in ASCII_SPACE if x != 10]] = True
_LINES_TYPE = T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("doc_id", T.LongType())])


def _lines(raw: np.ndarray, off: np.ndarray, shortest: int):
    """Of a chunk: starts and ends of the lines, number of each text's first line, and for lines with long enough keys their numbers and two key hashes."""
    end = np.flatnonzero(raw == 10)
    start = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
    first = np.searchsorted(end, off)  # a text's last line ends at the separator before the next
    black = np.flatnonzero(~_SPACE[raw] & (raw != 10))
    lo = np.searchsorted(black, start)
    hi = np.searchsorted(black, end)
    some = hi > lo
    ks = np.where(some, black[np.minimum(lo, max(len(black) - 1, 0))] if len(black) else 0, start)
    ke = np.where(some, black[np.maximum(hi - 1, 0)] + 1 if len(black) else 0, start)
    points = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=points[1:])
    kept = np.flatnonzero(points[ke] - points[ks] >= shortest)
    buf = LOWER[raw]
    h1 = _one.ranges(_one.prefix(buf), ks[kept], ke[kept])
    h2 = _two.ranges(_two.prefix(buf), ks[kept], ke[kept])
    return start, end, first, kept, h1, h2


def _places(h1: np.ndarray, h2: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(mix(h1 + U(j) * h2) % U(bits)).astype(np.int64) for j in range(PLACES)]


def _filters(shortest: int, bits: int) -> Callable:
    """Two filters of each task's rows, in blocks: lines of one document at least, and of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for _, _, raw, off in chunks(batch.column(0), b"\n"):
                _, _, first, kept, h1, h2 = _lines(raw, off, shortest)
                doc = np.searchsorted(first, kept, side="right")
                order = np.lexsort((h1, doc))  # a document counts once
                d, a, b = doc[order], h1[order], h2[order]
                fresh = np.ones(len(d), bool)
                fresh[1:] = (d[1:] != d[:-1]) | (a[1:] != a[:-1])
                a, b = a[fresh], b[fresh]
                _, at, n = np.unique(a, return_index=True, return_counts=True)
                a, b = a[at], b[at]
                again = n > 1
                places = _places(a, b, bits)
                known = np.ones(len(a), bool)
                for p in places:
                    known &= (once[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)
                for p in places:
                    q = p[known | again]
                    np.bitwise_or.at(twice, q >> 3, np.left_shift(1, q & 7).astype(np.uint8))
                    np.bitwise_or.at(once, p >> 3, np.left_shift(1, p & 7).astype(np.uint8))
        full = np.flatnonzero(once.reshape(-1, BLOCK).any(axis=1))
        for part in np.array_split(full, max(1, len(full) // 64)):
            yield pa.record_batch({"block": pa.array(part, pa.int32()), "once": pa.array([once[i * BLOCK : (i + 1) * BLOCK].tobytes() for i in part], pa.binary()), "twice": pa.array([twice[i * BLOCK : (i + 1) * BLOCK].tobytes() for i in part], pa.binary())})

    return run


def _merged(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block of the filter of lines that may be in two documents: in two tasks' filters of one, or in one's of two."""
    once, twice = np.zeros(BLOCK, np.uint8), np.zeros(BLOCK, np.uint8)
    for batch in batches:
        for a, b in zip(batch.column("once").to_pylist(), batch.column("twice").to_pylist(), strict=True):
            a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
            twice |= b | once & a
            once |= a
    yield pa.record_batch({"block": pa.array([key[0].as_py()], pa.int32()), "twice": pa.array([twice.tobytes()], pa.binary())})


def suspects(docs: DataFrame, shortest: int = 20, bits: int = BITS) -> DataFrame:
    """Rows (h1, h2, doc_id), one for each document and line key that may be in two documents; h1, h2 are a 128-bit digest of the key."""
    spark = docs.sparkSession
    parts = docs.where("doc_id is not null").select("text").mapInArrow(_filters(shortest, bits), "block int, once binary, twice binary")
    blocks = parts.groupBy("block").applyInArrow(_merged, "block int, twice binary").collect()  # bits / 8 bytes at most
    whole = np.zeros(bits // 8, np.uint8)
    for r in blocks:
        whole[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.twice, np.uint8)
    shared = spark.sparkContext.broadcast(whole.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, _, raw, off in chunks(batch.column(1), b"\n"):
                _, _, first, kept, h1, h2 = _lines(raw, off, shortest)
                hit = np.ones(len(kept), bool)
                for p in _places(h1, h2, bits):
                    hit &= (known[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)
                doc = ids[lo + np.searchsorted(first, kept[hit], side="right") - 1]
                yield pa.record_batch({"h1": h1[hit].view(np.int64), "h2": h2[hit].view(np.int64), "doc_id": doc})

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, _LINES_TYPE)


def _drop(shortest: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, drops = batch.column("doc_id"), batch.column("drops").to_pylist()
            texts = batch.column("text")
            for lo, hi, raw, off in chunks(texts, b"\n"):
                start, end, first, kept, h1, h2 = _lines(raw, off, shortest)
                place = np.searchsorted(kept, first)
                whole = raw.tobytes()
                n, gone, out = [], [], []
                for i in range(hi - lo):
                    a, b = int(first[i]), int(first[i + 1])
                    n.append(b - a)
                    if not drops[lo + i]:
                        gone.append(0)
                        out.append(whole[off[i] : off[i + 1] - 1])
                        continue
                    bad = {(d["h1"], d["h2"]) for d in drops[lo + i]}
                    p, q = int(place[i]), int(place[i + 1])
                    skip = {int(k) for k, x, y in zip(kept[p:q], h1[p:q].view(np.int64).tolist(), h2[p:q].view(np.int64).tolist(), strict=True) if (x, y) in bad}
                    gone.append(len(skip))
                    out.append(b"\n".join(whole[start[j] : end[j]] for j in range(a, b) if j not in skip))
                yield pa.record_batch({"doc_id": ids.slice(lo, hi - lo), "n_lines": pa.array(n, pa.int64()), "n_dropped": pa.array(gone, pa.int64()), "kept": pa.array([x.decode() for x in out], pa.string()), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in out], pa.string())})

    return run


def kept_elsewhere(seen: DataFrame, repeated: DataFrame, hot: int = HOT, broadcast: int = BROADCAST_KEYS) -> DataFrame:
    """Rows (h1, h2, doc_id) of `seen` whose line another document keeps.

    A line in more than `hot` documents never meets in one task: such lines' digests are broadcast where there are at most
    `broadcast` of them, else repeated for SALTS parts of their rows. All others are joined by digest.
    """
    common = repeated.where(F.col("n") > hot).select("h1", "h2", F.col("keep").alias("top"))
    if common.count() <= broadcast:
        marked = seen.join(F.broadcast(common), ["h1", "h2"], "left")
    else:
        salted = common.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
        marked = seen.withColumn("salt", salt).join(salted, ["h1", "h2", "salt"], "left").drop("salt")
    rare = marked.where("top is null").drop("top").join(repeated.where(F.col("n") <= hot).select("h1", "h2", "keep"), ["h1", "h2"])
    return rare.where("doc_id <> keep").drop("keep").unionByName(marked.where("doc_id <> top").drop("top"))


def dedup_lines(docs: DataFrame, shortest: int = 20, least_docs: int = 3, with_text: bool = True, bits: int = BITS, hot: int = HOT) -> DataFrame:
    """A row for each document: doc_id, n_lines, n_dropped, kept_sha256 and (with_text) the kept text.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of at least `shortest` code points
    in at least `least_docs` documents (distinct doc_ids) lose all their lines but in the largest doc_id that holds them, which
    keeps all its own. A null or empty text is one empty line; rows with a null doc_id neither count nor lose lines; rows of
    one doc_id are one document. An empty table gives no rows; further columns are ignored.
    """
    seen = durable(suspects(docs, shortest, bits).distinct())
    repeated = durable(seen.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep")).where(F.col("n") >= least_docs))
    out = kept_elsewhere(seen, repeated, hot).groupBy("doc_id").agg(F.collect_list(F.struct("h1", "h2")).alias("drops"))
    rows = docs.select("doc_id", "text").join(out.hint("shuffle_hash"), "doc_id", "left")
    schema = "doc_id long, n_lines long, n_dropped long, kept string, kept_sha256 string"
    done = rows.mapInArrow(_drop(shortest), schema)
    return done if with_text else done.drop("kept")
