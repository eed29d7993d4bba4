"""Length-prefixed binary streams of vectors and codes, read and written as tables.

A file is a magic line `<vendor>+<KIND>\\n`, a header by kind and records of a 32-bit length and a payload. Everything is little-endian;
strings and lists are a 64-bit length and their elements. Readers take any vendor; files without a magic line hold one whole data set.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions.exprs import NF4_LEVELS
from ..operators.pq import ProductQuantizer
from ..operators.rq import ResidualQuantizer

VENDOR = "VECSPARK"
_MAGIC = re.compile(rb"[A-Z0-9_-]{1,32}\+(STREAM1|QSTREAM1|NF4STREAM1|RQSTREAM1|PQSTREAM1)\n")
LEVELS = np.array(NF4_LEVELS, np.float32)
KINDS = {"stream": "STREAM1", "scalar": "QSTREAM1", "nf4": "NF4STREAM1", "rq": "RQSTREAM1", "pq": "PQSTREAM1"}


# ---------------------------------------------------------------- primitives


class Cursor:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, fmt: str):
        out = struct.unpack_from("<" + fmt, self.data, self.at)
        self.at += struct.calcsize("<" + fmt)
        return out if len(out) > 1 else out[0]

    def bytes(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise EOFError("a record ends early")
        out = self.data[self.at : self.at + n]
        self.at += n
        return out

    def blob(self) -> bytes:
        return self.bytes(self.take("Q"))

    def floats(self) -> np.ndarray:
        return np.frombuffer(self.bytes(4 * self.take("Q")), "<f4")


def _blob(x: bytes) -> bytes:
    return struct.pack("<Q", len(x)) + x


def _floats(v) -> bytes:
    a = np.asarray(v, "<f4")
    return struct.pack("<Q", len(a)) + a.tobytes()


def _books(books: np.ndarray) -> bytes:
    """[subspace][centroid][part] as nested lists."""
    return struct.pack("<Q", len(books)) + b"".join(struct.pack("<Q", len(b)) + b"".join(_floats(c) for c in b) for b in books)


def _read_books(c: Cursor) -> np.ndarray:
    return np.array([[c.floats() for _ in range(c.take("Q"))] for _ in range(c.take("Q"))], np.float64)


# ---------------------------------------------------------------- models in headers


def pq_blob(m: ProductQuantizer) -> bytes:
    return struct.pack("<QQQ", m.m, m.k, m.dim) + _books(m.books)


def read_pq_blob(data: bytes) -> ProductQuantizer:
    c = Cursor(data)
    _, _, dim = c.take("QQQ")
    return ProductQuantizer(_read_books(c), dim)


def rq_blob(m: ResidualQuantizer) -> bytes:
    k = m.books[0].shape[1] if m.books else 0
    return struct.pack("<QQQQ", len(m.books), m.m, k, m.dim) + struct.pack("<Q", len(m.books)) + b"".join(_books(b) for b in m.books) + b"\x01"


def read_rq_blob(data: bytes) -> ResidualQuantizer:
    c = Cursor(data)
    _, m, _, dim = c.take("QQQQ")
    books = [_read_books(c) for _ in range(c.take("Q"))]
    return ResidualQuantizer(books, m, dim, dim)


# ---------------------------------------------------------------- files


@dataclass
class Header:
    """What stands before the records: kind (`dataset` for a file without magic), where they begin, and the codec's model."""

    kind: str
    start: int
    model: object = None
    dim: int = 0


def read_header(data: bytes) -> Header:
    m = _MAGIC.match(data[:64])
    if not m:
        return Header("dataset", 0)
    kind = m[1].decode()
    c = Cursor(data, m.end())
    if kind == "QSTREAM1":
        n, dim, size = c.take("III")
        table = Cursor(c.bytes(size))
        count = table.take("Q")
        return Header(kind, c.at, np.frombuffer(table.bytes(8 * count), "<f4").reshape(-1, 2).astype(np.float64), dim)
    if kind == "NF4STREAM1":
        dim, _ = c.take("II")
        return Header(kind, c.at, None, dim)
    if kind in ("RQSTREAM1", "PQSTREAM1"):
        blob = c.bytes(c.take("I"))
        return Header(kind, c.at, (read_rq_blob if kind[0] == "R" else read_pq_blob)(blob))
    return Header(kind, c.at)


def offsets(data: bytes, start: int) -> Iterator[int]:
    """Where each record's payload begins; a cut length ends the file, a cut payload is an error."""
    at = start
    while at + 4 <= len(data):
        (n,) = struct.unpack_from("<I", data, at)
        if at + 4 + n > len(data):
            raise EOFError("a record ends early")
        yield at + 4
        at += 4 + n


def decode_file(data: bytes) -> Iterator[tuple[str, np.ndarray]]:
    """(id, vector) of each record; codes are decoded."""
    h = read_header(data)
    if h.kind == "dataset":
        c = Cursor(data)
        for _ in range(c.take("Q")):
            yield c.blob().decode(), c.floats()
        return
    for at in offsets(data, h.start):
        (n,) = struct.unpack_from("<I", data, at - 4)
        yield decode_record(h, data[at : at + n])


def decode_record(h: Header, payload: bytes) -> tuple[str, np.ndarray]:
    """(id, vector) of one record of a file with this header."""
    c = Cursor(payload)
    name = c.blob().decode()
    if h.kind == "STREAM1":
        return name, c.floats()
    if h.kind == "QSTREAM1":
        q = np.frombuffer(c.blob(), np.uint8).astype(np.float64)
        mn, mx = h.model[: len(q), 0], h.model[: len(q), 1]
        return name, np.where(mx > mn, mn + q / 255 * (mx - mn), mn).astype(np.float32)
    if h.kind == "NF4STREAM1":
        packed = np.frombuffer(c.blob(), np.uint8)
        codes = np.stack([packed & 15, packed >> 4], axis=1).ravel()[: h.dim]
        return name, LEVELS[codes] * np.float32(c.take("f"))
    if h.kind == "PQSTREAM1":
        code = np.frombuffer(c.blob(), np.uint8).astype(np.int64)
        return name, h.model.books[np.arange(h.model.m), code].ravel().astype(np.float32)
    out = np.zeros(h.model.dim)
    for p in range(c.take("Q")):
        code = np.frombuffer(c.blob(), np.uint8).astype(np.int64)
        b = h.model.books[p]
        there = code < b.shape[1]
        out += (b[np.arange(len(b)), np.where(there, code, 0)] * there[:, None]).ravel()
    return name, out.astype(np.float32)


def magic(kind: str, vendor: str = VENDOR) -> bytes:
    return f"{vendor}+{KINDS[kind]}\n".encode()


def encode_header(kind: str, model=None, dim: int = 0, count: int = 0, vendor: str = VENDOR) -> bytes:
    """model: ranges [dim, 2] of the scalar codec, or a trained quantiser."""
    out = magic(kind, vendor)
    if kind == "scalar":
        table = struct.pack("<Q", len(model)) + np.asarray(model, "<f4").tobytes()
        return out + struct.pack("<III", len(model), dim, len(table)) + table
    if kind == "nf4":
        return out + struct.pack("<II", dim, count)
    if kind in ("pq", "rq"):
        blob = (pq_blob if kind == "pq" else rq_blob)(model)
        return out + struct.pack("<I", len(blob)) + blob
    return out


def encode_record(kind: str, row: tuple) -> bytes:
    """A row is (id, vector), (id, code bytes), (id, packed, scale) or (id, [code bytes, ..]) by kind."""
    payload = _blob(row[0].encode())
    if kind == "stream":
        payload += _floats(row[1])
    elif kind == "nf4":
        payload += _blob(row[1]) + struct.pack("<f", row[2])
    elif kind == "rq":
        payload += struct.pack("<Q", len(row[1])) + b"".join(_blob(x) for x in row[1])
    else:
        payload += _blob(row[1])
    return struct.pack("<I", len(payload)) + payload


def encode_dataset(rows) -> bytes:
    rows = list(rows)
    return struct.pack("<Q", len(rows)) + b"".join(_blob(i.encode()) + _floats(v) for i, v in rows)


# ---------------------------------------------------------------- tables


def _decode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            ids, vectors, n = [], [], 0
            for name, v in decode_file(data):
                ids.append(name)
                vectors.append(v)
                if len(ids) == 4096:
                    yield _rows(path, n, ids, vectors)
                    n += len(ids)
                    ids, vectors = [], []
            yield _rows(path, n, ids, vectors)


def _rows(path: str, n: int, ids: list, vectors: list) -> pa.RecordBatch:
    return pa.record_batch({"path": pa.array([path] * len(ids), pa.string()), "place": pa.array(range(n, n + len(ids)), pa.int64()), "id": pa.array(ids, pa.string()), "vector": pa.array(vectors, pa.list_(pa.float32()))})


def read(spark: SparkSession, path: str) -> DataFrame:
    """path, place, id, vector of the files in any store that Spark reads; a task for each file."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_decode_batches, "path string, place long, id string, vector array<float>")
