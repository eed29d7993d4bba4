"""`vecstream`: tables of vectors or codes in length-prefixed files, written and read in parallel, as a batch or as a stream.

A written folder has a file for each FILE_BYTES of a task and a manifest for each commit, which names its files in order, with
their rows. What no manifest names, as the files of a lost or repeated task, isn't read. Files from elsewhere are one task
each, until `index` has put a list of record offsets beside them.
"""

from __future__ import annotations

import base64
import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

from . import formats
from .store import located

FILE_BYTES = 64 << 20
#: Bytes that a reader asks the store for at once, and rows of a batch.
READ_BYTES, BATCH = 8 << 20, 4096
MANIFEST, OFFSETS = "_manifest-", ".offsets"
COLUMNS = {"stream": ["id", "vector"], "scalar": ["id", "qvec"], "nf4": ["id", "packed", "scale"], "rq": ["id", "codes"], "pq": ["id", "code"]}
SCHEMA = "ord long, id string, vector array<float>"


# ---------------------------------------------------------------- reading


def opened(file) -> formats.Header:
    """The header of an open file, however long its model is."""
    size = 1 << 16
    while True:
        file.seek(0)
        data = file.read(size)
        try:
            return formats.read_header(data)
        except (EOFError, struct.error, ValueError):
            if len(data) < size:
                raise
            size *= 8


def records(file, start: int, end: int | None = None) -> Iterator[tuple[int, bytes]]:
    """(where its length stands, payload) of each record from start up to end; a cut length ends the file, a cut payload is an error."""
    file.seek(start)
    held, at = b"", start
    while end is None or at < end:
        if len(held) < 4 or len(held) < 4 + struct.unpack_from("<I", held)[0]:
            wanted = READ_BYTES if len(held) < 4 else max(READ_BYTES, 4 + struct.unpack_from("<I", held)[0] - len(held))
            more = file.read(wanted)
            if not more:
                if len(held) >= 4:
                    raise EOFError("a record ends early")
                return
            held += more
            continue
        low = 0
        while low + 4 <= len(held) and (end is None or at < end):
            n = struct.unpack_from("<I", held, low)[0]
            if low + 4 + n > len(held):
                break
            yield at, held[low + 4 : low + 4 + n]
            low += 4 + n
            at += 4 + n
        held = held[low:]


@dataclass
class Range(InputPartition):
    """Records of a file from byte start to end (-1: to its end); first is the ord of the first one."""

    path: str
    start: int
    end: int
    first: int


def _batches(part: Range) -> Iterator[pa.RecordBatch]:
    if not part.path:  # nothing was written
        return
    fs, path = located(part.path)
    with fs.open_input_file(path) as file:
        head = opened(file)
        if head.kind == "dataset":
            file.seek(0)
            rows = formats.decode_file(file.read())
        else:
            rows = (formats.decode_record(head, x) for _, x in records(file, part.start or head.start, part.end if part.end >= 0 else None))
        ids, vectors, at = [], [], part.first
        for name, v in rows:
            ids.append(name)
            vectors.append(v)
            if len(ids) == BATCH:
                yield _batch(at, ids, vectors)
                at += len(ids)
                ids, vectors = [], []
        if ids:
            yield _batch(at, ids, vectors)


def _batch(at: int, ids: list, vectors: list) -> pa.RecordBatch:
    return pa.record_batch({"ord": pa.array(range(at, at + len(ids)), pa.int64()), "id": pa.array(ids, pa.string()), "vector": pa.array(vectors, pa.list_(pa.float32()))})


def manifests(path: str) -> list[dict]:
    """The commits of a folder in order, from the last one that replaced all before."""
    fs, at = located(path)
    if fs.get_file_info(at).type == pafs.FileType.File:
        return []
    found = [x.path for x in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)) if x.base_name.startswith(MANIFEST)]
    out: list[dict] = []
    for p in sorted(found):
        with fs.open_input_file(p) as f:
            m = json.loads(f.read())
        out = [m] if m["replaces"] else [*out, m]
    return out


def _ranges(path: str, kept: list[dict]) -> list[Range]:
    out = []
    for m in kept:
        first = m["first"]
        for f in m["files"]:
            out.append(Range(f"{path.rstrip('/')}/{f['name']}", 0, -1, first))
            first += f["rows"]
    return out or [Range("", 0, 0, 0)]


def _foreign(path: str) -> list[str]:
    """The files of a folder that no commit wrote, or the one file."""
    fs, at = located(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return [path]
    names = sorted(x.base_name for x in fs.get_file_info(pafs.FileSelector(at)) if x.is_file and not x.base_name.startswith(("_", ".")) and not x.base_name.endswith(OFFSETS))
    return [f"{path.rstrip('/')}/{n}" for n in names]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.only = options["path"], options.get("kind")

    def partitions(self) -> list[InputPartition]:
        """A range for each file of the commits, or those of the offsets beside a file from elsewhere; only headers and lists are read here."""
        kept = manifests(self.path)
        if kept:
            self._same_kind({m["kind"] for m in kept})
            return _ranges(self.path, kept)
        out: list[InputPartition] = []
        first: int | None = 0
        for file in _foreign(self.path):
            fs, at = located(file)
            if first is None:
                raise ValueError(f"{self.path} has several files whose rows weren't counted: index it first")
            if self.only:
                with fs.open_input_file(at) as f:
                    self._same_kind({opened(f).kind})
            if fs.get_file_info(at + OFFSETS).type == pafs.FileType.File:
                with fs.open_input_file(at + OFFSETS) as f:
                    marks = list(struct.iter_unpack("<QQQ", f.read()))
                out += [Range(file, a, b, first + n) for n, a, b in marks[:-1]]
                first += marks[-1][0]
            else:
                out.append(Range(file, 0, -1, first))
                first = None
        return out or [Range("", 0, 0, 0)]

    def _same_kind(self, kinds: set) -> None:
        if self.only and kinds != {formats.KINDS.get(self.only, self.only)}:
            raise ValueError(f"{self.path} is no {self.only} file")

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        return _batches(part)


class _StreamReader(DataSourceStreamReader):
    """The commits of a folder as they arrive: an offset is the number of the last commit read, so a restart goes on after it; ord numbers all rows."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def initialOffset(self) -> dict:
        return {"commit": 0}

    def latestOffset(self) -> dict:
        return {"commit": max((m["commit"] for m in manifests(self.path)), default=0)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return _ranges(self.path, [m for m in manifests(self.path) if start["commit"] < m["commit"] <= end["commit"]])

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        return _batches(part)


def index(spark: SparkSession, path: str, every: int = FILE_BYTES) -> DataFrame:
    """Puts beside each file from elsewhere the offsets of its records at every `every` bytes, so that it is read in so many tasks.

    One task walks each file's length prefixes. Returns (path, rows, ranges), computed once. A file without magic has no records to list.
    """
    files = spark.createDataFrame([(x,) for x in _foreign(path)], "path string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("path").to_pylist():
                fs, at = located(name)
                with fs.open_input_file(at) as file:
                    head = opened(file)
                    if head.kind == "dataset":
                        raise ValueError(f"{name} is one data set, without records")
                    marks, begin, first, n, stop = [], head.start, 0, 0, head.start
                    for place, payload in records(file, head.start):
                        if place - begin >= every:
                            marks.append((first, begin, place))
                            begin, first = place, n
                        n += 1
                        stop = place + 4 + len(payload)
                    marks.append((first, begin, stop))
                with fs.open_output_stream(at + OFFSETS) as out:
                    out.write(b"".join(struct.pack("<QQQ", *m) for m in [*marks, (n, stop, stop)]))
                yield pa.record_batch({"path": pa.array([name]), "rows": pa.array([n], pa.int64()), "ranges": pa.array([len(marks)], pa.int64())})

    found = files.repartition(max(1, files.count())).mapInArrow(run, "path string, rows long, ranges long").collect()
    return spark.createDataFrame(found, "path string, rows long, ranges long")


# ---------------------------------------------------------------- writing


@dataclass
class _Written(WriterCommitMessage):
    part: int
    files: list


class _Writer(DataSourceArrowWriter):
    """Tasks write whole files; the driver writes the manifest, which makes them part of the folder, or removes what it knows of."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.kind, self.overwrite = options["path"], options.get("kind", "stream"), overwrite
        self.head = base64.b64decode(options["header"]) if "header" in options else formats.encode_header(self.kind, vendor=options.get("vendor", formats.VENDOR))
        self.limit = int(options.get("filebytes", options.get("fileBytes", FILE_BYTES)))
        self.single = options.get("single") == "true"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, at = located(self.path)
        part, files = TaskContext.get().partitionId(), []
        held, rows = [], 0
        size = 0

        def flush() -> None:
            nonlocal held, rows, size
            name = f"part-{part:05d}-{len(files):05d}-{uuid.uuid4().hex}.{formats.KINDS[self.kind].lower()}"
            head = self.head if self.kind != "nf4" else self.head[:-4] + struct.pack("<I", rows)
            fs.create_dir(at, recursive=True)
            with fs.open_output_stream(f"{at}/{name}") as out:
                out.write(b"".join([head, *held]))
            files.append({"name": name, "rows": rows, "bytes": len(head) + size})
            held, rows, size = [], 0, 0

        for batch in iterator:
            for row in zip(*(batch.column(c).to_pylist() for c in COLUMNS[self.kind]), strict=True):
                held.append(formats.encode_record(self.kind, row))
                size += len(held[-1])
                rows += 1
                if size >= self.limit:
                    flush()
        if held:
            flush()
        return _Written(part, files)

    def commit(self, messages: list) -> None:
        fs, at = located(self.path)
        before = manifests(self.path)
        files = [f for m in sorted((m for m in messages if m), key=lambda m: m.part) for f in m.files]
        number = before[-1]["commit"] + 1 if before else 1
        first = 0 if self.overwrite else sum(f["rows"] for m in before for f in m["files"])
        body = {"commit": number, "kind": formats.KINDS[self.kind], "first": first, "replaces": self.overwrite, "files": files}
        fs.create_dir(at, recursive=True)
        new = f"{at}/.{uuid.uuid4().hex}"
        with fs.open_output_stream(new) as out:
            out.write(json.dumps(body).encode())
        fs.move(new, f"{at}/{MANIFEST}{number:010d}.json")

    def abort(self, messages: list) -> None:
        fs, at = located(self.path)
        for m in messages:
            for f in m.files if m else []:
                fs.delete_file(f"{at}/{f['name']}")


class VectorStream(DataSource):
    """Reads and writes as the module says. Options: path; kind (of `formats.KINDS`); for writing header (base64, see `write`) and fileBytes. One writer at a time."""

    @classmethod
    def name(cls) -> str:
        return "vecstream"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VectorStream)


def read(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """ord, id and (decoded) vector of a written folder, a file or a folder of indexed files."""
    register(spark)
    rows = spark.read.format("vecstream").option("path", path)
    return (rows.option("kind", kind) if kind else rows).load()


def write(rows: DataFrame, path: str, kind: str = "stream", model=None, dim: int = 0, mode: str = "append", file_bytes: int = FILE_BYTES) -> None:
    """A table of the kind's columns and ord into a folder, in order of ord, in parallel: dealt by ranges of ord, no row passes the driver.

    model: ranges [dim, 2] of the scalar codec, or a trained quantiser; it stands in each file's header. No null ids, vectors or codes.
    """
    register(rows.sparkSession)
    placed = rows.repartitionByRange("ord").sortWithinPartitions("ord").select(*COLUMNS[kind])
    head = base64.b64encode(formats.encode_header(kind, model, dim)).decode()
    placed.write.format("vecstream").option("path", path).option("kind", kind).option("header", head).option("fileBytes", file_bytes).mode(mode).save()


def write_file(rows: DataFrame, path: str, kind: str = "stream", model=None, dim: int = 0, vendor: str = formats.VENDOR) -> int:
    """One file of such a table, in order of ord, and its number of rows; no rows, no file. One task writes it as a stream, so path must be in a shared store."""
    placed = rows.repartition(1).sortWithinPartitions("ord").select(*COLUMNS[kind])
    count = rows.count() if kind == "nf4" else 0
    head = formats.encode_header(kind, model, dim, count, vendor)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, out = 0, None
        for batch in batches:
            if batch.num_rows and out is None:
                fs, at = located(path)
                out = fs.open_output_stream(at)
                out.write(head)
            if batch.num_rows:
                out.write(b"".join(formats.encode_record(kind, row) for row in zip(*(batch.column(c).to_pylist() for c in COLUMNS[kind]), strict=True)))
                n += batch.num_rows
        if out is not None:
            out.close()
        yield pa.record_batch({"n": pa.array([n], pa.int64())})

    return sum(r.n for r in placed.mapInArrow(run, "n long").collect())
