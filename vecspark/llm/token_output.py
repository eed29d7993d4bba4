"""Token-id files: blocks of documents' ids coded by an interleaved static range asymmetric numeral system."""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Buckets, fresh_path, shuffle_width

#: Frequencies add up to 2**SCALE; lanes are coded in step; a checkpoint holds all lanes' states.
SCALE = 18
LANES = 1024
CHECKPOINT_STEPS = 128
BLOCK_TOKENS = 1 << 18
LOW = 1 << 31
MAGIC = b"RANSIDS1"
#: Words whose ids a worker remembers, at most, besides those it looks up just now; bytes of such a word, at most.
REMEMBERED = 300_000
LONGEST = 64
#: Bytes of text whose words are looked up together; words that go to the tokenizer's model in a string.
LOOKED_UP = 1 << 22
TOGETHER = 128
_U = np.uint64


class Table:
    """Shared static frequencies of the ids that occur, scaled to 2**SCALE with at least 1 each."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        order = np.argsort(ids)
        self.ids, counts = ids[order].astype(np.uint32), counts[order].astype(np.float64)
        n, whole = len(self.ids), 1 << SCALE
        if n > whole // 2:
            raise ValueError(f"{n} ids are too many for frequencies of {SCALE} bits")
        freq = 1 + np.floor(counts / max(counts.sum(), 1) * (whole - n)).astype(np.int64)
        if n:
            freq[int(np.argmax(counts))] += whole - freq.sum()
        self.freq = freq.astype(_U)
        self.start = np.concatenate([[0], np.cumsum(freq)]).astype(_U)[:-1]
        self.symbol = np.repeat(np.arange(n), freq)
        self.number = np.zeros(int(self.ids.max(initial=0)) + 1, np.int64)
        self.number[self.ids] = np.arange(n)


def encode(table: Table, ids: np.ndarray) -> bytes:
    """A block of ids that all are in the table: header, checkpoints, words, checksum."""
    sym = table.number[ids]
    n = len(sym)
    steps = -(-n // LANES)
    x = np.full(LANES, LOW, _U)
    out: list[np.ndarray] = []
    marks: list[tuple[int, int, np.ndarray]] = []  # step, words written from there to the end, states
    written = 0
    for t in range(steps - 1, -1, -1):
        s = sym[t * LANES : (t + 1) * LANES]
        f, c, own = table.freq[s], table.start[s], x[: len(s)]
        full = own >= f << _U(63 - SCALE)
        words = (own[full] & _U(0xFFFFFFFF)).astype(np.uint32)
        out.append(words)
        written += len(words)
        own[full] >>= _U(32)
        q = own // f
        x[: len(s)] = (q << _U(SCALE)) + (own - q * f) + c
        if t % CHECKPOINT_STEPS == 0:
            marks.append((t, written, x.copy()))
    body = np.concatenate(out[::-1]) if out else np.empty(0, np.uint32)
    marks.reverse()
    head = struct.pack("<8sIII", MAGIC, n, len(body), len(marks))
    table_ = b"".join(struct.pack("<II", t, len(body) - w) + s.astype("<u8").tobytes() for t, w, s in marks)
    payload = head + table_ + body.astype("<u4").tobytes()
    return payload + struct.pack("<I", zlib.crc32(payload))


def decode(table: Table, block: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids first..last of a block, from the checkpoint at or before first; the checksum is tested."""
    magic, n, size, n_marks = struct.unpack_from("<8sIII", block)
    if magic != MAGIC or zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise ValueError("a block is damaged")
    last = n if last is None else min(last, n)
    if first >= last:
        return np.empty(0, np.uint32)
    each = 8 + 8 * LANES
    base = 20
    mark = first // LANES // CHECKPOINT_STEPS
    step, at = struct.unpack_from("<II", block, base + mark * each)
    x = np.frombuffer(block, "<u8", LANES, base + mark * each + 8).astype(_U)
    body = np.frombuffer(block, "<u4", size, base + n_marks * each)
    out, began = [], step * LANES
    mask = _U((1 << SCALE) - 1)
    while step * LANES < last:
        own = x[: min(LANES, n - step * LANES)]
        slot = own & mask
        s = table.symbol[slot.astype(np.int64)]
        out.append(s)
        own = table.freq[s] * (own >> _U(SCALE)) + slot - table.start[s]
        low = own < _U(LOW)
        k = int(np.count_nonzero(low))
        own[low] = own[low] << _U(32) | body[at : at + k]
        at += k
        x[: len(own)] = own
        step += 1
    return table.ids[np.concatenate(out)[first - began : last - began]]


# ---------------------------------------------------------------- tokens


#: Words of Latin-1 letters, perhaps with closing marks: their normal form is lower case, their pre-tokens are the letters and the marks.
_LETTER, _MARK = r"[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]", r"[!-&(-/:;=?@\[-`{}~]"
_PLAIN = f"^{_LETTER}+{_MARK}*$"


def _binary(offsets: np.ndarray, data: pa.Buffer | None) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), data or pa.py_buffer(b"")])


class Remembered:
    """Ids of words, in Arrow arrays. `fresh` has those of words that aren't remembered."""

    def __init__(self, fresh: Callable[[pa.Array], pa.Array]):
        self.fresh = fresh
        self.words, self.ids, self.asked = pa.array([], pa.string()), pa.array([], pa.binary()), np.zeros(0, np.uint8)

    def look_up(self, words: pa.Array) -> pa.Array:
        """Ids of different words. Too many remembered: those stay that were asked for again since the last time, or else these; long ones never do."""
        at = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False).copy()
        new = words.filter(pa.array(at < 0))
        at[at < 0] = len(self.words) + np.arange(len(new))
        known, ids = pa.concat_arrays([self.words, new]), pa.concat_arrays([self.ids, self.fresh(new)])
        asked = np.concatenate([self.asked, np.zeros(len(new), np.uint8)])
        asked[at] = np.minimum(asked[at] + 1, 2)
        stay = np.less_equal(pc.binary_length(known).to_numpy(), LONGEST)
        if len(known) > REMEMBERED:
            again = asked > 1
            if np.count_nonzero(again) > REMEMBERED // 2:
                again[:] = False
                again[at[:REMEMBERED]] = True
            stay &= again
            asked[:] = 0
        kept = pa.array(stay)
        self.words, self.ids, self.asked = known.filter(kept), ids.filter(kept), asked[stay]
        return ids.take(pa.array(at))

    def rows(self, texts: pa.Array) -> pa.Array:
        """The ids of each text's words between spaces; each different word is looked up once."""
        if not len(texts):
            return pa.array([], pa.binary())
        pieces = pc.split_pattern(texts, " ")
        words = pieces.values.dictionary_encode()
        flat = self.look_up(words.dictionary).take(words.indices)
        _, at, data = flat.buffers()
        return _binary(np.frombuffer(at, np.int32, len(flat) + 1)[pieces.offsets.to_numpy()], data)


class Words:
    """Ids of words between spaces and line feeds, remembered by a worker from task to task.

    No pre-token of the tokenizers meant here spans such a place, so a text's ids are those of its words. Plain words' parts
    go to the tokenizer's model at once, many in a call; `plain` says whether that is right for this tokenizer, by trial. All others take the whole way.
    """

    kept: dict[tuple[str, int], Words] = {}

    def __init__(self, path: str, width: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok, self.type = Tokenizer.from_file(path), np.dtype(f"<u{width}")
        self.model = Tokenizer(self.tok.model)  # for parts in their normal form, between spaces
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), level])
        vocab, suffix = self.tok.get_vocab(), getattr(self.tok.model, "end_of_word_suffix", None)
        self.closes = np.zeros(max(vocab.values(), default=0) + 1, bool)  # ids that end a part
        self.closes[[i for x, i in vocab.items() if suffix and x.endswith(suffix)]] = True
        self.words, self.parts = Remembered(self._fresh), Remembered(self._parts)
        trial = ["the", "Straße", "ÀÉÎõü", "naïve.", "end?!", "Sch\u00f6nhausen,", "xqzj)", "ÿ;", "WORD...", "ab***", "ab_-&"]
        self.plain = bool(suffix) and all(x + suffix in vocab for x in level.alphabet())  # then each part has one end
        if self.plain:
            self.learn(set(trial))
            self.plain = [self.known[w] for w in trial] == self._whole(trial)
            self.words, self.parts = Remembered(self._fresh), Remembered(self._parts)

    @classmethod
    def of(cls, path: str, width: int) -> Words:
        if (path, width) not in cls.kept:
            cls.kept[path, width] = cls(path, width)
        return cls.kept[path, width]

    def _whole(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.type).tobytes() for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]

    def _parts(self, parts: pa.Array) -> pa.Array:
        """Ids of letters in lower case and of marks, by themselves."""
        lists = pa.ListArray.from_arrays(pa.array([*range(0, len(parts), TOGETHER), len(parts)], pa.int32()), parts)
        found = [np.empty(0, self.type)]
        for lo in range(0, len(lists), 32):  # what the tokenizer returns is large
            some = pc.binary_join(lists.slice(lo, 32), " ").to_pylist()
            found += [np.array(e.ids, self.type) for e in self.model.encode_batch_fast(some, add_special_tokens=False)]
        ids = np.concatenate(found)
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(parts):
            raise ValueError("the tokenizer's parts have no ends")
        return _binary(np.concatenate([[0], ends]) * self.type.itemsize, pa.py_buffer(ids.tobytes()))

    def _fresh(self, words: pa.Array) -> pa.Array:
        """Ids of words, plain ones by their parts."""
        plain = pc.match_substring_regex(words, _PLAIN).to_numpy(zero_copy_only=False) if self.plain else np.zeros(len(words), bool)
        order = np.concatenate([np.flatnonzero(plain), rest := np.flatnonzero(~plain)])
        low = pc.utf8_lower(words.filter(pa.array(plain)))
        found = [self.parts.rows(pc.replace_substring_regex(low, f"({_LETTER})({_MARK})", r"\1 \2", max_replacements=1))]
        for lo in range(0, len(rest), 4096):
            found.append(pa.array(self._whole(words.take(pa.array(rest[lo : lo + 4096])).to_pylist()), pa.binary()))
        return pa.concat_arrays(found).take(pa.array(np.argsort(order)))

    def learn(self, words: set[str]) -> None:
        """Has the ids of these words in `known`."""
        these = pa.array(sorted(words), pa.string())
        self.known = dict(zip(these.to_pylist(), self.words.look_up(these).to_pylist(), strict=True))

    def rows(self, texts: pa.Array) -> pa.Array:
        """The ids of each text, whose words are those between spaces and line feeds."""
        return self.words.rows(pc.replace_substring(texts.fill_null(""), "\n", " "))


def _tokenise(path: str, end_id: int) -> Callable:
    """Rows' ids with the end id, in 2 bytes each where the vocabulary allows it."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)
    width = 2 if max([*vocab["model"]["vocab"].values(), *(x["id"] for x in vocab.get("added_tokens", [])), end_id]) < 65536 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words.of(path, width)
        end = pa.scalar(np.array([end_id], words.type).tobytes())
        for batch in batches:
            size = np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(size // LOOKED_UP)) + 1).tolist(), len(size)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo < hi:
                    part = batch.slice(lo, hi - lo)
                    ids = pc.binary_join_element_wise(words.rows(part.column("text")), end, pa.scalar(b""))
                    yield pa.record_batch({"doc_id": part.column("doc_id"), "bucket": part.column("bucket"), "ids": ids})

    run.width = width
    return run


_STAGED = "bucket int, seq int, before long, doc_ids array<long>, sizes array<int>, ids binary"


def _pack(width: int) -> Callable:
    """Consecutive documents of a bucket, in blocks; a document is never split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, seq, before, docs, sizes, parts, size = None, 0, 0, [], [], [], 0

        def out() -> pa.RecordBatch:
            return pa.record_batch({"bucket": pa.array([bucket], pa.int32()), "seq": pa.array([seq], pa.int32()), "before": pa.array([before], pa.int64()), "doc_ids": pa.array([docs], pa.list_(pa.int64())), "sizes": pa.array([sizes], pa.list_(pa.int32())), "ids": pa.array([b"".join(parts)], pa.binary())})

        for batch in batches:
            for b, d, x in zip(batch.column("bucket").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                n = len(x) // width
                if docs and (b != bucket or size + n > BLOCK_TOKENS):
                    yield out()
                    seq, before = (seq + 1, before + size) if b == bucket else (0, 0)
                    docs, sizes, parts, size = [], [], [], 0
                bucket = b
                docs.append(d)
                sizes.append(n)
                parts.append(x)
                size += n
        if docs:
            yield out()

    return run


def _tally(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for x in batch.column("ids").to_pylist():
                n = np.bincount(np.frombuffer(x, f"<u{width}"))
                if len(n) > len(total):
                    total = np.concatenate([total, np.zeros(len(n) - len(total), np.int64)])
                total[: len(n)] += n
        ids = np.flatnonzero(total)
        yield pa.record_batch({"id": pa.array(ids, pa.int64()), "n": pa.array(total[ids], pa.int64())})

    return run


_BLOCK = "first_id long, before long, doc_ids array<long>, sizes array<int>, block binary"


def write_files(docs: DataFrame, tokenizer: str, end_id: int, path: str) -> DataFrame:
    """Tokenises every whole text and writes the coded blocks under path, in ascending doc_id order; returns the shared table's frequencies.

    Blocks are rows of Parquet files there (so that they live in any store that Spark writes), each with its own header,
    lane checkpoints and checksum; `table` beside them holds the frequencies. Documents are ordered by doc_id (null first),
    then by their ids. A null text is empty and gets its end id alone; equal rows are written each; an empty table writes no blocks.
    """
    spark = docs.sparkSession
    cut = Buckets(docs, "doc_id", 4 * shuffle_width(spark))
    run = _tokenise(tokenizer, end_id)
    tokens = docs.select("doc_id", cut.of("doc_id").alias("bucket"), "text").mapInArrow(run, "doc_id long, bucket int, ids binary")
    ordered = tokens.repartition(shuffle_width(spark), "bucket").sortWithinPartitions("bucket", "doc_id", "ids")
    ordered.mapInArrow(_pack(run.width), _STAGED).write.option("compression", "zstd").parquet(f"{path}/staged")
    staged = spark.read.schema(_STAGED).parquet(f"{path}/staged")
    tally = staged.select("ids").mapInArrow(_tally(run.width), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))  # a row for each id of the vocabulary at most
    tally.coalesce(1).write.parquet(f"{path}/table")
    table = spark.read.schema("id long, n long").parquet(f"{path}/table")
    before, offset = {}, 0
    for r in staged.select("bucket", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("bucket").agg(F.sum("n").alias("n")).orderBy("bucket").collect():  # cut.n rows at most
        before[r.bucket] = offset
        offset += r.n
    shared = spark.sparkContext.broadcast((_load(table), before))
    width = run.width

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, starts = shared.value
        for batch in batches:
            for b, at, d, s, x in zip(*(batch.column(c).to_pylist() for c in ("bucket", "before", "doc_ids", "sizes", "ids")), strict=True):
                block = encode(t, np.frombuffer(x, f"<u{width}"))
                yield pa.record_batch({"first_id": pa.array([d[0]], pa.int64()), "before": pa.array([starts[b] + at], pa.int64()), "doc_ids": pa.array([d], pa.list_(pa.int64())), "sizes": pa.array([s], pa.list_(pa.int32())), "block": pa.array([block], pa.binary())})

    staged.mapInArrow(code, _BLOCK).write.option("compression", "none").parquet(f"{path}/blocks")
    _remove(spark, f"{path}/staged")
    return table


def _remove(spark, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _load(table: DataFrame) -> Table:
    rows = table.collect()
    return Table(np.array([r.id for r in rows], np.int64), np.array([r.n for r in rows], np.int64))


def read_files(spark, path: str) -> DataFrame:
    """A row for each document of the files: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) and their crc32."""
    shared = spark.sparkContext.broadcast(_load(spark.read.schema("id long, n long").parquet(f"{path}/table")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for batch in batches:
            for at, d, s, x in zip(*(batch.column(c).to_pylist() for c in ("before", "doc_ids", "sizes", "block")), strict=True):
                ids = decode(t, x).astype("<u4")
                ends = np.cumsum(s)
                parts = [ids[e - n : e].tobytes() for e, n in zip(ends.tolist(), s, strict=True)]
                yield pa.record_batch({"doc_id": pa.array(d, pa.int64()), "start": pa.array(at + ends - np.array(s), pa.int64()), "n_tokens": pa.array(s, pa.int64()), "ids_crc32": pa.array([zlib.crc32(p) for p in parts], pa.int64()), "ids": pa.array(parts, pa.binary())})

    return spark.read.schema(_BLOCK).parquet(f"{path}/blocks").select("before", "doc_ids", "sizes", "block").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1, path: str | None = None) -> DataFrame:
    """Writes docs' token-id files (under the shared folder unless a path is given) and reads them back, without the ids."""
    spark = docs.sparkSession
    path = path or fresh_path(spark, "token-ids")
    write_files(docs, tokenizer, end_id, path)
    return read_files(spark, path).drop("ids")
