"""SentencePiece BPE: each prefix's last token by automaton matches and pair tests, ids recovered backwards, and decoding."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What stands for a space in pieces.
SPACE = "▁"
REPLACEMENT = "�"
#: Bytes of segments and of their ids that a worker remembers, in each of two generations, and the longest segment among them.
REMEMBERED = 24 << 20
LONGEST = 64
#: Pairs of tokens whose test a worker remembers.
PAIRS = 1 << 20


class Pieces:
    """A SentencePiece BPE model: its pieces, their ranks, and the two directions.

    The tokens of a text are those that merging adjacent symbols, best score first, then leftmost, leaves. No merge crosses
    a border between tokens, so a prefix that ends at one is coded by the tokens before it, and tokens are the code of a text
    exactly where each two neighbours are the code of their joined text. So each prefix has one last token: the one that
    ends there and is compatible with the last token of the prefix before it.
    """

    kept: dict[str, Pieces] = {}

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if sp.encode(" x\n  y ", out_type=str) != [*sp.encode(" x", out_type=str), *sp.encode("\n  y ", out_type=str)[1:]] or sp.decode(sp.encode("  A ﬁ ")) != "  A ﬁ ":
            raise ValueError("the model changes its text: only models that keep every character are read here")
        names = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        self.bytes = {int(names[i][3:5], 16): i for i in range(len(names)) if sp.is_byte(i)}
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte pieces to fall back to")
        plain = [i for i in range(len(names)) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.names, self.unknown = names, len(names)
        self.id = {names[i]: i for i in plain}
        self.score = {names[i]: sp.get_score(i) for i in plain}
        # what each id decodes to: bytes, with spaces; byte pieces their byte, control pieces nothing
        self.byte_ids = set(self.bytes.values())
        self.controls = {i for i in range(len(names)) if sp.is_control(i)}
        self.out = [b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else names[i].replace(SPACE, " ").encode() for i in range(len(names))]
        for b, i in self.bytes.items():
            self.out[i] = bytes([b])
        self.automaton = ahocorasick.Automaton()
        for name, i in self.id.items():
            self.automaton.add_word(name, (i, len(name)))
        self.automaton.make_automaton()
        inside = {c for name in self.id for c in name}
        if not inside <= self.id.keys():
            raise ValueError("a character of a piece is no piece")
        lone = "".join(c for c in "\n\t\r" if c not in inside)
        if any(SPACE in name.lstrip(SPACE) for name in self.id):
            self.segment = re.compile("[^" + lone + "]+|[" + lone + "]" if lone else ".+", re.DOTALL)
        else:  # no piece goes on with a space after anything else
            self.segment = re.compile(f"{SPACE}*[^{SPACE}{lone}]+|{SPACE}+" + (f"|[{lone}]" if lone else ""))
        self.pair: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.size = 0

    @classmethod
    def of(cls, path: str) -> Pieces:
        """The model at a place, read once a worker."""
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    # ------------------------------------------------------------ encoding

    def _stays_apart(self, text: str, border: int) -> bool:
        """Whether merging leaves two tokens, border characters the first (0: one token)."""
        parts, score = list(text), self.score
        left = border  # characters of parts before the border
        while len(parts) > (2 if border else 1):
            best, place = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, place = s, i
            if best is None:
                return False
            if border:
                at = sum(map(len, parts[: place + 1]))
                if at == left:
                    return False
            parts[place : place + 2] = [parts[place] + parts[place + 1]]
        return not (border and score.get(parts[0] + parts[1]) is not None)

    def _compatible(self, first: int, second: int) -> bool:
        key = first << 20 | second
        found = self.pair.get(key)
        if found is None:
            if len(self.pair) >= PAIRS:
                self.pair.clear()
            a = self.names[first]
            found = self.pair[key] = self._stays_apart(a + self.names[second], len(a))
        return found

    def _reached(self, token: int) -> bool:
        """Whether a piece is the code of its own text."""
        found = self.whole.get(token)
        if found is None:
            found = self.whole[token] = self._stays_apart(self.names[token], 0)
        return found

    def _last_tokens(self, text: str) -> list[int]:
        """The last token of each prefix of a text; a character that is no piece is `unknown`, and merges with nothing."""
        last = [self.unknown] * len(text)
        length = 0
        at = -1
        for end, (token, n) in self.automaton.iter(text):
            if end == at:
                continue  # settled
            start = end - n
            if start < 0 or last[start] == self.unknown:
                good = self._reached(token)
            else:
                good = self._compatible(last[start], token)
            if good:
                last[end], at, length = token, end, n
        return last

    def _segment_ids(self, text: str) -> list[int]:
        """The ids of a text, from its end backwards through its prefixes' last tokens."""
        last = self._last_tokens(text)
        out: list[int] = []
        at = len(text) - 1
        while at >= 0:
            token = last[at]
            if token == self.unknown:
                out.extend(self.bytes[b] for b in reversed(text[at].encode()))
                at -= 1
            else:
                out.append(token)
                at -= len(self.names[token])
        out.reverse()
        return out

    def _ids(self, segment: str) -> bytes:
        found = self.known.get(segment)
        if found is None:
            found = self.before.get(segment)
            if found is None:
                found = np.array(self._segment_ids(segment), np.int32).tobytes()
            if len(segment) <= LONGEST:
                if self.size >= REMEMBERED:
                    self.known, self.before, self.size = {}, self.known, 0
                self.known[segment] = found
                self.size += 4 * len(segment) + len(found) + 150
        return found

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, a space before it, no begin or end ids; of an empty text none."""
        if not text:
            return np.empty(0, np.int32)
        segments = self.segment.findall(SPACE + text.replace(" ", SPACE))
        known = self.known
        return np.frombuffer(b"".join([known.get(s) or self._ids(s) for s in segments]), np.int32)

    # ------------------------------------------------------------ decoding

    def decode(self, ids: list[int]) -> str:
        """The text of ids: the first space goes, byte pieces in a row are UTF-8, each byte that is in no character becomes U+FFFD."""
        out = self.out
        parts = [out[i] for i in ids]
        for n, i in enumerate(ids):  # the space that encoding put first
            if parts[n] or i in self.byte_ids:
                if i not in self.byte_ids and self.names[i].startswith(SPACE):
                    parts[n] = parts[n][1:]
                break
        try:
            if self.controls.isdisjoint(ids):  # else they part bytes
                return b"".join(parts).decode()
        except UnicodeDecodeError:
            pass
        return "".join(_characters(list(run)) if own else b"".join(run).decode() for own, run in _runs(ids, parts, self.byte_ids))


def _runs(ids: list[int], parts: list[bytes], byte_ids: set[int]) -> Iterator[tuple[bool, list[bytes]]]:
    start = 0
    for i in range(1, len(ids) + 1):
        if i == len(ids) or (ids[i] in byte_ids) != (ids[start] in byte_ids):
            yield ids[start] in byte_ids, parts[start:i]
            start = i


def _characters(run: list[bytes]) -> str:
    data, out, at = b"".join(run), [], 0
    while at < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                pass
        else:
            out.append(REPLACEMENT)
            at += 1
    return "".join(out)


# ---------------------------------------------------------------- tables


def _id_lists(ids: list[np.ndarray]) -> pa.Array:
    off = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate([np.empty(0, np.int32), *ids])))


def encode(docs: DataFrame, path: str, with_decoded: bool = False) -> DataFrame:
    """doc_id and ids of each row's whole text, as the model at `path` codes it without begin and end ids; with_decoded: also the text of these ids.

    path must be readable by the executors. A null text is empty and has no ids. An empty table gives no rows; repeated rows
    are each coded; further columns are ignored. Nothing is shuffled; segments that a worker has coded are remembered, REMEMBERED
    bytes of them twice at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Pieces.of(path)
        for batch in batches:
            ids, held, start = [], 0, 0
            for i, text in enumerate(batch.column("text")):
                ids.append(model.encode(text.as_py() or ""))
                held += len(ids[-1])
                if held >= 1 << 20 or i == batch.num_rows - 1:
                    out = {"doc_id": batch.column("doc_id").slice(start, len(ids)), "ids": _id_lists(ids)}
                    if with_decoded:
                        out["decoded"] = pa.array([model.decode(x.tolist()) for x in ids], pa.string())
                    yield pa.record_batch(out)
                    ids, held, start = [], 0, i + 1

    schema = "doc_id long, ids array<int>" + (", decoded string" if with_decoded else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and the text of each row's ids; null ids are none, and null elements or ids that the model doesn't have are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Pieces.of(path)
        for batch in batches:
            texts = [model.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def digests(coded: DataFrame) -> DataFrame:
    """The number of ids, and digests of the ids in decimal and of the decoded text."""
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
