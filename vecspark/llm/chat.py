"""Chat formatting: typed content parts flattened into a marked, reversible text with placeholders and a loss mask."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The template's control strings, as written.
START, END = "<|im_start|>", "<|im_end|>"
_ESCAPE = re.compile(r"\\|<\|")


def escape(text: str) -> str:
    """text without control strings: a backslash is doubled and `<|` becomes `<\\|`."""
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else "<\\|", text)


def unescape(text: str) -> str:
    out, i = [], 0
    while (j := text.find("\\", i)) >= 0:
        out.append(text[i:j])
        nxt = text[j + 1 : j + 2]
        out.append("\n" if nxt == "n" else nxt)
        i = j + 2
    out.append(text[i:])
    return "".join(out)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


@dataclass
class Flat:
    """What the visitor gathers: the flattened text, attachment references in order and the tokens that placeholders expand to."""

    text: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    expanded: int = 0


class PartVisitor:
    """Flattens typed parts; each kind has a visit method, and an unknown kind is an error."""

    def __init__(self, patch: int = 14, audio_rate: float = 25.0, page_tokens: int = 512, image_tokens: int = 256):
        self.patch, self.audio_rate, self.page_tokens, self.image_tokens = patch, audio_rate, page_tokens, image_tokens

    def flatten(self, parts: list[dict]) -> Flat:
        flat = Flat()
        for part in parts:
            visit = getattr(self, f"visit_{part.get('type')}", None)
            if visit is None:
                raise ValueError(f"no such kind of part: {part.get('type')!r}")
            visit(part, flat)
        return flat

    def visit_text(self, part: dict, flat: Flat) -> None:
        flat.text.append(escape(part.get("text") or ""))

    def _attach(self, kind: str, part: dict, tokens: int, flat: Flat) -> None:
        n = len(flat.attachments)
        flat.text.append(f"<|{kind}:{n}|>")
        flat.attachments.append({"index": n, "kind": kind, "ref": part.get("ref") or "", "tokens": tokens})
        flat.expanded += tokens

    def visit_image(self, part: dict, flat: Flat) -> None:
        w, h = part.get("width"), part.get("height")
        self._attach("image", part, -(-int(w) // self.patch) * -(-int(h) // self.patch) if w and h else self.image_tokens, flat)

    def visit_audio(self, part: dict, flat: Flat) -> None:
        self._attach("audio", part, int(-(-float(part.get("seconds") or 0) * self.audio_rate // 1)), flat)

    def visit_document(self, part: dict, flat: Flat) -> None:
        self._attach("document", part, int(part.get("pages") or 1) * self.page_tokens, flat)


def render(role: str, flat: Flat) -> str:
    return f"{START}{escape_role(role)}\n{''.join(flat.text)}{END}\n"


def parse(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text with placeholders, start and end of the text's escaped form) of each turn of a formatted text."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn begins at {at}")
        line = formatted.index("\n", at)
        end = formatted.index(END, line)
        yield unescape(formatted[at + len(START) : line]), unescape(formatted[line + 1 : end]), line + 1, end
        at = end + len(END) + 1


_FORMATTED = "conv_id long, turn long, formatted string, loss array<struct<start:int,end:int>>, attachments string, expanded_tokens long"


def _format(visitor: PartVisitor, loss_roles: tuple[str, ...]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
            parts = batch.column("parts").to_pylist() if "parts" in batch.schema.names else [None] * len(roles)
            out, loss, att, tokens = [], [], [], []
            for role, text, extra in zip(roles, texts, parts, strict=True):
                flat = visitor.flatten(json.loads(extra) if extra else [{"type": "text", "text": text}])
                role = role or ""
                s = render(role, flat)
                a = len(START) + len(escape_role(role)) + 1
                out.append(s)
                loss.append([{"start": a, "end": len(s) - len(END) - 1}] if role in loss_roles else [])
                att.append(json.dumps(flat.attachments))
                tokens.append(flat.expanded)
            yield pa.record_batch({"conv_id": batch.column("conv_id"), "turn": batch.column("turn"), "formatted": pa.array(out, pa.string()), "loss": pa.array(loss, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), "attachments": pa.array(att, pa.string()), "expanded_tokens": pa.array(tokens, pa.int64())})

    return run


def format_turns(conversations: DataFrame, visitor: PartVisitor | None = None, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Each turn (conv_id, turn, role, text and optionally `parts`, a JSON list of typed parts) in its formatted form.

    A conversation's formatted text is its rows joined in order of turn (then of formatted text). A null text is empty, a
    null role an empty one. loss holds the code points of a segment that the loss covers. Other columns are ignored.
    """
    cols = ["conv_id", "turn", "role", "text", *(["parts"] if "parts" in conversations.columns else [])]
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *cols[2:]).mapInArrow(_format(visitor or PartVisitor(), loss_roles), _FORMATTED)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    conv, n, chars, lost = None, 0, 0, 0
    turns, loss = hashlib.sha256(), hashlib.sha256()

    def out() -> pa.RecordBatch:
        names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        done = pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=list(names))
        rows.clear()
        return done

    for batch in batches:
        for c, segment, spans in zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist(), batch.column("loss").to_pylist(), strict=True):
            if n and c != conv:
                rows.append((conv, n, turns.hexdigest(), lost, loss.hexdigest(), chars))
                n, chars, lost, turns, loss = 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            conv = c
            for role, text, _, _ in parse(segment):
                n += 1
                turns.update(f"{role}\n{text}\n".encode())
            for s in spans:
                piece = unescape(segment[s["start"] : s["end"]])
                lost += len(piece)
                loss.update(piece.encode())
            chars += len(segment)
        if len(rows) >= 4096:
            yield out()
    if n:
        rows.append((conv, n, turns.hexdigest(), lost, loss.hexdigest(), chars))
    yield out()


def digest(formatted: DataFrame) -> DataFrame:
    """A row for each conversation, read back from the formatted segments as a stream: no conversation is held whole."""
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return ordered.select("conv_id", "formatted", "loss").mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
