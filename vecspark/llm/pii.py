"""Personal data: fixed patterns find seeds, whose contexts bootstrap lexical patterns for identifiers of unseen form."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import CHUNK, Hasher, durable, mix

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: A pattern needs as many different seeds, in as many documents, and this score to discover anything.
MIN_SUPPORT = 3
CONFIDENCE = 0.8
ROUNDS = 4


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns' matches that pass their tests, by kind, then start."""
    out = [("email", a, b) for a, b in _emails(text)]
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def lower(text: str) -> str:
    """text lower-cased code point by code point, each in its place: capital dotted I is i, and every sigma is the same."""
    if text.isascii():
        return text.lower()
    return text.replace("\u0130", "i").lower().replace("\u03c2", "\u03c3")


_TOKEN = re.compile(r"[^\s,;<>\"']+(?: (?=[(0-9])[^\s,;<>\"']+){0,4}")


# ---------------------------------------------------------------- contexts

#: What a code point is to a context: a character of words, a letter, white space or a token's end, something that an identifier has.
_WORD, _LETTER, _STOP, _SIGN = 1, 2, 4, 8
#: Characters between the two words of a context, and between the second one and the token, at most.
GAP, LAST_GAP = 3, 4
_kept: list[np.ndarray] = []


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point what it is, and what it counts in a hash: as much as its lower case."""
    if not _kept:
        kind, low = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint64)
        for c in range(0x110000):
            x = chr(c)
            word = x.isalnum() or x == "_"
            kind[c] = _WORD * word + _LETTER * (x.isalnum() and not x.isdecimal()) + _STOP * (x.isspace() or x in ",;<>\"'") + _SIGN * (x.isdigit() or x in "@:([")
            if word:
                low[c] = ord(lower(x))
        _kept.extend([kind, mix((low + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)])
    return _kept[0], _kept[1]


def contexts(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each place of a text where a token may follow a context: (place, start of the context, its hash, what each code point is).

    A context is two whole words of letters with what stands between and after them, lower-cased, on one line.
    """
    kinds, counts = _tables()
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kind = kinds[code]
    edge = np.flatnonzero(np.diff(kind & _WORD, prepend=np.uint8(0), append=np.uint8(0)))
    start, end = edge[0::2], edge[1::2]
    if len(start) < 2:
        none = np.empty(0, np.int64)
        return none, none, none.view(np.uint64), kind
    other = np.concatenate([[0], np.cumsum((kind & (_WORD | _LETTER)) == _WORD)])
    letters = other[end] == other[start]
    feeds = np.flatnonzero(code == 10)
    feed = np.append(feeds, len(code))[np.searchsorted(feeds, end)]  # the next line feed after each word
    pair = letters[1:] & letters[:-1] & (start[1:] - end[:-1] <= GAP) & (feed[:-1] >= start[1:])
    second = np.flatnonzero(pair) + 1
    stop = np.minimum(np.append(start[1:], len(code))[second], feed[second])
    place = (end[second][:, None] + np.arange(1, LAST_GAP + 1)).ravel()
    second = np.repeat(second, LAST_GAP)
    ok = place <= np.repeat(stop, LAST_GAP)
    ok[ok] = place[ok] < len(code)
    ok[ok] = (kind[place[ok]] & _STOP) == 0
    place, first = place[ok], start[second[ok] - 1]
    power, back = Hasher.powers(len(code) + 1)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(counts[code] * power[:-1], dtype=np.uint64)])
    return place, first, mix((prefix[place] - prefix[first]) * back[first] + (place - first).astype(np.uint64)), kind


def joined(texts: pa.Array) -> Iterator[tuple[int, str, list[int]]]:
    """(first row, texts each followed by a line feed, where each starts and the end) for chunks of a column; nulls are empty. No context crosses a line feed."""
    rows: list[str] = []
    size, first = 0, 0
    for i, text in enumerate(texts):
        x = text.as_py() or ""
        if rows and size + len(x) >= CHUNK >> 1:
            yield first, "\n".join([*rows, ""]), _offsets(rows)
            rows, size, first = [], 0, i
        rows.append(x)
        size += len(x) + 1
    if rows:
        yield first, "\n".join([*rows, ""]), _offsets(rows)


def _offsets(rows: list[str]) -> list[int]:
    return np.concatenate([[0], np.cumsum([len(x) + 1 for x in rows])]).tolist()


def follower(text: str, at: int) -> tuple[int, int] | None:
    """The token at a place, with digit groups that belong to it, without closing punctuation."""
    m = _TOKEN.match(text, at)
    if not m:
        return None
    end = m.end()
    while end > at and text[end - 1] in ".:!?)-":
        end -= 1
    return (at, end) if end > at else None


def plausible(kind: str, token: str) -> bool:
    """Whether a token that no fixed pattern takes may be an identifier of a kind."""
    digits = sum(c.isdigit() for c in token)
    if kind == "email":
        return ("@" in token or "(at)" in token or "[at]" in token) and len(token) >= 5
    if kind == "ip":
        return (token.count(":") >= 2 and all(c in "0123456789abcdefABCDEF:.%" for c in token)) or (token.count(".") >= 2 and digits >= 4 and digits + token.count(".") == len(token))
    if kind == "card":
        return 12 <= digits <= 19 and all(c.isdigit() or c in " -." for c in token)
    return 7 <= digits <= 15 and all(c.isdigit() or c in " ()+-./" for c in token)


# ---------------------------------------------------------------- patterns

#: Scores are whole numbers of 1 / UNIT, so that no order of adding changes them.
UNIT = 10**10
#: Patterns of one step over the texts (16 bytes each in every worker), and those whose scores are broadcast.
PATTERNS, BROADCAST = 1 << 22, 100_000
#: Miss hashes that a task holds before it hands them on.
HELD = 200_000


def _hash(value: str) -> int:
    """A value's hash, positive in 63 bits."""
    return xxhash.xxh64_intdigest(value.encode()) >> 1


def _hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every identifier after a context: the fixed patterns' matches, and other tokens that may be of a kind."""
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        for first, text, off in joined(batch.column("text")):
            seeds: dict[int, list[tuple[str, int]]] = {}
            for i in range(len(off) - 1):
                for kind, a, b in base_spans(text[off[i] : off[i + 1] - 1]):
                    seeds.setdefault(off[i] + a, []).append((kind, off[i] + b))
            place, begin, key, sort = contexts(text)
            # a token without a sign in its first group, and no other group, is of no kind
            signs = np.concatenate([[0], np.cumsum((sort & _SIGN) > 0)])
            stops = np.flatnonzero(sort & _STOP)
            group = stops[np.searchsorted(stops, place)] if len(place) else place
            sign = signs[np.minimum(group + 2, len(sort))] > signs[place]
            sign |= np.isin(place, np.fromiter(seeds, np.int64, len(seeds)))
            rows = []
            for x, c, h in zip(place[sign].tolist(), begin[sign].tolist(), key[sign].view(np.int64).tolist(), strict=True):
                own = dict(seeds.get(x, ()))
                token = follower(text, x)
                for kind in KINDS:
                    value = text[x : own[kind]] if kind in own else text[slice(*token)] if token and plausible(kind, text[slice(*token)]) else None
                    if value:
                        rows.append((kind, lower(text[c:x]), h, _hash(value), kind in own, ids[first + int(np.searchsorted(off, x, side="right")) - 1]))
            types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64())
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["kind", "pattern", "key", "instance", "seed", "doc_id"])


class _Known:
    """Patterns as sorted hashes, with a number for each: the first of several kinds' rows."""

    def __init__(self, kind: np.ndarray, key: np.ndarray, most: np.ndarray):
        by = np.lexsort((kind, key))
        self.kind, self.key, self.most = kind[by], key[by], most[by]
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[self._slot(self.key)] = True

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) >> np.uint64(44)).astype(np.int64)

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in `key`, row) for each pattern met."""
        key = key.view(np.int64)
        may = np.flatnonzero(self.sieve[self._slot(key)])
        low, high = (np.searchsorted(self.key, key[may], side=s) for s in ("left", "right"))
        n = high - low
        at = np.repeat(may, n)
        return at, np.repeat(low - np.cumsum(n) + n, n) + np.arange(len(at))


def _collected(patterns: DataFrame, most: str) -> list[_Known]:
    """Patterns (kind, key) with a number each, PATTERNS in each part."""
    t = patterns.select("kind", "key", F.col(most).alias("most")).toArrow()
    number = {k: i for i, k in enumerate(KINDS)}
    kind = np.array([number[k] for k in t["kind"].to_pylist()], np.int8)
    key, most = t["key"].to_numpy(), t["most"].to_numpy()
    return [_Known(*(x[lo : lo + PATTERNS] for x in (kind, key, most))) for lo in range(0, len(key), PATTERNS)]


def _misses(shared) -> Callable:
    """Distinct tokens after a pattern that can't be of its kind; a pattern with more than its limit in one task is only named, with a null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: _Known = shared.value
        held: dict[int, set[int]] = {}
        size = 0
        lost = np.zeros(len(known.key), bool)

        def out() -> pa.RecordBatch:
            rows = [(r, x) for r, xs in held.items() for x in xs]
            held.clear()
            at = np.array([r for r, _ in rows], np.int64)
            return pa.record_batch({"kind": pa.array([KINDS[k] for k in known.kind[at]], pa.string()), "key": pa.array(known.key[at]), "miss": pa.array([x for _, x in rows], pa.int64())})

        for batch in batches:
            for _, text, off in joined(batch.column("text")):
                place, _, key, _ = contexts(text)
                at, row = known.find(key)
                open_ = ~lost[row]
                own: dict[int, set] = {}
                for x, r in zip(place[at[open_]].tolist(), row[open_].tolist(), strict=True):
                    if lost[r] or not (token := follower(text, x)):
                        continue
                    value, kind = text[slice(*token)], KINDS[known.kind[r]]
                    if plausible(kind, value):
                        continue
                    if "@" in value or text[x] == "+" or text[x].isdigit():
                        i = int(np.searchsorted(off, x, side="right")) - 1
                        if i not in own:
                            own[i] = {(k, a) for k, a, _ in base_spans(text[off[i] : off[i + 1] - 1])}
                        if (kind, x - off[i]) in own[i]:
                            continue
                    found = held.setdefault(r, set())
                    before = len(found)
                    found.add(_hash(value))
                    size += len(found) - before
                    if len(found) > known.most[r]:
                        size -= len(found) - 1
                        held[r] = {None}
                        lost[r] = True
                if size > HELD:
                    yield out()
                    size = 0
        yield out()

    return run


def _scored(pairs: DataFrame, patterns: DataFrame, steps: int) -> DataFrame:
    """patterns (kind, key, n) with `score`, a whole number of 1 / UNIT: the mean of their n instances' scores."""
    on = ["kind", "key"]
    score = F.when(F.col("seed"), F.lit(UNIT)).otherwise(F.lit(0)).cast("long")
    edges = durable(_beside(pairs, patterns.select(*on, "n")).withColumn("score", score))
    for left in range(steps, -1, -1):
        means = edges.groupBy(*on, "n").agg(F.sum("score").alias("total")).select(*on, "n", F.expr("total div n").alias("score"))
        if left:
            means = durable(means)
            each = edges.where("not seed").select("kind", "key", "instance")
            others = _beside(each, means.select(*on, F.col("score").alias("p"))).groupBy("kind", "instance").agg(F.sum("p").alias("p"), F.count("*").alias("k"))
            others = others.select("kind", "instance", F.expr("p div k").alias("found"))
            edges = durable(edges.drop("score").join(others, ["kind", "instance"], "left").withColumn("score", F.when(F.col("seed"), F.lit(UNIT)).otherwise(F.coalesce("found", F.lit(0))).cast("long")).drop("found"))
    return means


def _beside(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """rows of patterns, which are broadcast where a count shows that they are few; else they are shuffled, and Spark splits a pattern of many rows."""
    return rows.join(F.broadcast(patterns) if patterns.limit(BROADCAST + 1).count() <= BROADCAST else patterns, ["kind", "key"])


def learned(docs: DataFrame, confidence: float = CONFIDENCE, min_support: int = MIN_SUPPORT, rounds: int = ROUNDS) -> DataFrame:
    """Rows (kind, key, pattern, score): contexts that identifiers follow, found and scored by bootstrapping over the whole corpus.

    A pattern is a context with `min_support` different known instances in as many documents. Known are the seeds and, from
    the second round on, tokens that a pattern of score `confidence` discovered, so discovered ones induce patterns of their
    own. Rounds end with the first that induces none, or after `rounds`.

    A new pattern's followers are judged in one step over the texts: tokens that can't be of its kind, misses, count 0, each
    different one once. Where these alone keep its score below `confidence` the pattern has no part in the graph and score 0; so
    a task hands on at most as many misses a pattern as it could bear. The graph of the others is scored in `rounds` steps: a
    pattern's score is the mean of its different instances', however often each follows it; a seed has 1, another
    instance the mean of the patterns before it. All are exact whole numbers of 1 / UNIT.
    """
    on = ["kind", "key"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sc = docs.sparkSession.sparkContext
    hits = durable(rows.mapInArrow(_hits, "kind string, pattern string, key long, instance long, seed boolean, doc_id long").distinct())
    pairs = durable(hits.groupBy(*on, "instance").agg(F.max("seed").alias("seed")))
    names = hits.groupBy(*on).agg(F.min("pattern").alias("pattern"), F.count_distinct("instance").alias("s"))
    least = round(confidence * UNIT)
    # of s instances and m misses the score is s * UNIT div (s + m) at most
    bears = F.expr(f"s * {UNIT - least} div {least}") if least else F.lit(2**62)
    known = pairs.where("seed").select("kind", "instance").distinct()
    asked = docs.sparkSession.createDataFrame([], "kind string, key long, pattern string, s long, bears long")
    graph = asked.withColumn("n", F.col("s"))
    scores = graph.select(*on, F.col("s").alias("score"))
    for _ in range(rounds):
        support = hits.join(known, ["kind", "instance"], "left_semi").groupBy(*on).agg(F.count_distinct("instance").alias("v"), F.count_distinct("doc_id").alias("d"))
        new = names.join(support.where((F.col("v") >= min_support) & (F.col("d") >= min_support)), on).select(*on, "pattern", "s", bears.cast("long").alias("bears"))
        new = durable(new.join(asked, on, "left_anti"))
        if new.isEmpty():
            break
        asked = asked.unionByName(new)
        missed = [rows.select("text").mapInArrow(_misses(sc.broadcast(part)), "kind string, key long, miss long") for part in _collected(new, "bears")]
        counted = reduce(DataFrame.unionByName, missed).groupBy(*on).agg(F.count_distinct("miss").alias("m"), F.max(F.col("miss").isNull()).alias("lost"))
        alive = new.join(counted, on, "left").where("not coalesce(lost, false) and coalesce(m, 0) <= bears")
        graph = durable(graph.unionByName(alive.select(*new.columns, (F.col("s") + F.coalesce("m", F.lit(0))).alias("n"))))
        scores = durable(_scored(pairs, graph, rounds))
        found = _beside(pairs, scores.where(F.col("score") >= least).select(*on))
        known = pairs.where("seed").select("kind", "instance").union(found.select("kind", "instance")).distinct()
    return asked.join(scores, on, "left").select(*on, "pattern", F.coalesce("score", F.lit(0).cast("long")).alias("score"))


def scored_patterns(docs: DataFrame, min_support: int = MIN_SUPPORT, rounds: int = ROUNDS, confidence: float = CONFIDENCE) -> DataFrame:
    """Rows (kind, pattern, score from 0 to 1) of all patterns with support, see `learned`."""
    return learned(docs, confidence, min_support, rounds).select("kind", "pattern", (F.col("score") / UNIT).alias("score"))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _discovered(texts: pa.Array, parts: list[_Known]) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
    """Each text, and the tokens after patterns that may be of their kinds."""
    for _, text, off in joined(texts):
        more: list[list[tuple[str, int, int]]] = [[] for _ in off[1:]]
        place, _, key, _ = contexts(text) if parts else (None, None, None, None)
        for known in parts:
            at, row = known.find(key)
            for x, kind in zip(place[at].tolist(), known.kind[row].tolist(), strict=True):
                if (t := follower(text, x)) and plausible(KINDS[kind], text[slice(*t)]):
                    i = int(np.searchsorted(off, x, side="right")) - 1
                    more[i].append((KINDS[kind], t[0] - off[i], t[1] - off[i]))
        for i, found in enumerate(more):
            yield text[off[i] : off[i + 1] - 1], found


def _extract(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, more in _discovered(batch.column("text"), shared.value):
                base = base_spans(text)
                more = {(kind, a, b) for kind, a, b in more if all(b <= x or a >= y for _, x, y in base)}
                spans = sorted([*base, *more], key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
                n = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                out.append((*n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
            cols = [pa.array([r[i] for r in out], pa.int64() if i < 4 else pa.string()) for i in range(6)]
            yield pa.record_batch([batch.column("doc_id"), *cols], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return run


def find(docs: DataFrame, confidence: float = CONFIDENCE, min_support: int = MIN_SUPPORT) -> DataFrame:
    """A row for each document: doc_id, counts of the fixed patterns' matches, their digest, and all spans (code points).

    Patterns scored at least `confidence` add the tokens that follow them, where these may be of the kind and touch no
    fixed match. A null text is empty; an empty table gives no rows; repeated rows and copies are each reported; further
    columns are ignored. A pattern takes 16 bytes on the driver and in each worker; none is dropped.
    """
    good = learned(docs, confidence, min_support).where(F.col("score") >= round(confidence * UNIT))
    shared = docs.sparkSession.sparkContext.broadcast(_collected(good, "score"))
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_extract(shared), schema)


def mask(text: str, spans: str) -> str:
    """text with each span of `spans` replaced by its kind in angle brackets; of overlapping spans the first by start counts."""
    out, at = [], 0
    for a, b, kind in sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(",") if s)):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
            at = b
    return "".join([*out, text[at:]])
