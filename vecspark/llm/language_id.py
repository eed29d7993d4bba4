"""Language identification by prediction by partial matching: per-language byte context trees score exact code lengths."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import LOWER, chunks, durable, plainly_named

#: Labelled documents a language that the trees are fitted on, at most about; which ones follows from a hash of doc_id.
TRAIN_DOCS = 5000
#: Bytes of context at most.
ORDER = 4
#: Bytes of their texts, at most about.
TRAIN_BYTES = 1 << 21
#: Bits a byte from which on a text is of no learned language: its shortest code is no shorter than its bytes.
PLAIN = 8.0
#: Bytes that are looked up in one go.
PLACES = 1 << 20


def _grams(raw: np.ndarray, off: np.ndarray, order: int) -> np.ndarray:
    """Each byte with the `order` bytes before it as one number, A-Z lower-cased; before a text stand spaces."""
    b = LOWER[raw].astype(np.int64)
    age = np.arange(len(b)) - np.repeat(off[:-1], np.diff(off))
    out = b.copy()
    for j in range(1, order + 1):
        before = np.full_like(b, 32)
        before[j:] = np.where(age[j:] < j, 32, b[:-j])
        out |= before << (8 * j)
    return out


def _counts(order: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lo, hi, raw, off in chunks(batch.column("text")):
                g = _grams(raw, off, order)
                for lang in sorted(set(langs[lo:hi])):
                    own = np.repeat(langs[lo:hi] == lang, np.diff(off))
                    own[off[1:] - 1] = False  # separators are no text
                    kinds, n = np.unique(g[own], return_counts=True)
                    yield pa.record_batch({"lang": pa.array([lang] * len(kinds), pa.string()), "gram": pa.array(kinds, pa.int64()), "n": pa.array(n, pa.int64())})

    return run


class _Index:
    """Places of numbers in an ascending array."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each number, -1 where it isn't there."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)


class _Tree:
    """One language: for each order the probabilities of the bytes seen after each context, and what the others share."""

    def __init__(self, order: int, nodes: list[tuple[np.ndarray, np.ndarray]]):
        self.seen, self.contexts = [], []
        for k in range(order + 1):
            gram, n = nodes[k]
            context, own = np.unique(gram >> 8, return_inverse=True)
            kinds, total = np.bincount(own, minlength=len(context)), np.bincount(own, weights=n, minlength=len(context))
            rest = 1 - np.bincount(own, weights=self.probability(k - 1, gram & ((1 << 8 * k) - 1)), minlength=len(context))
            open_ = rest > 1e-9  # else every byte was seen
            p = n / np.where(open_, total + kinds, total)[own]
            escape = np.where(open_, kinds / (total + kinds) / np.where(open_, rest, 1.0), 0.0)
            self.seen.append((_Index(gram), p))
            self.contexts.append((_Index(context), escape))

    def probability(self, k: int, gram: np.ndarray) -> np.ndarray:
        """Of the last byte of each number after the k bytes before it (escape method C, with exclusion)."""
        if k < 0:
            return np.full(len(gram), 1 / 256)
        at = self.seen[k][0].find(gram)
        out = np.where(at >= 0, self.seen[k][1][at], 0.0) if len(self.seen[k][1]) else np.zeros(len(gram))
        less = np.flatnonzero(at < 0)
        if len(less):
            out[less] = self.escape(k, gram[less] >> 8) * self.probability(k - 1, gram[less] & ((1 << 8 * k) - 1))
        return out

    def escape(self, k: int, context: np.ndarray) -> np.ndarray:
        """What the probability of one order less is multiplied by, where the byte wasn't seen; 1 after contexts not seen."""
        at = self.contexts[k][0].find(context)
        return np.where(at >= 0, self.contexts[k][1][at], 1.0) if len(self.contexts[k][1]) else np.ones(len(context))


class Model:
    """Frozen statistics: a tree for each language, made of that language's documents alone."""

    def __init__(self, langs: list[str], nodes: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]], order: int = ORDER):
        self.langs, self.order = langs, order
        none = (np.empty(0, np.int64), np.empty(0, np.int64))
        self.trees = [_Tree(order, [nodes.get((x, k), none) for k in range(order + 1)]) for x in langs]

    def code_lengths(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """[language, text]: the bits that each language's tree needs for each text. No language's depend on the others.

        Each different byte with its context is looked up once in PLACES bytes, tree by tree.
        """
        out = np.zeros((len(self.langs), len(off) - 1))
        for lo in range(0, len(raw), PLACES):
            start = max(lo - self.order, 0)
            hi = min(lo + PLACES, len(raw))
            before, first, last = np.searchsorted(off, [start, lo, hi - 1], side="right") - 1
            gram = _grams(raw[start:hi], np.clip(off[before : last + 2] - start, 0, hi - start), self.order)[lo - start :]
            which, kinds = pd.factorize(gram)
            inside = np.ones(hi - lo, bool)
            ends = off[first + 1 : last + 2] - 1 - lo  # separators are no text
            inside[ends[ends < hi - lo]] = False
            begin = np.maximum(off[first : last + 1] - lo, 0)
            for x, tree in enumerate(self.trees):
                bits = -np.log2(np.maximum(tree.probability(self.order, kinds), 2.0**-60))
                out[x, first : last + 1] += np.add.reduceat(np.where(inside, bits[which], 0.0), begin)
        return out


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, order: int = ORDER, train_bytes: int = TRAIN_BYTES) -> Model:
    """Trees from labelled documents that aren't held out: whole ones by a hash of doc_id, about train_docs of each language and train_bytes of their texts, all where there are fewer.

    That sample bounds each language's tree, which keeps every node of it, and no language's depends on the others. What
    reaches the driver is a count for each node, language by language; a node takes 16 bytes there and in each worker, about
    10 MB a language for prose.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    n = {r.lang: r for r in labelled.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).collect()}
    share = {lang: min(1.0, train_docs / r.n, train_bytes / max(r.size, 1)) for lang, r in sorted(n.items())}
    if not n:
        return Model([], {}, order)
    unit = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("train")), 11).cast("double") * F.lit(2.0**-53)
    shares = docs.sparkSession.createDataFrame(list(share.items()), "of string, share double")
    taken = labelled.select("lang", "text", unit.alias("unit")).join(F.broadcast(shares), F.col("lang") == F.col("of")).where("unit < share")
    grams = taken.select("lang", "text").mapInArrow(_counts(order), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    each = F.explode(F.sequence(F.lit(0), F.lit(order))).alias("k")
    nodes = grams.select("lang", "n", "gram", each).groupBy("lang", "k", F.expr("gram & (shiftleft(1L, 8 * (k + 1)) - 1L)").alias("gram")).agg(F.sum("n").alias("n"))
    nodes = durable(nodes)
    found: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
    for lang in sorted(n):
        t = nodes.where(F.col("lang") == lang).select("k", "gram", "n").toArrow()
        k, gram, count = (t[c].to_numpy() for c in ("k", "gram", "n"))
        for j in range(order + 1):
            by = np.argsort(gram[k == j])
            found[lang, j] = gram[k == j][by], count[k == j][by]
    return Model(sorted(n), found, order)


def _has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "ignore"))


def _judge(m: Model, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, number of the best language or of `und`, score, bits a byte)."""
    letter = np.zeros(256, bool)
    letter[ord("a") : ord("z") + 1] = letter[ord("A") : ord("Z") + 1] = True
    for lo, hi, raw, off in chunks(texts):
        some = np.add.reduceat(letter[raw].astype(np.int64), off[:-1]) > 0
        for i in np.flatnonzero(~some).tolist():
            some[i] = _has_letter(raw[off[i] : off[i + 1]].tobytes())
        best, score, rate = np.full(hi - lo, len(m.langs)), np.zeros(hi - lo), np.zeros(hi - lo)
        if m.langs:
            bits = m.code_lengths(raw, off)
            least = bits.min(axis=0)
            score = np.where(some, 1.0 / np.exp2(np.maximum(least - bits, -1000.0)).sum(axis=0), 0.0)
            best = np.where(some, bits.argmin(axis=0), len(m.langs))
            rate = least / np.maximum(np.diff(off) - 1, 1)
        yield lo, hi, best, score, rate


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score and bits_per_byte for each document, from its whole text alone.

    lang_pred is the language of the shortest code (ties: the first by name), score its share of all languages' likelihood.
    A text that is null, empty or without a letter, and any text where nothing was learned, is `und` with score 0. An empty
    table gives no rows; repeated rows are each judged, alike; further columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.langs, "und"], object)
        for batch in batches:
            for lo, hi, best, score, rate in _judge(m, batch.column("text")):
                yield pa.record_batch({"doc_id": batch.column("doc_id").slice(lo, hi - lo), "held_out": batch.column("held_out").slice(lo, hi - lo), "lang_pred": pa.array(names[best].tolist(), pa.string()), "score": pa.array(score, pa.float64()), "bits_per_byte": pa.array(rate, pa.float64())})

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double")


def identify(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """predict with trees fitted on docs' own labels; lang, source and doc_id are no inputs of a prediction."""
    return predict(docs, fit(docs, train_docs))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """docs, all columns, without those judged `und` and those whose shortest code takes PLAIN bits a byte or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            keep = [(best < len(m.langs)) & (rate < PLAIN) for _, _, best, _, rate in _judge(m, batch.column("text"))]
            yield batch.filter(pa.array(np.concatenate([*keep, np.empty(0, bool)]), pa.bool_()))

    rows = plainly_named(docs, "text")
    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)
