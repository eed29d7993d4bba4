"""N-gram Jaccard join: ordered shingle sets in prefix trees, whose first level is dealt out by token.

Equal sets are one class. Each set posts its prefix: its least shingles by hash, a little more of them than one common shingle
needs. Two similar sets have several posted shingles in common, so a set with too few posts that any other set has too is
alone and goes no further. What the others share gets the global order: rare shingles first, by the number of sets that posted
them, ties by hash. In this order the few first shingles of a set are the branches that it is dealt to.

Pairs are looked for twice. First each set is held against some leaders, the least sets with the same least shingles; what is
similar there makes components. Then every branch with sets of several components becomes a tree of the sets' next shingles in
order. All its sets traverse it together: sets below one node share the overlap counted on the way, and a subtree is left as soon
as the overlap so far and the shorter rest cannot reach what is required, or when it holds the set's own component alone. A pair
at a leaf must also pass a bound from the parity bits of both sets (each differing bit is a shingle that only one has). The pairs
that are left are settled on their whole sets, by traversing a tree of one set's partners.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import U, durable, mix, shingle_sets
from .components import components

#: Similar: 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Percent of a set by which its posted prefix is longer than one common shingle needs.
STRETCH = 5
#: A shingle that so many sets of a chunk of text post is dealt over SALTS tasks.
HOT = 64
SALTS = 64
#: From so many sets on a shingle is just frequent; so many rows of a shingle are held at most.
MOST = 1 << 16
#: Least shingles of a set by which it meets leaders, leaders of a shingle, and leaders that a set is settled with.
KEYS, LEADERS, BEST = 8, 16, 3
#: Levels of a branch's tree below its first, and shingles before it that tell whether a pair met before.
LEVELS, BACK = 6, 4
#: Sets of a branch that one task looks at, about; a larger branch is cut into parts, each two of which meet.
BRANCH = 1 << 13
#: Places in trees that are looked at in one go.
FRONT = 1 << 18
#: Sets whose rows are dealt at once.
AT_ONCE = 256
#: Partners of one set in one task.
PARTNERS = 4096
#: Bits of the largest broadcast set of documents whose texts are read again; beyond it they are joined.
INVOLVED_BITS = 1 << 26


def required(a: np.ndarray | int, b: np.ndarray | int, percent: int = PERCENT):
    """The least intersection of sets of sizes a and b that are similar."""
    return -(-percent * (a + b) // (100 + percent))


def _rest(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles of a set of n that come after its posted prefix."""
    return np.maximum(-(-percent * n // 100) - 1 - n * STRETCH // 100, 0)


def _least_common(n: np.ndarray, percent: int) -> np.ndarray:
    """Posted shingles that a set of n has in common with any similar one, at least."""
    return 1 + -(-percent * n // 100) * STRETCH // 100


class _Seen:
    """Sets already met in this task; forgetting some costs only repeated work."""

    def __init__(self, most: int = 100_000):
        self.known: set = set()
        self.most = most

    def __call__(self, s) -> bool:
        if s in self.known:
            return True
        if len(self.known) > self.most:
            self.known.clear()
        self.known.add(s)
        return False


def _sums(g: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit digests of each set."""
    out = []
    for seed in (0x1B873593, 0xC2B2AE3D27D4EB4F):
        c = np.zeros(len(g) + 1, U)
        np.cumsum(mix(g ^ U(seed)), out=c[1:])
        out.append(mix(c[at[1:]] - c[at[:-1]]))
    return out[0], out[1]


def _names(g: np.ndarray, at: np.ndarray, twins: np.ndarray) -> np.ndarray:
    """A name of each set: its first digest, or one made of both where different sets share the first (twins)."""
    one, two = _sums(g, at)
    return np.where(np.isin(one, twins), mix(one ^ mix(two)), one).view(np.int64) if len(twins) else one.view(np.int64)


# ---------------------------------------------------------------- parity bits


def _width(n: np.ndarray) -> np.ndarray:
    """Parity bits of a set of n: the next power of two, from 64 to 1024."""
    return np.left_shift(64, np.searchsorted(np.array([64, 128, 256, 512]), n)).astype(np.int64)


def _parity(g: np.ndarray, at: np.ndarray) -> list[bytes]:
    """For each set and bit whether an odd number of its shingles fall on the bit."""
    n = np.diff(at)
    width = _width(n)
    out: list[bytes] = [b""] * len(n)
    row = np.repeat(np.arange(len(n)), n)
    place = (g >> U(20)).astype(np.int64)
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        number = np.full(len(n), -1)
        number[own] = np.arange(len(own))
        inside = number[row] >= 0
        odd = np.bincount(number[row[inside]] * w + (place[inside] & (w - 1)), minlength=len(own) * w) & 1
        packed = np.packbits(odd.astype(np.uint8).reshape(len(own), w), axis=1, bitorder="little")
        for i, x in zip(own.tolist(), packed, strict=True):
            out[i] = x.tobytes()
    return out


class _Bits:
    """Parity bits of many sets, compared pair by pair at the lesser width of both (the bits of a wider one are folded)."""

    def __init__(self, n: np.ndarray, bits: bytes):
        self.width = _width(n)
        words = np.frombuffer(bits, U)
        start = np.cumsum(self.width // 64) - self.width // 64
        self.at: dict[int, np.ndarray] = {}
        self.number = np.zeros(len(n), np.int64)
        for w in np.unique(self.width).tolist():
            own = np.flatnonzero(self.width == w)
            self.number[own] = np.arange(len(own))
            self.at[w] = words[start[own][:, None] + np.arange(w // 64)]

    def _of(self, rows: np.ndarray, w: int) -> np.ndarray:
        out = np.empty((len(rows), w // 64), U)
        for v in np.unique(self.width[rows]).tolist():
            own = self.width[rows] == v
            x = self.at[v][self.number[rows[own]]]
            while v > w:
                v //= 2
                x = x[:, : v // 64] ^ x[:, v // 64 :]
            out[own] = x
        return out

    def differ(self, i: np.ndarray, j: np.ndarray, other: _Bits | None = None) -> np.ndarray:
        """Differing bits of sets i and j (of other): at most the shingles that only one of both has."""
        other = other or self
        out = np.zeros(len(i), np.int64)
        w = np.minimum(self.width[i], other.width[j])
        for v in np.unique(w).tolist():
            own = np.flatnonzero(w == v)
            for lo in range(0, len(own), 1 << 16):
                part = own[lo : lo + (1 << 16)]
                out[part] = np.bitwise_count(self._of(i[part], v) ^ other._of(j[part], v)).sum(axis=1)
        return out


def _may(nx: np.ndarray, ny: np.ndarray, differ: np.ndarray, percent: int) -> np.ndarray:
    return (nx + ny - differ) // 2 >= required(nx, ny, percent)


# ---------------------------------------------------------------- signatures and posts

_SIGNED = "doc_id long, same long, n int, s1 long, s2 long, both long, bits binary"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, g, at in shingle_sets(batch.column("text")):
            s1, s2 = _sums(g, at)
            ids, same = (batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "same"))
            yield pa.record_batch({"doc_id": ids, "same": same, "n": pa.array(np.diff(at), pa.int32()), "s1": s1.view(np.int64), "s2": s2.view(np.int64), "both": mix(s1 ^ mix(s2)).view(np.int64), "bits": pa.array(_parity(g, at), pa.binary())})


def _post(twins: np.ndarray, percent: int) -> Callable:
    """Rows of the prefixes. A shingle that many sets of a chunk post is surely shared: its rows are salted, but for one, of negative n, that tells the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in batches:
            for _, _, g, at in shingle_sets(batch.column("text")):
                s = _names(g, at, twins)
                n = np.diff(at)
                fresh = np.array([not seen(x) for x in s.tolist()], bool) & (n > 0)
                row = np.repeat(np.arange(len(n)), n)
                keep = fresh[row] & (np.arange(len(g)) - at[:-1][row] < (n - _rest(n, percent))[row])
                token, row = g[keep], row[keep]
                _, first, back, often = np.unique(token, return_index=True, return_inverse=True, return_counts=True)
                hot = often >= HOT
                size = n[row]
                salt = np.where(hot[back], 1 + (s[row] & (SALTS - 1)), 0)
                salt[first[hot]] = 0
                size[first[hot]] *= -1
                yield pa.record_batch({"token": token.view(np.int64), "salt": salt.astype(np.int32), "s": s[row], "n": size.astype(np.int32)})

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of shingles that several sets posted, with their rank by the number of sets, from rows in order of token, salt, set and n; MOST rows at most are held."""
    names = ("token", "salt", "s", "n")
    held, told, frequent = None, 0, False  # the last shingle's rows; how many of them went out already; whether it is frequent

    def rows(cols, df):
        return pa.record_batch({"token": cols[0], "s": cols[2], "n": np.abs(cols[3]), "rank": _rank(df)})

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        if held is not None:
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
        t, salt, s, n = cols
        group = np.ones(len(t), bool)
        group[1:] = (t[1:] != t[:-1]) | (salt[1:] != salt[:-1])
        fresh = group.copy()
        fresh[1:] |= s[1:] != s[:-1]
        fresh[:told] = True
        cols, group = [c[fresh] for c in cols], group[fresh]
        start = np.flatnonzero(group)
        size = np.diff(np.append(start, len(group)))
        hot = (cols[1][start] > 0) | np.logical_or.reduceat(cols[3] < 0, start)
        hot[0] |= frequent
        df = np.where(hot, MOST, np.minimum(size, MOST))
        last = int(start[-1])
        many = (df > 1)[np.cumsum(group) - 1]
        done = np.arange(len(group)) < told
        whole = int(df[-1]) >= MOST
        out = many & ~done & ((np.arange(len(group)) < last) | whole)
        yield rows([c[out] for c in cols], np.repeat(df, size)[out])
        frequent = whole
        held, told = ([c[-1:] for c in cols], 1) if whole else ([c[last:] for c in cols], 0)
    if held is not None and not told and len(held[0]) > 1:
        yield rows(held, np.full(len(held[0]), min(len(held[0]), MOST)))


def _groups(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of whole keys' rows, from batches sorted by the first column: the columns as arrays."""
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        cols = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in columns)
        t = cols[0]
        if not len(t):
            continue
        cut = int(np.searchsorted(t, t[-1]))  # rows of the last key may go on
        if cut or (held and held[-1][0][-1] != t[0]):
            if held and held[-1][0][-1] != t[0]:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held = []
            if cut:
                yield tuple(np.concatenate([*(h[i] for h in held), c[:cut]]) for i, c in enumerate(cols))
                held = []
        held.append(tuple(c[cut:] for c in cols))
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _rank(df: np.ndarray) -> np.ndarray:
    """How frequent a shingle is, in ten bits: exact up to 512 sets, then sixteen steps for each doubling."""
    return np.where(df < 512, df, 512 + np.floor(16 * (np.log2(np.maximum(df, 512)) - 9))).astype(np.int32)


def _codes(rank: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Places in the global order, in 32 bits: monotone, though not one to one."""
    return (rank.astype(U) << U(22) | ((token.view(U) ^ U(1 << 63)) >> U(42))).astype(np.uint32)


_SET = "s long, n int, tokens binary, codes binary"


def _ordered(percent: int) -> Callable:
    """Sets with enough shared posts to be similar to any other, the shared posts in the global order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, n, rank, t in _groups(batches, ("s", "n", "rank", "token")):
            fresh = np.ones(len(s), bool)
            fresh[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1])
            s, n, rank, t = s[fresh], n[fresh].astype(np.int64), rank[fresh], t[fresh]
            start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            end = np.append(start[1:], len(s))
            code = _codes(rank, t)
            kept = np.flatnonzero(end - start >= _least_common(n[start], percent))
            a, b = start[kept].tolist(), end[kept].tolist()
            yield pa.record_batch({"s": s[start[kept]], "n": pa.array(n[start[kept]], pa.int32()), "tokens": pa.array([t[i:j].tobytes() for i, j in zip(a, b, strict=True)], pa.binary()), "codes": pa.array([code[i:j].tobytes() for i, j in zip(a, b, strict=True)], pa.binary())})

    return run


def _sets_in_order(docs: DataFrame, twins: np.ndarray, percent: int) -> DataFrame:
    posts = docs.where("doc_id is not null").select("text").mapInArrow(_post(twins, percent), "token long, salt int, s long, n int")
    shared = posts.repartition("token", "salt").sortWithinPartitions("token", "salt", "s", "n").mapInArrow(_shared, "token long, s long, n int, rank int")
    return shared.repartition("s").sortWithinPartitions("s", "rank", "token").mapInArrow(_ordered(percent), _SET)


# ---------------------------------------------------------------- leaders


_KEYED = "key long, s long, n int, bits binary"


def _keyed(leaders: int | None = None) -> Callable:
    """A row for each of the KEYS least shingles of a set; of each key in a batch only the first `leaders` sets, if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [np.sort(np.frombuffer(x, np.int64))[:KEYS] for x in batch.column("tokens").to_pylist()]
            row = np.repeat(np.arange(len(tokens)), [len(x) for x in tokens])
            key = np.concatenate([np.empty(0, np.int64), *tokens])
            if leaders and len(key):
                order = np.lexsort((batch.column("s").to_numpy()[row], key))
                row, key = row[order], key[order]
                start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                first = np.arange(len(key)) - np.repeat(start, np.diff(np.append(start, len(key)))) < leaders
                row, key = row[first], key[first]
            at = pa.array(row)
            yield pa.record_batch({"key": key, **{c: batch.column(c).take(at) for c in ("s", "n", "bits")}})

    return run


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first LEADERS rows of each key, from rows in order of key."""
    key, count = None, 0
    for batch in batches:
        t = batch.column("key").to_numpy(zero_copy_only=False)
        if not len(t):
            continue
        start = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        place = np.arange(len(t)) - np.repeat(start, np.diff(np.append(start, len(t))))
        if t[0] == key:
            place[: start[1] if len(start) > 1 else len(t)] += count
        key, count = t[-1], int(place[-1]) + 1
        yield batch.filter(pa.array(place < LEADERS))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each key with its leaders, where there are two at least."""
    for key, s, n, bits in _groups(_first(batches), ("key", "s", "n", "bits")):
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        cuts = [(a, b) for a, b in zip(start.tolist(), [*start[1:].tolist(), len(key)], strict=True) if b - a > 1]
        yield pa.record_batch({"key": pa.array([key[a] for a, _ in cuts], pa.int64()), "ls": pa.array([s[a:b].tobytes() for a, b in cuts], pa.binary()), "ln": pa.array([n[a:b].tobytes() for a, b in cuts], pa.binary()), "lbits": pa.array([b"".join(bits[a:b]) for a, b in cuts], pa.binary())})


def _best(percent: int) -> Callable:
    """For each set and key the leader with the fewest differing bits, if it may be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            s, n = batch.column("s").to_numpy(), batch.column("n").to_numpy().astype(np.int64)
            bits, names, sizes, theirs = (batch.column(c).to_pylist() for c in ("bits", "ls", "ln", "lbits"))
            row = np.repeat(np.arange(len(s)), [len(x) // 8 for x in names])
            ls, ln = np.frombuffer(b"".join(names), np.int64), np.frombuffer(b"".join(sizes), np.int32).astype(np.int64)
            ok = np.flatnonzero((ls < s[row]) & (np.minimum(ln, n[row]) >= required(ln, n[row], percent)))
            differ = _Bits(n, b"".join(bits)).differ(row[ok], ok, _Bits(ln, b"".join(theirs)))
            may = _may(n[row[ok]], ln[ok], differ, percent)
            ok, differ = ok[may], differ[may]
            order = np.lexsort((ls[ok], differ, row[ok]))
            ok, differ = ok[order], differ[order]
            first = np.ones(len(ok), bool)
            first[1:] = row[ok][1:] != row[ok][:-1]
            yield pa.record_batch({"a": ls[ok][first], "b": s[row[ok]][first], "differ": differ[first]})

    return run


def _with_leaders(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of a set and its nearest leaders. A key's leaders are its least sets, chosen in each task first; all its sets then meet them in a plain join."""
    keyed = sets.mapInArrow(_keyed(), _KEYED)
    some = sets.mapInArrow(_keyed(LEADERS), _KEYED)
    leaders = some.repartition("key").sortWithinPartitions("key", "s").mapInArrow(_packed, "key long, ls binary, ln binary, lbits binary")
    near = keyed.join(leaders, "key").mapInArrow(_best(percent), "a long, b long, differ long")
    few = near.groupBy("b").agg(F.slice(F.sort_array(F.collect_set(F.struct("differ", "a"))), 1, BEST).alias("few"))
    return few.select(F.explode("few.a").alias("a"), "b")


# ---------------------------------------------------------------- trees


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(lo, AT_ONCE)


def _fixed(parts: list[bytes], size: int) -> pa.Array:
    """Binary values of one size that lie one after another."""
    whole = b"".join(parts)
    n = len(whole) // size
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, len(whole) + 1, size, dtype=np.int32)), pa.py_buffer(whole)])


def _dealt() -> Callable:
    """A row for each branch of a set: the branch, the set's place there, its next LEVELS codes and its last BACK shingles before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            rows, keys, places, paths, backs = [], [], [], [], []
            s = batch.column("s").to_numpy().view(U)
            size = []
            for i, (tokens, codes, branches) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("tokens", "codes", "branches")), strict=True)):
                t = np.frombuffer(tokens, np.int64)
                c = np.concatenate([np.frombuffer(codes, np.uint32), np.full(LEVELS, 0xFFFFFFFF, np.uint32)])
                size.append(len(t))
                order = np.argsort(t, kind="stable")
                token = np.array([b["token"] for b in branches], np.int64)
                place = order[np.searchsorted(t, token, sorter=order)]
                last = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(BACK, np.int64), t]), BACK)
                next_ = np.lib.stride_tricks.sliding_window_view(c, LEVELS)
                parts = np.array([b["parts"] for b in branches], np.int64)
                k = np.repeat(np.arange(len(token)), parts)  # a large branch has a key for each two of its parts
                other = np.arange(len(k)) - np.repeat(np.cumsum(parts) - parts, parts)
                own = (int(s[i]) >> 7) % parts[k]
                key = np.where(parts[k] > 1, mix(token[k].view(U) + mix((np.minimum(own, other) << 32 | np.maximum(own, other)).astype(U) + U(1))).view(np.int64), token[k])
                rows.append(np.full(len(k), i))
                keys.append(key)
                places.append(place[k])
                paths.append(next_[place[k] + 1].tobytes())
                backs.append(last[place[k]].tobytes())
            if rows:
                at = pa.array(np.concatenate(rows))
                yield pa.record_batch({"key": np.concatenate(keys), "place": pa.array(np.concatenate(places), pa.int32()), "m": pa.array(np.array(size)[np.concatenate(rows)], pa.int32()), "path": _fixed(paths, 4 * LEVELS), "back": _fixed(backs, 8 * BACK), **{c: batch.column(c).take(at) for c in ("s", "n", "label", "bits")}})

    return run


class _Forest:
    """The trees of some whole branches: rows sorted by branch and path; a node is a run of rows whose paths begin alike."""

    def __init__(self, key, place, m, path, back, s, n, label, bits, percent: int):
        codes = np.frombuffer(b"".join(path.tolist()), np.uint32).reshape(-1, LEVELS)
        order = np.lexsort((*codes.T[::-1], key))
        self.codes, key = codes[order], key[order]
        self.back = np.frombuffer(b"".join(back.tolist()), np.int64).reshape(-1, BACK)[order]
        self.s, self.label, self.percent = s[order], label[order], percent
        self.n, self.after = n[order].astype(np.int64), (m - place - 1)[order].astype(np.int64)  # after: shared posts that follow the branch's
        self.rest = _rest(self.n, percent)
        self.bits = _Bits(self.n, b"".join(bits[order].tolist()))
        new = np.concatenate([[True], key[1:] != key[:-1]])
        self.levels = []
        for d in range(LEVELS + 1):
            start = np.flatnonzero(new)
            least, most = (lambda x: np.minimum.reduceat(x, start)), (lambda x: np.maximum.reduceat(x, start))  # noqa: B023
            self.levels.append((start, np.append(start[1:], len(key)), np.maximum(most(self.after) - d, 0), least(self.label), most(self.label), least(self.n), most(self.n)))
            if d < LEVELS:
                new = new | np.concatenate([[True], self.codes[1:, d] != self.codes[:-1, d]])
        self.known = (np.arange(len(key), dtype=U)[:, None] << U(32) | self.codes.astype(U)).reshape(-1)  # ascending

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Names of pairs of different components that may be similar; rows traverse all trees, FRONT places at a time."""
        start, end = self.levels[0][:2]
        root = np.repeat(np.arange(len(start)), end - start)
        cost = np.cumsum(end[root] - np.arange(len(root)))
        lo = 0
        while lo < len(root):
            hi = max(int(np.searchsorted(cost, (cost[lo - 1] if lo else 0) + FRONT, side="right")), lo + 1)
            yield self._traverse(np.arange(lo, hi), root[lo:hi])
            lo = hi

    def _traverse(self, probe: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shared = np.ones(len(probe), np.int64)  # the branch's own shingle
        mine = self.after[probe]
        for d in range(LEVELS):
            a, b = self.levels[d][0][node], self.levels[d][1][node]
            start, end, after, low, high, small, large = self.levels[d + 1]
            first, last = np.searchsorted(start, a), np.searchsorted(start, b)
            k = np.repeat(np.arange(len(node)), last - first)
            child = np.arange(len(k)) - np.repeat(np.cumsum(last - first) - (last - first), last - first) + first[k]
            p = probe[k]
            n, label = self.n[p], self.label[p]
            ok = (end[child] > p + 1) & ~((low[child] == label) & (high[child] == label)) & (100 * large[child] >= self.percent * n) & (self.percent * small[child] <= 100 * n)
            k, child, p = k[ok], child[ok], p[ok]
            code = self.codes[start[child], d]
            want = p.astype(U) << U(32) | code.astype(U)
            at = np.searchsorted(self.known, want)
            before = at - p * LEVELS  # the probe's known codes before this one
            some = code != 0xFFFFFFFF
            hit = some & (self.known[np.minimum(at, len(self.known) - 1)] == want)
            over = shared[k] + (hit | some & (before == LEVELS))  # what follows all known codes may be shared
            left = np.minimum(mine[k], self.after[p] - before - hit)  # of the probe's, after this place in the order
            low_need = required(self.n[p], np.maximum(small[child], -(-self.percent * self.n[p] // 100)), self.percent) - np.maximum(self.rest[p], _rest(large[child], self.percent))
            ok = over + np.minimum(left, after[child]) >= low_need
            probe, node, shared, mine = p[ok], child[ok], over[ok], left[ok]
        start, end = self.levels[LEVELS][:2]
        k = np.repeat(np.arange(len(node)), end[node] - start[node])
        j = np.arange(len(k)) - np.repeat(np.cumsum(end[node] - start[node]) - (end[node] - start[node]), end[node] - start[node]) + start[node][k]
        i = probe[k]
        need = required(self.n[i], self.n[j], self.percent)
        bound = shared[k] + np.minimum(mine[k], np.maximum(self.after[j] - LEVELS, 0))
        ok = (j > i) & (self.label[i] != self.label[j]) & (np.minimum(self.n[i], self.n[j]) >= need) & (bound >= need - np.maximum(self.rest[i], self.rest[j]))
        i, j = i[ok], j[ok]
        may = _may(self.n[i], self.n[j], self.bits.differ(i, j), self.percent)
        i, j = i[may], j[may]
        x, y = self.back[i], self.back[j]
        met = ((x[:, :, None] == y[:, None, :]) & (x != 0)[:, :, None]).any(axis=(1, 2))  # at a branch before this one
        return self.s[i[~met]], self.s[j[~met]]


def _climb(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for rows in _groups(batches, ("key", "place", "m", "path", "back", "s", "n", "label", "bits")):
            for x, y in _Forest(*rows, percent).pairs():
                new = [p for p in zip(np.minimum(x, y).tolist(), np.maximum(x, y).tolist(), strict=True) if not seen(p)]
                yield pa.record_batch({"a": pa.array([p[0] for p in new], pa.int64()), "b": pa.array([p[1] for p in new], pa.int64())})

    return run


def _in_trees(sets: DataFrame, labels: DataFrame, percent: int, branch: int = BRANCH) -> DataFrame:
    """Pairs of sets of different components that may be similar, from the trees of all branches that hold several components."""
    label = labels.select(F.col("node").alias("s"), "label")
    named = durable(sets.join(label, "s", "left").withColumn("label", F.coalesce("label", "s")))
    light = named.mapInArrow(_light(percent), "token long, s long, label long")
    mixed = light.groupBy("token").agg(F.count("*").alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("token", F.ceil(F.col("m") / branch).cast("int").alias("parts"))
    kept = light.select("token", "s").join(mixed, "token").groupBy("s").agg(F.collect_list(F.struct("token", "parts")).alias("branches"))
    rows = named.join(kept, "s").mapInArrow(_dealt(), "key long, place int, m int, path binary, back binary, s long, n int, label long, bits binary")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_climb(percent), "a long, b long")


def _light(percent: int) -> Callable:
    """(token, s, label) of the first shared posts of a set, so many that any similar set has one of them among its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            n = batch.column("n").to_numpy().astype(np.int64)
            tokens = [np.frombuffer(x, np.int64) for x in batch.column("tokens").to_pylist()]
            first = [t[: len(t) - c + 1] for t, c in zip(tokens, _least_common(n, percent).tolist(), strict=True)]
            at = pa.array(np.repeat(np.arange(len(first)), [len(x) for x in first]))
            yield pa.record_batch({"token": np.concatenate([np.empty(0, np.int64), *first]), "s": batch.column("s").take(at), "label": batch.column("label").take(at)})

    return run


# ---------------------------------------------------------------- settling pairs


def _involved(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The documents that stand for the sets in pairs."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("s")).distinct()
    return nodes.join(classes.select("s", "rep"), "s").select(F.col("rep").alias("doc_id"))


def _sets(docs: DataFrame, involved: DataFrame, twins: np.ndarray) -> DataFrame:
    """(s, items): the involved documents' sets, ascending shingles of 8 bytes each, most significant first.

    The documents are marked by broadcast bits while they are few, so that others aren't shuffled, else joined.
    """
    rows = docs.where("doc_id is not null").select("doc_id", "text")
    bits = 1 << max(10, (16 * involved.count()).bit_length())
    shared, h = None, F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    if bits > INVOLVED_BITS:
        rows = rows.join(involved, "doc_id", "left_semi")
    else:
        words = involved.select(F.shiftright(h, 6).alias("w"), (h % 64).cast("int").alias("k")).groupBy("w").agg(F.expr("bit_or(shiftleft(1L, k))").alias("m"))
        marks = np.zeros(bits // 64, np.int64)
        t = words.toArrow()  # bits / 64 rows at most
        marks[t["w"].to_numpy()] = t["m"].to_numpy()
        shared = docs.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in batches:
            if shared is not None:
                x = batch.column("h").to_numpy()
                batch = batch.filter(pa.array((shared.value[x >> 6] >> (x & 63) & 1).astype(bool)))
            for _, _, g, at in shingle_sets(batch.column("text")):
                s = _names(g, at, twins)
                keep = [i for i, x in enumerate(s.tolist()) if at[i + 1] > at[i] and not seen(x)]
                big = g.astype(">u8")
                yield pa.record_batch({"s": pa.array(s[keep], pa.int64()), "items": pa.array([big[at[i] : at[i + 1]].tobytes() for i in keep], pa.binary())})

    return rows.select(h.alias("h"), "text").mapInArrow(run, "s long, items binary").groupBy("s").agg(F.first("items").alias("items"))


class _Probe:
    """A set that a tree of other sets is traversed with; these come in ascending order as sequences."""

    def __init__(self, items: np.ndarray, percent: int):
        self.items, self.percent = items, percent
        self.last = np.empty(0, U)
        self.shared = np.zeros(1, np.int64)  # overlap on the path, by depth
        self.passed = np.zeros(1, np.int64)  # of the probe's items, those up to the path's last

    def linked(self, items: np.ndarray) -> bool:
        k = min(len(items), len(self.last), len(self.shared) - 1)
        differ = np.flatnonzero(items[:k] != self.last[:k])
        depth = int(differ[0]) if len(differ) else k
        need = required(len(items), len(self.items), self.percent)
        self.last = items
        if self.shared[depth] + min(len(items) - depth, len(self.items) - self.passed[depth]) < need:
            self.shared, self.passed = self.shared[: depth + 1], self.passed[: depth + 1]
            return False
        rest = items[depth:]
        at = np.searchsorted(self.items, rest)
        hit = self.items[np.minimum(at, len(self.items) - 1)] == rest
        self.shared = np.concatenate([self.shared[: depth + 1], self.shared[depth] + np.cumsum(hit)])
        self.passed = np.concatenate([self.passed[: depth + 1], at + hit])
        return bool(self.shared[-1] >= need)


def _traverse(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe, key = None, None
        for batch in batches:
            a, b = [], []
            for at, salt, x, items in zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "b", "items")), strict=True):
                items = np.frombuffer(items, ">u8").astype(U)
                if x is None:
                    probe, key = _Probe(items, percent), (at, salt)
                elif key == (at, salt) and probe.linked(items):
                    a.append(at)
                    b.append(x)
            yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def settle(docs: DataFrame, classes: DataFrame, pairs: DataFrame, twins: np.ndarray, percent: int = PERCENT) -> DataFrame:
    """Those of the pairs (a, b) of sets that are similar. The partners of one set are split over tasks PARTNERS at a time."""
    pairs = durable(pairs.distinct())
    sets = durable(_sets(docs, durable(_involved(pairs, classes)), twins))
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("parts"))
    probes = parts.join(sets, F.col("a") == F.col("s")).select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "items")
    partners = pairs.join(parts, "a").join(sets, F.col("b") == F.col("s")).select("a", F.pmod(F.xxhash64("b"), F.col("parts").cast("long")).cast("int").alias("salt"), "b", "items")
    dealt = probes.unionByName(partners).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").isNotNull(), "items")
    return dealt.mapInArrow(_traverse(percent), "a long, b long")


# ---------------------------------------------------------------- whole


def linked(docs: DataFrame, percent: int = PERCENT, branch: int = BRANCH) -> DataFrame:
    """A row for each row of docs: doc_id, same (a hash of the text), n_shingles, label of its component and the component's least doc_id.

    Rows without a doc_id or without words link with nothing: their label is null.
    """
    docs = docs.select("doc_id", "text")
    signed = durable(docs.select("doc_id", "text", F.xxhash64("text").alias("same")).mapInArrow(_sign, _SIGNED))
    able = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    classes = signed.where(able).groupBy("s1", "s2", "both").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    # different sets with the same first digest: fewer than one is expected below 10**9 sets, about 70 among 5 * 10**10
    twin = classes.groupBy("s1").agg(F.count("*").alias("sets")).where("sets > 1").select("s1")
    twins = np.array([r.s1 for r in twin.collect()], np.int64).view(U)
    name = _name(twins)
    classes = durable(classes.select(name, "rep", "n", "bits"))
    sets = durable(_sets_in_order(docs, twins, percent).join(classes.select("s", "bits"), "s"))
    links = durable(settle(docs, classes, _with_leaders(sets, percent), twins, percent))
    more = settle(docs, classes, _in_trees(sets, components(links), percent, branch), twins, percent)
    labels = components(links.unionByName(more))
    ids = classes.select("s", "rep").join(labels.withColumnRenamed("node", "s"), "s", "left").withColumn("label", F.coalesce("label", "s"))
    ids = ids.join(ids.groupBy("label").agg(F.min("rep").alias("component_id")), "label").select("s", "label", "component_id")
    rows = signed.select("doc_id", "same", F.col("n").cast("long").alias("n_shingles"), F.when(able, name).alias("s"))
    found = rows.where("s is not null").join(ids, "s").select("doc_id", "same", "n_shingles", "label", "component_id")
    alone = rows.where("s is null")  # they would all meet in one task of the join
    return found.unionByName(alone.select("doc_id", "same", "n_shingles", *(F.lit(None).cast(found.schema[c].dataType).alias(c) for c in ("label", "component_id"))))


def _name(twins: np.ndarray) -> Column:
    """_names of signed rows."""
    s = F.col("s1")
    if len(twins):
        s = F.when(s.isin(twins.view(np.int64).tolist()), F.col("both")).otherwise(s)
    return s.alias("s")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, branch: int = BRANCH) -> DataFrame:
    """A row for each document: doc_id, n_shingles and component_id, the least doc_id that links reach.

    Two documents link when 100 * intersection >= percent * union of their sets of 5-word shingles (64-bit hashes); equal
    sets (two 64-bit digests) always do. A text of fewer words has its whole sequence as one shingle; a null or blank one has
    none, links with nothing and is its own component. Rows with a null doc_id link with nothing and get a null component;
    rows of one doc_id are one document. An empty table gives no rows; further columns are ignored.
    """
    rows = durable(linked(docs, percent, branch))
    again = durable(_same_id(rows))
    if again.isEmpty():
        return rows.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    labels = components(again).select(F.col("node").alias("label"), F.col("label").alias("whole"))
    named = rows.join(labels, "label", "left")
    least = named.where("whole is not null").groupBy("whole").agg(F.min("component_id").alias("least"))
    return named.join(least, "whole", "left").select("doc_id", "n_shingles", F.coalesce("least", "component_id", "doc_id").alias("component_id"))


def _same_id(rows: DataFrame) -> DataFrame:
    """Links between the different components of one doc_id."""
    own = rows.where("label is not null").groupBy("doc_id").agg(F.min("label").alias("a"), F.max("label").alias("m"), F.collect_set("label").alias("all")).where("a <> m")
    return own.select("a", F.explode("all").alias("b")).where("a <> b")
