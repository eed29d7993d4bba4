"""A sharded graph index: each shard is a navigable small-world graph over its rows, kept as one packed row of a table."""

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import durable
from . import grid, search

# The generator's seed and shifts.
SEED, SHIFTS = 0xDEADBEEFCAFE1234, (13, 7, 17)
_MASK = (1 << 64) - 1

#: A shard: its nodes' ords and ids, their unit vectors (32-bit floats, row by row), and their neighbours in compressed rows:
#: the lists of node i are those from layers[i] up to layers[i + 1], one a layer, and list j is edges[lists[j]] up to edges[lists[j + 1]]
#: (all 32-bit integers). Integers and floats are little-endian.
INDEX = "shard int, n int, dim int, entry int, ord array<long>, id array<string>, vectors binary, layers binary, lists binary, edges binary"
#: Rows that are scored against all before them at once, when a shard is built, and scores that a task holds for that.
BLOCK, SCORES = 1024, 1 << 23
#: Nodes of an upper layer that a search scores to find its starts.
START = 1 << 14


def xorshift(state: int, shifts: tuple[int, int, int] = SHIFTS) -> int:
    a, b, c = shifts
    state ^= state << a & _MASK
    state ^= state >> b
    return (state ^ state << c) & _MASK


class Graph:
    """Rows of unit length and their neighbours layer by layer."""

    def __init__(self, m: int = 16, ef_construction: int = 200):
        if m < 2:
            raise ValueError("m must be at least 2")
        self.m, self.m0, self.ef = m, 2 * m, ef_construction
        self.scale = 1 / math.log(m)
        self.state = SEED
        self.vectors = np.zeros((0, 0))
        self.edges: list[list[list[int]]] = []
        self.entry = -1
        self.upper: tuple[int, np.ndarray, np.ndarray] | None = None

    def _draw(self) -> int:
        self.state = xorshift(self.state)
        return int(-math.log(max((self.state >> 11) / float(1 << 53), 1e-15)) * self.scale)

    def size(self) -> int:
        return len(self.edges)

    def height(self, node: int) -> int:
        """The number of a node's layers."""
        return len(self.edges[node])

    def near(self, node: int, layer: int) -> np.ndarray:
        return np.array(self.edges[node][layer] if layer < len(self.edges[node]) else [], np.int64)

    def beam(self, q: np.ndarray, start: int | list[int], ef: int, layer: int) -> list[tuple[float, int]]:
        """Up to ef nodes near q, best first, from one node or up to ef of them; neighbours of a node are scored together."""
        starts = [start] if isinstance(start, int) else start
        seen = np.zeros(self.size(), bool)
        seen[starts] = True
        kept = list(zip((self.vectors[starts] @ q).tolist(), starts, strict=True))
        ahead = [(-s, x) for s, x in kept]
        heapq.heapify(kept)
        heapq.heapify(ahead)
        while ahead:
            near, node = heapq.heappop(ahead)
            if len(kept) >= ef and -near < kept[0][0]:
                break
            next_ = self.near(node, layer)
            next_ = next_[~seen[next_]]
            if not len(next_):
                continue
            seen[next_] = True
            for s, x in zip((self.vectors[next_] @ q).tolist(), next_.tolist(), strict=True):
                if len(kept) < ef:
                    heapq.heappush(kept, (s, x))
                elif s > kept[0][0]:
                    heapq.heapreplace(kept, (s, x))
                else:
                    continue
                heapq.heappush(ahead, (-s, x))
        return sorted(kept, key=lambda t: -t[0])

    def descend(self, q: np.ndarray, start: int, top: int, bottom: int) -> int:
        for layer in range(top, bottom, -1):
            start = self.beam(q, start, 1, layer)[0][1]
        return start

    def insert(self, node: int) -> None:
        """Links row `node` of vectors, which come in order."""
        level = self._draw()
        self.edges.append([[] for _ in range(level + 1)])
        if self.entry < 0:
            self.entry = node
            return
        q, top = self.vectors[node], len(self.edges[self.entry]) - 1
        at = self.descend(q, self.entry, top, level)
        for layer in range(min(top, level), -1, -1):
            found = self.beam(q, at, self.ef, layer)
            most = self.m0 if layer == 0 else self.m
            self.edges[node][layer] = [x for _, x in found[:most]]
            for x in self.edges[node][layer]:
                own = self.edges[x][layer]
                own.append(node)
                if len(own) > most:
                    near = self.vectors[own] @ self.vectors[x]
                    self.edges[x][layer] = [own[i] for i in np.argsort(-near, kind="stable")[:most]]
            at = found[0][1]
        if level > top:
            self.entry = node

    def build(self, vectors: np.ndarray) -> "Graph":
        """The graph of all rows, as if each were inserted in order and found its nearest earlier ones exactly.

        Those come from matrix products of a block of rows with all before it, layer by layer. A node's neighbours are the
        nearest of those that it chose and those that chose it, as pruning after each insertion leaves them. The time grows with the
        square of the rows, which shards bound; `insert` adds to a finished graph through a beam of ef_construction.
        """
        self.vectors = search.unit(vectors, on_zero="keep")
        levels = np.array([self._draw() for _ in range(len(vectors))], np.int64)
        self.edges = [[[] for _ in range(x + 1)] for x in levels.tolist()]
        self.entry = int(levels.argmax()) if len(levels) else -1
        for layer in range(int(levels.max(initial=-1)) + 1):
            own = np.flatnonzero(levels >= layer)
            for node, near in zip(own.tolist(), linked(self.vectors[own], self.m if layer else self.m0), strict=True):
                self.edges[node][layer] = own[near].tolist()
        return self

    def search(self, q: np.ndarray, k: int, ef: int) -> list[tuple[float, int]]:
        """The k nearest found; none for k = 0, an empty graph or a zero query. A query of another length is compared over the shorter one."""
        if self.entry < 0 or k <= 0 or not (q * q).sum() > 0:
            return []
        q = q / np.sqrt((q * q).sum())
        w = self.vectors.shape[1]
        q = np.concatenate([q, np.zeros(max(0, w - len(q)))])[:w]
        ef = max(ef, k)
        return self.beam(q, self.starts(q, ef), ef, 0)[:k]

    def starts(self, q: np.ndarray, n: int) -> list[int]:
        """The n nodes nearest to q of the lowest upper layer with at most START nodes, by exact scores; a descent from one node can end in a region that few edges leave."""
        if self.upper is None or self.upper[0] != self.size():
            heights = np.array([self.height(i) for i in range(self.size())])
            nodes = next(own for i in range(1, int(heights.max()) + 1) if len(own := np.flatnonzero(heights > i)) <= START)
            nodes = nodes if len(nodes) else np.array([self.entry])
            self.upper = self.size(), nodes, self.vectors[nodes]
        _, nodes, vectors = self.upper
        s = vectors @ q
        return nodes[np.argpartition(-s, n - 1)[:n] if n < len(s) else slice(None)].tolist()


def linked(v: np.ndarray, most: int) -> list[np.ndarray]:
    """Of each row the `most` nearest among the rows that it chose, its `most` nearest earlier ones, and those that chose it."""
    n = len(v)
    one, other, near = [], [], []
    hi = 0
    while hi < n:
        lo, hi = hi, min(hi + max(1, min(BLOCK, SCORES // (hi + BLOCK))), n)
        s = v[lo:hi] @ v[:hi].T
        s[np.arange(hi) >= np.arange(lo, hi)[:, None]] = -np.inf
        k = min(most, hi)
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        best = np.take_along_axis(s, top, axis=1)
        row, place = np.nonzero(np.isfinite(best))
        one.append(row + lo)
        other.append(top[row, place])
        near.append(best[row, place])
    if not n:
        return []
    a, b, s = (np.concatenate(x) for x in (one, other, near))
    a, b, s = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([s, s])
    by = np.lexsort((b, -s, a))
    a, b = a[by], b[by]
    first = np.searchsorted(a, np.arange(n + 1))
    return led_to([b[x : min(x + most, y)] for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], most)


def led_to(lists: list[np.ndarray], most: int) -> list[np.ndarray]:
    """The lists, so changed that every row is in at least most // 4 of them where it can be: pruning leaves rows that none leads to.

    A row that is in too few is put into those of its nearest rows, in place of the farthest that is in enough others.
    """
    least = most // 4
    ways = np.bincount(np.concatenate(lists), minlength=len(lists))
    for i in np.flatnonzero(ways < least).tolist():
        for j in lists[i].tolist():
            own = lists[j]
            if ways[i] >= least:
                break
            if (own == i).any():
                continue
            if len(own) < most:
                lists[j] = np.append(own, i)
            elif len(spare := np.flatnonzero(ways[own] > least)):
                ways[own[spare[-1]]] -= 1
                lists[j] = np.append(np.delete(own, spare[-1]), i)
            else:
                continue
            ways[i] += 1
    return lists


class Packed(Graph):
    """A graph over the arrays of a packed shard, for searching only."""

    def __init__(self, dim: int, entry: int, vectors: bytes, layers: bytes, lists: bytes, edges: bytes):
        super().__init__()
        self.vectors = np.frombuffer(vectors, "<f4").reshape(-1, dim).astype(np.float64)
        self.layers, self.lists, self.flat = (np.frombuffer(x, "<i4") for x in (layers, lists, edges))
        self.entry = entry

    def height(self, node: int) -> int:
        return int(self.layers[node + 1] - self.layers[node])

    def size(self) -> int:
        return len(self.layers) - 1

    def near(self, node: int, layer: int) -> np.ndarray:
        at = self.layers[node] + layer
        return self.flat[self.lists[at] : self.lists[at + 1]] if layer < self.height(node) else self.flat[:0]


def packed(shard: int, ords, ids, g: Graph) -> pd.DataFrame:
    """A graph as a row of the index."""
    layers = np.cumsum([0, *(len(e) for e in g.edges)])
    lists = np.cumsum([0, *(len(x) for e in g.edges for x in e)])
    edges = np.array([y for e in g.edges for x in e for y in x], np.int64)
    bits = [x.astype("<i4").tobytes() for x in (layers, lists, edges)]
    return pd.DataFrame({"shard": [shard], "n": [len(g.edges)], "dim": [g.vectors.shape[1]], "entry": [g.entry], "ord": [list(ords)], "id": [list(ids)], "vectors": [g.vectors.astype("<f4").tobytes()], "layers": bits[:1], "lists": bits[1:2], "edges": bits[2:]})


def nodes(row) -> Iterator[tuple[int, str, np.ndarray, list[list[int]]]]:
    """(ord, id, unit vector, neighbours layer by layer) of each node of a row of the index."""
    g = Packed(row.dim, row.entry, row.vectors, row.layers, row.lists, row.edges)
    for i, (o, name) in enumerate(zip(row.ord, row.id, strict=True)):
        yield o, name, g.vectors[i].astype(np.float32), [g.near(i, layer).tolist() for layer in range(g.height(i))]


#: Rows of a shard where the caller names no number of shards.
SHARD_ROWS = 2048
#: Queries by which the beam of a larger shard is judged, and the share of their nearest rows that it must find.
JUDGES, FOUND = 64, 0.95


def build(df: DataFrame, shards: int | None = None, m: int = 16, ef_construction: int = 200) -> DataFrame:
    """The index table, computed once and kept in the shared folder: a row for each shard. Rows are dealt by a hash of ord; a shard holds about SHARD_ROWS unless told.

    One shard has the insertion order and layers of a single graph over the whole table.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord", kind="stable").reset_index(drop=True)
        return packed(key[0], pdf["ord"], pdf["id"], Graph(m, ef_construction).build(_matrix(pdf["vector"])))

    shards = shards or max(1, -(-df.count() // SHARD_ROWS))
    dealt = df.select(F.pmod(F.xxhash64("ord"), F.lit(shards)).cast("int").alias("shard"), "ord", "id", "vector")
    return durable(dealt.groupBy("shard").applyInPandas(run, INDEX))


def _matrix(column: pd.Series) -> np.ndarray:
    rows = [np.asarray(x, np.float64) for x in column]
    width = max((len(x) for x in rows), default=0)
    out = np.zeros((len(rows), width))
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out


def batch_top_k(index: DataFrame, queries: DataFrame, k: int, ef_search: int = 50) -> DataFrame:
    """Each query's k best over all shards. A shard is searched where its row lies: only results are shuffled.

    The beam is ef_search wide; shards of more than SHARD_ROWS rows widen it until it finds enough (beam_width), so that
    recall doesn't fall as they grow.
    """
    return grid.over_columns(index.sparkSession, queries, k, lambda files: index.mapInArrow(_searcher(files, k, ef_search), grid.RESULT))


def beam_width(g: Graph, asked: list[np.ndarray], k: int, ef: int) -> int:
    """The least of ef, 2 ef, 4 ef and so on with which the graph finds FOUND of the k nearest rows, by exact scores, of JUDGES of the queries.

    A beam that a doubled one doesn't better is taken as the widest of use.
    """
    n, w = g.size(), g.vectors.shape[1]
    able = [v for v in asked if len(v) == w and (v * v).sum() > 0]
    able = able[:: -(-len(able) // JUDGES)] if able else able
    k = min(k, n)
    if not able or k <= 0:
        return ef
    least = [np.partition(g.vectors @ (v / np.sqrt((v * v).sum())), n - k)[n - k] - 1e-9 for v in able]
    ef, before = max(ef, k), -1
    while before < (now := sum(s >= t for v, t in zip(able, least, strict=True) for s, _ in g.search(v, k, ef))) < FOUND * k * len(able):
        ef, before = ef * 2, now
    return ef


def _searcher(files: list[str], k: int, ef_search: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = None
        for batch in batches:
            blocks = blocks or [grid.block_of(f) for f in files]
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("dim", "entry", "vectors", "layers", "lists", "edges")}
                g, ords, ids = Packed(**row), batch.column("ord")[i].values, batch.column("id")[i].values
                ef = beam_width(g, [v for _, vectors in blocks for v in vectors], k, ef_search) if g.size() > SHARD_ROWS else ef_search
                for names, vectors in blocks:
                    found = [(q, s, x) for q, v in zip(names, vectors, strict=True) for s, x in g.search(v, k, ef)]
                    at = pa.array([x for _, _, x in found], pa.int64())
                    yield grid.result([q for q, _, _ in found], TaskContext.get().partitionId(), ords.take(at), ids.take(at), [s for _, s, _ in found])

    return run


def save(index: DataFrame, path: str) -> None:
    index.write.mode("overwrite").parquet(path)


def load(spark, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(path)


def append(index: DataFrame, more: DataFrame, shard: int, m: int = 16, ef_construction: int = 200) -> DataFrame:
    """index with more rows as a shard of their own; compact by building anew."""
    new = build(more, 1, m, ef_construction).withColumn("shard", F.lit(shard))
    return index.unionByName(new)


def graphs(index: DataFrame) -> Iterator[int]:
    """The sizes of the shards."""
    return (r.n for r in index.select("n").toLocalIterator())
