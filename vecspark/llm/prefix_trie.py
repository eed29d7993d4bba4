"""The trie of conversations' shared beginnings: rolling prefix fingerprints find candidates, exact turns settle them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ._common import durable, shuffle_width

#: Base of the fingerprints, which are polynomials of turn hashes modulo 2**64.
BASE = 0x9E3779B97F4A7C15
#: Turns of one conversation that meet in one task of a join.
BLOCK = 4096
_U = np.uint64

# ---------------------------------------------------------------- scans over ordered rows


def _starts(key: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)


def _scan(terms: Callable, names: list[str], before: dict | None) -> Callable:
    """Running sums (modulo 2**64) of columns within runs of equal conv_id.

    before None: of each part of the rows only its first and last conv_id and the last one's sums. Else the rows with their
    running sums, begun at before[part].
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, last, held = None, None, None, np.zeros(len(names), _U)

        def ends() -> pa.RecordBatch:
            return pa.record_batch({"part": pa.array([part], pa.int32()), "first": pa.array([first]), "last": pa.array([last]), "sums": pa.array([held.view(np.int64).tolist()], pa.list_(pa.int64()))})

        for whole in batches:
            parts = whole.column("part").to_numpy(zero_copy_only=False)
            edges = _starts(parts)
            for low, high in zip(edges, [*edges[1:], len(parts)], strict=True):
                batch = whole.slice(low, high - low)
                key = batch.column("conv_id").to_numpy(zero_copy_only=False)
                if part != parts[low]:
                    if before is None and part is not None:
                        yield ends()
                    part, first = int(parts[low]), int(key[0])
                    last, sums = before.get(part, (None, [0] * len(names))) if before else (None, [0] * len(names))
                    held = np.array(sums, _U)
                start = _starts(key)
                n = np.diff(np.append(start, len(key)))
                columns = dict(zip(batch.schema.names, batch.columns, strict=True))
                columns.pop("part")
                for i, own in enumerate(terms(batch)):
                    total = np.cumsum(own, dtype=_U)
                    total -= np.repeat(total[start] - own[start], n)
                    if last == key[0]:
                        total[: n[0]] += held[i]
                    held[i] = total[-1]
                    columns |= {names[i]: pa.array(total.view(np.int64)), names[i] + "_before": pa.array((total - own).view(np.int64))}
                last = int(key[-1])
                if before is not None:
                    yield pa.record_batch(columns)
        if before is None and part is not None:
            yield ends()

    return run


def running(rows: DataFrame, order: list, terms: Callable, names: list[str]) -> DataFrame:
    """rows with the running sums of terms(batch) within each conv_id, in the given order, as columns `names`, and those before each row as `names` with _before.

    Rows are dealt by range over all of `order`, so that a conversation of any length spreads over many tasks; each task's
    sums go on where those before end. A row for each of these parts reaches the driver; a lost part is computed again alike.
    """
    placed = rows.repartitionByRange(shuffle_width(rows.sparkSession), "conv_id", *order).sortWithinPartitions("conv_id", *order)
    placed = durable(placed.withColumn("part", F.spark_partition_id()))
    ends = placed.mapInArrow(_scan(terms, names, None), "part int, first long, last long, sums array<long>").collect()
    before, carry = {}, None
    for e in sorted(ends, key=lambda e: e.part):
        own = [x % (1 << 64) for x in e.sums]
        if carry and carry[0] == e.first:
            before[e.part] = carry
            if e.first == e.last:
                own = [(x + y) % (1 << 64) for x, y in zip(own, carry[1], strict=True)]
        carry = (e.last, own)
    more = [StructField(n + x, LongType()) for n in names for x in ("", "_before")]
    schema = StructType([*(f for f in placed.schema.fields if f.name != "part"), *more])
    return placed.mapInArrow(_scan(terms, names, before), schema)


def _powers(depth: np.ndarray) -> np.ndarray:
    """BASE to each depth, modulo 2**64."""
    out, square, left = np.ones(len(depth), _U), BASE, depth.astype(np.int64)
    while len(left) and left.max(initial=0) > 0:
        odd = (left & 1).astype(bool)
        out[odd] *= _U(square)
        square, left = square * square % (1 << 64), left >> 1
    return out


def _one(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.ones(batch.num_rows, _U)]


def _terms(batch: pa.RecordBatch) -> list[np.ndarray]:
    depth, turn, words = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("depth", "turn_hash", "words"))
    return [np.where(depth > 0, turn.view(_U) * _powers(depth), _U(0)), words.astype(_U)]


# ---------------------------------------------------------------- tables of turns


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, depth (from 1), role and text of each row: in a conversation by turn (null first), then role and text; nulls of these are empty.

    Rows without a conv_id belong to no conversation and are left out; rows that repeat are turns of their own.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), empty("role"), empty("text"))
    return running(rows, ["turn", "role", "text"], _one, ["depth"]).select("conv_id", "depth", "role", "text")


def with_shared_starts(turns: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Rebuilt conversations: conv_id c begins with the first h turns of conversation c - c % every, then come its own turns after its first h.

    h is the crc32 of the decimal c modulo `most`. Where that conversation has fewer turns, all of them are taken, where
    there is none, none. Each conversation has a row of depth 0, without role and text, beside its turns.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    sizes = turns.groupBy("conv_id").agg(F.max("depth").alias("n"))
    lent = turns.where((F.col("conv_id") % every == 0) & (F.col("depth") < most)).select(F.col("conv_id").alias("base"), "depth", "role", "text")
    convs = durable(sizes.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base")))
    lenders = sizes.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("has"))
    convs = convs.join(lenders, "base", "left").withColumn("k", F.least("h", F.coalesce("has", F.lit(0))))
    start = convs.select("conv_id", "base", "h").join(lent, "base").where("depth <= h").select("conv_id", "depth", "role", "text")
    own = by_block(turns, convs.select("conv_id", "n", "h", "k")).where("depth > h").select("conv_id", (F.col("depth") - F.col("h") + F.col("k")).alias("depth"), "role", "text")
    top = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit("").alias("role"), F.lit("").alias("text"))
    return top.unionByName(start).unionByName(own)


def by_block(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """rows (conv_id, depth) with their conversation's columns; convs has one row each, n its greatest depth. A task gets BLOCK turns of a conversation, not all."""
    blocks = convs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"n div {BLOCK}"))))
    return rows.withColumn("block", F.expr(f"depth div {BLOCK}")).join(blocks, ["conv_id", "block"]).drop("block")


# ---------------------------------------------------------------- the trie

#: A node with more children is looked up by parts of them, or broadcast where there are at most BROADCAST such nodes.
HOT, BROADCAST, SALTS = 4096, 100_000, 64


def _variants(rows: DataFrame) -> DataFrame:
    """The distinct turns of each group of equal fingerprints: groups of one are settled, the least conv_id stands for each."""
    same = ["depth", "print", "print_before", "role", "text"]
    return rows.groupBy(*same).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("words_before").alias("words_before"))


def settled(turns: DataFrame, hash_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """The turns with `print`, a fingerprint of the turns up to each that only equal beginnings share, and a row for each such beginning.

    The members of a group of equal (depth, fingerprint) are compared, by turn and by the group that they come from, with
    the turn of the group's representative, the least conv_id; where all agree at every depth, groups are beginnings. Members
    that differ are split off: their turn's hash is drawn again, which changes it and all that follows, until no group is
    mixed. Copies of a turn are counted before they meet. hash_bits: fewer make collisions, for tests of this.
    """
    words = F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).cast("long")
    drawn = F.xxhash64("role", "text")
    if hash_bits < 64:
        drawn = drawn.bitwiseAND(F.lit((1 << hash_bits) - 1))
    rows = turns.select("conv_id", "depth", "role", "text", words.alias("words"), drawn.alias("turn_hash"))
    while True:
        scanned = running(rows, ["depth"], _terms, ["print", "words_sum"]).withColumnRenamed("words_sum_before", "words_before")
        found = durable(_variants(scanned).drop("role", "text"))
        mixed = found.groupBy("depth", "print").agg(F.min("conv_id").alias("stands"), F.count("*").alias("n")).where("n > 1").drop("n")
        if mixed.isEmpty():
            return scanned, found
        other = _variants(scanned).join(mixed, ["depth", "print"]).where("conv_id <> stands").select("depth", "print", "print_before", "role", "text", F.col("conv_id").alias("of"))
        redrawn = F.when(F.col("of").isNull(), F.col("turn_hash")).otherwise(F.xxhash64("role", "text", "of", "turn_hash"))
        rows = durable(scanned.join(other, ["depth", "print", "print_before", "role", "text"], "left").select("conv_id", "depth", "role", "text", "words", redrawn.alias("turn_hash")))


def _with_parents(nodes: DataFrame) -> DataFrame:
    """nodes with their parent's conv_id; the children of a node with more than HOT of them don't meet in one task."""
    on = ["depth", "print_before"]
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("print").alias("print_before"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("kids"))
    hot = above.where(F.col("kids") > HOT).drop("kids")
    if hot.count() <= BROADCAST:
        marked = nodes.join(F.broadcast(hot.withColumnRenamed("parent_conv_id", "hot")), on, "left")
    else:
        salted = hot.withColumnRenamed("parent_conv_id", "hot").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        marked = nodes.withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int")).join(salted, [*on, "salt"], "left").drop("salt")
    rest = marked.where("hot is null").drop("hot").join(above.where(F.col("kids") <= HOT).drop("kids"), on, "left")
    return rest.unionByName(marked.where("hot is not null").withColumnRenamed("hot", "parent_conv_id"))


def trie(turns: DataFrame, hash_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """The nodes, and the conversations that end in each, of the trie of turns (conv_id, depth from 0 without gaps, role, text).

    Nodes: depth and print (together a key), conv_id (the least member), parent_conv_id (null above the root), n_convs (members),
    n_children, n_leaves (childless nodes of the subtree) and saved_tokens (over the subtree, words of a node's turn times its
    members but one). Ends: depth, print, conv_id.

    The rollup needs no step for each depth: a conversation owns the nodes that it is the least member of, which are all its
    nodes from some depth on. What a node's subtree saves is, over its members, the words of their turns from there to the
    first that they own; its leaves are those whose owner is a member. Both are sums over a node's members.
    """
    scanned, found = settled(turns, hash_bits)
    kids = found.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("print_before").alias("print")).agg(F.count("*").alias("n_children"))
    nodes = durable(found.join(kids, ["depth", "print"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    owners = nodes.groupBy("conv_id").agg(F.min_by("words_before", "depth").alias("cut"), (F.max_by("n_children", "depth") == 0).alias("leaf"))
    convs = scanned.groupBy("conv_id").agg(F.max("depth").alias("n"), F.max("words_sum").alias("total")).join(owners, "conv_id", "left")
    convs = convs.select("conv_id", "n", F.coalesce("cut", "total").alias("cut"), F.coalesce("leaf", F.lit(False)).cast("long").alias("leaf"))
    rows = by_block(scanned.select("conv_id", "depth", "print", "words_before"), convs)
    saves = F.greatest(F.lit(0).cast("long"), F.col("cut") - F.col("words_before"))
    sums = rows.groupBy("depth", "print").agg(F.sum("leaf").alias("n_leaves"), F.sum(saves).alias("saved_tokens"))
    out = _with_parents(nodes).join(sums, ["depth", "print"]).select("depth", "print", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    return out, rows.where("depth = n").select("depth", "print", "conv_id")


def _end_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, digest = None, None
    done: list[tuple[int, int, str]] = []

    def out() -> pa.RecordBatch:
        rows = pa.record_batch([pa.array([r[i] for r in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["depth", "print", "ends_sha256"])
        done.clear()
        return rows

    for batch in batches:
        for depth, mark, conv in zip(*(batch.column(c).to_pylist() for c in ("depth", "print", "conv_id")), strict=True):
            if (depth, mark) == key:
                digest.update(f",{conv}".encode())
                continue
            if key:
                done.append((*key, digest.hexdigest()))
            key, digest = (depth, mark), hashlib.sha256(str(conv).encode())
        if len(done) >= 4096:
            yield out()
    if key:
        done.append((*key, digest.hexdigest()))
    yield out()


def with_end_digests(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """nodes without their print, and the SHA-256 of the conv_ids that end in each, ascending and joined by commas.

    A digest depends on the order of what it reads, so one task reads a node's ends, sorted by Spark, as a stream, and holds none.
    """
    placed = ends.repartition("depth", "print").sortWithinPartitions("depth", "print", "conv_id")
    digests = placed.mapInArrow(_end_digests, "depth long, print long, ends_sha256 string")
    none = hashlib.sha256(b"").hexdigest()
    return nodes.join(digests, ["depth", "print"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(none))).drop("print")
