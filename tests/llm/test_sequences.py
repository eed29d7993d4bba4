"""Periodic runs, SentencePiece tokens and the prefix trie against brute force."""

import collections
import random
import zlib

import numpy as np
import pytest
import sentencepiece

from vecspark.llm import periodic_runs, piece_tokens, prefix_trie, queries

from . import edge

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return edge.table(spark)


# ---------------------------------------------------------------- 11 periodic runs


def runs(w, least_words=24, least_periods=3):
    """All runs, comparing each word with the one p on, for every p."""
    number = {}
    w = np.array([number.setdefault(x, len(number)) for x in w], np.int64)
    out = {}
    for p in range(1, len(w) // least_periods + 1):
        same = np.concatenate([[False], w[:-p] == w[p:], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1]).tolist()
        for start, end in zip(edges[0::2], edges[1::2], strict=True):
            if end + p - start >= max(least_words, least_periods * p):
                out.setdefault((start, end + p), p)
    return sorted((a, b - a, p) for (a, b), p in out.items())


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def run_digests(doc_id, text):
    w = planted(doc_id, edge.WORDS.findall(text or ""))
    found = runs(w)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return (len(found), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, edge.sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), edge.sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


RUN_COLUMNS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


@pytest.mark.parametrize("seed", range(8))
def test_grid_finds_every_run(seed):
    rng = random.Random(seed)
    for _ in range(120):
        n, k = rng.randint(0, 240), rng.choice([1, 2, 3, 30])
        w = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randint(0, 4)):
            if n:
                a, p = rng.randrange(n), rng.randint(1, max(1, n // rng.randint(2, 12)))
                for i in range(a, min(n, a + rng.randint(1, n))):
                    w[i] = w[a + (i - a) % p]
        least = rng.choice([(24, 3), (24, 3), (1, 3), (6, 4)])
        assert periodic_runs.find_runs(np.array(w, np.int32), *least) == runs(w, *least)


def test_runs_of_long_texts():
    block = np.random.default_rng(1).integers(0, 5, 1000).astype(np.int32)
    w = np.concatenate([np.arange(50_000) + 10, np.tile(block, 40), np.zeros(3000), np.arange(7) + 100]).astype(np.int32)
    found = periodic_runs.find_runs(w)
    assert (50_000, 40_000 + (block[0] == 0), 1000) in found and [r for r in found if r[2] == 1] and found == sorted(found)
    assert periodic_runs.find_runs(np.zeros(200_000, np.int32)) == [(0, 200_000, 1)]
    with pytest.raises(ValueError):
        periodic_runs.find_runs(block, 24, 2)


def test_periodic_runs(spark, docs):
    more = [(110 + i, " ".join(["a b c"] * i + ["x"] + ["y"] * 24 + [f"w{j}" for j in range(i)]), "en", "a", 1, "s", "x", "h", "k") for i in range(40)]
    more += [(None, "p q " * 30, "en", "a", 1, "s", "x", "h", "k")]
    table = docs.unionByName(spark.createDataFrame(more, edge.SCHEMA))
    got = periodic_runs.digests(periodic_runs.periodic_runs(periodic_runs.with_planted_runs(table))).collect()
    want = collections.Counter((d, *run_digests(d, t)) for d, t, *_ in [*edge.rows(), *more])
    assert collections.Counter(tuple(r[c] for c in ("doc_id", *RUN_COLUMNS)) for r in got) == want
    assert periodic_runs.periodic_runs(edge.empty(spark)).count() == 0


def test_periodic_runs_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = queries.op11_periodic_runs(spark, SMALL).collect()
    assert len(got) == len(texts) and any(r.n_runs for r in got)
    for r in got:
        if len((texts[r.doc_id] or "").split()) < 4000:  # the brute force takes all pairs
            assert tuple(r[c] for c in RUN_COLUMNS) == run_digests(r.doc_id, texts[r.doc_id])


# ---------------------------------------------------------------- 12 pieces


@pytest.fixture(scope="module")
def pieces():
    path = queries.pieces_path()
    return piece_tokens.Pieces.of(path), sentencepiece.SentencePieceProcessor(model_file=path)


ALPHABETS = ["ab ", "aeiou nrst", "  \n\t\rab", "▁ a", "éüß日本語 aé", "0123456789.- ", "<s>/x<0x0A> ", "\x00 a ﻿", "the in on re er at or "]


@pytest.mark.parametrize("letters", ALPHABETS)
def test_pieces_equal_the_library(pieces, letters):
    model, lib = pieces
    rng = random.Random(letters)
    for _ in range(300):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 80)))
        ids = lib.encode(text)
        assert model.encode(text).tolist() == ids and model.decode(ids) == lib.decode(ids)


def test_any_ids_decode_as_the_library_does(pieces):
    model, lib = pieces
    rng = random.Random(5)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(32_000), rng.randrange(259), rng.choice([0, 1, 2, 259])]) for _ in range(rng.randint(0, 12))]
        assert model.decode(ids) == lib.decode(ids)


def test_pieces_of_long_segments_and_little_memory(pieces, monkeypatch):
    model, lib = pieces
    monkeypatch.setattr(piece_tokens, "REMEMBERED", 2000)
    monkeypatch.setattr(piece_tokens, "PAIRS", 50)
    for text in ("a" * 5000, "日本語の文章" * 700, "".join(random.Random(1).choice("abcdefg0123+/") for _ in range(8000)), " ".join(f"word{i}ly" for i in range(700))):
        assert model.encode(text).tolist() == lib.encode(text)


def test_piece_tokens(spark, docs, pieces):
    _, lib = pieces
    coded = piece_tokens.encode(docs, queries.pieces_path(), with_decoded=True)
    texts = {d: t for d, t, *_ in edge.rows()}
    rows = coded.collect()
    assert len(rows) == len(edge.rows())
    for r in rows:
        assert r.ids == lib.encode(texts[r.doc_id] or "") and r.decoded == lib.decode(r.ids)
    assert {r.doc_id: r.text for r in piece_tokens.decode(coded, queries.pieces_path()).collect()} == {d: lib.decode(lib.encode(t or "")) for d, t in texts.items()}
    assert piece_tokens.encode(edge.empty(spark), queries.pieces_path()).count() == 0


def test_piece_tokens_query(spark, pieces):
    _, lib = pieces
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = queries.op12_piece_tokens(spark, SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = lib.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), edge.sha(",".join(map(str, ids))), edge.sha(lib.decode(ids)))


# ---------------------------------------------------------------- 13 prefix trie

NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def nodes(rows):
    """The trie of (conv_id, turn, role, text) rows, with dictionaries of whole beginnings."""
    own = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [v[2:] for v in sorted(vs)] for c, vs in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    members = collections.defaultdict(list)
    for c, v in rebuilt.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    kids = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, m in members.items():
        words = (len(m) - 1) * len(edge.WORDS.findall(k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += words
            leaves[k[:d]] += kids[k] == 0
    ends = {k: ",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(k)) for k, m in members.items()}
    return sorted(((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], edge.sha(ends[k])) for k, m in members.items()), key=str)


def built(df, **options):
    made = prefix_trie.with_end_digests(*prefix_trie.trie(prefix_trie.with_shared_starts(prefix_trie.numbered(df)), **options))
    return sorted((tuple(r[c] for c in NODE) for r in made.collect()), key=str)


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(4)
    out = [(rng.randrange(90), rng.choice([None, *range(6)]), rng.choice(["u", "a", None]), rng.choice(["x", "y z", "  ", None, "x"])) for _ in range(400)]
    out += [(100, i, "u", "x") for i in range(500)] + [(101, i, "u", "x") for i in range(300)]  # long, shared and hot
    out += [(200 + i, 0, "s", "one first turn of all") for i in range(60)] + [(200 + i, 1, "u", f"then {i}") for i in range(60)]
    return [*out, (None, 0, "u", "nobody's"), (None, 1, None, None), *out[:5]]


SPEECH = "conv_id long, turn long, role string, text string, depth string, print string, part int, n string"


@pytest.mark.parametrize("bits, broadcast", [(64, 100_000), (3, 100_000), (64, 0)])
def test_prefix_trie(spark, turns, monkeypatch, bits, broadcast):
    monkeypatch.setattr(prefix_trie, "BLOCK", 32)
    monkeypatch.setattr(prefix_trie, "HOT", 5)
    monkeypatch.setattr(prefix_trie, "BROADCAST", broadcast)
    df = spark.createDataFrame([(*r, "d", "p", 7, "n") for r in turns], SPEECH).repartition(5)
    assert built(df, hash_bits=bits) == nodes(turns)


def test_prefix_trie_of_nothing(spark):
    empty = spark.createDataFrame([], SPEECH)
    assert built(empty) == []
    short = [(41, 0, "u", "a"), (40, 0, "u", "a"), (63, None, None, None)]  # turnless after rebuilding, or without a base
    assert built(spark.createDataFrame(short, "conv_id long, turn long, role string, text string")) == nodes(short)


def test_scans_go_on_across_parts(spark):
    df = spark.createDataFrame([(c, i) for c in (1, 2, 3) for i in range(400 if c == 2 else 5)], "conv_id long, turn long").repartition(3)
    rows = prefix_trie.running(df, ["turn"], prefix_trie._one, ["n"]).collect()
    assert all(r.n == r.turn + 1 and r.n_before == r.turn for r in rows) and len(rows) == 410
