import collections
import itertools
import json
import random
import re
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vecspark.llm import chat, decontamination, fingerprints, jaccard_join, language_id, line_dedup, mixing, pii, queries, sharding, token_output
from vecspark.llm._common import Buckets, Hasher, chunks, grams, words, NOT_SPACE

from . import edge

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return edge.table(spark)


def by(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def texts():
    return [(d, t) for d, t, _, _ in edge.TEXTS]


# ---------------------------------------------------------------- shared pieces


def test_hashes_do_not_depend_on_place_or_chunk():
    h = Hasher(3)
    found = collections.defaultdict(set)
    for text in ("aa bb", "bb aa cc", "x " * 50 + "bb"):
        for _, _, raw, off in chunks(pa.array([text])):
            s, e, _ = words(raw, off, NOT_SPACE)
            for a, b, v in zip(s, e, h.ranges(h.prefix(raw), s, e), strict=True):
                found[raw[a:b].tobytes()].add(int(v))
    assert all(len(v) == 1 for v in found.values()) and len({min(v) for v in found.values()}) == len(found)


def test_grams_stay_inside_texts():
    h = np.arange(10, dtype=np.uint64) + np.uint64(1)
    first = np.array([0, 3, 3, 10])
    g, at, n = grams(h, first, 5)
    assert at.tolist() == [0, 3, 4, 5] and n.tolist() == [0, 1, 1, 4]
    g2, at2, _ = grams(h, first, 5, whole=False)
    assert at2.tolist() == [3, 4, 5] and (g[1:] == g2).all()


def test_buckets_keep_order(spark):
    df = spark.createDataFrame([(x * x * (-1) ** x,) for x in range(300)] + [(None,), (7,), (7,)], "doc_id long")
    b = Buckets(df, "doc_id", 100)
    rows = sorted((r.doc_id, r.b) for r in df.withColumn("b", b.of("doc_id")).where("doc_id is not null").collect())
    assert [x[1] for x in rows] == sorted(x[1] for x in rows) and rows[-1][1] < b.n
    assert df.where("doc_id is null").select(b.of("doc_id").alias("b")).first().b == -1


# ---------------------------------------------------------------- 1 sharding


def test_sharding(spark, docs):
    rows = sharding.assign(docs, 4).collect()
    for r in rows:
        t = dict(texts())[r.doc_id] or ""
        assert r.size == len(t.encode()) + 1 and r.text_crc32 == edge.crc(t.encode()) and r.law == "key" and r.grown_shard in (r.shard, 4)
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and len(rows) == len(edge.rows())
    assert sharding.assign(edge.empty(spark), 4).count() == 0


@pytest.mark.parametrize("n", [1, 5, 8, 16])
def test_another_shard_takes_rows_only_into_itself(spark, n):
    df = spark.range(4000).select(sharding.shard_of(F.col("id"), sharding.default_tree(n)).alias("a"), sharding.shard_of(F.col("id"), sharding.default_tree(n + 1)).alias("b"))
    rows = df.collect()
    assert all(r.b in (r.a, n) for r in rows)
    assert abs(sum(r.b == n for r in rows) - 4000 / (n + 1)) < 5 * (4000 / (n + 1)) ** 0.5


def test_weights_move_rows_only_to_what_gained(spark):
    tree = (((sharding.Leaf(0), sharding.Leaf(1)),), ((sharding.Leaf(2, 2.0),), (sharding.Leaf(3),)))
    more = (((sharding.Leaf(0), sharding.Leaf(1)),), ((sharding.Leaf(2, 4.0),), (sharding.Leaf(3),)))
    rows = spark.range(5000).select(sharding.shard_of(F.col("id"), tree).alias("a"), sharding.shard_of(F.col("id"), more).alias("b")).collect()
    assert all(r.b in (r.a, 2) for r in rows)
    n = collections.Counter(r.a for r in rows)
    assert abs(n[2] - 2000) < 200 and abs(n[0] - 1000) < 160


# ---------------------------------------------------------------- 2 n-gram Jaccard join


def test_near_duplicates(docs, spark):
    want = edge.components(texts())
    got = jaccard_join.near_duplicates(docs).collect()
    assert len(got) == len(edge.rows())
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id], r
    assert jaccard_join.near_duplicates(edge.empty(spark)).count() == 0


def test_near_duplicates_of_chained_and_borderline_copies(spark):
    rng = random.Random(5)
    rows, base = [], [f"t{i}" for i in range(120)]
    passage = " ".join(f"shared{i}" for i in range(60))
    for i in range(60):
        own = list(base)
        for _ in range(rng.randrange(5)):
            own[rng.randrange(len(own))] = f"edit{rng.random()}"
        rows.append((i, " ".join(own)))
        rows.append((1000 + i, passage + " " + " ".join(f"u{i}_{j}" for j in range(rng.randrange(4, 90)))))
    want = edge.components(rows)
    got = by(jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == want


def _near_copies(seed, groups=6, size=25):
    """Texts whose sets lie around the threshold, with passages that many groups share."""
    rng = random.Random(seed)
    rows = []
    passages = [[f"p{k}_{i}" for i in range(12)] for k in range(3)]
    for k in range(groups):
        base = [f"b{k}_{i}" for i in range(rng.choice([6, 30, 90, 260]))] + passages[k % 3]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randrange(1 + len(own) // 25)):
                own[rng.randrange(len(own))] = f"e{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(own[rng.randrange(3) :])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("branch", [4, jaccard_join.BRANCH])
def test_large_branches_are_cut_without_loss(spark, branch):
    rows = _near_copies(branch)
    got = by(jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), branch=branch))
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == edge.components(rows)


def _trees(rows, label):
    """Pairs of the forest over whole sets of numbers, dealt and traversed here."""
    sets = [np.array(sorted(x), np.int64) for x in rows]
    n = np.array([len(x) for x in sets])
    df = collections.Counter(t for x in sets for t in x.tolist())
    out = []
    for i, x in enumerate(sets):
        x = np.array(sorted((t for t in x.tolist() if df[t] > 1), key=lambda t: (df[t], t)), np.int64)
        code = np.concatenate([jaccard_join._codes(jaccard_join._rank(np.array([df[t] for t in x.tolist()])), x), np.full(jaccard_join.LEVELS, 0xFFFFFFFF, np.uint32)])
        for k, t in enumerate(x.tolist()):
            bits = jaccard_join._parity(sets[i].view(np.uint64), np.array([0, n[i]]))[0]
            out.append((t, k, len(x), code[k + 1 : k + 1 + jaccard_join.LEVELS].astype(np.uint32).tobytes(), np.concatenate([np.zeros(jaccard_join.BACK, np.int64), x])[k : k + jaccard_join.BACK].tobytes(), i, n[i], label[i], bits))
    out.sort(key=lambda r: r[0])
    cols = [np.array(c, object) if isinstance(c[0], bytes) else np.array(c) for c in zip(*out, strict=True)]
    found = set()
    for a, b in jaccard_join._Forest(*cols, 80).pairs():
        found |= {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist(), strict=True)}
    return found


def test_trees_lose_no_pair(monkeypatch):
    monkeypatch.setattr(jaccard_join, "FRONT", 50)
    for seed in range(6):
        rng = random.Random(seed)
        base = [rng.sample(range(1 << 62), rng.choice([3, 20, 150])) for _ in range(4)]
        rows = []
        for _ in range(60):
            own = list(rng.choice(base))
            for _ in range(rng.randrange(1 + len(own) // 6)):
                own[rng.randrange(len(own))] = rng.randrange(1 << 62)
            rows.append(set(own))
        label = [rng.randrange(12) for _ in rows]
        similar = {(i, j) for j in range(len(rows)) for i in range(j) if label[i] != label[j] and 100 * len(rows[i] & rows[j]) >= 80 * len(rows[i] | rows[j])}
        found = _trees(rows, label)
        assert similar <= found and all(label[i] != label[j] for i, j in found)


def test_parity_bits_bound_the_difference():
    rng = random.Random(8)
    sets = [rng.sample(range(1 << 62), n) for n in (1, 3, 64, 65, 70, 130, 250, 260, 900, 1100, 1300)]
    sets += [x[: len(x) - len(x) // 9] for x in sets]
    at = np.cumsum([0, *map(len, sets)])
    bits = jaccard_join._Bits(np.diff(at), b"".join(jaccard_join._parity(np.array([t for x in sets for t in sorted(x)], np.uint64), at)))
    i, j = (x.ravel() for x in np.indices((len(sets), len(sets))))
    for a, b, d in zip(i.tolist(), j.tolist(), bits.differ(i, j).tolist(), strict=True):
        assert d <= len(set(sets[a]) ^ set(sets[b])) and (a != b or d == 0)


@pytest.mark.parametrize("most", [3, 1 << 16])
def test_shared_posts_over_batches(monkeypatch, most):
    monkeypatch.setattr(jaccard_join, "MOST", most)
    rng = random.Random(3)
    rows = sorted((rng.randrange(30), rng.choice([0, 0, 0, 2]), rng.randrange(6), rng.choice([5, 5, 5, -5])) for _ in range(150))
    rows = [r for r in rows if r[1] == 0 or r[3] > 0]
    sets, hot = collections.defaultdict(set), {(t, k) for t, k, _, n in rows if k or n < 0}
    for t, k, s, _ in rows:
        sets[t, k].add(s)
    want = {(t, k, s): most if (t, k) in hot else min(len(x), most) for (t, k), x in sets.items() if len(x) > 1 or (t, k) in hot for s in x}
    for size in (1, 2, 7, 500):
        batches = (pa.record_batch({c: pa.array(v, t) for c, v, t in zip(("token", "salt", "s", "n"), zip(*rows[i : i + size], strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int32()), strict=True)}) for i in range(0, len(rows), size))
        got = [r for b in jaccard_join._shared(batches) for r in zip(*(b[c].to_pylist() for c in ("token", "s", "n", "rank")), strict=True)]
        assert sorted(got) == sorted((t, s, 5, int(jaccard_join._rank(np.array([d]))[0])) for (t, _, s), d in want.items())


def test_sets_with_one_digest_are_told_apart_by_both(spark):
    texts_ = pa.record_batch({"doc_id": pa.array([1, 2]), "same": pa.array([1, 2]), "text": pa.array([edge.BASE, edge.NEAR])})
    signed = next(jaccard_join._sign(iter([texts_])))
    twins = signed["s1"].to_numpy().view(np.uint64)
    _, _, g, at = next(jaccard_join.shingle_sets(texts_["text"]))
    assert jaccard_join._names(g, at, twins).tolist() == signed["both"].to_pylist() != signed["s1"].to_pylist()
    rows = spark.createDataFrame([(int(a), int(b)) for a, b in zip(signed["s1"].to_pylist(), signed["both"].to_pylist(), strict=True)], "s1 long, both long")
    assert sorted(r.s for r in rows.select(jaccard_join._name(twins)).collect()) == sorted(signed["both"].to_pylist())


def test_rows_of_one_id_are_one_document(spark):
    rows = [(1, edge.BASE), (1, edge.NEAR), (2, edge.NEAR), (3, edge.BASE), (4, "x y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in jaccard_join.near_duplicates(df).collect()) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]
    labels = {(r.doc_id, r.n_shingles): r.label for r in jaccard_join.linked(df).collect()}
    assert len(set(labels.values())) == 3


def test_null_ids_link_with_nothing(spark):
    rows = [(None, edge.BASE), (1, edge.BASE), (2, edge.BASE)]
    got = sorted((str(r.doc_id), r.component_id) for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("1", 1), ("2", 1), ("None", None)]


def test_trie_traversal_agrees_with_counting():
    rng = random.Random(1)
    probe = np.array(sorted(rng.sample(range(200), 60)), np.uint64)
    members = sorted((np.array(sorted(set(rng.sample(probe.tolist(), rng.randrange(40, 60))) | set(rng.sample(range(200), rng.randrange(12)))), np.uint64) for _ in range(300)), key=lambda a: a.astype(">u8").tobytes())
    p = jaccard_join._Probe(probe, 80)
    for m in members:
        both = len(np.intersect1d(m, probe))
        assert p.linked(m) == (100 * both >= 80 * (len(m) + len(probe) - both))


# ---------------------------------------------------------------- 3 PII


def test_base_spans(docs, spark):
    got = by(pii.find(docs))
    for d, t in texts():
        want = edge.spans(t)
        n = collections.Counter(k for k, _, _ in want)
        r = got[d]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (n["email"], n["ip"], n["card"], n["phone"]), d
        assert r.base_sha256 == edge.sha(",".join(f"{k}:{a}:{b}" for k, a, b in want))
    assert pii.find(edge.empty(spark)).count() == 0


def test_base_spans_of_random_texts():
    rng = random.Random(3)
    for _ in range(3000):
        t = "".join(rng.choice("a1.@+- (2)5é\n") for _ in range(rng.randrange(40)))
        assert pii.base_spans(t) == edge.spans(t), t


def test_contexts_discover_unseen_forms(spark):
    rows = [(i, f"Please call us at +1 (415) 555-01{i:02d} any day.") for i in range(8)]
    rows += [(100, "Please call us at 415-555-0199 today."), (101, "Nothing to call here, 415-555-0199 is bare."), (102, "Please call us at noon")]
    got = by(pii.find(spark.createDataFrame(rows, "doc_id long, text string"), confidence=0.7))
    a = rows[8][1].index("415")
    assert got[100].n_phone == 0 and got[100].spans == f"phone:{a}:{a + 12}"
    assert got[101].spans == "" and got[102].spans == "" and got[3].n_phone == 1
    assert pii.mask(rows[8][1], got[100].spans) == "Please call us at <phone> today."


def test_scores_count_distinct_instances_however_often_copied(spark):
    rows = [(i, f"Please call us at +1 (415) 555-01{i:02d} any day.") for i in range(50)]
    rows += [(i, "Please call us at noon") for i in range(100, 1100)]
    rows += [(2000, "Please call us at 415-555-0199 today.")]
    rows += [(i, "The code was +1 415 555 0100 again") for i in range(3000, 4000)] + [(4000 + i, f"The code was +1 415 555 020{i} again") for i in range(3)]
    rows += [(5000 + i, f"The code was w{i}") for i in range(20)] + [(6000, "The code was 415-555-0199 again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    score = {r.pattern: r.score for r in pii.scored_patterns(docs).collect()}
    assert score["us at "] > 50 / 52 and score["code was "] < 0.3
    got = by(pii.find(docs))
    a = rows[1050][1].index("415")
    assert got[2000].spans == f"phone:{a}:{a + 12}" and got[6000].spans == ""


def contexts(text):
    """(place, context) by a pattern at each place."""
    for x in range(1, len(text)):
        if m := re.search(r"(?<!\w)[^\W\d_]+[^\w\n]{1,3}[^\W\d_]+[^\w\n]{1,4}\Z", text[:x]):
            if not (text[x - 1].isalnum() or text[x - 1] == "_"):
                yield x, pii.lower(m[0])


def test_contexts_are_two_whole_words_of_any_length():
    rng = random.Random(6)
    one = {}
    for n in range(400):
        text = "".join(rng.choice("aB1_ ,.é\u0130\u2014\u65e5:(@\n") for _ in range(rng.randint(0, 40))) if n else "x " + "long" * 40 + "\u0130 word: y"
        place, first, key, _ = pii.contexts(text)
        want = [(x, c) for x, c in contexts(text) if not re.match(r"[\s,;<>\"']", text[x])]
        assert sorted(zip(place.tolist(), (pii.lower(text[a:x]) for a, x in zip(first, place, strict=True)), strict=True)) == want
        for (_, c), h in zip(want, key[np.argsort(place)].tolist(), strict=True):
            assert one.setdefault(c, h) == h
    assert len(set(one.values())) == len(one)


def learned_by_force(rows, confidence, least=3, rounds=pii.ROUNDS):
    """(kind, pattern) -> score, from dictionaries of whole texts, in whole numbers as the operator counts them."""
    unit, want = pii.UNIT, round(confidence * pii.UNIT)
    after, docs, seed = collections.defaultdict(lambda: collections.defaultdict(bool)), collections.defaultdict(set), set()
    for d, text in rows:
        base = {(k, a): b for k, a, b in pii.base_spans(text or "")}
        for x, c in contexts(text or ""):
            t = pii.follower(text, x)
            for k in pii.KINDS:
                if value := text[x : base[k, x]] if (k, x) in base else text[slice(*t)] if t else None:
                    may = (k, x) in base or pii.plausible(k, value)
                    after[k, c][value] |= may
                    docs[k, c, value].add(d)
                    if (k, x) in base:
                        seed.add((k, c, value))
    known = {(k, v) for k, _, v in seed}
    asked, graph, score = set(), {}, {}
    for _ in range(rounds):
        new = set()
        for (k, c), values in after.items():
            own = [v for v, may in values.items() if may and (k, v) in known]
            if (k, c) not in asked and len(own) >= least and len(set().union(*(docs[k, c, v] for v in own))) >= least:
                new.add((k, c))
        if not new:
            break
        asked |= new
        for p in new:
            good = sum(after[p].values())
            if good * unit // len(after[p]) >= want:
                graph[p] = len(after[p])
        value = {(k, c, v): unit * ((k, c, v) in seed) for k, c in graph for v, may in after[k, c].items() if may}
        for step in range(rounds + 1):
            score = {p: sum(value[*p, v] for v, may in after[p].items() if may) // n for p, n in graph.items()}
            if step < rounds:
                before = collections.defaultdict(list)
                for k, c, v in value:
                    if (k, c, v) not in seed:
                        before[k, v].append(score[k, c])
                value = {e: unit if e in seed else sum(before[e[0], e[2]]) // len(before[e[0], e[2]]) for e in value}
        known |= {(k, v) for (k, c), x in score.items() if x >= want for v, may in after[k, c].items() if may}
    return {p: score.get(p, 0) / unit for p in asked}


@pytest.mark.parametrize("confidence, held", [(0.8, 200_000), (0.5, 3), (0.0, 200_000)])
def test_scores_equal_brute_force(spark, monkeypatch, confidence, held):
    monkeypatch.setattr(pii, "HELD", held)
    rng = random.Random(5)
    words = ["alpha beta ", "gamma delta ", "omega sigma ", "kappa rho: (", "new form "]
    rows = []
    for d in range(220):
        w = words[rng.randrange(4)]
        kind = rng.choice([0, 0, 1, 1, 2, 2, 3] if w != "omega sigma " else [0, 3, 3])
        v = f"u{rng.randrange(25)}@host.org" if kind < 2 else f"v{rng.randrange(9)}(at)host" if kind == 2 else f"x{d % 5}" if w != "omega sigma " else f"x{d}"
        rows.append((d, f"{w}{v} end\nand {w}{v}"))
    rows += [(300 + i, f"new form v{i}(at)host, other way 555-010-{i:04d} x") for i in range(8)]  # only discovered ones stand here
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.kind, r.pattern): r.score for r in pii.scored_patterns(docs, confidence=confidence).collect()}
    want = learned_by_force(rows, confidence)
    assert got == want and any(p[1].startswith("new") for p in got) == (confidence in (0.5, 0.8, 0.0))


def test_misses_of_many_patterns_are_fewer_than_the_input(spark):
    rng = random.Random(8)
    seeds = [(i, f"w{'abcdefghij'[i % 10]}q zz{'abcdefghij'[i // 10 % 10]}{'abcdefghij'[i // 100 % 10]}{'abcdefghij'[i // 1000]} u{j}@host.org") for i in range(2000) for j in range(3)]
    rows = [(3 * i + j, t.replace("w", "v", 1)) for j, (i, t) in enumerate(seeds)]
    text = [t for _, t in rows]
    noise = [" ".join(f"{t.rsplit(' ', 1)[0]} n{rng.randrange(10**6)}" for t in rng.sample(text, 60)) for _ in range(150)]
    keys = sorted({int(k) for t in text for k in pii.contexts(t)[2].view(np.int64)[-1:]})
    n = len(keys)
    known = pii._Known(np.zeros(n, np.int8), np.array(keys), np.zeros(n, np.int64))
    out = list(pii._misses(type("Shared", (), {"value": known}))(iter([pa.record_batch({"text": pa.array(noise)})])))
    assert n == 2000 and 1000 < sum(b.num_rows for b in out) <= n and sum(b.nbytes for b in out) < sum(map(len, noise))


def test_lower_casing_keeps_places_whatever_stands_around():
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    one = [pii.lower(c) for c in every]
    assert all(len(c) == 1 for c in one) and pii.lower("".join(every)) == "".join(one)
    assert pii.lower("\u039f\u0394\u039f\u03a3 \u03a3") == "".join(map(pii.lower, "\u039f\u0394\u039f\u03a3 \u03a3"))


def test_contexts_are_found_beside_a_capital_dotted_i(spark):
    rows = [(i, f"\u0130stanbul'da bize \u0130leti\u015fim hatt\u0131: +90 (212) 555-01{i:02d} aray\u0131n.") for i in range(20)]
    rows += [(100, "\u0130zmir, \u0130leti\u015fim hatt\u0131: 0212-555-0199")]
    got = by(pii.find(spark.createDataFrame(rows, "doc_id long, text string")))
    a = rows[20][1].index("0212")
    assert got[100].spans == f"phone:{a}:{a + 13}" and got[3].n_phone == 1


# ---------------------------------------------------------------- 4 line dedup


def test_line_dedup(docs, spark):
    want = edge.lines(texts())
    got = line_dedup.dedup_lines(docs).collect()
    assert len(got) == len(edge.rows())
    for r in got:
        assert (r.n_lines, r.n_dropped, r.kept_sha256) == want[r.doc_id], r.doc_id
        assert edge.sha(r.kept) == r.kept_sha256
    assert line_dedup.dedup_lines(edge.empty(spark)).count() == 0


def test_line_dedup_with_full_filters(docs):
    got = by(line_dedup.dedup_lines(docs, with_text=False, bits=8 * line_dedup.BLOCK))
    assert {d: (r.n_lines, r.n_dropped, r.kept_sha256) for d, r in got.items()} == edge.lines(texts())


def test_line_dedup_with_hot_lines(docs, spark):
    got = by(line_dedup.dedup_lines(docs, with_text=False, hot=2))
    assert {d: (r.n_lines, r.n_dropped, r.kept_sha256) for d, r in got.items()} == edge.lines(texts())
    seen = spark.createDataFrame([(k, -k, d) for k, n in ((1, 500), (2, 60), (3, 3)) for d in range(n)], "h1 long, h2 long, doc_id long")
    repeated = seen.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep"))
    want = sorted((k, d) for k, n in ((1, 500), (2, 60), (3, 3)) for d in range(n - 1))
    for broadcast in (10, 1, -1):
        assert sorted((r.h1, r.doc_id) for r in line_dedup.kept_elsewhere(seen, repeated, 10, broadcast).collect()) == want


# ---------------------------------------------------------------- 5 mixing


def _check_mix(got, rows):
    sizes = collections.Counter()
    for _, t, _, s in rows:
        sizes[s] += len(edge.WORDS.findall(t or ""))
    want, taken = edge.targets(sizes), collections.Counter()
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    return {s: abs(taken[s] - want[s]) for s in sizes}


def test_mixing_edges(docs, spark):
    got = mixing.mix(docs).collect()
    assert len(got) == len(edge.rows())
    _check_mix(got, [*edge.TEXTS, edge.TEXTS[0]])
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    assert mixing.mix(edge.empty(spark)).count() == 0


def test_mixing_meets_targets(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.choice([1, 3, 10, 40, 200]), None, rng.choice(["a", "b", "c", "d", None, "hot", "hot", "hot"])) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    off = _check_mix(mixing.mix(df).collect(), rows)
    assert max(off.values()) <= 3
    copies = {r.doc_id: r.copies for r in mixing.mix(df).collect()}
    assert collections.Counter(r.doc_id for r in mixing.resample(df).collect()) == collections.Counter({d: c for d, c in copies.items() if c})


def test_resample_keeps_all_columns(docs):
    out = mixing.resample(docs)
    assert out.columns == docs.columns and out.schema == docs.schema
    assert out.count() == sum(r.copies for r in mixing.mix(docs).collect())


def test_resample_takes_the_same_twins_and_clashing_columns_stay(spark):
    rows = [(1 + i // 8, "a b c", None, "x", i, i, i, i, i, i, i, i) for i in range(16)] + [(50, "w " * 40, None, "y", *[777] * 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _d int, _s int, h int, n int, same int, list int, I int, Copies int")
    out = [sorted(map(tuple, mixing.resample(df.repartition(k)).collect()), key=str) for k in (1, 3, 5)]
    assert out[0] == out[1] == out[2] and all(len(set(r[4:])) == 1 for r in out[0])


def test_balance_solves_the_dual(spark):
    rng = random.Random(4)
    rows = [(s, size, rng.randrange(1, 9)) for s in ("a", "b", None) for size in (1, 5, 30, 200, 1500)]
    sizes = spark.createDataFrame(rows, "source string, size long, n long")
    own = collections.Counter()
    for s, size, n in rows:
        own[s] += size * n
    share = {"a": 1.5, "b": 0.4, None: 2.0}
    goal = spark.createDataFrame([(s, x, share[s] * x) for s, x in own.items()], "source string, source_size long, target double")
    got = {(r.source, r["size"]): r.rate for r in mixing.balance(sizes, goal).collect()}
    z = {size: np.log1p(size) for _, size, _ in rows}
    centre = sum(n * size * z[size] for _, size, n in rows) / sum(own.values())
    for s in own:
        assert sum(got[s, size] * size * n for t, size, n in rows if t == s) == pytest.approx(share[s] * own[s], rel=1e-6)
    assert all(got[None, size] == 2 for size in z)
    logit = {k: np.log(r / (2 - r)) for k, r in got.items() if k[0]}
    slopes = [(logit[s, 1500] - logit[s, x]) / (z[1500] - z[x]) for s in ("a", "b") for x in (1, 5, 30, 200)]
    assert max(slopes) - min(slopes) < 1e-5  # one multiplier of the size for all documents
    moment = sum(got[s, size] * size * n * (z[size] - centre) for s, size, n in rows if s)
    assert moment == pytest.approx(-mixing.RIDGE * sum(own.values()) * slopes[0], rel=1e-3)


# ---------------------------------------------------------------- 6 token output


@pytest.fixture(scope="module")
def tokenizer():
    return queries.tokenizer_path()


def test_token_files(docs, spark, tokenizer):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    rows = sorted(edge.rows(), key=lambda r: r[0])
    got = sorted(token_output.round_trip(docs, tokenizer).collect(), key=lambda r: r.start)
    at = 0
    for r, row in zip(got, rows, strict=True):
        ids = np.array([*t.encode(row[1] or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (row[0], at, len(ids), edge.crc(ids.tobytes()))
        at += len(ids)
    assert token_output.round_trip(edge.empty(spark), tokenizer).count() == 0


def test_pieces_tokenise_as_whole_texts(tokenizer):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    rng = random.Random(4)
    for _ in range(400):
        text = "".join(rng.choice("aZé\u0301Σς '’1\n\t\u00a0\u3000<|endoftext|>日İ") for _ in range(30))
        whole = t.encode(text, add_special_tokens=False).ids
        parts = [i for p in text.replace("\n", " ").split(" ") for i in t.encode(p, add_special_tokens=False).ids]
        assert whole == parts, text


def test_plain_words_take_the_short_way_rightly(tokenizer):
    words = token_output.Words(tokenizer, 2)
    assert words.plain
    rng = random.Random(8)
    some = {"".join(rng.choice("abcxyzABZéÉàßÿÀÖöñ") for _ in range(rng.randrange(1, 14))) + rng.choice(["", "", ".", ",", "?!", "...", "'", "-", "\u0301"]) for _ in range(3000)}
    words.learn(some)
    assert all(words.known[w] == words._whole([w])[0] for w in some)


def test_parts_of_words_go_to_the_tokenizer_once(tokenizer):
    words = token_output.Words(tokenizer, 2)
    asked, fresh = [], words.parts.fresh
    words.parts.fresh = lambda parts: asked.extend(parts.to_pylist()) or fresh(parts)
    texts = [f"{w}{m}\n{w.upper()} {w.title()}{m}{m}" for w in ("alpha", "naïf", "été", "xqzj") for m in ("", ".", "?!", ")")]
    for _ in range(2):
        assert words.rows(pa.array(texts)).to_pylist() == words._whole(texts)
    assert sorted(asked) == sorted({"alpha", "naïf", "été", "xqzj", ".", "..", "?!", "?!?!", ")", "))"})


def test_words_cost_no_call_each(tokenizer):
    some = [f"{''.join(w)}{m}" for w in itertools.product("abcdefgh", repeat=4) for m in ("", ".")]
    batch = pa.record_batch({"doc_id": pa.array([0, 1], pa.int64()), "bucket": pa.array([0, 0], pa.int32()), "text": [" ".join(some), " ".join(some[::-1])]})
    run = token_output._tokenise(tokenizer, 1)
    list(run(iter([batch.slice(0, 0)])))
    calls = collections.Counter()
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    try:
        list(run(iter([batch])))
    finally:
        sys.setprofile(None)
    assert calls["c_call"] + calls["call"] < len(some) / 2


@pytest.mark.parametrize("kept", [0, 3, 40, 600_000])
def test_looked_up_ids_are_those_of_whole_texts(tokenizer, monkeypatch, kept):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_output, "REMEMBERED", kept)
    monkeypatch.setattr(token_output, "LOOKED_UP", 300)
    monkeypatch.setattr(token_output, "TOGETHER", 3)
    monkeypatch.setattr(token_output.Words, "kept", {})
    t = Tokenizer.from_file(tokenizer)
    rng = random.Random(9)
    some = ["The", "the,", "it's", "d'été", "DON'T", "'s", "x'll", "''s", "ab12", "¡Olé!", "Σας", "日本語", "<|endoftext|>", "<|ENDOFTEXT|>", "a\u0301", "I\u0307", "\u00a0", "…", "µm", "a\tb", "\x1c", "</w>", "w</w>", "***", "e" * 70, "Z" * 70 + "?", "日" * 80, ""]
    texts = [None, "", " ", "\n", *(rng.choice(" \n").join(rng.choices(some, k=rng.randrange(1, 12))) for _ in range(200)), *some]
    rows = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "bucket": pa.array([0] * len(texts), pa.int32()), "text": pa.array(texts, pa.string())})
    out = token_output._tokenise(tokenizer, 1)(iter([*rows.to_batches(max_chunksize=37), rows.to_batches()[0].slice(0, 0)]))
    got = {d: x for b in out for d, x in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist(), strict=True)}
    assert got == {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u2").tobytes() for i, x in enumerate(texts)}
    (words,) = token_output.Words.kept.values()
    assert words.plain and all(len(w.encode()) <= token_output.LONGEST for r in (words.words, words.parts) for w in r.words.to_pylist())
    assert len(words.words.words) <= kept and len(words.words.words) == len(words.words.ids) == len(words.words.asked)


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 300_000])
def test_rans_round_trip(n):
    rng = np.random.default_rng(n)
    ids = rng.zipf(1.3, n).clip(1, 40_000).astype(np.uint32)
    seen, counts = np.unique(np.concatenate([ids, [5, 49_407]]), return_counts=True)
    table = token_output.Table(seen, counts)
    block = token_output.encode(table, ids)
    assert (token_output.decode(table, block) == ids).all()
    for a, b in ((0, 5), (n // 2, n // 2 + 7), (max(n - 3, 0), n)):
        assert (token_output.decode(table, block, a, b) == ids[a:b]).all()
    if n:
        bad = bytearray(block)
        bad[len(bad) // 2] ^= 1
        with pytest.raises(ValueError):
            token_output.decode(table, bytes(bad))
    if n == 300_000:
        assert len(block) < 4 * n / 2


# ---------------------------------------------------------------- 7 language ID


def test_language_id(spark, docs):
    small = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = by(language_id.identify(small))
    held = [(r.lang, got[r.doc_id].lang_pred) for r in small.collect() if got[r.doc_id].held_out]
    assert held and sum(a == b for a, b in held) >= 0.95 * len(held)
    assert all(got[d].held_out == (edge.crc(str(d).encode()) % 4 == 2) and 0 <= got[d].score <= 1 for d in got)
    model = language_id.fit(small)
    odd = by(language_id.predict(docs, model))
    assert all(odd[d].lang_pred == "und" for d, t in texts() if not any(c.isalpha() for c in t or "")) and odd[14].lang_pred != "und"
    kept = language_id.accepted(docs, model)
    bits = {d: r.bits_per_byte for d, r in odd.items()}
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == {d for d, t in texts() if any(c.isalpha() for c in t or "") and bits[d] < language_id.PLAIN}
    assert language_id.identify(edge.empty(spark)).count() == 0


def _plain_ppm(training, order):
    """Code lengths by the definition: counts in dictionaries, escape method C, exclusion by renormalising the lower order."""
    counts = [collections.defaultdict(collections.Counter) for _ in range(order + 1)]
    lowered = lambda t: re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode())
    for text in training:
        b = b" " * order + lowered(text)
        for i in range(order, len(b)):
            for k in range(order + 1):
                counts[k][b[i - k : i]][b[i]] += 1

    def p(context, c):
        k = len(context)
        seen = counts[k].get(context)
        below = (lambda x: p(context[1:], x)) if k else (lambda x: 1 / 256)
        if not seen:
            return below(c)
        rest = 1 - sum(below(x) for x in seen)
        total, kinds = sum(seen.values()), len(seen)
        if rest <= 1e-9:
            return seen[c] / total
        return seen[c] / (total + kinds) if c in seen else kinds / (total + kinds) / rest * below(c)

    def bits(text):
        b = b" " * order + lowered(text)
        return sum(-np.log2(p(b[i - order : i], b[i])) for i in range(order, len(b)))

    return p, bits


TRAINING = {
    "de": ["Der Fluss ist breit und der Wald ist still", "das Wasser ist kalt"], "en": ["The river is wide and the forest is still", "the water is cold " * 3],
    "ru": ["\u0440\u0435\u043a\u0430 \u0448\u0438\u0440\u043e\u043a\u0430 \u0438 \u043b\u0435\u0441 \u0442\u0438\u0445", "\u0432\u043e\u0434\u0430"], "zh": ["\u6cb3\u5f88\u5bbd\u68ee\u6797\u5f88\u5b89\u9759", "\u6c34\u5f88\u51b7"],
}


@pytest.mark.parametrize("order", [2, 4])
def test_code_lengths_equal_a_plain_coder(spark, order):
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang, ts in TRAINING.items() for t in ts)]
    rows = [(d, t, lang) for d, (_, t, lang) in zip((d for d in range(99) if edge.crc(str(d).encode()) % 4 != 2), rows)]  # none is held out
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), order=order)
    asked = ["der Fluss", "the cold", "", "x", "\u0440\u0435\u043a\u0430 \u0438 \u0434\u043e\u043c", "\u68ee\u6797 \u6c34 42", "A" * 300, "\x00\u00ff the"]
    got = np.concatenate([model.code_lengths(raw, off) for _, _, raw, off in chunks(pa.array(asked))], axis=1)
    for k, lang in enumerate(model.langs):
        p, bits = _plain_ppm(TRAINING[lang], order)
        assert sum(p(b"the " [-order:], c) for c in range(256)) == pytest.approx(1)
        assert got[k] == pytest.approx([bits(t) for t in asked], rel=1e-5)


def test_trees_are_proper_codes():
    tree = language_id._Tree(2, [(np.array([97, 98]), np.array([3, 1])), (np.array([97 << 8 | 97, 97 << 8 | 98]), np.array([2, 1])), (np.array([(97 << 8 | 97) << 8 | 98]), np.array([1]))])
    for context in (0, 97, 98, 97 << 8 | 97):
        assert tree.probability(2, (context << 8) + np.arange(256)).sum() == pytest.approx(1)


def test_code_lengths_do_not_depend_on_other_languages(spark, monkeypatch):
    rng = random.Random(9)
    ids = (d for d in range(10**6) if edge.crc(str(d).encode()) % 4 != 2)
    rows = [(next(ids), t, lang) for lang, ts in TRAINING.items() for t in ts]
    more = [(next(ids), " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(300)), f"other{i}") for i in range(56)]
    few, many = (language_id.fit(spark.createDataFrame(x, "doc_id long, text string, lang string")) for x in (rows, rows + more))
    asked = ["der Fluss und the water", "", *TRAINING["zh"], "ABC " * 200]
    bits = lambda m: np.concatenate([m.code_lengths(raw, off) for _, _, raw, off in chunks(pa.array(asked))], axis=1)
    whole, own = bits(many), bits(few)
    assert len(many.langs) == 60 and (whole[[many.langs.index(x) for x in few.langs]] == own).all()
    monkeypatch.setattr(language_id, "PLACES", 7)  # in pieces that end inside texts
    assert bits(few) == pytest.approx(own)


def test_the_sample_of_labelled_rows_is_bounded(spark):
    rows = [(d, f"word{d} " * 50, "en") for d in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    n = lambda m: m.trees[0].contexts[0][1].size and int(m.trees[0].seen[4][0].keys.size)
    assert n(language_id.fit(docs, train_bytes=4000)) < n(language_id.fit(docs, train_docs=60)) < n(language_id.fit(docs))


def test_numbers_are_found_in_an_index():
    keys = np.unique(np.random.default_rng(2).integers(0, 1 << 40, 5000))
    index = language_id._Index(keys)
    assert (index.find(keys) == np.arange(len(keys))).all() and (index.find(keys + 1) == np.where(np.isin(keys + 1, keys), np.searchsorted(keys, keys + 1), -1)).all()
    assert language_id._Index(keys[:0]).find(keys[:2]).tolist() == [-1, -1]


def test_texts_that_no_tree_shortens_are_not_accepted(spark):
    rows = [(d, t * 20, "en") for d, t in enumerate(TRAINING["en"] * 9)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = spark.createDataFrame([(1, "the forest and the water"), (2, "\u6cb3\u5f88\u5bbd\u68ee\u6797\u5f88\u5b89\u9759"), (3, "12 34"), (4, None)], "doc_id long, text string")
    assert [r.doc_id for r in language_id.accepted(asked, model).collect()] == [1]


def test_languages_that_differ_in_rare_bytes_are_told_apart(spark):
    rng = random.Random(5)
    ascii_ = "".join(chr(c) for c in range(33, 127))
    many = "".join(chr(c) for c in range(0x400, 0x460)) + "".join(chr(c) for c in range(0xC0, 0x100))
    word = lambda letters: "".join(rng.choice(letters) for _ in range(5))
    rows = [(i, " ".join(word(ascii_ + many) for _ in range(600)), "big") for i in range(80)]
    rare = {"x": "\u0e01\u0e02\u0e03\u0e04", "y": "\u1e01\u1e02\u1e03\u1e04"}  # lead bytes e0 and e1, the rest alike
    rows += [(1000 + 100 * k + i, " ".join(word(letters) for _ in range(4)), lang) for k, (lang, letters) in enumerate(rare.items()) for i in range(20)]
    got = by(language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert all(got[d].lang_pred == lang for d, _, lang in rows)


# ---------------------------------------------------------------- 8 chat formatting


def test_chat_round_trip(spark):
    rows = [(1, 1, "assistant", "a\\n<|im_end|>\n\\"), (1, 0, "us\ner<|", None), (2, 0, "assistant", ""), (-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok"), (3, 0, "system", "x" * 100_000), (3, 0, "system", "x" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = by(chat.digest(chat.format_turns(df)), "conv_id")
    for c in {r[0] for r in rows}:
        turns = [(r[2], r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=lambda r: r[1])]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert got[c].n_turns == len(turns) and got[c].turns_sha256 == edge.sha("".join(f"{a}\n{b}\n" for a, b in turns))
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == edge.sha(loss)
    assert chat.digest(chat.format_turns(df.limit(0))).count() == 0
    whole = "".join(r.formatted for r in chat.format_turns(df.where("conv_id = -1")).orderBy("turn").collect())
    assert [(a, b) for a, b, _, _ in chat.parse(whole)] == [("user", rows[3][3]), ("assistant", rows[4][3])]


def test_chat_escapes_are_reversible():
    rng = random.Random(0)
    for _ in range(2000):
        t = "".join(rng.choice("\\<|>n\nx") for _ in range(12))
        e = chat.escape(t)
        assert chat.unescape(e) == t and chat.END not in e and chat.START not in e
        r = chat.escape_role(t)
        assert "\n" not in r and chat.unescape(r) == t


def test_chat_parts(spark):
    parts = [{"type": "text", "text": "see <|image:9|>"}, {"type": "image", "ref": "a.png", "width": 28, "height": 15}, {"type": "audio", "ref": "b.wav", "seconds": 2.1}, {"type": "document", "ref": "c.pdf", "pages": 3}]
    df = spark.createDataFrame([(1, 0, "user", None, json.dumps(parts))], "conv_id long, turn long, role string, text string, parts string")
    r = chat.format_turns(df).first()
    att = json.loads(r.attachments)
    assert [a["ref"] for a in att] == ["a.png", "b.wav", "c.pdf"] and [a["tokens"] for a in att] == [4, 53, 1536] and r.expanded_tokens == 1593
    assert "<|image:0|><|audio:1|><|document:2|>" in r.formatted and "<|image:9|>" not in r.formatted
    with pytest.raises(ValueError):
        chat.PartVisitor().flatten([{"type": "video"}])


# ---------------------------------------------------------------- 9 decontamination

ITEMS = [("7", " ".join(edge.LONG.split()[300:330])), ("8", "one two THREE"), ("9", None), ("10", " ".join(edge.BASE.split()[3:13])), (None, "éàü ñandú straße éàü ñandú straße éàü ñandú straße éàü"), ("11", " ".join(edge.BASE.split()[5:9] + ["zzz"] * 8))]


@pytest.mark.parametrize("block", [10**9, 8])
def test_decontamination(spark, docs, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", block)
    bench = spark.createDataFrame(ITEMS, "item_id string, text string")
    want = edge.windows(texts(), ITEMS)
    got = decontamination.find(docs, bench).collect()
    assert len(got) == len(edge.rows())
    for r in got:
        n, hit, names = want[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(names), edge.sha(",".join(names)), hit > 0), r.doc_id
    kept = decontamination.clean(docs, bench)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == {d for d in want if not want[d][1]}
    assert decontamination.find(edge.empty(spark), bench).count() == 0
    assert not any(r.contaminated for r in decontamination.find(docs, bench.limit(0)).collect())


def test_winnowing_misses_no_window():
    rng = random.Random(6)
    for _ in range(200):
        item = [rng.choice("abc") for _ in range(12)]
        text = [rng.choice("abcd") for _ in range(30)] + item[:10] + [rng.choice("abcd") for _ in range(rng.randrange(9))]
        bench = decontamination.Benchmark([("i", " ".join(item))])
        for _, _, raw, off in chunks(pa.array([" ".join(text)])):
            h, first = decontamination._hashed(raw, off)
            assert any(set(range(30, 40)) <= {k for a, b in r for k in range(a, b)} for _, r, _ in decontamination._hits(bench, h, first))


# ---------------------------------------------------------------- 10 fingerprints


def test_fingerprints(docs, spark):
    got = fingerprints.neighbours(docs, buckets=64).collect()
    rows = [(d, t or "") for d, t, *_ in edge.rows()]
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: -r[0])
    follow = {}
    for i, (d, t) in enumerate(order):
        follow.setdefault(d, set()).add((t, order[(i + 1) % len(order)][1]))
    seen = {}
    for r in got:
        ok = False
        for t, nxt in follow[r.doc_id]:
            half = len(t) // 2
            edited = t[: len(t) - half] + nxt[:half]
            if r.n_chars == len(t) and r.edited_sha256 == edge.sha(edited):
                ok = True
                a, b, c = (edge.shingles(x, lower=False) for x in (t, edited, nxt))
                for s, est in ((b, r.near_edited), (c, r.near_next)):
                    true = len(a & s) / len(a | s) if a | s else 1.0
                    assert abs(true - est) < (0.2 if len(a | s) > 128 else 1e-9)
        assert ok, r.doc_id
        t = dict(rows)[r.doc_id]
        assert seen.setdefault(t, r.fingerprint) == r.fingerprint
        assert len(a) == pytest.approx(r.distinct_shingles, rel=0.4) if len(a) > 127 else r.distinct_shingles == len(a)
    assert fingerprints.neighbours(edge.empty(spark)).count() == 0
    one = fingerprints.neighbours(docs.where("doc_id = 6")).first()
    assert one.near_next == 1.0


def test_sketches_merge(spark):
    a, b = " ".join(f"a{i}" for i in range(900)), " ".join(f"a{i}" for i in range(600, 1500))
    r = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprints.sketch(F.col("a")).alias("a"), fingerprints.sketch(F.col("b")).alias("b"))
    r = r.select(fingerprints.distinct_shingles(fingerprints.merge(F.col("a"), F.col("b"))).alias("n"), fingerprints.containment(F.col("a"), F.col("b")).alias("c"), F.size("a").alias("k"), (fingerprints.from_text(fingerprints.as_text(F.col("a"))) == F.col("a")).alias("same")).first()
    assert r.n == pytest.approx(1496, rel=0.3) and r.c == pytest.approx(0.33, abs=0.15) and r.k == 128 and r.same


# ---------------------------------------------------------------- registration


def test_all_queries_are_there():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries()) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.queries().keys() - queries.ORACLE.keys()))
def test_query_runs_over_all_documents(spark, name):
    ids = sorted(r.doc_id for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id").collect())
    assert sorted(r.doc_id for r in queries.queries()[name](spark, SMALL).collect()) == ids


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    want = con.execute(queries.ORACLE[name])
    columns = [d[0] for d in want.description]
    df = queries.queries()[name](spark, SMALL)
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(str, ([r[c] for c in columns] for r in df.collect()))) == sorted(str(list(r)) for r in want.fetchall())
