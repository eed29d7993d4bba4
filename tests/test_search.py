import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspark.operators import grid, hnsw, ivf, nf4, pq, quality, rq, scalar, search
from vecspark.schema import EMBEDDING, dimension, from_arrays, stats, toy_dataset, validate_dims


def table(spark, rows):
    return spark.createDataFrame([(i, n, v) for i, (n, v) in enumerate(rows)], EMBEDDING)


def ask(spark, *vectors):
    return spark.createDataFrame([(f"q{i}", v) for i, v in enumerate(vectors)], "qid string, vector array<float>")


def got(rows):
    out = {}
    for r in sorted(rows.collect(), key=lambda r: (r.qid, r.rn)):
        out.setdefault(r.qid, []).append((r.id, round(r.score, 5)))
    return out


def units(n, d, seed=0):
    v = np.random.default_rng(seed).standard_normal((n, d))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def modular(n, d):
    i, k = np.indices((n, d))
    return ((17 * i + 11 * k) % 97 + 0.5) / 97.5


def exact(v, q, k):
    u, w = v / np.linalg.norm(v, axis=1, keepdims=True), q / np.linalg.norm(q)
    return np.lexsort((np.arange(len(v)), -(u @ w)))[:k]


def test_toy_search(spark):
    assert got(search.batch_top_k(toy_dataset(spark), ask(spark, [1.0, 0.0]), 1)) == {"q0": [("one", 1.0)]}


@pytest.mark.parametrize("naive", [True, False])
def test_both_paths_agree_with_numpy(spark, naive):
    v = units(700, 24).astype(np.float32)
    df = from_arrays(spark, v).repartition(5)
    q = ask(spark, *[[float(x) for x in v[i]] for i in (0, 5, 9)])
    a, b = got(search.batch_top_k(df, q, 7, naive=naive)), got(search.batch_top_k_sql(df, q, 7))
    assert a == b
    for name, i in (("q0", 0), ("q1", 5), ("q2", 9)):
        assert [x[0] for x in a[name]] == [f"vec_{j}" for j in exact(v.astype(float), v[i].astype(float), 7)]


def test_ties_keep_input_order(spark):
    df = table(spark, [(f"r{i}", [1.0, float(i % 2)]) for i in range(40)]).repartition(7)
    assert [x[0] for x in got(search.batch_top_k(df, ask(spark, [1.0, 0.0]), 5))["q0"]] == ["r0", "r2", "r4", "r6", "r8"]


def test_edges(spark):
    df = table(spark, [("zero", [0.0, 0.0]), ("x", [1.0, 2.0])])
    q = ask(spark, [1.0, 0.0], [0.0, 0.0], [1.0, 2.0, 3.0])
    assert got(search.batch_top_k(df, q, 2)) == {"q0": [("x", 0.44721), ("zero", 0.0)]}
    assert got(search.batch_top_k(df, q, 2, naive=True)) == {"q0": [("x", 0.44721), ("zero", -1.0)], "q1": [("zero", -1.0), ("x", -1.0)], "q2": [("zero", -1.0), ("x", -1.0)]}
    assert got(search.batch_top_k(df, q, 0)) == {}
    assert search.top_k(df, [1.0, 0.0], 0).count() == 0 and search.top_k(df, [1.0, 0.0, 0.0], 2, naive=False).count() == 0
    assert [r.id for r in search.top_k(df, [1.0, 0.0], 1).collect()] == ["x"]


@pytest.mark.parametrize("block, column", [(2, 1), (2, 2), (4, 8), (100, 1)])
def test_blocks_and_columns_change_nothing(spark, block, column):
    df = from_arrays(spark, units(60, 8)).repartition(5)
    q = ask(spark, *units(9, 8, 1).tolist(), [0.0] * 8, [1.0]).repartition(3)
    whole = got(search.batch_top_k(df, q, 3))
    assert len(whole) == 9 and got(search.batch_top_k(df, q, 3, block=block, column=column)) == whole


def test_a_column_scans_the_corpus_once(spark):
    """Blocks have at most their size, hold every query once, and a column's plan reads the corpus in one scan without a shuffle of it."""
    q = ask(spark, *units(50, 4).tolist()).repartition(7)
    columns = grid.deal(q, 4, 5)
    blocks = [grid.block_of(f) for files in columns for f in files]
    assert all(len(files) <= 5 for files in columns) and all(len(names) <= 4 for names, _ in blocks)
    assert sorted(n for names, _ in blocks for n in names) == sorted(f"q{i}" for i in range(50))
    df = from_arrays(spark, units(60, 4))
    plan = search.batch_top_k(df, q, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan and "Union" not in plan


def test_small_blocks_share_a_scan(spark, monkeypatch):
    q = ask(spark, *units(50, 4).tolist()).repartition(7)
    df = from_arrays(spark, units(60, 4))
    whole = got(search.batch_top_k(df, q, 3))
    few = search.batch_top_k(df, q, 3, block=4, column=2)
    assert few._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1 and got(few) == whole
    files = [f for column in grid.deal(q, 4, 100) for f in column]
    assert len(files) > 12 and [len(names) for names, _ in grid.joined(files)] == [50]
    monkeypatch.setattr(grid, "QUERY_BLOCK", 8)
    monkeypatch.setattr(grid, "COLUMN", 2)
    assert all(len(names) <= 8 for names, _ in grid.joined(files)) and sum(len(names) for names, _ in grid.joined(files)) == 50
    several = search.batch_top_k(df, q, 3, block=4, column=2)
    assert "MapInArrow" not in several._jdf.queryExecution().optimizedPlan().toString() and got(several) == whole


def test_heaps_against_a_full_sort():
    """Batches in any order, ties, rows without a score and fewer rows than k."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    for k in (1, 3, 50):
        scores = rng.integers(0, 6, (40, 5)) / 4
        scores[rng.random((40, 5)) < 0.2] = np.nan
        ords = rng.permutation(40)
        heaps = grid.Heaps([f"q{i}" for i in range(5)], k)
        for lo in range(0, 40, 7):
            heaps.add(ords[lo : lo + 7], pa.array([f"r{o}" for o in ords[lo : lo + 7]]), scores[lo : lo + 7])
        want = [(f"q{j}", o, s) for j in range(5) for s, o in sorted(((s, o) for s, o in zip(scores[:, j], ords) if not np.isnan(s)), key=lambda x: (-x[0], x[1]))[:k]]
        rows = heaps.rows(0).to_pylist()
        assert [(r["qid"], r["ord"], r["score"]) for r in rows] == want and all(r["id"] == f"r{r['ord']}" for r in rows)


@pytest.mark.parametrize("naive", [True, False])
def test_totals_are_those_of_all_rows_ranked(spark, naive):
    df = table(spark, [(f"r{i}", v) for i, v in enumerate([*units(90, 6).tolist(), [0.0] * 6, [1.0] * 4, None, [float("nan")] * 6])]).repartition(5)
    q = ask(spark, *units(9, 6, 1).tolist(), [0.0] * 6, [1.0], (-units(1, 6)[0]).tolist()).repartition(3)
    rows = search.batch_top_k(df, q, 1000, naive=naive, dim=6)
    want = sorted(rows.groupBy("qid").agg(F.round(F.max("score"), 9), F.count("*"), F.count_if(F.col("score") == -1)).collect())
    for block, column in ((None, None), (4, 1)):
        found = search.batch_totals(df, q, naive, 6, block, column).select("qid", F.round("best", 9), "n", "least")
        assert sorted(found.collect()) == want and len(want) == (12 if naive else 10)
    assert search.batch_totals(df, q.limit(0), naive, 6).count() == 0


def test_full_heaps_are_handed_on(spark):
    """The rows of a task that holds few: those of one that holds all, each once."""
    v = units(50, 4)
    columns = grid.deal(ask(spark, *units(3, 4, 1).tolist()))

    class Few(grid.Heaps):
        most = 0

        def full(self):
            Few.most = max(Few.most, len(self.held[0]))
            return len(self.held[0]) > 60

    import pyarrow as pa
    import pyspark

    batches = [pa.record_batch({"ord": pa.array(range(lo, lo + 10)), "id": pa.array([f"r{i}" for i in range(lo, lo + 10)]), "vector": pa.array(v[lo : lo + 10].tolist())}) for lo in range(0, 50, 10)]
    scorer = lambda vectors: (list(range(len(vectors))), lambda b: search.matrix(b.column("vector")) @ np.array(vectors).T)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(pyspark.TaskContext, "get", classmethod(lambda cls: type("Task", (), {"partitionId": lambda self: 0})()))
        left = list(grid.task_rows(columns[0], lambda qids: Few(qids, 50), scorer)(iter(batches)))
        whole = list(grid.task_top_k(columns[0], 50, scorer)(iter(batches)))
    key = lambda batches: sorted((r["qid"], r["ord"], r["id"], r["score"]) for b in batches for r in b.to_pylist())
    assert len(left) > 1 and Few.most <= 90 and key(left) == key(whole) and len(key(whole)) == 150


def test_repeated_null_and_no_queries(spark):
    df = from_arrays(spark, units(30, 4)).repartition(3)
    v = [float(x) for x in units(1, 4, 3)[0]]
    q = spark.createDataFrame([("a", v), ("a", v), ("b", None), (None, v)], "qid string, vector array<float>")
    rows = search.batch_top_k(df, q, 2).collect()
    assert {r.qid for r in rows} == {"a", None} and search.batch_top_k(df, q.limit(0), 2).count() == 0
    assert got(search.batch_top_k(df.limit(0), q, 2, dim=4)) == {}


def test_the_relational_form_refuses_many_queries(spark, monkeypatch):
    df = from_arrays(spark, units(10, 4))
    monkeypatch.setattr(search, "RELATIONAL", 9)
    with pytest.raises(ValueError, match="more than 9"):
        search.batch_top_k_sql(df, df.select(F.col("id").alias("qid"), "vector"), 2)


def test_the_relational_query_takes_any_number(spark, monkeypatch, tmp_path):
    from vecspark.plans import catalogue

    v = units(600, 8).astype(np.float32)
    spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    whole = sorted(catalogue.topk_batch_exact(spark, str(tmp_path)).collect())
    monkeypatch.setattr(search, "RELATIONAL", 5)
    assert len(whole) == 120 and sorted(catalogue.topk_batch_relational(spark, str(tmp_path)).collect()) == whole


def test_the_relational_form_on_odd_rows(spark):
    """Equal rows, zero, null and other lengths, NaN; queries that are so; fewer rows than k."""
    rows = [(f"r{i}", [1.0, float(i % 2)]) for i in range(80)] + [("zero", [0.0, 0.0]), ("null", None), ("long", [1.0, 2.0, 3.0]), ("nan", [float("nan"), 1.0])]
    df = table(spark, rows).repartition(7)
    q = ask(spark, [1.0, 0.0], [0.0, 0.0], [1.0, 2.0, 3.0], [-1.0, -1.0], [], None)
    for k in (3, 500):
        want = {n: x for n, x in got(search.batch_top_k(df, q, k, naive=True)).items()}
        assert got(search.batch_top_k_relational(df, q, k)) == want == got(search.batch_top_k_sql(df, q, k))
    assert search.batch_top_k_relational(df, q, 0).count() == 0 and search.batch_top_k_relational(df, q.limit(0), 3).count() == 0
    assert search.batch_top_k_relational(df.limit(0), q, 3).count() == 0


def test_scalar_codec(spark):
    v = units(200, 16).astype(np.float32)
    df = from_arrays(spark, v)
    ranges = scalar.fit_arrays(df)
    assert np.allclose(ranges[0], v.min(0)) and np.allclose(ranges[1], v.max(0))
    codes = scalar.encode(df, ranges)
    back = np.array([r.vector for r in scalar.decode(codes, ranges).orderBy("ord").collect()])
    assert np.abs(back - v).max() <= ((ranges[1] - ranges[0]) / 510 + 1e-6).max()
    a = {r.ord: bytes(r.qvec) for r in scalar.to_bytes(codes).collect()}
    assert a == {r.ord: bytes(r.qvec) for r in scalar.encode_bytes(df, ranges).collect()}
    assert sorted(map(str, scalar.from_bytes(scalar.to_bytes(codes)).collect())) == sorted(map(str, codes.collect()))


def test_scalar_zero_rows(spark):
    df = table(spark, [("zero", [0.0, 0.0]), ("x", [1.0, 2.0])])
    ranges = scalar.fit_arrays(df)
    codes = scalar.encode(df, ranges)
    q = ask(spark, [1.0, 0.0], [0.0, 0.0], [1.0])
    assert got(scalar.batch_top_k(codes, ranges, q, 2))["q0"][1] == ("zero", -1.0)
    assert got(scalar.batch_top_k(codes, ranges, q, 2, cached=True))["q0"][1] == ("zero", 0.0)
    assert set(got(scalar.batch_top_k(codes, ranges, q, 2))) == {"q0"}


@pytest.mark.parametrize("d", [7, 64, 768])
def test_nf4(spark, d):
    v = np.concatenate([units(60, d), np.zeros((1, d))]).astype(np.float32)
    df = from_arrays(spark, v)
    a = {r.ord: (r.dim, r.scale, bytes(r.packed)) for r in nf4.pack(nf4.encode(df)).collect()}
    assert a == {r.ord: (r.dim, r.scale, bytes(r.packed)) for r in nf4.encode_packed(df).collect()}
    back = np.array([r.vector for r in nf4.decode(nf4.unpack(nf4.encode_packed(df))).orderBy("ord").collect()])
    assert (back[60] == 0).all()
    if d > 7:
        assert nf4.mean_cosine(df.where("ord < 60")).first().mean_cosine >= 0.98
    if d >= 512:
        assert nf4.compression_ratio(d) >= 7.5


def kmeans_reference(x, first, iterations, spherical, spare):
    c, before = first.copy(), np.zeros(len(x), int) if spherical else np.full(len(x), -1)
    for _ in range(iterations):
        now = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)
        if (now == before).all():
            break
        before = now
        for k in range(len(c)):
            own = x[now == k]
            if len(own):
                m = own.mean(0)
                n = np.linalg.norm(m)
                c[k] = m / n if spherical and n > 1e-12 else m
            elif spherical:
                c[k] = spare[k]
    return c


def test_pq_training_does_not_depend_on_the_partitioning(spark):
    df = from_arrays(spark, units(200, 8, 6))
    books = [pq.train(df.repartition(k), 2, 16, 8).books for k in (1, 5)]
    assert np.array_equal(books[0], books[1])


def test_pq_training_follows_lloyd(spark):
    v = units(150, 8, 4)
    model = pq.train(from_arrays(spark, v).repartition(4), 2, 6, 12)
    v = np.array([np.float32(x) for x in v], np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    for s in range(2):
        x = v[:, 4 * s : 4 * s + 4]
        want = kmeans_reference(x, x[[i * 150 // 6 for i in range(6)]], 12, True, x[:6])
        assert np.allclose(model.books[s], want, atol=1e-6)


def test_rq_training_follows_lloyd(spark):
    v = units(150, 8, 5).astype(np.float32).astype(np.float64)
    model = rq.train(from_arrays(spark, v).repartition(4), 1, 2, 6, 9)
    for s in range(2):
        x = v[:, 4 * s : 4 * s + 4]
        assert np.allclose(model.books[0][s], kmeans_reference(x, x[:6], 9, False, None), atol=1e-6)


def test_pq_gates(spark):
    v = modular(2000, 64)
    df = from_arrays(spark, v).repartition(4).persist()
    model = pq.train(df, 8, 256, 30)
    codes = model.encode(df)
    q = ask(spark, *v[:30].tolist())
    truth = search.batch_top_k(df, q, 10)
    assert quality.mean_recall(truth, model.batch_top_k(codes, q, 10), 10).first().recall >= 0.9
    assert model.compression_ratio() == 32.0 and pq.ProductQuantizer(np.zeros((8, 1, 16)), 128).compression_ratio() >= 16
    with pytest.raises(ValueError):
        pq.train(df, 7, 16, 1)
    with pytest.raises(ValueError):
        pq.train(df, 8, 257, 1)
    with pytest.raises(ValueError):
        pq.train(df.limit(0), 8, 16, 1)
    zero = got(model.batch_top_k(codes, ask(spark, [0.0] * 64), 2))
    assert zero == {"q0": [("vec_0", 0.0), ("vec_1", 0.0)]}


def test_reranking_keeps_up_with_the_table(spark):
    """A coarse codebook: of the 10 * k rows that lookup puts first many nearest ones are missing."""
    df = from_arrays(spark, units(6000, 32, 7)).repartition(3).persist()
    model = pq.train(df, 4, 16, 3)
    codes, q = model.encode(df).persist(), ask(spark, *units(50, 32, 8).tolist(), [0.0] * 32, [1.0])
    truth, found = search.batch_top_k(df, q, 5), pq.rerank_top_k(model, codes, df, q, 5, 10)
    assert quality.mean_recall(truth, found, 5).first().recall >= 0.95
    a, b = got(truth), got(found)
    assert set(b) == {*a, "q50"} and [i for i, _ in b["q50"]] == [f"vec_{i}" for i in range(5)]
    exact_scores = {(r.qid, r.id): r.score for r in search.batch_top_k(df, q, 6000).collect()}
    assert all(abs(exact_scores[n, i] - s) < 1e-5 for n, x in b.items() if n != "q50" for i, s in x)
    assert got(pq.rerank_top_k(model, codes, df, q.limit(50), 6000)) == got(search.batch_top_k(df, q.limit(50), 6000)) and pq.rerank_top_k(model, codes, df, q, 0).count() == 0


def test_rq_gates(spark):
    i, k = np.indices((100, 128))
    v = np.random.default_rng(7).standard_normal((100, 128)) * 0.2 - 0.5
    df = from_arrays(spark, v)
    model = rq.train(df, 3, 8, 64, 15)
    assert model.mean_cosine(df).first().mean_cosine >= 0.75
    two = rq.ResidualQuantizer(model.books[:2], 8, 128, 128)
    assert two.compression_ratio() >= 30
    odd = from_arrays(spark, v[:40, :13])
    small = rq.train(odd, 2, 8, 16, 3)
    assert small.dim == 16
    back = small.decode(small.encode(odd))
    assert len(back.first().vector) == 13 and len(small.decode(small.encode(odd), trim=False).first().vector) == 16


def test_hnsw_recall_and_edges(spark, tmp_path):
    v = units(1000, 64, 3)
    df = from_arrays(spark, v).persist()
    q = ask(spark, *units(40, 64, 9).tolist())
    truth = search.batch_top_k(df, q, 10)
    for shards in (1, 3):
        index = hnsw.build(df, shards)
        hnsw.save(index, str(tmp_path / f"i{shards}"))
        index = hnsw.load(spark, str(tmp_path / f"i{shards}"))
        assert quality.mean_recall(truth, hnsw.batch_top_k(index, q, 10), 10).first().recall >= 0.95
    low = quality.mean_recall(truth, hnsw.batch_top_k(index, q, 10, 10), 10).first().recall
    assert low <= quality.mean_recall(truth, hnsw.batch_top_k(index, q, 10, 200), 10).first().recall + 1e-9
    g = hnsw.Graph().build(np.array([[0, 1], [1, 0], [0, -1], [-1, 0]], float))
    assert g.search(np.array([1, 0.1]), 1, 10)[0][1] == 1 and g.search(np.array([0.1, 1]), 1, 10)[0][1] == 0
    assert g.search(np.zeros(2), 1, 10) == [] and g.search(np.ones(2), 0, 10) == [] and hnsw.Graph().search(np.ones(2), 1, 5) == []
    assert all(len(e[0]) <= 32 for e in hnsw.Graph().build(units(200, 8)).edges)
    with pytest.raises(ValueError):
        hnsw.Graph(m=1)


def test_graph_search_reaches_every_region():
    """Rows in groups that few edges leave: from one start a beam ends in the wrong group."""
    rng = np.random.default_rng(8)
    for n, groups in ((600, 4), (2500, 12)):
        v = np.eye(24)[np.arange(n) % groups] + 0.1 * rng.standard_normal((n, 24))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        g = hnsw.Graph().build(v)
        assert all(g.search(x, 1, 50)[0][1] == i for i, x in enumerate(v[:240]))


def test_the_beam_widens_with_the_shard(spark):
    df = from_arrays(spark, units(12000, 64, 5))
    q = ask(spark, *units(60, 64, 6).tolist())
    recall = quality.mean_recall(search.batch_top_k(df, q, 10), hnsw.batch_top_k(hnsw.build(df, 1), q, 10), 10).first().recall
    assert recall >= 0.93


def test_blocks_of_a_shard_follow_its_size(monkeypatch):
    v = units(300, 6)
    whole = hnsw.linked(v, 8)
    monkeypatch.setattr(hnsw, "SCORES", 500)
    monkeypatch.setattr(hnsw, "BLOCK", 100)
    assert [x.tolist() for x in hnsw.linked(v, 8)] == [x.tolist() for x in whole]


def test_ivf(spark, tmp_path):
    v = units(600, 16, 2)
    df = from_arrays(spark, v).persist()
    q = ask(spark, *v[:20].tolist())
    index = ivf.build(df, 12, 5)
    truth = search.batch_top_k(df, q, 10)
    assert quality.mean_recall(truth, index.batch_top_k(q, 10, 12), 10).first().recall == 1.0
    index.save(str(tmp_path / "ivf"))
    assert quality.mean_recall(truth, ivf.load(spark, str(tmp_path / "ivf")).batch_top_k(q, 10, 8), 10).first().recall >= 0.8


def test_recall_edges(spark):
    e = spark.createDataFrame([("q", i, c) for i, c in enumerate("abcde", 1)], "qid string, rn int, id string")
    a = spark.createDataFrame([("q", i, c) for i, c in enumerate("aacef", 1)], "qid string, rn int, id string")
    assert quality.recall_at_k(e, a, 5).first().recall == pytest.approx(0.8)
    assert quality.recall_at_k(e, a, 0).first().recall == 0.0
    assert quality.recall_at_k(e, a.limit(0), 5).first().recall == 0.0


def test_auto_select(spark):
    df = from_arrays(spark, units(300, 16))
    assert quality.auto_select(df.limit(0)).format == "stream"
    assert quality.auto_select(df, 0.9, 3.0).format == "nf4"
    assert quality.auto_select(df, 0.99, 1000.0).format == "scalar"
    c = quality.auto_select(df, 1.1, 8.0)
    assert c.format in ("rq", "pq") and c.ratio >= 8.0


def test_registered_auto_select_judges_all_rows(spark, tmp_path):
    from vecspark.plans import catalogue

    rng = np.random.default_rng(4)
    v = np.concatenate([np.tile([1.0, -1.0], (1000, 4)), rng.normal(size=(600, 8)) ** 5])
    spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    df = catalogue.corpus(spark, str(tmp_path))
    got = catalogue.auto_select(spark, str(tmp_path)).first()
    whole, first = quality.auto_select(df, max_sample=1600), quality.auto_select(df)
    assert got.format == whole.format and got.cosine == pytest.approx(whole.cosine, abs=1e-9) and abs(first.cosine - whole.cosine) > 1e-3


def test_schema_checks(spark):
    with pytest.raises(ValueError):
        validate_dims(table(spark, [("a", [1.0, 0.0]), ("b", [0.0, 1.0, 2.0])]))
    with pytest.raises(ValueError):
        validate_dims(toy_dataset(spark).limit(0))
    with pytest.raises(ValueError):
        validate_dims(table(spark, [("a", [float("nan")])]))
    assert validate_dims(toy_dataset(spark)) == 2 and dimension(table(spark, [("e", []), ("a", [1.0])])) == 1
    assert stats(toy_dataset(spark)).first()["count"] == 3
    with pytest.raises(ValueError):
        from_arrays(spark, [])


def test_quality_report(spark):
    df = from_arrays(spark, units(100, 32))
    ranges = scalar.fit_arrays(df)
    r = quality.quality_report(df, scalar.encode(df, ranges), ranges, 50).first()
    assert r.samples_analyzed == 50 and r.quality_grade == "A+" and r.compression_ratio == 4.0 and r.memory_savings_percent == 75.0 and r.recommendation.startswith("Excellent")
    assert spark.range(1).select(quality.change_percent(F.lit(3.0), F.lit(2.0)).alias("a"), quality.change_percent(F.lit(3.0), F.lit(0.0)).alias("b")).first() == (50.0, None)


def test_graph_shards_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD_ROWS", 100)
    df = from_arrays(spark, units(250, 8))
    assert len(list(hnsw.graphs(hnsw.build(df)))) == 3 and len(list(hnsw.graphs(hnsw.build(df, 1)))) == 1
