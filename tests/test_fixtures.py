"""Fixed small cases of what the registered queries do over a whole table."""

import pytest
from pyspark.sql import functions as F

from vecspark.functions import exprs as X
from vecspark.operators import quality, search
from vecspark.operators.hnsw import xorshift
from vecspark.sources import generators, ingest

VECTORS = [(0, "a", [1.0, 0.0]), (1, "zero", [0.0, 0.0]), (2, "long", [1.0, 2.0, 3.0]), (3, "b", [0.6, 0.8]), (4, "a2", [2.0, 0.0])]
ROWS = "ord long, id string, vector array<float>"


def test_naive_search_scores_every_row(spark):
    q = spark.createDataFrame([("q", [1.0, 0.0])], "qid string, vector array<float>")
    got = search.batch_top_k(spark.createDataFrame(VECTORS, ROWS), q, 10, naive=True).orderBy("rn").collect()
    assert [(r.id, round(r.score, 6)) for r in got] == [("a", 1.0), ("a2", 1.0), ("b", 0.6), ("zero", -1.0), ("long", -1.0)]


def test_index_search_leaves_queries_without_results(spark):
    q = spark.createDataFrame([("ok", [0.5, 0.5]), ("zero", [0.0, 0.0]), ("long", [1.0, 2.0, 3.0])], "qid string, vector array<float>")
    got = search.batch_top_k(spark.createDataFrame([r for r in VECTORS if len(r[2]) == 2], ROWS), q, 10)
    assert [(r.qid, r.n) for r in got.groupBy("qid").agg(F.count("*").alias("n")).collect()] == [("ok", 4)]


def test_cosine_of_odd_pairs(spark):
    pairs = [([1.0, 0.0], [0.0, 0.0], -1.0, 0.0), ([1.0, 0.0], [1.0], -1.0, None), ([0.0, 0.0], [0.0, 0.0], -1.0, 0.0), ([3.0, 4.0], [3.0, 4.0], 1.0, 1.0), ([1.0, 0.0], [-2.0, 0.0], -1.0, -1.0)]
    df = spark.createDataFrame(pairs, "a array<float>, b array<float>, c double, w double")
    assert df.where(F.abs(X.cosine("a", "b") - F.col("c")) > 1e-6).count() == 0
    assert df.where("w is not null").where(F.abs(X.cosine("a", "b", on_zero="zero", on_mismatch="error", clamp=True) - F.col("w")) > 1e-6).count() == 0


def test_recall_of_five(spark):
    one, other = (spark.createDataFrame([("q", i, c) for i, c in enumerate(x, 1)], "qid string, rn int, id string") for x in ("abcde", "acefg"))
    assert quality.recall_at_k(one, other, 5).first().recall == pytest.approx(0.6)


LINES = ['{"id":"one","vector":[1.0,"x",2]}', "", "invalid json line", "two,3.0,bad,4.0", "three,none", '{"id":7,"vector":[1]}', '{"id":"four","vector":[]}', "  five,5.5  "]


@pytest.mark.parametrize("keep", [False, True])
def test_malformed_lines(spark, keep):
    rows = ingest.parse_lines(spark.createDataFrame(list(enumerate(LINES)), "ord long, line string"), keep_empty=keep).collect()
    want = {"one": [1.0, 2.0], "two": [3.0, 4.0], "four": [], "five": [5.5]} | ({"three": []} if keep else {})
    assert {r.id: r.vector for r in rows} == want


def test_queries_as_text(spark):
    rows = spark.createDataFrame([(x,) for x in ("", "1.0", "1.0, 2.0 , 3.0", "1.0,invalid,3.0", "-1.5,0.0,2.5")], "q string")
    assert [r.v for r in rows.select(ingest.parse_query(F.col("q")).alias("v")).collect()] == [[], [1.0], [1.0, 2.0, 3.0], [1.0, 3.0], [-1.5, 0.0, 2.5]]
    lines = spark.createDataFrame([(0, '{"id":"a","vector":[1,2]}'), (1, ""), (2, '{"vector":[1.5,"x",null]}')], "ord long, line string")
    assert {r.qid: r.vector for r in ingest.parse_queries(lines).collect()} == {"a": [1.0, 2.0], "?": [1.5, 0.0, 0.0]}


def test_draws_from_any_place_of_the_sequence(spark):
    state, all_ = generators.XORSHIFT_SEED, [generators.XORSHIFT_SEED]
    for _ in range(300):
        all_.append(state := xorshift(state))
    assert all(generators.jump(generators.XORSHIFT_SEED, n) == all_[n] for n in (0, 1, 2, 63, 64, 65, 255, 300))
    rows = generators.xorshift_cube(spark, 60, 5).collect()
    assert [x for r in sorted(rows, key=lambda r: r.ord) for x in r.vector] == pytest.approx([(s >> 11) / 2**53 for s in all_[1:]], abs=1e-6)


def test_places_follow_the_order_of_rows(spark, tmp_path):
    (tmp_path / "a").write_text("".join(f"line {i}\n" for i in range(500)))
    (tmp_path / "b").write_text("last\nof all")
    rows = ingest.lines(spark, str(tmp_path)).collect()
    own = {r.line: r.ord for r in rows}
    assert sorted(own.values()) == list(range(502)) and all(own[f"line {i + 1}"] == own[f"line {i}"] + 1 for i in range(499)) and own["of all"] == own["last"] + 1
    kept = ingest.numbered(spark.range(1000).orderBy(F.desc("id")), "n", kept=True).collect()
    assert all(r.n == 999 - r.id for r in kept)
    assert ingest.numbered(spark.range(0), "n").count() == 0
