import uuid

from vecspark.operators import positions


def rows(spark, *pairs):
    return spark.createDataFrame(pairs, "ord long, id string")


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_last_wins_in_any_order_of_merging(spark):
    a, b = rows(spark, (0, "x"), (1, "y"), (2, "x"), (3, None)), rows(spark, (4, "y"), (5, ""))
    want = [("", 5), ("x", 2), ("y", 4)]
    assert found(positions.merged(positions.build(a), b).select("id", "ord")) == want
    assert found(positions.merged(positions.build(b), a).select("id", "ord")) == want
    assert positions.build(a.limit(0)).count() == 0


def test_lookup_keeps_every_row(spark, monkeypatch):
    """Hot, rare, unknown, null and repeated ids, and columns with clashing and dotted names, in both ways of joining."""
    table = positions.build(rows(spark, *[(i, f"e{i % 5}") for i in range(20)]))
    ids = ["e1"] * 40 + ["e2", "e2", "e4", "gone", None, None]
    asked = spark.createDataFrame([(i, x, -i, "k", "l") for i, x in enumerate(ids)], "n long, `my.id` string, ord long, key string, KEY_ string")
    want = sorted([(i, x, -i, "k", "l", {"e1": 16, "e2": 17, "e4": 19}.get(x)) for i, x in enumerate(ids)], key=str)
    for shares in (2, 1000):
        monkeypatch.setattr(positions, "SHARES", shares)
        out = positions.lookup(table, asked, "my.id")
        assert out.columns == [*asked.columns, "place"] and found(out) == want
    assert positions.lookup(table, asked.limit(0), "my.id").count() == 0
    assert {r.place for r in positions.lookup(table.limit(0), asked, "my.id").collect()} == {None}


def test_buckets_are_not_shuffled(spark):
    name = f"places_{uuid.uuid4().hex}"
    kept = positions.save(positions.build(rows(spark, *[(i, f"e{i % 50}") for i in range(200)])), name, 4)
    try:
        asked = spark.createDataFrame([(f"e{i}",) for i in range(60)], "id string")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        plan = kept.join(asked.repartition(3), "id")._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1
        assert sorted((r.id, r.place) for r in positions.lookup(kept, asked).collect()) == sorted((f"e{i}", 150 + i if i < 50 else None) for i in range(60))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"DROP TABLE IF EXISTS {name}")
