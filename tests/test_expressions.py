import pytest
from pyspark.sql import functions as F

from vecspark.functions import exprs as X
from vecspark.operators import scalar


def one(spark, col, **vectors):
    schema = ", ".join(f"{k} array<float>" for k in vectors)
    return spark.createDataFrame([tuple(vectors.values())], schema).select(col.alias("x")).first().x


def test_dot_and_norm(spark):
    assert one(spark, X.dot("a", "b"), a=[1.0, 2.0, 3.0], b=[4.0, 5.0]) == 14.0
    assert one(spark, X.l2_norm("a"), a=[3.0, 4.0]) == 5.0
    assert one(spark, X.l2sq("a", "b"), a=[1.0, 2.0], b=[4.0, 6.0]) == 25.0


@pytest.mark.parametrize(
    ("a", "b", "options", "want"),
    [
        ([1.0, 0.0], [1.0, 0.0], {}, 1.0),
        ([1.0, 0.0], [1.0], {}, -1.0),
        ([0.0, 0.0], [1.0, 0.0], {}, -1.0),
        ([0.0, 0.0], [1.0, 0.0], {"on_zero": "zero"}, 0.0),
        ([1.0, 0.0, 9.0], [1.0, 0.0], {"on_mismatch": "truncate"}, 1 / 82**0.5),
    ],
)
def test_cosine(spark, a, b, options, want):
    assert one(spark, X.cosine("a", "b", **options), a=a, b=b) == pytest.approx(want)


def test_cosine_error_on_mismatch(spark):
    with pytest.raises(Exception, match="differ in length"):
        one(spark, X.cosine("a", "b", on_mismatch="error"), a=[1.0], b=[1.0, 2.0])


def test_normalize(spark):
    assert one(spark, X.normalize("a"), a=[3.0, 4.0]) == [0.6, 0.8]
    assert one(spark, X.normalize("a"), a=[0.0, 0.0]) == [0.0, 0.0]
    assert one(spark, X.normalize("a", on_zero="keep", tiny=1e-3), a=[1e-6, 0.0]) == [pytest.approx(1e-6), 0.0]


def test_nearest_takes_the_first_on_ties(spark):
    c = F.array(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(-1.0), F.lit(0.0)))
    assert one(spark, X.nearest("a", c), a=[0.0, 3.0]) == 0


@pytest.mark.parametrize(("x", "mn", "mx", "code"), [(1.0, 1.0, 1.0, 0), (0.0, 0.0, 10.0, 0), (10.0, 0.0, 10.0, 255), (5.0, 0.0, 10.0, 128), (99.0, 0.0, 10.0, 255), (-9.0, 0.0, 10.0, 0), (float("nan"), 0.0, 1.0, 0)])
def test_scalar_code(spark, x, mn, mx, code):
    r = spark.createDataFrame([(x, mn, mx)], "x double, mn double, mx double").select(X.scalar_code(F.col("x"), F.col("mn"), F.col("mx")).alias("c"), X.scalar_value(F.lit(code), F.col("mn"), F.col("mx")).alias("v")).first()
    assert r.c == code
    assert mn <= r.v <= mx


def test_byte_batch():
    assert scalar.byte_batch([0.0, 1.0], 1) == [0, 255]
    assert scalar.byte_batch([], 1) == [] and scalar.byte_batch([1.0], 0) == [] and scalar.byte_batch([1.0, 2.0, 3.0], 2) == []
    assert scalar.byte_batch([5.0, 0.0, 5.0, 1.0], 2) == [128, 0, 128, 255]


def test_nf4_midpoint_goes_down(spark):
    t = X.NF4_MIDPOINTS[3]
    r = spark.range(1).select(X.nf4_code(F.lit(t)).alias("a"), X.nf4_code(F.lit(t + 1e-9)).alias("b"), X.nf4_code(F.lit(-2.0)).alias("lo"), X.nf4_code(F.lit(2.0)).alias("hi")).first()
    assert (r.a, r.b, r.lo, r.hi) == (3, 4, 0, 15)


@pytest.mark.parametrize("n", [0, 1, 2, 7, 64])
def test_nf4_pack_round_trip(spark, n):
    codes = [i % 16 for i in range(n)]
    df = spark.createDataFrame([(codes,)], "c array<int>")
    r = df.select(X.nf4_pack("c").alias("p")).select("p", X.nf4_unpack("p", n).alias("back")).first()
    assert r.back == codes and len(r.p) == (n + 1) // 2


def test_sql_functions(spark):
    X.register_sql_functions(spark)
    r = spark.sql("SELECT vec_cosine(array(1D, 0D), array(0D, 0D)) a, vec_dot(array(1D, 2D), array(3D, 4D, 5D)) b, vec_norm(array(3D, 4D)) c, vec_l2sq(array(1D), array(3D)) d").first()
    assert (r.a, r.b, r.c, r.d) == (-1.0, 11.0, 5.0, 4.0)
