"""Vector functions as Column expressions, evaluated in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# The sixteen levels of the 4-bit NormalFloat code.
NF4_LEVELS = (
    -1.0, -0.6961928, -0.525073, -0.3949003, -0.2844677, -0.1848745, -0.09105004, 0.0,
    0.07958031, 0.16093908, 0.24611496, 0.33791524, 0.44070983, 0.56266755, 0.7229576, 1.0,
)
NF4_MIDPOINTS = tuple((a + b) / 2 for a, b in zip(NF4_LEVELS, NF4_LEVELS[1:], strict=False))


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _sum(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def bound(x: Column, then: Callable[[Column], Column]) -> Column:
    """then(x) with x computed once, also where then uses it for each element of an array."""
    return F.get(F.transform(F.array(x), then), 0)


def _common(a: Column, b: Column) -> tuple[Column, Column]:
    n = F.least(F.size(a), F.size(b))
    return F.slice(a, 1, n), F.slice(b, 1, n)


def dot(a: Column | str, b: Column | str) -> Column:
    """The sum of products over the shorter vector's length, in double precision."""
    a, b = _common(_c(a), _c(b))
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2_norm(a: Column | str) -> Column:
    return F.sqrt(_sum(F.transform(_c(a), lambda x: x.cast("double") * x.cast("double"))))


def l2sq(a: Column | str, b: Column | str) -> Column:
    """The squared Euclidean distance over the shorter vector's length."""
    a, b = _common(_c(a), _c(b))
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def cosine(a: Column | str, b: Column | str, on_zero: str = "minus_one", on_mismatch: str = "minus_one", clamp: bool = False) -> Column:
    """Cosine similarity.

    on_zero: minus_one or zero, the value where a norm is 0. on_mismatch: minus_one, error, or truncate to the shorter length.
    """
    a, b = _c(a), _c(b)
    zero = F.lit({"minus_one": -1.0, "zero": 0.0}[on_zero])

    def ratio(norms: Column) -> Column:
        out = dot(a, b) / norms
        if clamp:
            out = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), out))
        return F.when(norms == 0, zero).otherwise(out)

    out = bound(l2_norm(a) * l2_norm(b), ratio)
    if on_mismatch == "truncate":
        return out
    other = F.lit(-1.0) if on_mismatch == "minus_one" else F.raise_error(F.lit("vectors differ in length")).cast("double")
    return F.when(F.size(a) != F.size(b), other).otherwise(out)


def normalize(a: Column | str, on_zero: str = "zeros", tiny: float = 0.0) -> Column:
    """A vector of unit length, as doubles. on_zero: zeros, or keep the vector as it is where its norm is at most tiny."""
    a = _c(a)
    kept = F.transform(a, lambda x: x.cast("double") if on_zero == "keep" else F.lit(0.0))
    return bound(l2_norm(a), lambda n: F.when(n <= tiny, kept).otherwise(F.transform(a, lambda x: x.cast("double") / n)))


def nearest(a: Column | str, centroids: Column) -> Column:
    """The index of the nearest of an array of vectors, the first on ties."""
    d = F.transform(centroids, lambda c: l2sq(_c(a), c))
    return bound(d, lambda d: (F.array_position(d, F.array_min(d)) - 1).cast("int"))


def scalar_code(x: Column, mn: Column, mx: Column) -> Column:
    """The 8-bit code of a value in its dimension's range: 0 where the range is empty or the value NaN, halves away from zero."""
    x, mn, mx = (c.cast("double") for c in (x, mn, mx))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - mn) / (mx - mn)))
    return F.when((mx <= mn) | F.isnan(x), 0).otherwise(F.round(t * 255)).cast("int")


def scalar_value(q: Column, mn: Column, mx: Column) -> Column:
    mn, mx = mn.cast("double"), mx.cast("double")
    return F.when(mx <= mn, mn).otherwise(mn + q.cast("double") / 255 * (mx - mn))


def nf4_code(x: Column) -> Column:
    """The level of a scaled value: the number of midpoints below it."""
    x = x.cast("double")
    return sum((F.when(x > F.lit(t), 1).otherwise(0) for t in NF4_MIDPOINTS), F.lit(0))


def nf4_level(code: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in NF4_LEVELS]), (code + 1).cast("int"))


def abs_max(a: Column | str) -> Column:
    return F.coalesce(F.array_max(F.transform(_c(a), lambda x: F.abs(x.cast("double")))), F.lit(0.0))


def nf4_scale(a: Column | str) -> Column:
    m = abs_max(a)
    return F.when(m == 0, F.lit(1.0)).otherwise(m)


def nf4_codes(a: Column | str) -> Column:
    scaled = bound(nf4_scale(a), lambda scale: F.transform(_c(a), lambda x: x.cast("double") / scale))
    return F.transform(scaled, nf4_code)


def nf4_pack(codes: Column | str) -> Column:
    """Pairs of codes as byte values, the even dimension in the low half; an odd last one alone."""
    c = _c(codes)
    pairs = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(c) - 1) / 2)).cast("int"))
    out = F.transform(pairs, lambda i: (F.get(c, 2 * i) + F.coalesce(F.get(c, 2 * i + 1), F.lit(0)) * 16).cast("int"))
    return F.when(F.size(c) == 0, F.array().cast("array<int>")).otherwise(out)


def nf4_unpack(packed: Column | str, dim: Column | int) -> Column:
    p = _c(packed)
    both = F.flatten(F.transform(p, lambda b: F.array(b.bitwiseAND(F.lit(15)), F.shiftright(b, 4))))
    return F.slice(both, 1, F.lit(dim) if isinstance(dim, int) else dim)


def grade(similarity: Column) -> Column:
    return F.when(similarity >= 0.99, "A+").when(similarity >= 0.95, "A").when(similarity >= 0.90, "B").when(similarity >= 0.85, "C").otherwise("D")


# The advice given for a mean similarity of at least the first and a ratio of at least the second number.
ADVICE = (
    (0.99, 3.0, "Excellent compression with minimal quality loss. Recommended for production."),
    (0.95, 2.0, "Good compression ratio with acceptable quality. Consider for most applications."),
    (0.90, 0.0, "Moderate compression. May be suitable for applications tolerant to some quality loss."),
)
NO_ADVICE = "Low compression quality. Consider adjusting quantization parameters."


def recommendation(similarity: Column, ratio: Column) -> Column:
    out = F.lit(NO_ADVICE)
    for least, least_ratio, text in reversed(ADVICE):
        out = F.when((similarity >= least) & (ratio >= least_ratio), text).otherwise(out)
    return out


#: SQL functions with the same meaning, inlined by the analyser.
SQL_FUNCTIONS = {
    "vec_dot": "(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(slice(a, 1, least(size(a), size(b))), slice(b, 1, least(size(a), size(b))), (x, y) -> x * y), 0D, (s, x) -> s + x)",
    "vec_norm": "(a ARRAY<DOUBLE>) RETURNS DOUBLE RETURN sqrt(aggregate(a, 0D, (s, x) -> s + x * x))",
    "vec_l2sq": "(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(slice(a, 1, least(size(a), size(b))), slice(b, 1, least(size(a), size(b))), (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)",
    "vec_cosine": "(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN CASE WHEN size(a) <> size(b) OR vec_norm(a) * vec_norm(b) = 0 THEN -1D ELSE vec_dot(a, b) / (vec_norm(a) * vec_norm(b)) END",
}


def register_sql_functions(spark: SparkSession) -> None:
    for name, rest in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{rest}")
