"""The engine's row: an ordinal, an id and a float vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ord is the input order, which settles ties, samples and initial centroids.
EMBEDDING = "ord long, id string, vector array<float>"


def embeddings(df: DataFrame, ord_col: str, vector_col: str, id_col: str | None = None) -> DataFrame:
    """A table in the engine's form; without an id column the ordinal is the id."""
    return df.select(F.col(ord_col).cast("long").alias("ord"), F.col(id_col or ord_col).cast("string").alias("id"), F.col(vector_col).cast("array<float>").alias("vector"))


def toy_dataset(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, "one", [1.0, 0.0]), (1, "two", [0.0, 1.0]), (2, "three", [0.707, 0.707])], EMBEDDING)


def from_arrays(spark: SparkSession, vectors, ids=None) -> DataFrame:
    """Rows of a two-dimensional array; default ids are vec_0, vec_1 and so on. Empty input is an error."""
    rows = [(i, str(ids[i]) if ids is not None else f"vec_{i}", [float(x) for x in v]) for i, v in enumerate(vectors)]
    if not rows:
        raise ValueError("no vectors")
    return spark.createDataFrame(rows, EMBEDDING)


def dimension(df: DataFrame) -> int:
    """The length of the first non-empty vector by ord, 0 if there is none."""
    row = df.where(F.size("vector") > 0).agg(F.min_by(F.size("vector"), "ord").alias("dim")).first()
    return row.dim or 0


def stats(df: DataFrame) -> DataFrame:
    """count, dimensions (of the first row), shortest and longest vector, rows with a NaN."""
    nan = F.exists("vector", lambda x: F.isnan(x) | x.isNull())
    return df.agg(F.count("*").alias("count"), F.min_by(F.size("vector"), "ord").alias("dimensions"), F.min(F.size("vector")).alias("min_dim"), F.max(F.size("vector")).alias("max_dim"), F.count_if(nan).alias("nan_rows"))


def validate_dims(df: DataFrame) -> int:
    """The common dimension; an empty table, vectors of different lengths and NaN are errors."""
    s = stats(df).first()
    if not s["count"]:
        raise ValueError("no vectors")
    if s["min_dim"] != s["max_dim"]:
        raise ValueError(f"vectors have between {s['min_dim']} and {s['max_dim']} elements")
    if s["nan_rows"]:
        raise ValueError(f"{s['nan_rows']} vectors hold NaN or null")
    return s["min_dim"]
