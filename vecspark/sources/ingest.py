"""Parsers of text sources, as Column expressions over lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import durable

#: What counts as a number: no type suffixes, no white space inside.
NUMBER = r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])$"


def number(x: Column) -> Column:
    """A float, or null where the string is none."""
    t = F.trim(x)
    return F.when(t.rlike(NUMBER), t.try_cast("float"))


def numbers(parts: Column) -> Column:
    """The floats of an array of strings; those that are none are dropped."""
    return F.filter(F.transform(parts, number), lambda x: x.isNotNull())


def lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of text files with their place: file, and byte-ordered number within it (`ord` is global, in order of file and line)."""
    return with_ord(spark.read.text(path).select(F.col("value").alias("line")))


def with_ord(df: DataFrame) -> DataFrame:
    """df, as read from files, with ord 0, 1, 2 and so on in the order of its rows."""
    return numbered(df, "ord")


def numbered(df: DataFrame, name: str, kept: bool = False) -> DataFrame:
    """df with its rows' places in their order: a place in a partition and the rows of the partitions before, counted in one pass.

    The count for each partition reaches the driver. Both passes must see the same partitions: scans of files do; kept
    writes rows of any other origin to the shared folder first.
    """
    part, place, before = (f"{name}_{x}" for x in ("part", "place", "before"))
    rows = df.withColumn(part, F.spark_partition_id()).withColumn(place, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    rows = durable(rows) if kept else rows
    counts = sorted((r[part], r.n) for r in rows.groupBy(part).agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, total))
        total += n
    offsets = df.sparkSession.createDataFrame(starts, f"{part} int, {before} long")
    return rows.join(F.broadcast(offsets), part).withColumn(name, F.col(before) + F.col(place)).drop(part, place, before)


def parse_lines(rows: DataFrame, keep_empty: bool = False) -> DataFrame:
    """ord, id, vector of lines that are JSON objects `{"id": str, "vector": [..]}` or else `id,number,..`; others are left out.

    Elements that are no numbers are dropped. A blank line is skipped; a JSON object whose id is no string, or without a
    vector, is left out rather than read as CSV. A CSV line without any number is left out unless keep_empty.
    """
    line = F.trim("line")
    js = F.from_json(line, "id string, vector array<string>")
    is_object = line.startswith("{")
    id_is_string = F.regexp_extract(line, r'"id"\s*:\s*(.)', 1) == '"'
    raw = rows.select("ord", line.alias("line"), is_object.alias("is_object"), id_is_string.alias("named"), js.alias("js"), F.split(line, ",").alias("parts")).where("line <> ''")
    strings = F.transform("js.vector", lambda x: x)
    from_json = F.when(F.col("named") & F.col("js.id").isNotNull() & F.col("js.vector").isNotNull(), F.struct(F.col("js.id").alias("id"), numbers(strings).alias("vector")))
    csv = numbers(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(1))))
    from_csv = F.when((F.size("parts") >= 2) & (F.lit(keep_empty) | (F.size(csv) > 0)), F.struct(F.get("parts", 0).alias("id"), csv.alias("vector")))
    row = F.when(F.col("is_object"), from_json).otherwise(from_csv)
    return raw.select("ord", row.alias("row")).where("row is not null").select("ord", "row.id", "row.vector")


def read_lines(spark: SparkSession, path: str, keep_empty: bool = False) -> DataFrame:
    """JSONL and CSV files, also mixed."""
    return parse_lines(lines(spark, path), keep_empty)


def parse_words(rows: DataFrame, most: int | None = None) -> DataFrame:
    """ord, id, vector of `word f1 .. fd` lines; blank lines, lines without a space and lines with any bad number are skipped whole."""
    parts = F.split(F.trim("line"), r"\s+")
    raw = rows.select("ord", parts.alias("parts")).where(F.size("parts") >= 2)
    values = F.transform(F.slice("parts", 2, F.size("parts") - 1), number)
    out = raw.select("ord", F.get("parts", 0).alias("id"), values.alias("vector")).where(~F.exists("vector", lambda x: x.isNull()))
    return out if most is None else out.orderBy("ord").limit(most)


def parse_queries(rows: DataFrame) -> DataFrame:
    """qid, vector of JSONL queries: bad JSON or a missing vector is an error with the line's number; a missing id is `?`; elements that are no numbers are 0."""
    js = F.from_json("line", "id string, vector array<string>")
    raw = rows.where(F.trim("line") != "").select("ord", js.alias("js"), F.regexp_extract("line", r'"id"\s*:\s*(.)', 1).alias("quote"))
    bad = F.raise_error(F.concat(F.lit("no vector in line "), (F.col("ord") + 1).cast("string")))
    vector = F.when(F.col("js.vector").isNull(), bad.cast("array<float>")).otherwise(F.transform("js.vector", lambda x: F.coalesce(number(x), F.lit(0.0).cast("float"))))
    return raw.select("ord", F.when(F.col("quote") == '"', F.coalesce("js.id", F.lit("?"))).otherwise("?").alias("qid"), vector.alias("vector"))


def parse_query(text: Column) -> Column:
    """The numbers of `1.0, 2, x`; others are dropped."""
    return numbers(F.split(text, ","))
