"""Ids to places: a table of each id's last place (ord), kept in buckets, merged with later rows and looked up by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import durable

#: An id that more than this part of the rows ask for is looked up by a broadcast; there are fewer such ids than this.
SHARES = 1000


def build(df: DataFrame) -> DataFrame:
    """id, ord: the last place of each id; rows without an id have none. Repeats are reduced before the shuffle."""
    return df.where("id is not null").groupBy("id").agg(F.max("ord").alias("ord"))


def merged(table: DataFrame, more: DataFrame) -> DataFrame:
    """The table after more rows (id, ord); the last place wins, whatever the order of merging."""
    return build(table.select("id", "ord").unionByName(more.select("id", "ord")))


def save(table: DataFrame, name: str, buckets: int = 200) -> DataFrame:
    """Keeps it in the warehouse in sorted buckets of the id, so that lookups don't shuffle it."""
    table.write.bucketBy(buckets, "id").sortBy("id").mode("overwrite").saveAsTable(name)
    return table.sparkSession.table(name)


def lookup(table: DataFrame, asked: DataFrame, id_col: str = "id", place: str = "place") -> DataFrame:
    """asked with each row's place; null for ids that are null or not in the table.

    Ids that hold more than one of SHARES of asked's rows meet their places in a broadcast join of fewer than SHARES rows,
    and null ids in none; the other rows are joined with the table by id.
    """
    columns = asked.columns
    taken = {c.lower() for c in columns}
    if place.lower() in taken:
        raise ValueError(f"there is a column {place} already")
    key = "key"
    while key in taken:
        key += "_"
    rows = asked.withColumn(key, F.col(f"`{id_col}`").cast("string"))
    places = table.select(F.col("id").alias(key), F.col("ord").alias(place))
    named = rows.where(F.col(key).isNotNull())
    least = named.count() / SHARES
    hot = named.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > least).select(key)
    hot = durable(hot.join(places, key, "left"))
    rare = named.join(F.broadcast(hot.select(key)), key, "left_anti").join(places, key, "left")
    out = rare.unionByName(named.join(F.broadcast(hot), key)).unionByName(rows.where(F.col(key).isNull()).withColumn(place, F.lit(None).cast("long")))
    return out.select(*[F.col(f"`{c}`") for c in columns], place)
