"""A training corpus from `documents`: language, near duplicates, benchmark passages, mixture, token-id files.

STAGES are (name, function); a function takes (spark, docs, sf_dir) and returns the documents it keeps, all columns. The
last returns what it reads back from the token-id files. run() writes each stage as Parquet in the shared folder and reads
it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecspark.llm import decontamination, jaccard_join, language_id, mixing, token_output
from vecspark.llm._common import fresh_path, plainly_named, row_hash
from vecspark.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: null texts, those without a letter and those that no language's tree codes in fewer bits than their bytes have go."""
    return language_id.accepted(docs, language_id.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates: the least doc_id's, of its texts and rows the first by hash.

    Rows are told apart by doc_id and text, so different texts of one doc_id stay unless they are near duplicates. Rows without
    a doc_id or without words stay.
    """
    first = jaccard_join.linked(docs.select("doc_id", "text")).where("label is not null").groupBy("label").agg(F.min(F.struct("doc_id", "same")).alias("first"))
    first = first.select("first.doc_id", "first.same")
    rows = plainly_named(docs, "doc_id", "text")
    columns = rows.columns
    alone = F.col("doc_id").isNull() | F.coalesce(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    kept = rows.withColumn("same", F.xxhash64("text")).withColumn("place", row_hash(rows)).join(first.hint("shuffle_hash"), ["doc_id", "same"], "left_semi")
    kept = kept.withColumn("one", F.row_number().over(Window.partitionBy("doc_id", "same").orderBy("place"))).where("one = 1")
    return kept.select(*columns).unionByName(rows.where(alone)).toDF(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of ten words of the benchmark."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them: 0, 1 or 2 times."""
    return mixing.resample(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, read back from the files of token ids."""
    return token_output.round_trip(docs, tokenizer_path())


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("token_output", token_ids),
]

#: Components and coded files aren't SQL; tests/llm holds the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(path := fresh_path(spark, name))
            docs = spark.read.parquet(path)
    return docs
