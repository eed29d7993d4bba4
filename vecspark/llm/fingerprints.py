"""Document fingerprints: mergeable bottom-k sketches of word-shingle hashes (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import Buckets, shuffle_width

K = 128
SHINGLE = 5
#: Hashes are compared as signed longs, so the least is LEAST and a fraction f of them lies below LEAST + f * 2**64.
LEAST = -(1 << 63)
ODD = (-7046029254386353131, -4417276706812531889, 1609587929392839161, -8796714831421723037, 2870177450012600261)


def shingle_hashes(text: Column) -> Column:
    """Hashes of all runs of five words (`[^\\x20\\x09-\\x0D]+`, as written); of fewer words, of the whole run; of none, an empty array."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    h = F.transform(F.split(trimmed, r"[\x20\x09-\x0D]+"), lambda w: F.xxhash64(w))

    def runs(h: Column) -> Column:
        n = F.size(h)
        return F.when(n >= SHINGLE, F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(SHINGLE)]))).otherwise(F.array(F.xxhash64(h, n)))

    # the array of word hashes is bound once, by a transform over an array of one
    return F.when(F.length(trimmed) == 0, F.array().cast("array<bigint>")).otherwise(F.get(F.transform(F.array(h), runs), 0))


def bottom(hashes: Column, k: int = K) -> Column:
    """The k least distinct hashes, ascending.

    Of a long array only hashes under a threshold that keeps about 4k are sorted; where that leaves fewer than k distinct ones, all are.
    """

    def of(h: Column) -> Column:
        whole = F.sort_array(F.array_distinct(h))
        fraction = F.lit(4.0 * k) / F.size(h)
        limit = (F.lit(float(LEAST)) + fraction * F.lit(2.0**64)).cast("bigint")
        few = F.sort_array(F.array_distinct(F.filter(h, lambda x: x < limit)))
        bound = F.get(F.transform(F.array(few), lambda f: F.when(F.size(f) >= k, f).otherwise(whole)), 0)
        return F.slice(F.when(F.size(h) > 8 * k, bound).otherwise(whole), 1, k)

    return F.get(F.transform(F.array(hashes), of), 0)


def sketch(text: Column, k: int = K) -> Column:
    """The bottom-k sketch of a text; a null or empty text has an empty one."""
    return bottom(shingle_hashes(F.coalesce(text, F.lit(""))), k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def distinct_shingles(s: Column, k: int = K) -> Column:
    """The estimated number of distinct shingles: exact below k, else (k - 1) / (the k-th hash as a fraction)."""
    fraction = (F.element_at(s, k).cast("double") - F.lit(float(LEAST))) / F.lit(2.0**64)
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise(F.lit(float(k - 1)) / fraction)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """The estimated Jaccard similarity: of the k least hashes of both, the fraction in each. Two empty sketches are alike (1), one is not (0)."""
    least = merge(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(a, b), least))
    return F.when(F.size(least) == 0, F.lit(1.0)).otherwise(both / F.size(least)).cast("double")


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The estimated share of a's shingles that b has: resemblance x distinct shingles of both / those of a."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k) / distinct_shingles(a, k)))


def as_text(s: Column) -> Column:
    """A sketch as fixed-width hexadecimal, 16 digits a hash."""
    return F.array_join(F.transform(s, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def from_text(c: Column) -> Column:
    """The sketch that as_text wrote."""
    each = F.transform(F.sequence(F.lit(0), (F.length(c) / 16).cast("int") - 1), lambda i: F.conv(F.substring(c, (i * 16 + 1).cast("int"), F.lit(16)), 16, -10).cast("bigint"))
    return F.when(F.length(c) == 0, F.array().cast("array<bigint>")).otherwise(each)


def fingerprint(docs: DataFrame, text: str = "text", k: int = K) -> DataFrame:
    """docs with a column `sketch`; equal texts have equal sketches."""
    return docs.withColumn("sketch", sketch(F.col(text), k))


def with_next(docs: DataFrame, buckets: int | None = None):
    """Rows (doc_id, text, next_text, extra), and the window they are ordered by. next_text is that of the row that follows in descending doc_id order, of the first row after the last.

    Rows of one doc_id follow each other by the text's hash and the text; null ids come last; a table of one row follows itself.
    Buckets of consecutive ids are sorted apart; the first row of each bucket is also sent, as extra, to the bucket before it.
    """
    spark = docs.sparkSession
    cut = Buckets(docs, "doc_id", buckets or 4 * shuffle_width(spark))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), cut.of("doc_id").alias("bucket"))
    heads = docs.select(cut.of("doc_id").alias("bucket"), "doc_id").groupBy("bucket").agg(F.max("doc_id").alias("head")).collect()  # at most cut.n + 1 rows of two numbers
    order = sorted(heads, key=lambda r: -r.bucket)
    following = [order[(i + 1) % len(order)] for i in range(len(order))]
    sent = spark.createDataFrame([(r.bucket, n.bucket, n.head) for r, n in zip(order, following, strict=True)], "to int, bucket int, head long")
    sent = F.broadcast(sent) if len(order) <= 1 << 16 else sent  # three numbers a bucket
    ahead = rows.join(sent, (rows["bucket"] == sent["bucket"]) & rows["doc_id"].eqNullSafe(sent["head"])).select("doc_id", "text", F.col("to").alias("bucket"), F.lit(1).alias("extra"))
    both = rows.withColumn("extra", F.lit(0)).unionByName(ahead)
    w = Window.partitionBy("bucket").orderBy("extra", F.desc_nulls_last("doc_id"), F.xxhash64("text"), "text")
    return both.withColumn("next_text", F.lead("text").over(w)), w


def neighbours(docs: DataFrame, k: int = K, buckets: int | None = None) -> DataFrame:
    """Each document's fingerprint beside that of an edited text (its last half replaced by the next document's beginning) and of the next document.

    A null text is empty; other columns are ignored; an empty table gives no rows; repeated rows each give one.
    """
    rows, w = with_next(docs, buckets)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.withColumns({"n_chars": n.cast("long"), "edited": edited, "print": sketch(F.col("text"), k)})
    rows = rows.withColumn("next_print", F.lead("print").over(w)).where("extra = 0")
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "print", "next_print", sketch(F.col("edited"), k).alias("edited_print"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("print")).alias("fingerprint"), as_text(F.col("edited_print")).alias("edited_fingerprint"),
        resemblance(F.col("print"), F.col("edited_print"), k).alias("near_edited"), resemblance(F.col("print"), F.col("next_print"), k).alias("near_next"),
        distinct_shingles(F.col("print"), k).alias("distinct_shingles"),
    )
