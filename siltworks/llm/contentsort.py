"""Exact deduplication by content sort.

Sampled splitters range-partition the normalised texts (by a short start, a hash
that separates texts with the same start, and a salt), the external sort of each
partition puts equals side by side, and full comparisons of neighbours find the
groups; the smallest identifier of a group stays. Only DataFrame functions are used.
A table holds the rows with the start and hash of their text, so counting and sampling read
these two alone; it is compressed well, as it is the one copy of the corpus beside the shuffle.

A text with more copies than a quarter of a partition's share is dealt out over
salts, so that no task gets a whole hot group; its salted parts are then compared
in full once more through one representative each. There are at most
4 * partitions such texts and 8 * partitions such parts whatever the corpus, which
bounds what is broadcast.

Defined results: null counts as empty; of repeated rows (same id, same text) one
stays; a group whose ids are all null has a null keep_id, and one row of it stays; texts of any
length are compared whole; an empty table gives no rows; ``exact_dedup`` carries the
input's columns in one struct, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WS_CHARS, discard, staged

#: Characters of a text that take part in the choice of its partition, and rows below which a group is never salted.
START_CHARS, SMALL_GROUP = 24, 256


def normalised(text: Column) -> Column:
    """Each run of white space as one blank. Literal replacements first: the regex then only meets runs of blanks."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    for c in WS_CHARS:
        t = F.replace(t, F.lit(c), F.lit(" "))
    return F.regexp_replace(t, "  +", " ")


def exact_dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = True) -> DataFrame:
    """(row, keep_id, group_size, kept, text_sha256) of every row: row is a struct of the input's columns if ``carry``, else of the id alone."""
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    row = F.struct(*[docs[c] for c in docs.columns]) if carry else F.struct(docs[id_col].alias(id_col))
    rows = docs.select(row.alias("row"), docs[id_col].alias("id"), normalised(docs[text_col]).alias("norm"))
    own = [] if carry else ["norm"]  # a carried text is normalised again where it is compared, instead of being kept twice
    rows = texts = staged(spark, rows.select("row", "id", *own, F.xxhash64("norm").alias("h"), F.substring("norm", 1, START_CHARS).alias("start")), "texts", "zstd")

    # how often each text occurs, to find the hot ones; counted before the shuffle and after
    counts = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    limit = max(SMALL_GROUP, rows.count() // (4 * n))
    hot = counts.where(F.col("n") > limit).select(F.col("h").alias("hot_h"), F.ceil(F.col("n") / F.lit(limit)).cast("int").alias("salts"))
    hot = staged(spark, hot, "hot-texts")  # at most 4n rows, as their counts sum to all rows at most
    any_hot = not hot.isEmpty()
    # rows of a hot text may share an id: their place in the table deals them out
    salted = rows.withColumn("place", F.monotonically_increasing_id()).join(F.broadcast(hot), rows["h"] == hot["hot_h"], "left") if any_hot else rows.withColumn("salts", F.lit(None).cast("int")).withColumn("place", F.lit(0))
    rows = salted.select("row", "id", *own, "h", "start", F.when(F.col("salts").isNull(), -1).otherwise(F.pmod(F.xxhash64("place"), F.col("salts")).cast("int")).alias("salt"))

    keys = ["start", "h", "salt"] if any_hot else ["start", "h"]  # a salt that is always the same would cost the window a second exchange
    placed = rows.repartitionByRange(n, *keys)
    if carry:
        placed = placed.withColumn("norm", normalised(F.col("row")[text_col]))
    group = Window.partitionBy(*keys, "norm").orderBy(F.col("id").asc_nulls_last())
    whole_group = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = placed.select(
        "row", "id", "h", "salt", "norm",
        F.min("id").over(whole_group).alias("part_keep"),
        F.count(F.lit(1)).over(whole_group).alias("part_size"),
        F.row_number().over(group).alias("place"),
    ).select("row", "id", "h", "salt", "part_keep", "part_size", "place", F.sha2("norm", 256).alias("text_sha256"), F.when((F.col("salt") >= 0) & (F.col("place") == 1), F.col("norm")).alias("part_text"))
    if not any_hot:
        return found.select("row", F.col("part_keep").alias("keep_id"), F.col("part_size").alias("group_size"), (F.col("place") == 1).alias("kept"), "text_sha256")
    found = staged(spark, found, "sorted-texts")
    for t in (hot, texts):
        discard(spark, t)
    parts = found.where(F.col("part_text").isNotNull())  # rows of hot texts: one of each part, at most 8n
    whole = parts.groupBy("part_text").agg(F.min("part_keep").alias("keep"), F.sum("part_size").alias("size"), F.min(F.struct(F.col("part_keep").isNull(), "part_keep", "salt"))["salt"].alias("first_salt"))
    # parts with equal texts meet in full; then (h, salt, digest) names a part: at most 8n rows
    keys = parts.join(whole, "part_text").select(F.col("h").alias("w_h"), F.col("salt").alias("w_salt"), F.col("text_sha256").alias("w_sha"), "keep", "size", "first_salt")
    out = found.join(F.broadcast(keys), (F.col("h") == F.col("w_h")) & (F.col("salt") == F.col("w_salt")) & (F.col("text_sha256") == F.col("w_sha")), "left")
    merged = F.col("w_h").isNotNull()
    return out.select(
        "row",
        F.when(merged, F.col("keep")).otherwise(F.col("part_keep")).alias("keep_id"),
        F.when(merged, F.col("size")).otherwise(F.col("part_size")).alias("group_size"),
        ((F.col("place") == 1) & (~merged | (F.col("salt") == F.col("first_salt")))).alias("kept"),
        "text_sha256",
    )


def dedup_report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return exact_dedup(spark, docs, carry=False).select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n"""
