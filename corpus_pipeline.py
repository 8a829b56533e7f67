"""The corpus pipeline: language, quality, exact copies, near copies, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor
kept; ``run`` writes each result as Parquet in the shared folder and reads it again.

Defined results, in each stage: a null text counts as empty, has no language and goes
in the first stage; of rows that repeat id and text one stays from exact copies on;
rows without an id are judged as any other, but where only such rows are near copies of each other
they all stay; texts of any length are read whole; an empty table gives an empty one; input
columns of any name are handed on, but for packing, which returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.llm import contentsort, jaccard, langid, lengthpack, rules
from siltworks.llm.common import discard, scratch, staged, table

#: Documents whose language is less certain than this are rejected, as are those without any.
MIN_SCORE = 0.1


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those that no language fits."""
    model = langid.train(spark, docs)
    out = langid.predict(spark, docs, model)
    return out.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)).select("row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail the base rule or a learned rule."""
    return rules.judged(spark, docs, table(spark, sf_dir, "labels")).where("kept").select("row.*")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised text, the one with the smallest id stays."""
    return contentsort.exact_dedup(spark, docs).where("kept").select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies, the document with the smallest id stays."""
    found = jaccard.near_duplicates(spark, docs)
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("id"), "text_hash")
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["id"]) & (F.xxhash64(docs["text"].cast("string")) == gone["text_hash"]), "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The batch of each document."""
    return lengthpack.pack_documents(spark, docs)


STAGES = [("language", language), ("quality", quality), ("exact copies", exact_copies), ("near copies", near_copies), ("packing", packing)]

#: SQL can't state the trained stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch() as keep:  # what a stage stages for itself goes when its result is written
            docs = keep(staged(spark, stage(spark, docs, sf_dir), name.replace(" ", "-")))
        if last is not None:
            discard(spark, last)
        last = docs
    return docs
