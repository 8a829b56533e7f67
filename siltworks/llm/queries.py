"""The operators' queries over the synthetic tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, contentsort, jaccard, langid, lengthpack, licenses, linededup, rules, tokenpack, urlgraph
from .common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(spark, table(spark, sf_dir, "documents"), bpe.default_vocabulary())


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_report(spark, table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_report(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spark, table(spark, sf_dir, "documents")).drop("blocks")


def op5_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_report(spark, table(spark, sf_dir, "documents"))


def op6_url_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlgraph.judge(spark, table(spark, sf_dir, "pages"))


def op7_token_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenpack.pack(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, pad=50256)


def op8_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengthpack.pack_documents(spark, table(spark, sf_dir, "documents"))


def op9_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contentsort.dedup_report(spark, table(spark, sf_dir, "documents"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(spark, table(spark, sf_dir, "documents")).drop("text_hash")


def quality_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op 3 states about a text before anything is learned."""
    return rules.statistics(table(spark, sf_dir, "documents").select("doc_id", "text")).select("row.doc_id", *rules.STATISTICS, rules.base_failed().alias("base_failed"))


def license_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of op 4, without templates."""
    return licenses.scan(spark, table(spark, sf_dir, "documents"), {}).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of op 6, without the graph."""
    return urlgraph.ruled(table(spark, sf_dir, "pages"))


QUERIES = {
    "quality_statistics": quality_statistics,
    "license_places": license_places,
    "url_rules": url_rules,
    "op1_bpe": op1_bpe,
    "op2_langid": op2_langid,
    "op3_quality_rules": op3_quality_rules,
    "op4_licenses": op4_licenses,
    "op5_line_runs": op5_line_runs,
    "op6_url_graph": op6_url_graph,
    "op7_token_pack": op7_token_pack,
    "op8_length_buckets": op8_length_buckets,
    "op9_content_sort": op9_content_sort,
    "op10_jaccard": op10_jaccard,
}

#: Ops 3, 4 and 6 go on with what is learned or spreads over a graph; SQL states what they start from.
ORACLE_SQL: dict[str, str] = {
    "op5_line_runs": linededup.ORACLE,
    "op9_content_sort": contentsort.ORACLE,
    "quality_statistics": rules.ORACLE_STATISTICS,
    "license_places": licenses.ORACLE_PLACES,
    "url_rules": urlgraph.ORACLE_RULES,
}
