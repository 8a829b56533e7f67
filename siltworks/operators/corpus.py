"""Corpus rollups: repository report, duplicates, offsets."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import format_bytes
from ..plans.staging import staged

SIZE_LIMITS = [("<1KB", 1024), ("1-10KB", 10240), ("10-100KB", 102400)]


def repository_report(files: DataFrame, key: str = "repo") -> DataFrame:
    """One row per repository from per-file metrics: one shuffle of partial sums."""
    total = lambda c: F.sum(c).cast("long")
    out = files.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_files"), total("size_bytes").alias("total_bytes"), total("lines_total").alias("total_lines"), total("lines_code").alias("code_lines"), total("lines_comments").alias("comment_lines"), total("functions").alias("functions"), total("non_ascii_chars").alias("non_ascii"), total("complexity").alias("complexity"),
        F.count_if(F.col("size_bytes") < 1024).alias("under_1kb"), F.count_if(F.col("size_bytes").between(1024, 10239)).alias("kb_1_10"), F.count_if(F.col("size_bytes").between(10240, 102399)).alias("kb_10_100"), F.count_if(F.col("size_bytes") >= 102400).alias("over_100kb"),
        F.count_if(~F.col("has_includes") & F.col("path").endswith(".c")).alias("without_includes"), F.count_if(F.col("max_line_length") > 120).alias("long_line_files"),
    )
    per = lambda a, b, k=1.0: F.round(k * F.col(a) / F.greatest(F.col(b), F.lit(1)), 6)
    return out.withColumns({"comment_ratio": per("comment_lines", "total_lines"), "avg_file_size": per("total_bytes", "total_files"), "non_ascii_ratio": per("non_ascii", "total_bytes"), "function_density": per("functions", "code_lines", 1000.0), "complexity_score": per("complexity", "code_lines", 100.0)})


def quality_flags() -> Column:
    rule = lambda cond, name: F.when(cond, F.lit(name))
    return F.array_join(F.array_compact(F.array(rule(F.col("comment_ratio") < 0.1, "low_comments"), rule(F.col("non_ascii_ratio") > 0.01, "non_ascii"), rule(F.col("duplicate_ratio") > 0.05, "duplicates"), rule(F.col("avg_file_size") > 50000, "large_files"), rule(F.col("without_includes") > 0, "no_includes"), rule(F.col("long_line_files") > 0.1 * F.col("total_files"), "long_lines"))), ",")


SIZE_COLUMNS = {"under_1kb": "<1KB", "kb_1_10": "1-10KB", "kb_10_100": "10-100KB", "over_100kb": ">100KB"}


def report_text() -> Column:
    """A repository's report with its duplicate_ratio, and optionally a map ``extensions`` of files, as text for people."""
    n = F.greatest(F.col("total_files"), F.lit(1))
    count = lambda name, c: F.format_string(f"{name}: %,d", c)
    share = lambda name, c: F.format_string(f"{name}: %.2f%%", F.col(c) * 100.0)
    each = lambda name, c: F.format_string("  %s: %,d files (%.1f%%)", name, c, c * 100.0 / n)
    size = lambda name, c: F.concat(F.lit(f"{name}: "), format_bytes(F.floor(c).cast("double")))
    flags = quality_flags()
    lines = [
        count("files", F.col("total_files")), size("size", F.col("total_bytes")), count("lines", F.col("total_lines")), count("lines of code", F.col("code_lines")), size("mean size", F.col("avg_file_size")),
        share("comments", "comment_ratio"), share("non-ASCII", "non_ascii_ratio"), share("duplicates", "duplicate_ratio"), F.format_string("functions in 1000 lines: %.1f", "function_density"), F.format_string("branches in 100 lines: %.1f", "complexity_score"),
        F.lit("by size:"), *[each(F.lit(name), F.col(c)) for c, name in SIZE_COLUMNS.items()],
        F.when(flags == "", F.lit("no issues")).otherwise(F.concat(F.lit("issues: "), flags)),
    ]
    return F.array_join(F.array(*lines), "\n")


def extension_text(extensions: Column, files: Column) -> Column:
    """Files by extension, in the order of their names."""
    rows = F.array_sort(F.map_entries(extensions))
    return F.array_join(F.transform(rows, lambda x: F.format_string("  %s: %,d files (%.1f%%)", x["key"], x["value"], x["value"] * 100.0 / F.greatest(files, F.lit(1)))), "\n")


def duplicate_groups(files: DataFrame, folded: Column, key: list[str]) -> DataFrame:
    """Groups of more than one equal folded text, over files."""
    g = files.groupBy(*key, F.sha2(folded, 256).alias("h")).agg(F.count(F.lit(1)).alias("c"))
    return g.groupBy(*key).agg(F.sum("c").cast("long").alias("files"), F.count_if(F.col("c") > 1).alias("groups"), (F.count_if(F.col("c") > 1) / F.greatest(F.sum("c"), F.lit(1))).alias("duplicate_ratio"))


def prefix_sums(rows: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """rows with the sum of each column over all rows before it in ``order``, 0 for the first. Rows are staged before they are placed by range, since that reads them twice, and after; then sums within a partition, and the totals of those before it. No task gets all rows, only one row for each partition."""
    spark, tag = rows.sparkSession, f"_{uuid.uuid4().hex}_"
    part, names = f"{tag}part", {name: f"{tag}{k}" for k, name in enumerate(sums)}
    values = staged(spark, rows.withColumns({names[name]: c.cast("long") for name, c in sums.items()}), "values")
    placed = staged(spark, values.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "placed")
    totals = placed.groupBy(F.col(part).alias(f"{tag}at")).agg(*[F.sum(c).alias(f"{c}_all") for c in names.values()])
    earlier = Window.orderBy(f"{tag}at").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    before = totals.select(f"{tag}at", *[F.coalesce(F.sum(f"{c}_all").over(earlier), F.lit(0)).alias(f"{c}_before") for c in names.values()])
    inside = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"{c}_inside") for c in names.values()]).join(F.broadcast(before), F.col(part) == F.col(f"{tag}at"))
    return out.select(*rows.columns, *[(F.col(f"{c}_before") + F.col(f"{c}_inside")).alias(name) for name, c in names.items()])


def offsets(lines: DataFrame, order: list[str], text: str = "text") -> DataFrame:
    """lines with line_offset, the bytes of all lines before in ``order``, line ends included."""
    return prefix_sums(lines, order, {"line_offset": F.octet_length(text) + 1})


def row_numbers(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows numbered from 0 in ``order``."""
    return prefix_sums(rows, order, {name: F.lit(1)})
