"""Writers for the corpus, its index and reports; all go through Spark's committers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.corpus import offsets


def write_corpus(docs: DataFrame, path: str, order: list[str]) -> None:
    """One line per non-blank document, in order: the part files in the order of their names are the corpus."""
    docs.where(strip(F.col("text")) != "").orderBy(*order).select("text").write.text(path)


def write_offsets(docs: DataFrame, path: str, order: list[str]) -> None:
    """The byte offset of each line that ``write_corpus`` writes, in all part files together."""
    offsets(docs.where(strip(F.col("text")) != ""), order).select(*order, "line_offset").write.parquet(path)


def write_report(df: DataFrame, path: str, by: str | None = None, append: bool = False) -> None:
    """JSON lines, one folder per value of ``by`` (epochs), appended for logs."""
    w = df.write.mode("append" if append else "overwrite")
    (w.partitionBy(by) if by else w).json(path)


def write_repository_report(report: DataFrame, path: str, files: DataFrame | None = None, key: str = "repo") -> None:
    """The report, and with ``files`` each repository's rows of file metrics under ``files`` beside it, as they are: not gathered into one value."""
    write_report(report, f"{path}/report")
    if files is not None:
        write_report(files, f"{path}/files", by=key)


def write_monitor(batches: DataFrame, alerts: DataFrame, summary: DataFrame, path: str) -> None:
    """The monitor's window, alerts and summary."""
    for name, df in (("metrics", batches), ("alerts", alerts), ("summary", summary)):
        write_report(df, f"{path}/{name}")


def write_vocabulary(tokens: DataFrame, path: str, token: str = "token", at: str = "id") -> None:
    """One JSON object from token to id, by ascending id. A vocabulary is small by nature; it makes one line."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(at).alias("id"), F.col(token).alias("token"))))
    tokens.agg(F.to_json(F.map_from_arrays(F.transform(pairs, lambda p: p["token"]), F.transform(pairs, lambda p: p["id"]))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_embeddings(df: DataFrame, path: str, key: str, embedding: str) -> None:
    """A JSON list of floats for each row, beside its key."""
    df.select(key, F.col(embedding).cast("array<float>").alias("embedding")).write.mode("overwrite").json(path)


def write_bom(boms: DataFrame, path: str) -> None:
    """A JSON array, one row to a line; of a bill of materials there are as many rows as repositories."""
    rows = F.array_sort(F.collect_list(F.struct(*boms.columns)))
    boms.agg(F.concat(F.lit("["), F.array_join(F.transform(rows, lambda r: F.to_json(r)), ",\n"), F.lit("]")).alias("value")).coalesce(1).write.mode("overwrite").text(path)
