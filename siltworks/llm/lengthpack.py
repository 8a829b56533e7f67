"""Packing by optimal length buckets.

Lengths are token counts of the whole texts. Their global histogram, one point for
each distinct length, goes through a dynamic program that picks the bucket boundaries
with the least padding; inside each bucket, rows form batches under a token budget.
The driver gets the histogram alone: as distinct lengths add up to the corpus at most,
T tokens have at most sqrt(2 T) of them. A layer of the program is one pass over the
points with a lower hull of lines, in exact integers.

Defined results: null or empty text has length 0 and goes to the first bucket; a row
longer than the budget is a batch of its own; repeated rows are packed each, and rows
without an id too; ties are ordered by id; texts of any length are read whole; an empty
table gives no row; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, with_package
from .tokenpack import cached_encoder

#: Rows of a bucket that one task orders: larger buckets are dealt out over several tasks.
ROWS_A_TASK = 20_000


def best_boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Of ascending lengths, at most ``buckets`` upper boundaries that minimise sum(count * (boundary - length)); the last length is always one."""
    n = len(lengths)
    if not n:
        return []
    rows = [0]
    for c in counts:
        rows.append(rows[-1] + int(c))
    # the padding of a bucket over points i..j is x[j] * rows(i..j) - sum(i..j) of length * count; the last term is the same for any choice
    cost, came = [int(x) * r for x, r in zip(lengths, rows[1:], strict=True)], []
    for _ in range(min(buckets, n) - 1):
        new, at = cost.copy(), np.full(n, -1, np.int32)
        # a bucket that ends at j and starts after i costs cost[i] - rows[i + 1] * x[j], and x[j] * rows[j + 1]: lines of falling slope at rising x
        hull: deque[tuple[int, int, int]] = deque()
        for j in range(1, n):
            slope, start = -rows[j], cost[j - 1]
            while len(hull) > 1:
                (m1, c1, _), (m2, c2, _) = hull[-2], hull[-1]
                if (start - c1) * (m1 - m2) > (c2 - c1) * (m1 - slope):
                    break
                hull.pop()
            hull.append((slope, start, j - 1))
            x = int(lengths[j])
            while len(hull) > 1 and hull[1][0] * x + hull[1][1] <= hull[0][0] * x + hull[0][1]:
                hull.popleft()
            through = hull[0][0] * x + hull[0][1] + x * rows[j + 1]
            if through < new[j]:
                new[j], at[j] = through, hull[0][2]
        came.append(at)
        cost = new
    out, j = [lengths[-1]], n - 1
    for at in reversed(came):
        if at[j] >= 0:
            j = int(at[j])
            out.append(lengths[j])
    return out[::-1]


def token_counts(spark: SparkSession, docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, no) of every row; no differs from row to row."""
    with open(ranks_path, encoding="ascii") as f:
        spec = with_package(spark).sparkContext.broadcast((f.read(), pattern))  # a vocabulary: about 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, no = cached_encoder(spec.value), TaskContext.get().partitionId() << 33
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                n = [len(x) for x in encode([t or "" for t in part.column(1).to_pylist()])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(range(no, no + len(n)), pa.int64())], ["doc_id", "n_tokens", "no"])
                no += len(n)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, no long")


def pack(spark: SparkSession, lengths: DataFrame, buckets: int = 16, budget: int = 1 << 16) -> DataFrame:
    """(doc_id, n_tokens, bucket, boundary, batch, place, batch_rows): each row's bucket, its batch there and its place in the batch, for rows (doc_id, n_tokens, no). batch is unique over all buckets. Lengths are read twice: a table of them serves best."""
    points = sorted((r["n_tokens"], r["n"]) for r in lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each distinct length
    bounds = best_boundaries([p for p, _ in points], [n for _, n in points], buckets) or [0]
    size = [sum(n for p, n in points if lo < p <= hi) for lo, hi in zip([-1, *bounds], bounds, strict=False)]
    pick = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("bucket") + 1)
    bucket = F.coalesce(*[F.when(F.col("n_tokens") <= b, F.lit(k)) for k, b in enumerate(bounds)], F.lit(len(bounds) - 1))
    placed = lengths.withColumn("bucket", bucket)
    placed = placed.withColumn("boundary", pick(bounds).cast("long")).withColumn("deal", F.pmod(F.xxhash64("no"), pick([max(1, -(-s // ROWS_A_TASK)) for s in size])).cast("int"))
    order = Window.partitionBy("bucket", "deal").orderBy("n_tokens", "doc_id", "no")
    per = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("boundary"), F.lit(1)))).cast("long")
    out = placed.withColumn("k", F.row_number().over(order) - 1).withColumn("per", per).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("bucket", "deal")))
    no = F.floor(F.col("k") / F.col("per")).cast("long")
    return out.select("doc_id", "n_tokens", "bucket", "boundary", F.concat_ws("-", "bucket", "deal", no).alias("batch"), (F.col("k") % F.col("per")).cast("long").alias("place"), F.least(F.col("per"), F.col("total") - no * F.col("per")).cast("long").alias("batch_rows"))


def pack_texts(spark: SparkSession, docs: DataFrame, ranks_path: str, pattern: str, buckets: int = 16, budget: int = 1 << 16) -> DataFrame:
    """As ``pack``, from the texts: they are encoded once, to a table of lengths."""
    return pack(spark, staged(spark, token_counts(spark, docs, ranks_path, pattern), "lengths"), buckets, budget)


def pack_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """With the byte-level vocabulary of the token-id output."""
    import public_tokenizers

    return pack_texts(spark, docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
