"""Line deduplication on levelled sorted runs of line hashes.

Documents come in batches. A batch counts, for each 128-bit hash of a line's key, the
documents that hold it; the counts are merge-anti-joined with the settled run (keys
already known to be common) and written as a run: a table in buckets by hash, each
bucket sorted. When a level holds FANOUT runs, a merge join of their buckets makes them one run of the
next level, without a shuffle, and keys that reach the threshold move to the settled run. Lines whose
keys are common in the end are dropped.

Runs, levels and the settled run are listed in a manifest beside them. It is written
anew after each step, and what it no longer lists is deleted only then: a later
session that opens the folder goes on from the last complete step.

The common keys go to the workers as one broadcast while they are at most
MAX_BROADCAST; beyond that, lines are joined with them by key in a shuffle.

Defined results: null or empty text is one empty line, which has no key and stays;
each row counts as one document (a repeated row as another); kept text of a document
that loses all lines is empty; texts and lines of any length are read whole; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS_CHARS, delete, discard, folder, staged, with_package

MIN_DOCS, MIN_CHARS, FANOUT, BATCHES = 10, 1, 2, 4
MAX_BROADCAST = 500_000
BLANKS = (" " + WS_CHARS).encode()


def line_keys(text: bytes | None, min_chars: int = MIN_CHARS) -> tuple[list[bytes], list[bytes | None]]:
    """The lines, and the hash of each line's key (None where the key is too short)."""
    lines, out = (text or b"").split(b"\n"), []
    for line in lines:
        key = line.strip(BLANKS).lower()  # of bytes: A-Z only
        long = len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars
        out.append(xxhash.xxh3_128_digest(key) if long else None)
    return lines, out


def line_counts(spark: SparkSession, texts: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(batch, key, n) of rows (batch, text): documents that hold a key, counted within small blocks of rows."""
    with_package(spark)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[tuple[int, bytes], int] = {}
            for no, t in zip(*(b.column(k).to_pylist() for k in range(2)), strict=True):
                for k in {k for k in line_keys(t, min_chars)[1] if k is not None}:
                    found[no, k] = found.get((no, k), 0) + 1
            no, key = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(no, pa.int32()), pa.array(key, pa.binary()), pa.array(found.values(), pa.int64())], ["batch", "key", "n"])

    return texts.select(F.col("batch").cast("int"), F.col("text").cast("string").cast("binary")).mapInArrow(keys, "batch int, key binary, n long")


class LineRuns:
    """Runs (key, n) by level, and the settled run of keys found in min_docs documents or more, in the folder ``path``; those that a former session left there are taken up."""

    def __init__(self, spark: SparkSession, path: str | None = None, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, fanout: int = FANOUT):
        self.spark, self.path = with_package(spark), (path or folder(spark, "line-runs")).rstrip("/")
        self.state = {"min_docs": min_docs, "min_chars": min_chars, "fanout": fanout, "buckets": int(spark.conf.get("spark.sql.shuffle.partitions")), "levels": [], "settled": None}
        self.step = 0
        self.tables: set[str] = set()
        fs, at = self._fs(self.path)
        if fs.exists(at):
            done = sorted(int(x.getPath().getName().rpartition("-")[2]) for x in fs.listStatus(at) if x.getPath().getName().startswith("manifest-") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS")))
            if done:
                self.step = done[-1]
                self.state = json.loads(spark.read.text(f"{self.path}/manifest-{self.step}").first()["value"])

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _commit(self, gone: list[str]) -> None:
        """Write the manifest of the new step, then delete what it no longer lists."""
        self.spark.createDataFrame([(json.dumps(self.state),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest-{self.step + 1}")
        self.step += 1
        for name in gone:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            self.tables.discard(name)
            delete(self.spark, f"{self.path}/{name}")
        delete(self.spark, f"{self.path}/manifest-{self.step - 1}")

    def _write(self, df: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        df.select("key", "n").write.format("parquet").bucketBy(self.state["buckets"], "key").sortBy("key").option("path", f"{self.path}/{name}").saveAsTable(name)
        self.tables.add(name)
        return name

    def _read(self, name: str) -> DataFrame:
        if name not in self.tables:
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (key BINARY, n BIGINT) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {self.state['buckets']} BUCKETS LOCATION '{self.path}/{name}'")
            self.tables.add(name)
        return self.spark.table(name)

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        """Counts of the runs added up, by merge joins of their buckets."""
        out = runs[0]
        for r in runs[1:]:
            out = out.join(r.select("key", F.col("n").alias("m")).hint("merge"), "key", "full").select("key", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
        return out

    def add(self, texts: DataFrame) -> None:
        """Take in one batch: a frame with one text column."""
        self.add_counts(line_counts(self.spark, texts.select(F.lit(0).alias("batch"), texts[texts.columns[0]].alias("text")), self.state["min_chars"]))

    def add_counts(self, counts: DataFrame) -> None:
        """Take in one batch as counts (key, n), which may repeat a key."""
        run = counts.groupBy("key").agg(F.sum("n").alias("n"))
        if self.state["settled"]:
            run = run.join(self._read(self.state["settled"]).select("key").hint("merge"), "key", "left_anti")
        self._place(0, self._write(run), [])

    def _place(self, level: int, run: str, gone: list[str]) -> None:
        """Put a run on a level; if that fills it, compact the level and go on with the next. One commit ends it all."""
        levels = self.state["levels"]
        while len(levels) <= level:
            levels.append([])
        levels[level].append(run)
        if len(levels[level]) < self.state["fanout"]:
            self._commit(gone)
            return
        runs, levels[level] = levels[level], []
        merged = self._write(self._merged([self._read(r) for r in runs]))
        full = self._read(merged).where(F.col("n") >= self.state["min_docs"])
        settled, self.state["settled"] = self.state["settled"], self._write(full if self.state["settled"] is None else self._merged([self._read(self.state["settled"]), full]))
        rest = self._write(self._read(merged).where(F.col("n") < self.state["min_docs"]))
        self._place(level + 1, rest, [*gone, *runs, merged, *([settled] if settled else [])])

    def common(self) -> DataFrame:
        """(key) of all lines found in min_docs documents or more; a table of its own."""
        runs = [self._read(r) for level in self.state["levels"] for r in level]
        out = self._merged(runs).where(F.col("n") >= self.state["min_docs"]).select("key") if runs else None
        settled = self._read(self.state["settled"]).select("key") if self.state["settled"] else None
        found = [x for x in (out, settled) if x is not None]
        if not found:
            found = [self.spark.createDataFrame([], "key binary")]
        return staged(self.spark, found[0] if len(found) == 1 else found[0].unionByName(found[1]), "common")

    def drop(self) -> None:
        """Delete the folder with all runs."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(self.spark, self.path)


def _kept(lines: list[bytes], keys: list[bytes | None], gone) -> tuple[bytes, int]:
    left = [x for x, k in zip(lines, keys, strict=True) if k is None or k not in gone]
    return b"\n".join(left), len(lines) - len(left)


OUT = "doc_id long, n_lines long, n_dropped long, kept binary"


def without_lines(spark: SparkSession, docs: DataFrame, common: DataFrame, min_chars: int = MIN_CHARS, max_broadcast: int = MAX_BROADCAST, digest: bool = False) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) of every row: the text without common lines, or its SHA-256 if ``digest``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    names = ["doc_id", "n_lines", "n_dropped", "kept"]

    def rows(ids: pa.Array, texts: list, gone: list) -> pa.RecordBatch:
        n, d, kept = [], [], []
        for t, g in zip(texts, gone, strict=True):
            lines, keys = line_keys(t, min_chars)
            left, lost = _kept(lines, keys, g)
            n.append(len(lines))
            d.append(lost)
            kept.append(hashlib.sha256(left).hexdigest().encode() if digest else left)
        return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(d, pa.int64()), pa.array(kept, pa.binary())], names)

    if common.count() <= max_broadcast:
        held = spark.sparkContext.broadcast(frozenset(bytes(r["key"]) for r in common.collect()))

        def by_broadcast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield rows(b.column(0), b.column(1).to_pylist(), [held.value] * b.num_rows)

        return texts.mapInArrow(by_broadcast, OUT)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, found = [], []
            for k, t in enumerate(b.column(2).to_pylist()):
                own = {x for x in line_keys(t, min_chars)[1] if x is not None}
                at += [k] * len(own)
                found += own
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(found, pa.binary())], ["d", "h", "key"])

    def by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield rows(b.column(0), b.column(1).to_pylist(), [frozenset(x or ()) for x in b.column(2).to_pylist()])

    # (id, hash of the text) names a row; rows that share both have the same lines
    named = texts.withColumn("h", F.xxhash64("text"))
    lost = named.select("doc_id", "h", "text").mapInArrow(keys, "d long, h long, key binary").join(common, "key").groupBy("d", "h").agg(F.collect_set("key").alias("gone")).withColumnRenamed("h", "lost_h")
    return named.join(lost, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h").eqNullSafe(F.col("lost_h"))), "left").select("doc_id", "text", "gone").mapInArrow(by_row, OUT)


def dedup_report(spark: SparkSession, docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256): the rows come as ``batches`` batches by their hash. Texts are read once for all batches and once for the result."""
    docs = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    counts = staged(spark, line_counts(spark, docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).alias("batch"), "text")), "line-counts")
    runs = LineRuns(spark)
    for k in range(batches):
        runs.add_counts(counts.where(F.col("batch") == k).select("key", "n"))
    common = runs.common()
    runs.drop()
    discard(spark, counts)
    return without_lines(spark, docs, common, digest=True).select("doc_id", "n_lines", "n_dropped", F.col("kept").cast("string").alias("kept_sha256"))


#: Each row counts as a document, also one that repeats another's id: rows are told apart by their place in the file.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT row_no, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT row_no) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(f.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY row_no"""
