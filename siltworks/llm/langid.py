"""Language identification by hierarchical discrimination.

Hashed byte n-grams of the whole text give a unit vector. A linear SVM for each
family picks the language family; inside it, one-versus-one linear SVMs vote
between the closely related languages. All are trained here, on the driver, with a
squared hinge loss on a bounded sample of labelled documents (SAMPLE_DOCS in all, the
same number of each of the MAX_LANGUAGES most frequent languages: those with the
smallest hashes, the same ones at any partitioning) and on shorter cuts of those same
documents, so that short texts are known too. The model has a few MB whatever the corpus.

Defined results: a null text or one without a letter is ``und`` with score 0; without
labelled documents everything is ``und``; a language that FAMILIES doesn't name is a
family of its own; repeated rows get repeated results; texts of any length are read
whole; an empty table gives no rows; ``predict`` carries the input's columns in one
struct, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import with_package

SAMPLE_DOCS, MAX_LANGUAGES, BUCKETS, ROUNDS, PENALTY = 800, 200, 4096, 120, 1e-4
FAMILIES = {
    "germanic": ("da", "de", "en", "is", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("bg", "cs", "hr", "pl", "ru", "sk", "sl", "sr", "uk"),
}
LETTER = re.compile(r"[^\W\d_]")


def vector(text: bytes) -> np.ndarray:
    """Square roots of the shares of each bucket's n-grams of 1 to 4 bytes: a vector of length 1."""
    b = np.frombuffer(b" " + text.lower() + b" ", np.uint8).astype(np.uint32)
    h, total = b * np.uint32(0x9E3779B1), np.zeros(BUCKETS)
    for n in range(1, 5):
        if n > 1:
            h = (h[:-1] * np.uint32(0x85EBCA6B)) ^ (b[n - 1 :] * np.uint32(0x9E3779B1) + np.uint32(n))
        if not len(h):
            break
        total += np.bincount((h >> np.uint32(20)).astype(np.int64), minlength=BUCKETS)
    return np.sqrt(total / total.sum()).astype(np.float32)


def cuts(text: bytes) -> list[bytes]:
    """The whole text, and pieces of about 200, 60 and 20 bytes from its middle."""
    words, out = text.split(), [text]
    for size in (200, 60, 20):
        at, piece = len(words) // 2, b""
        while at < len(words) and len(piece) < size:
            piece += b" " + words[at]
            at += 1
        out.append(piece or text)
    return out


@dataclass
class Model:
    families: list[str]
    languages: list[list[str]]
    family_w: np.ndarray
    pair_w: np.ndarray
    pairs: list[tuple[int, int, int]]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        squash = lambda m: 1 / (1 + np.exp(-4 * np.clip(m, -20, 20)))
        own = squash(x @ self.family_w[:-1] + self.family_w[-1])
        family = own.argmax(axis=1) if own.shape[1] else np.zeros(len(x), int)
        sure = own.max(axis=1) if own.shape[1] > 1 else np.ones(len(x))
        margins = squash(x @ self.pair_w[:-1] + self.pair_w[-1]) if self.pairs else np.zeros((len(x), 0))
        votes = [np.zeros((len(x), len(g))) for g in self.languages]
        for k, (f, a, b) in enumerate(self.pairs):
            votes[f][:, a] += margins[:, k]
            votes[f][:, b] += 1 - margins[:, k]
        names, score = [], np.empty(len(x))
        for i, f in enumerate(family):
            v = votes[f][i]
            k = int(v.argmax())
            names.append(self.languages[f][k])
            score[i] = sure[i] * (v[k] / max(len(v) - 1, 1) if len(v) > 1 else 1.0)
        return names, score


def train_svms(x: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Linear classifiers, one per column of targets (1, -1, or 0 for rows that a column doesn't use), by accelerated gradient steps on the squared hinge loss; the last row holds the offsets."""
    used = (targets != 0).astype(np.float32)
    n = np.maximum(used.sum(axis=0), 1)
    balance = used.copy()
    for sign in (1, -1):
        side = targets == sign
        balance[side] *= np.broadcast_to(n / (2 * np.maximum(side.sum(axis=0), 1)), targets.shape)[side]
    xb = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w = np.zeros((xb.shape[1], targets.shape[1]), np.float32)
    look, t, step = w.copy(), 1.0, 1 / (2 * 2 * 2 + PENALTY)
    for _ in range(ROUNDS):
        slack = np.maximum(0, 1 - targets * (xb @ look)) * balance
        grad = -2 * (xb.T @ (slack * targets)) / n + PENALTY * look
        new = look - step * grad
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        look, w = new + ((before - 1) / t) * (new - w), new
    return w


def fit(x: np.ndarray, y: list[str]) -> Model | None:
    known = sorted(set(y))
    if not known:
        return None
    family = {lang: next((f for f, g in FAMILIES.items() if lang in g), lang) for lang in known}
    families = sorted(set(family.values()))
    languages = [[g for g in known if family[g] == f] for f in families]
    lang, fam = np.array(y), np.array([family[v] for v in y])
    pairs = [(f, a, b) for f, g in enumerate(languages) for a, b in combinations(range(len(g)), 2)]
    by_family = np.stack([np.where(fam == f, 1, -1) for f in families], axis=1).astype(np.float32)
    by_pair = [np.where(lang == languages[f][a], 1, np.where(lang == languages[f][b], -1, 0)) for f, a, b in pairs]
    targets = np.hstack([by_family, np.stack(by_pair, axis=1)]) if by_pair else by_family
    w = train_svms(x, targets.astype(np.float32))
    return Model(families, languages, w[:, : len(families)], w[:, len(families) :], pairs)


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(spark: SparkSession, docs: DataFrame, sample: int = SAMPLE_DOCS) -> Model | None:
    """Learn from text and lang of documents that are not held out: at most ``sample`` distinct ones, as many of each language."""
    with_package(spark)
    rows = docs.select("doc_id", "text", "lang").where("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL").where(~held_out())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()}
    if not counts:
        return None
    each = max(1, sample // len(counts))
    # hashes below a language's bound are a few more than wanted, however many rows it has; the smallest are taken
    most = (1 << 63) - 1
    bound = F.create_map(*[F.lit(v) for k, n in sorted(counts.items()) for v in (k, min(most, int((each + 10 * each**0.5 + 20) / n * most)))])
    some = rows.withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1)).where(F.col("h") <= bound[F.col("lang")]).dropDuplicates(["lang", "h"])
    few = some.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= each)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, langs, xs = [], [], []
            for d, t, g in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for piece in cuts(t):
                    ids.append(d)
                    langs.append(g)
                    xs.append(vector(piece).astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(xs, pa.binary())], ["doc_id", "lang", "x"])

    got = few.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"), "lang").mapInArrow(vectors, "doc_id long, lang string, x binary").collect()  # four cuts of at most ``sample`` documents
    got.sort(key=lambda r: (r["doc_id"], r["x"]))
    if not got:
        return None
    return fit(np.stack([np.frombuffer(r["x"], np.float16) for r in got]).astype(np.float32), [r["lang"] for r in got])


def predict(spark: SparkSession, docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """(row, lang_pred, score): row is a struct of the input's columns. No shuffle; the columns pass through the worker as they are."""
    with_package(spark)
    held = spark.sparkContext.broadcast(model)
    n = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(n).to_pylist()]
            names, score = ["und"] * len(texts), np.zeros(len(texts))
            some = [k for k, t in enumerate(texts) if LETTER.search(t)]
            for at in range(0, len(some), 256):
                part = some[at : at + 256]
                if held.value is not None:
                    x = np.stack([vector(texts[k].encode()) for k in part])
                    for k, name, s in zip(part, *held.value.predict(x), strict=True):
                        names[k], score[k] = name, s
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(names, pa.string()), pa.array(score, pa.float64())], [*b.schema.names[:n], "lang_pred", "score"])

    fields = [T.StructField(f"c{k}", f.dataType) for k, f in enumerate(docs.schema)]  # by place: no name can clash
    out = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    found = docs.select(*[docs[c].alias(f.name) for c, f in zip(docs.columns, fields, strict=True)], docs[text_col].cast("string").alias(f"c{n}")).mapInArrow(run, out)
    return found.select(F.struct(*[F.col(f.name).alias(c) for c, f in zip(docs.columns, fields, strict=True)]).alias("row"), "lang_pred", "score")


def language_report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    model = train(spark, docs)
    out = predict(spark, docs.select("doc_id", "text"), model)
    return out.select("row.doc_id", "lang_pred", "score").select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
