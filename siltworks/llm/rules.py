"""Quality rules: learned decision lists over text statistics.

Sequential covering on labelled statistics: each rule grows by the threshold that
gains most (FOIL gain) on two thirds of the rows it has not covered, is pruned from its
end on the other third, and joins the list while it stays precise there. Thresholds
lie half-way between neighbouring values that tell the classes apart, so a statistic
that is 0 for nearly all rows is not cut at 0. The list
is emitted as one ordered CASE expression, evaluated in the scan; statistics,
learning input and verdicts use DataFrame functions only. Learning is bounded by
SAMPLE_ROWS labelled documents: those with the smallest hashes of their id.

Defined results: null or empty text has no words and fails the base rule; rows
without a usable label teach nothing; with no labels at all the list is empty and
the base rule alone decides; repeated rows get repeated verdicts and teach once; texts of any
length are read whole; an empty table gives no rows; the input's columns are carried in one
struct, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that the list is learned from at most.
SAMPLE_ROWS = 20_000
#: Rules in a list, conditions in a rule, and the least precision of a rule on pruning rows.
MAX_RULES, MAX_CONDITIONS, MIN_PRECISION = 8, 4, 0.9
#: Rows that a rule covers at least, of growing and of pruning rows.
MIN_COVER = 5

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
FEATURES = {
    "n_words": "n_words",
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_word_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
}


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _fixed(value: Column) -> Column:
    """value, below any later filter: a filter on it that sank into the scan would compute it anew for each word that it is made of. A condition that the optimizer takes for non-deterministic keeps it up."""
    return F.when(F.spark_partition_id() >= 0, value)


def _repeat_words(keys: Column) -> Column:
    """Words that lie in a 3-word window whose key occurs twice or more."""

    def covered(s: Column) -> Column:
        twin = lambda k: (F.get(s, k)["t"] == F.get(s, k - 1)["t"]) | (F.get(s, k)["t"] == F.get(s, k + 1)["t"])
        at = F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), twin), lambda k: F.get(s, k)["i"]))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(at, start, lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])

    return _let(F.sort_array(F.transform(keys, lambda t, i: F.struct(t.alias("t"), i.alias("i")))), covered)


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """row (a struct of the input's columns) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_word_lines (all long). They are columns, not fields of a struct: the optimizer would copy a struct's inputs to each place that reads a field."""
    own = docs.columns
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    strip = lambda t, chars: F.translate(t, chars, "")
    df = docs.select(F.struct(*[docs[c] for c in own]).alias("row"), text.alias("t"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"), F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    df = df.select("row", "t", F.size("words").alias("n_words"), F.array_join("words", "").alias("chars"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"), F.size("lines").alias("n_word_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"))
    df = df.select(
        "row", "n_words", "n_word_lines", "n_dup_lines",
        F.length("chars").alias("word_chars"),
        (F.length("chars") - F.length(F.regexp_replace("chars", r"[#*$%&|<>]", ""))).alias("n_symbols"),
        F.when(F.col("n_words") >= 3, F.transform(F.slice("hashes", 1, F.greatest(F.size("hashes") - 2, F.lit(0))), lambda h, i: F.xxhash64(h, F.get(F.col("hashes"), i + 1), F.get(F.col("hashes"), i + 2)))).otherwise(F.array().cast("array<bigint>")).alias("keys"),
    )
    repeats = F.when(F.size(F.array_distinct("keys")) == F.size("keys"), F.lit(0).cast("long")).otherwise(_repeat_words(F.col("keys")))
    return df.select("row", *[_fixed(F.col(c).cast("long")).alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_word_lines")], _fixed(repeats).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold


def _all(rule: tuple[Condition, ...], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, dtype=bool)
    for c in rule:
        out &= c.holds(x)
    return out


def best_cut(feature: str, values: np.ndarray, bad: np.ndarray) -> tuple[float, Condition | None]:
    """The threshold with the largest FOIL gain among the middles between all neighbouring values, and its gain."""
    order = np.argsort(values, kind="stable")
    v, b = values[order], bad[order]
    p_low, n_low = np.cumsum(b)[:-1], np.cumsum(~b)[:-1]
    p0, n0 = int(b.sum()), int((~b).sum())
    at = v[1:] > v[:-1]
    best, pick = 0.0, None
    for above in (True, False):
        p, q = (p0 - p_low, n0 - n_low) if above else (p_low, n_low)
        fits = at & (p >= MIN_COVER)
        if not fits.any():
            continue
        gain = np.where(fits, p * (np.log2(np.maximum(p, 1) / np.maximum(p + q, 1)) - np.log2(p0 / (p0 + n0))), -1.0)
        k = int(gain.argmax())
        if gain[k] > best + 1e-9:
            best, pick = float(gain[k]), Condition(feature, above, float((v[k] + v[k + 1]) / 2))
    return best, pick


def learn(x: dict[str, np.ndarray], bad: np.ndarray, prune: np.ndarray) -> list[tuple[Condition, ...]]:
    """Rules for the rows that ``bad`` marks; ``prune`` marks the rows held back for pruning."""
    n, left, rules = len(bad), np.ones(len(bad), dtype=bool), []
    while len(rules) < MAX_RULES and (bad & left & ~prune).sum() >= MIN_COVER:
        inside, rule = left & ~prune, ()
        while len(rule) < MAX_CONDITIONS and (~bad & inside).any():
            best, pick = 0.0, None
            for f in sorted(x):
                gain, c = best_cut(f, x[f][inside], bad[inside])
                if gain > best + 1e-9:
                    best, pick = gain, c
            if pick is None:
                break
            rule, inside = (*rule, pick), inside & pick.holds(x)
        worth = {}
        for k in range(len(rule), 0, -1):
            got = left & prune & _all(rule[:k], x, n)
            p, q = (bad & got).sum(), (~bad & got).sum()
            worth[k] = ((p - q) / (p + q) if p + q else -1.0, p, p + q)
        if not worth:
            break
        k = max(worth, key=lambda k: (worth[k][0], -k))
        _, p, seen = worth[k]
        if seen < MIN_COVER or p < MIN_PRECISION * seen:
            break
        rules.append(rule[:k])
        left &= ~_all(rule[:k], x, n)
    return rules


def labelled_sample(spark: SparkSession, docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> list:
    """Statistics and label of the ``rows`` labelled documents with the smallest hashes of their id, or of all if there are fewer. Of rows that share an id one is taken."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    total, most = usable.count(), (1 << 63) - 1
    # hashes below the bound are a few more than wanted, however many labels there are
    bound = min(most, int((rows + 10 * rows**0.5 + 20) / max(total, 1) * most))
    few = usable.withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id"), 1)).where(F.col("h") <= bound).orderBy("h", "doc_id").limit(rows).drop("h")
    # ``rows`` bounds the broadcast side
    picked = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text")).join(F.broadcast(few), "doc_id")
    s = statistics(picked).select("row.doc_id", "row.quality", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_word_lines", "n_repeat_words")
    s = s.groupBy("doc_id").agg(F.min(F.struct(*[c for c in s.columns if c != "doc_id"])).alias("s")).select("doc_id", "s.*").where(~base_failed())
    return s.selectExpr("doc_id", "quality = 0 AS bad", "pmod(xxhash64(doc_id, 'prune'), 3) = 0 AS prune", *[f"cast({e} AS double) AS f_{f}" for f, e in FEATURES.items()]).collect()


def learn_list(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> list[tuple[Condition, ...]]:
    got = sorted(labelled_sample(spark, docs, labels), key=lambda r: r["doc_id"])
    if not got:
        return []
    return learn({f: np.array([r[f"f_{f}"] for r in got]) for f in FEATURES}, np.array([r["bad"] for r in got], dtype=bool), np.array([r["prune"] for r in got], dtype=bool))


def as_case(rules: list[tuple[Condition, ...]]) -> Column:
    """The number of the first rule that fires, from 1; 0 where none does."""
    out = F.when(F.lit(False), F.lit(0))
    for k, rule in enumerate(rules, 1):
        fires = F.lit(True)
        for c in rule:
            v = F.expr(f"cast({FEATURES[c.feature]} AS double)")
            fires &= (v > c.threshold) if c.above else (v <= c.threshold)
        out = out.when(fires, F.lit(k))
    return out.otherwise(F.lit(0))


def judged(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """row (a struct of the input's columns) with its statistics, base_failed, rule and kept."""
    rules = learn_list(spark, docs, labels)
    out = statistics(docs).withColumn("base_failed", base_failed())
    return out.withColumn("rule", F.when(F.col("base_failed"), F.lit(0)).otherwise(as_case(rules))).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_report(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = judged(spark, docs.select("doc_id", "text"), labels)
    return out.select("row.doc_id", *STATISTICS, "base_failed", "kept", "rule")


#: The statistics by themselves.
ORACLE_STATISTICS = r"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT row_no, unnest(range(0, len(w) - 2)) AS i, unnest(list_transform(range(0, len(w) - 2), lambda k: list_slice(w, k + 1, k + 3))) AS gram FROM d WHERE len(w) >= 3),
r AS (SELECT row_no, i FROM (SELECT *, count(*) OVER (PARTITION BY row_no, gram) AS c FROM g) WHERE c > 1),
n AS (SELECT row_no, count(*) AS n FROM (SELECT DISTINCT row_no, unnest([i, i + 1, i + 2]) AS at FROM r) GROUP BY row_no),
s AS (SELECT row_no, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d)
SELECT doc_id, n_words, word_chars, n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n.n, 0) AS n_repeat_words, n_words < 50 OR 100 * coalesce(n.n, 0) > 50 * n_words AS base_failed
FROM s LEFT JOIN n USING (row_no)"""
