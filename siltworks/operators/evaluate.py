"""Evaluation metrics and statistics."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import staged
from .corpus import prefix_sums

IGNORE = -100


def ngrams(tokens: str, top: int, predicted: bool) -> Column:
    """ARRAY<STRUCT<n, gram, c, rc>> for n = 1..top: each gram counts in c if it is predicted, else in rc."""
    def grams(n: int) -> Column:
        starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda k: F.struct(F.lit(n).alias("n"), F.array_join(F.slice(tokens, k, F.lit(n)), " ").alias("gram"), F.lit(int(predicted)).alias("c"), F.lit(int(not predicted)).alias("rc")))

    return F.concat(*[grams(n) for n in range(1, top + 1)])


def bleu(pairs: DataFrame, key: str, prediction: str, reference: str, top: int = 4) -> DataFrame:
    """(key, bleu): geometric mean of clipped n-gram precisions up to min(top, tokens), without brevity penalty; 0 for an empty prediction.

    Grams of both sides are counted together, so nothing is joined: a join's sides look as small as the input and would be broadcast. A row of n = 0 stands for each pair."""
    pair = F.array(F.struct(F.lit(0).alias("n"), F.lit("").alias("gram"), F.lit(1).alias("c"), F.lit(0).alias("rc")))
    counts = pairs.select(key, F.explode(F.concat(pair, ngrams(prediction, top, True), ngrams(reference, top, False))).alias("g")).groupBy(key, "g.n", "g.gram").agg(F.sum("g.c").alias("c"), F.sum("g.rc").alias("rc"))
    hits = counts.groupBy(key, "n").agg(F.sum(F.least("c", "rc")).alias("hit"), F.sum("c").alias("all"))
    precision = F.when((F.col("n") > 0) & (F.col("all") > 0), F.log(F.greatest(F.col("hit") / F.col("all"), F.lit(1e-10))))
    score = hits.groupBy(key).agg(F.coalesce(F.exp(F.avg(precision)), F.lit(0.0)).alias("bleu"), F.sum(F.when(F.col("n") == 0, F.col("all"))).cast("int").alias("times"))
    return score.select(key, "bleu", F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("pair")).drop("pair")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(1e-8))


def binary_metrics(rows: DataFrame, label: str, score: str, cut: float = 0.5) -> DataFrame:
    hit, real = F.col(score) > cut, F.col(label) == 1
    n = rows.agg(F.count_if(hit & real).alias("tp"), F.count_if(hit & ~real).alias("fp"), F.count_if(~hit & real).alias("fn"))
    div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    n = n.withColumns({"precision": div(F.col("tp"), F.col("tp") + F.col("fp")), "recall": div(F.col("tp"), F.col("tp") + F.col("fn"))})
    return n.withColumn("f1", div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def roc_auc(rows: DataFrame, label: str, score: str) -> DataFrame:
    """Tie-aware area from the counts of each distinct score, added up in the order of scores over range partitions."""
    by = rows.groupBy(F.col(score).alias("score")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("q"))
    by = prefix_sums(by, ["score"], {"below": F.col("q")})
    won = by.agg(F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)).alias("w"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    return won.select(F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("w") / (F.col("p") * F.col("q"))).otherwise(0.0).alias("auc"))


def batch_auc(rows: DataFrame, batch: str, label: str, score: str) -> DataFrame:
    """(batch, auc) of many small batches: 0 for one with a single class."""
    by = rows.groupBy(batch, F.col(score).alias("score")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("q"))
    below = F.coalesce(F.sum("q").over(Window.partitionBy(batch).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = by.select(batch, "p", "q", (F.col("p") * (below + F.col("q") / 2)).alias("w")).groupBy(batch).agg(F.sum("w").alias("w"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    return won.select(batch, F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("w") / (F.col("p") * F.col("q"))).otherwise(0.0).alias("auc"))


def weighted_prf(rows: DataFrame, label: str, prediction: str) -> DataFrame:
    """Support-weighted precision, recall, F1, and accuracy from the confusion counts."""
    c = rows.where(F.col(label) != IGNORE).groupBy(F.col(label).alias("l"), F.col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    side = c.select(F.explode(F.array(F.struct(F.col("l").alias("k"), F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("support"), F.lit(0).cast("long").alias("chosen")), F.struct(F.col("p").alias("k"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("support"), F.col("n").alias("chosen")))).alias("s")).select("s.*").groupBy("k").agg(*[F.sum(x).alias(x) for x in ("tp", "support", "chosen")])
    div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    m = side.withColumns({"pr": div(F.col("tp"), F.col("chosen")), "re": div(F.col("tp"), F.col("support"))}).withColumn("f", div(2 * F.col("pr") * F.col("re"), F.col("pr") + F.col("re")))
    w = lambda x: F.sum(F.col(x) * F.col("support")) / F.sum("support")
    return m.agg(w("pr").alias("precision"), w("re").alias("recall"), w("f").alias("f1"), (F.sum("tp") / F.sum("support")).alias("accuracy"))


def student_cdf(t: float, df: float) -> float:
    """Student's t distribution by the continued fraction of the incomplete beta function."""
    x, a, b = df / (df + t * t), df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0

    def fraction(x: float, a: float, b: float) -> float:
        c, d, tiny = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300), 1e-300
        h = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 / (1 + num * d or tiny), 1 + num / c or tiny
                h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return h

    if x <= 0 or x >= 1:
        tail = float(x >= 1)
    elif x < (a + 1) / (a + b + 2):
        tail = front * fraction(x, a, b) / a
    else:
        tail = 1 - front * fraction(1 - x, b, a) / b
    return 1 - tail / 2 if t > 0 else tail / 2


def student_quantile(q: float, df: float) -> float:
    lo, hi = -1e6, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if student_cdf(mid, df) < q else (lo, mid)
    return (lo + hi) / 2


def interval(rows: DataFrame, key: str, value: str, confidence: float = 0.95) -> DataFrame:
    """(key, n, mean, lower, upper); (0, 0) below two rows. The quantile depends on the group's size alone: Python sees one row per group."""
    s = rows.groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))

    def run(batches):
        for pdf in batches:
            half = np.array([student_quantile((1 + confidence) / 2, n - 1) * sd / n**0.5 if n > 1 else 0.0 for n, sd in zip(pdf["n"], pdf["sd"])])
            ok = (pdf["n"] > 1).to_numpy()
            pdf["lower"], pdf["upper"] = np.where(ok, pdf["mean"] - half, 0.0), np.where(ok, pdf["mean"] + half, 0.0)
            yield pdf[[key, "n", "mean", "lower", "upper"]]

    kind = dict(s.dtypes)[key]
    return s.mapInPandas(run, f"{key} {kind}, n long, mean double, lower double, upper double")


def t_test(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Pooled two-sample statistic of groups 0 and 1, in one pass."""
    at = lambda k: F.when(F.col(group) == k, F.col(value))
    s = rows.agg(*[f(at(k)).alias(f"{n}{k}") for k in (0, 1) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    pooled = ((F.col("n0") - 1) * F.col("v0") + (F.col("n1") - 1) * F.col("v1")) / (F.col("n0") + F.col("n1") - 2)
    return s.select("n0", "n1", F.when((F.col("n0") > 1) & (F.col("n1") > 1), (F.col("m0") - F.col("m1")) / F.sqrt(pooled * (1 / F.col("n0") + 1 / F.col("n1")))).otherwise(0.0).alias("t"))


def t_test_p(rows: DataFrame, group: str, value: str) -> DataFrame:
    def run(batches):
        for pdf in batches:
            pdf["p_value"] = [2 * (1 - student_cdf(abs(t), a + b - 2)) if min(a, b) > 1 else 1.0 for t, a, b in zip(pdf["t"], pdf["n0"], pdf["n1"])]
            pdf["significant"] = pdf["p_value"] < 0.05
            yield pdf

    return t_test(rows, group, value).mapInPandas(run, "n0 long, n1 long, t double, p_value double, significant boolean")


# ---- composed evaluations ----
def beside(*frames: DataFrame) -> DataFrame:
    """Frames of one row each as one row; one without a row leaves nulls."""
    out = frames[0].withColumn("_one", F.lit(1))
    for f in frames[1:]:
        out = out.join(F.broadcast(f.withColumn("_one", F.lit(1))), "_one", "left")
    return out.drop("_one")


def pooled_scores(rows: DataFrame, logits: str, labels: str) -> DataFrame:
    """rows with prob, prediction and label: class logits averaged over the places whose label isn't ignored, softmax of class 1, the larger class, and the first place's label. Rows whose label is ignored go."""
    pairs = F.filter(F.arrays_zip(F.col(logits).alias("x"), F.col(labels).alias("y")), lambda t: t["y"] != IGNORE)
    total = lambda k: F.aggregate(F.transform("_pairs", lambda t: t["x"][k].cast("double")), F.lit(0.0), lambda s, v: s + v) / F.greatest(F.size("_pairs"), F.lit(1))
    df = rows.withColumn("_pairs", pairs).withColumns({"_a": total(0), "_b": total(1)})
    df = df.withColumns({"prob": 1 / (1 + F.exp(F.col("_a") - F.col("_b"))), "prediction": F.when(F.col("_b") > F.col("_a"), 1).otherwise(0), "label": F.get(F.col(labels), F.lit(0))})
    return df.where(F.col("label") != IGNORE).drop("_pairs", "_a", "_b")


def detection_batches(rows: DataFrame, batch: str) -> DataFrame:
    """(batch, accuracy, precision, recall, f1, auc) of pooled rows (prob, prediction, label)."""
    hit, real = F.col("prediction") == 1, F.col("label") == 1
    n = rows.groupBy(batch).agg(F.avg((F.col("prediction") == F.col("label")).cast("int")).alias("accuracy"), F.count_if(hit & real).alias("tp"), F.count_if(hit & ~real).alias("fp"), F.count_if(~hit & real).alias("fn"))
    div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    n = n.withColumns({"precision": div(F.col("tp"), F.col("tp") + F.col("fp")), "recall": div(F.col("tp"), F.col("tp") + F.col("fn"))})
    n = n.withColumn("f1", div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return n.join(batch_auc(rows, batch, "label", "prob"), batch).select(batch, "accuracy", "precision", "recall", "f1", "auc")


def batch_means(batches: DataFrame, *columns: str) -> DataFrame:
    """Means over batches, each counting alike, and their number: so the batch size has a say in the result."""
    return batches.agg(F.count(F.lit(1)).alias("batches"), *[F.avg(c).alias(f"average_{c}") for c in columns])


def task_results(batches: DataFrame, task: str, samples: str = "samples", metrics: tuple[str, ...] = ()) -> DataFrame:
    """The result of an evaluation from its batches (loss, accuracy, samples and the task's metrics): means over batches, and for masked language modelling the perplexity of the mean loss. Zeros where there is no batch."""
    out = batches.agg(F.coalesce(F.avg("loss"), F.lit(0.0)).alias("average_loss"), F.coalesce(F.avg("accuracy"), F.lit(0.0)).alias("average_accuracy"), *[F.avg(m).alias(f"average_{m}") for m in metrics], F.coalesce(F.sum(samples), F.lit(0)).cast("long").alias("num_samples"))
    return out.withColumns({"task": F.lit(task), "average_perplexity": F.exp("average_loss") if task == "mlm" else F.lit(0.0)})


def unfinished(batches: DataFrame, done: DataFrame, batch: str = "batch") -> DataFrame:
    """Batches that an interrupted evaluation has not written yet: ``done`` is the table that it appends to."""
    return batches.join(done.select(batch).distinct(), batch, "left_anti")


def model_evaluation(rows: DataFrame, batch: str, logits: str, ids: str, mask: str) -> DataFrame:
    """(loss, accuracy, perplexity): mean over batches of the mean cross entropy of places whose id isn't 0, and the share of right places among those that the mask has."""
    places = rows.select(batch, F.explode(F.arrays_zip(F.col(logits).alias("x"), F.col(ids).alias("id"), F.col(mask).alias("m"))).alias("t")).select(batch, F.transform("t.x", lambda v: v.cast("double")).alias("x"), "t.id", "t.m")
    best = F.array_max("x")
    total = F.aggregate(F.transform("x", lambda v: F.exp(v - best)), F.lit(0.0), lambda s, v: s + v)
    loss = F.log(total) + best - F.get(F.col("x"), F.col("id"))
    right = (F.array_position("x", best) - 1 == F.col("id")) & (F.col("m") == 1)
    per = places.groupBy(batch).agg(F.avg(F.when(F.col("id") != 0, loss)).alias("loss"), F.count_if(right).alias("hits"), F.count_if(F.col("m") == 1).alias("places"))
    return per.agg(F.avg("loss").alias("loss"), (F.sum("hits") / F.greatest(F.sum("places"), F.lit(1))).alias("accuracy"), F.exp(F.avg("loss")).alias("perplexity"))


def mlm_task(pairs: DataFrame, key: str, predicted: str, reference: str, tokens: DataFrame) -> DataFrame:
    """One row: token accuracy of ``tokens`` (prediction, label), exact match, BLEU, AST similarity and its interval over pairs of texts."""
    from ..functions.code import ast_similarity
    from ..functions.text import WS, strip

    words = lambda c: F.filter(F.split(F.col(c), f"{WS}+"), lambda w: w != "")
    scores = bleu(pairs.select(key, words(predicted).alias("p"), words(reference).alias("r")), key, "p", "r").agg(F.avg("bleu").alias("bleu_score"))
    each = pairs.select(F.lit(0).alias("all"), (strip(F.col(predicted)) == strip(F.col(reference))).cast("int").alias("same"), ast_similarity(F.col(predicted), F.col(reference)).alias("similarity"))
    same = each.agg(F.avg("same").alias("exact_match"), F.avg("similarity").alias("ast_similarity"))
    kept = tokens.where(F.col("label") != IGNORE)
    right = kept.agg(F.coalesce(F.avg((F.col("prediction") == F.col("label")).cast("int")), F.lit(0.0)).alias("token_accuracy"))
    bounds = interval(each, "all", "similarity").select(F.col("lower").alias("ast_similarity_lower"), F.col("upper").alias("ast_similarity_upper"))
    return beside(right, same, scores, bounds)


#: Draws of a bootstrap that one task makes.
DRAWS_A_TASK = 2_000_000


def bootstrap_means(numbered: DataFrame, value: str, number: str, resamples: int) -> DataFrame:
    """(rep, v): the mean of each resample of rows numbered from 0. Draws look their value up in a broadcast of one value a row and are added up where they are made: only the sums of each resample move."""
    from ..functions.code import uniform

    x = staged(numbered.sparkSession, numbered.select(number, value), "numbered")
    n = x.count()
    reps = F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("rep")
    draws = x.select(number).repartition(-(-n * resamples // DRAWS_A_TASK) or 1, number).select(reps, number).select("rep", F.floor(uniform(F.col("rep"), F.col(number)) * F.lit(n)).alias("pick"))
    return draws.join(F.broadcast(x.select(F.col(number).alias("pick"), value)), "pick").groupBy("rep").agg((F.sum(value) / F.count(F.lit(1))).alias("v"))


def vulnerability_task(rows: DataFrame, label: str, score: str) -> DataFrame:
    """One row: precision, recall and F1 at 0.5, and the area under the curve; the scores' interval is ``bootstrap``'s."""
    return beside(binary_metrics(rows, label, score).select("precision", "recall", "f1"), roc_auc(rows, label, score))


def cross_validation(rows: DataFrame, fold: str, value: str) -> DataFrame:
    """One row: the mean of the folds' means, their population deviation, the means by fold, and their interval."""
    means = rows.groupBy(fold).agg(F.avg(value).alias("score"))
    bounds = interval(means.withColumn("all", F.lit(0)), "all", "score").select(F.col("lower").alias("cv_lower"), F.col("upper").alias("cv_upper"))
    one = means.agg(F.avg("score").alias("cv_mean"), F.stddev_pop("score").alias("cv_std"), F.transform(F.array_sort(F.collect_list(F.struct(fold, "score"))), lambda x: x["score"]).alias("cv_scores"))  # a row for each fold
    return beside(one, bounds)
