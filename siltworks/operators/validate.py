"""Checks of encoded batches, of code before and after processing, of training steps and checkpoints, and their report.

A result is a row (check_name, severity, passed, value, detail); a frame of results
has the key of what was checked beside it. ``report`` adds them up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import code as C
from ..functions.text import strip

SEVERITIES = ("info", "warning", "error", "critical")
REQUIRED = ("input_ids", "attention_mask")
#: What to do about a failed check.
REMEDIES = {
    "required_key": "return all required fields from the tokenizer",
    "input_ids_shape": "check how batches are padded",
    "sequence_length": "truncate, or allow longer sequences",
    "vocab_range": "check the size of the vocabulary",
    "batch_sequence_length": "check preprocessing and filters",
    "brace_balance": "review the removal of comments",
    "identifier_preservation": "check that processing keeps identifiers",
    "tokenization_sample": "check what the vocabulary covers",
    "training_batch_outputs": "return a loss from the model",
    "training_batch_loss": "check parameters and learning rate",
    "training_batch_validation": "mend the batch first",
    "checkpoint_file": "check how checkpoints are saved",
    "checkpoint_model_state": "check how the model is initialised",
}
RESULT = "struct<check_name:string,severity:string,passed:boolean,value:double,detail:string>"


def result(name: str, severity: str, failed: Column, value: Column | None = None, detail: Column | None = None) -> Column:
    """A failed check as a struct, null where it doesn't fail."""
    return F.when(failed, F.struct(F.lit(name).alias("check_name"), F.lit(severity).alias("severity"), F.lit(False).alias("passed"), (F.lit(None) if value is None else value).cast("double").alias("value"), (F.lit(None) if detail is None else detail).cast("string").alias("detail")))


def _rows(df: DataFrame, keys: list[str], checks: list[Column]) -> DataFrame:
    return df.select(*keys, F.explode(F.array_compact(F.array(*checks))).alias("r")).select(*keys, "r.*")


def batch_checks(rows: DataFrame, batch: str, max_length: int = 512, vocab_size: int = 30000, lengths: tuple[float, float] = (10, 1000)) -> DataFrame:
    """Failed checks of batches of encoded rows (batch, input_ids[, attention_mask]): keys, a common length, length, id range, mean count of non-zero ids. One aggregation of a few numbers a row."""
    missing = [k for k in REQUIRED if k not in rows.columns]
    if "input_ids" not in rows.columns:
        return _rows(rows.select(batch).distinct(), [batch], [result(f"required_key_{k}", "error", F.lit(True)) for k in missing])
    per = rows.select(batch, F.size("input_ids").alias("n"), F.array_max("input_ids").alias("top"), F.size(F.filter("input_ids", lambda x: x != 0)).alias("real"))
    b = per.groupBy(batch).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("top").alias("top"), F.avg("real").alias("mean"))
    checks = [result(f"required_key_{k}", "error", F.lit(True)) for k in missing] + [
        result("input_ids_shape", "error", F.col("least") != F.col("most"), F.col("most")),
        result("sequence_length", "warning", F.col("most") > max_length, F.col("most")),
        result("vocab_range", "error", F.col("top") >= vocab_size, F.col("top")),
        result("batch_sequence_length", "warning", ~F.col("mean").between(*lengths), F.round("mean", 6)),
    ]
    return _rows(b, [batch], checks)


def structure_checks(pairs: DataFrame, key: str, original: str, processed: str, most_names: int = 10) -> DataFrame:
    """Failed checks of code before and after processing: braces, and identifiers (the first few lost ones by name)."""
    o, p = F.col(original), F.col(processed)
    df = pairs.select(key, C.brace_balance(o).alias("a"), C.brace_balance(p).alias("b"), F.array_sort(F.array_except(C.plain_identifiers(o), C.plain_identifiers(p))).alias("gone"))
    return _rows(df, [key], [
        result("brace_balance", "error", F.col("a") != F.col("b")),
        result("identifier_preservation", "warning", F.size("gone") > 0, F.size("gone"), F.array_join(F.slice("gone", 1, most_names), ",")),
    ])


def sampled(pairs: DataFrame, key: str, rows: int = 100, seed: int = 7) -> DataFrame:
    """At most ``rows`` pairs, the same ones at any partitioning: the sample is what a preprocessing step is checked on."""
    return pairs.withColumn("_draw", F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))).orderBy("_draw", key).limit(rows).drop("_draw")


def round_trip_checks(samples: DataFrame, keys: list[str], text: str, decoded: str) -> DataFrame:
    """Failed checks of texts whose decoded form lost more than half their length."""
    a, b = F.length(strip(F.col(text))), F.length(strip(F.col(decoded)))
    return _rows(samples, keys, [result("tokenization_sample", "warning", b < a * 0.5, b)])


def training_checks(batches: DataFrame, batch: str, loss: str, critical: str) -> DataFrame:
    """One result per batch, by the first rule that holds: no loss, no finite loss, critical results in the batch, else passed."""
    x = F.col(loss)
    one = lambda name, severity, passed, value: F.struct(F.lit(name).alias("check_name"), F.lit(severity).alias("severity"), F.lit(passed).alias("passed"), value.cast("double").alias("value"), F.lit(None).cast("string").alias("detail"))
    none = F.lit(None)
    bad = F.isnan(x) | x.isin(float("inf"), float("-inf"))
    r = F.when(x.isNull(), one("training_batch_outputs", "error", False, none)).when(bad, one("training_batch_loss", "critical", False, none)).when(F.col(critical) > 0, one("training_batch_validation", "critical", False, F.col(critical))).otherwise(one("training_batch_validation", "info", True, none))
    return batches.select(batch, r.alias("r")).select(batch, "r.*")


def checkpoint_checks(spark: SparkSession, folder: str, parameters: int | None = None, files: tuple[str, ...] = ("config.json", "pytorch_model.bin")) -> DataFrame:
    """Failed checks of a checkpoint folder: its files, and that the model has any parameter. The folder may lie in any store that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    rows = [(f"checkpoint_file_{f}", "warning", False, None, f) for f in files if not fs.exists(path(folder, f))]
    if parameters == 0:
        rows.append(("checkpoint_model_state", "error", False, 0.0, None))
    return spark.createDataFrame(rows, RESULT).withColumn("folder", F.lit(folder))


def remedy(name: Column) -> Column:
    """What to do about a failed check, by the longest name that it starts with."""
    out = F.lit(None).cast("string")
    for k in sorted(REMEDIES, key=len):
        out = F.when(F.startswith(name, F.lit(k)), F.lit(REMEDIES[k])).otherwise(out)
    return out


def report(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Totals, each severity even where it has none, names of critical failures, distinct remedies. One row, or one for each group."""
    failed = ~F.col("passed")
    severity = [F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]
    names = F.collect_set(F.when(failed & (F.col("severity") == "critical"), F.col("check_name")))
    advice = F.collect_set(F.when(failed, remedy(F.col("check_name"))))  # at most one for each kind of check
    return results.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("total_checks"), F.count_if("passed").alias("passed"), F.count_if(failed).alias("failed"), *severity, F.array_join(F.array_sort(names), ",").alias("critical_checks"), F.array_join(F.array_sort(advice), "; ").alias("recommendations"))
