"""Readers. Files are rows (repo, path, text); nothing is collected."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import decoded, preprocess, strip

EXTENSIONS = (".c", ".h", ".cpp", ".cc", ".cxx", ".hpp", ".hxx")
BOM = "name string, author string, url string, stars int, language string, description string, commit_hash string"


def source_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(repo, path, text) of all files under root with these endings (case-sensitive): the glob prunes before any file is opened."""
    glob = "*{" + ",".join(extensions) + "}"
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    rest = F.regexp_replace(F.col("path"), "^.*?" + root.rstrip("/").replace(".", r"\.") + "/", "")
    return df.select(F.regexp_extract(rest, "^([^/]+)/", 1).alias("repo"), F.regexp_replace(rest, "^[^/]+/", "").alias("path"), decoded(F.col("content")).alias("text"))


def bom(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A JSON array of repositories: the rows with name, url and commit_hash, and the rejects."""
    df = spark.read.schema(BOM).json(path, multiLine=True)
    ok = F.col("name").isNotNull() & F.col("url").isNotNull() & F.col("commit_hash").isNotNull()
    return df.where(ok), df.where(~ok)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value) of the non-blank lines."""
    return spark.read.text(path).where(strip(F.col("value")) != "")


def json_or_text(df: DataFrame, column: str, schema: str, text_field: str) -> DataFrame:
    """Each line as a struct ``record``: the JSON object it holds if the text field is there, else the raw line as that field."""
    j = F.from_json(F.col(column), schema)
    ok = j[text_field].isNotNull()
    return df.withColumn("structured", F.coalesce(ok, F.lit(False))).withColumn("code", F.when(ok, j[text_field]).otherwise(F.col(column))).withColumn("record", j)


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(token, id) from a JSON object of ids, or from the first column of a TSV file in file order."""
    head = [r["value"] for r in spark.read.text(path).limit(1).collect()]
    if head and head[0].lstrip()[:1] in ("{", "["):
        whole = spark.read.text(path, wholetext=True)
        return whole.select(F.explode(F.from_json("value", "map<string,int>")).alias("token", "id"))
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\n\z", ""), "\n")).alias("id", "line"))
    return rows.select(F.split("line", "\t")[0].alias("token"), "id")


def training_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("step int, epoch int, loss double, accuracy double").json(path)


CONFIG = "vocab_size int, hidden_size int, num_hidden_layers int, num_attention_heads int, intermediate_size int, max_position_embeddings int, type_vocab_size int, pad_token_id int, hidden_act string, hidden_dropout_prob double, attention_probs_dropout_prob double, layer_norm_eps double, initializer_range double, model_type string"


def model_config(spark: SparkSession, path: str) -> DataFrame:
    """One row of CONFIG; what a file doesn't state is null."""
    return spark.read.schema(CONFIG).json(path, multiLine=True)


def checked_config(config: DataFrame):
    """The sizes of a one-row configuration, checked."""
    from ..plans.arguments import ModelConfig

    r = config.first()
    if r is None:
        raise ValueError("the configuration is empty")
    names = {"vocab_size": "vocab_size", "hidden_size": "hidden_size", "num_hidden_layers": "layers", "num_attention_heads": "heads", "intermediate_size": "intermediate_size", "max_position_embeddings": "max_positions", "type_vocab_size": "token_types"}
    return ModelConfig(**{to: r[c] for c, to in names.items() if r[c] is not None})


def processed_files(files: DataFrame, text: str = "text") -> DataFrame:
    """files with ``cleaned`` and the number of critical changes; only texts of more than 100 characters are checked, and one that can't be read (null) becomes an empty one."""
    from ..functions.code import semantic_issues

    t = F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("\0"), F.lit(""))
    df = files.withColumn("cleaned", F.coalesce(preprocess(t), F.lit("")))
    critical = F.size(F.filter(semantic_issues(t, F.col("cleaned")), lambda x: x["severity"] == "critical"))
    return df.withColumn("critical_issues", F.when(F.length(t) > 100, critical).otherwise(F.lit(0)).cast("long"))


def offset_index(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line_offset) of a JSON index ``{"line_offsets": [...]}``."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.from_json("value", "line_offsets array<bigint>")["line_offsets"]).alias("line_no", "line_offset"))


def lines_at(index: DataFrame, numbers: DataFrame, key: str = "line_no") -> DataFrame:
    """The indexed lines whose number ``numbers`` has: an equi join, where a seek would be one read at a time."""
    return index.join(numbers.select(key).distinct(), key, "left_semi")


def head(df: DataFrame, order: list[str], text: str, rows: int = 10) -> DataFrame:
    """The non-blank ones of the first rows."""
    return df.orderBy(*order).limit(rows).where(strip(F.col(text)) != "")


API = "name string, owner struct<login:string>, html_url string, stargazers_count int, language string, description string"


def bom_projection(repositories: DataFrame, commit_hash: str | Column) -> DataFrame:
    """Rows of a hosting service's answer (API) as rows of BOM."""
    return repositories.select("name", F.col("owner.login").alias("author"), F.col("html_url").alias("url"), F.col("stargazers_count").alias("stars"), "language", "description", (F.col(commit_hash) if isinstance(commit_hash, str) else commit_hash).alias("commit_hash"))


def top_repositories(spark: SparkSession, fetch: Callable[[str, int], str], language: str = "C", repositories: int = 100) -> DataFrame:
    """The best starred repositories of a language, by ``fetch``, which gets the language and the number and returns the service's JSON answer; none where it fails. The network is the caller's."""
    try:
        items = json.loads(fetch(language, repositories))["items"]
    except (OSError, ValueError, KeyError):
        items = []
    df = spark.createDataFrame([(json.dumps(x),) for x in items], "value string").select(F.from_json("value", API).alias("x")).select("x.*")
    return df.where(F.col("language") == language).orderBy(F.desc("stargazers_count"), "name").limit(repositories)


def latest_commits(boms: DataFrame, fetch: Callable[[str], str | None]) -> DataFrame:
    """boms with commit_hash by ``fetch``, which gets ``author/name`` on a worker; null where it fails. One call a row, so the service's limits set the pace, not Spark."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = []
            for full in f["author"].str.cat(f["name"], sep="/"):
                try:
                    found.append(fetch(full))
                except (OSError, ValueError):
                    found.append(None)
            yield f.assign(commit_hash=pd.Series(found, index=f.index, dtype=object))

    return boms.select(*[f.split()[0] for f in BOM.split(", ")]).mapInPandas(run, BOM)


def discovered_repositories(spark: SparkSession, root: str, max_depth: int = 1) -> DataFrame:
    """(name, path) of folders under root that hold a ``.git`` folder, down to a depth; of equal names the last path wins. Only folder names are listed, in any store: a scan would skip hidden folders."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs, found = path(root).getFileSystem(spark._jsc.hadoopConfiguration()), {}
    for depth in range(max_depth + 1):
        for x in fs.globStatus(path(root.rstrip("/") + "/*" * depth + "/.git")) or []:
            repo = x.getPath().getParent()
            if x.isDirectory() and "/.git/" not in f"{repo}/":
                found[repo.getName()] = max(str(repo), found.get(repo.getName(), ""))
    return spark.createDataFrame(sorted(found.items()), "name string, path string")


def git_info(repositories: DataFrame, path: str = "path") -> DataFrame:
    """repositories (name, path) with the commit and remote of each working tree, null where git has none. Runs where the folders are: on one machine, or on a mount that workers share."""

    def ask(folder: str, *args: str) -> str | None:
        try:
            return subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True, check=True, timeout=60).stdout.strip() or None
        except (OSError, subprocess.SubprocessError):
            return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            folders = [p.removeprefix("file:") for p in f["path"]]
            yield pd.DataFrame({"name": f["name"], "path": f["path"], "commit_hash": [ask(p, "rev-parse", "HEAD") for p in folders], "remote_url": [ask(p, "config", "--get", "remote.origin.url") for p in folders]})

    return repositories.select("name", F.col(path).alias("path")).mapInPandas(run, "name string, path string, commit_hash string, remote_url string")


def bom_updated(boms: DataFrame, local: DataFrame) -> DataFrame:
    """boms with the commit of the local tree of the same name, else of the same remote; a url is only filled in where there is none."""
    by_name = local.select(F.col("name").alias("n"), F.col("commit_hash").alias("n_hash"), F.col("remote_url").alias("n_url"))
    by_url = local.where("remote_url IS NOT NULL").groupBy(F.col("remote_url").alias("u")).agg(F.min(F.struct("name", "commit_hash"))["commit_hash"].alias("u_hash"))
    out = boms.join(by_name, boms["name"] == F.col("n"), "left").join(by_url, F.col("n").isNull() & (boms["url"] == F.col("u")), "left")
    new = {"commit_hash": F.coalesce("n_hash", "u_hash", boms["commit_hash"]), "url": F.coalesce(boms["url"], F.col("n_url"))}
    return out.select(*[new[c].alias(c) if c in new else boms[c] for c in boms.columns])
