"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import os
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from ..plans.staging import shared_dir

#: The white space of every contract in this subpackage: blank and 0x09-0x0D.
WS_CLASS = r"[\x20\x09-\x0D]"
WS_CHARS = "\t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_package(spark: SparkSession) -> SparkSession:
    """Let Python workers that share this machine's files import the package; on a cluster it comes by --py-files."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in (path := env.get("PYTHONPATH", "").split(os.pathsep)):
        env["PYTHONPATH"] = os.pathsep.join([x for x in path if x] + [root])
    return spark


#: The tables that this process has written and not deleted yet, by the scope they belong to, and the folder that holds them.
_SCOPES: list[dict[str, SparkSession]] = [{}]
_RUN = uuid.uuid4().hex


def staged(spark: SparkSession, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor costs a reread."""
    path = f"{shared_dir(spark)}/siltworks/{_RUN}/{name}-{uuid.uuid4().hex}"
    _SCOPES[-1][path] = spark
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def folder(spark: SparkSession, name: str) -> str:
    """The name of a new folder beside the staged tables, deleted with their scope."""
    path = f"{shared_dir(spark)}/siltworks/{_RUN}/{name}-{uuid.uuid4().hex}"
    _SCOPES[-1][path] = spark
    return path


def delete(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table that ``staged`` wrote and that nothing reads any more."""
    for scope in _SCOPES:
        scope.pop(df._staged_path, None)
    delete(spark, df._staged_path)


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end what operators staged meanwhile, but for the tables given to ``keep``: a lazy result must be written before."""
    _SCOPES.append({})

    def keep(df: DataFrame) -> DataFrame:
        _SCOPES[-2][df._staged_path] = _SCOPES[-1].pop(df._staged_path)
        return df

    try:
        yield keep
    finally:
        for path, spark in _SCOPES.pop().items():
            delete(spark, path)


@atexit.register
def _clean() -> None:
    """What results of this process still read is deleted with the process."""
    for scope in _SCOPES:
        for path, spark in scope.items():
            with contextlib.suppress(Exception):  # the session may have ended
                delete(spark, os.path.dirname(path))
