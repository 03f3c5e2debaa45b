"""Tables written in the shared folder: lineage ends there, and a lost executor loses no part of them."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where that is unset, a temporary one on a local master alone: executors elsewhere couldn't read it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="strandline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/strandline/{tag}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].add(path)
    return path


#: What each open call of ``tidied`` has written, the innermost last.
_scopes: list[set[str]] = []


def tidied(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``build`` gives. Of the tables that were written on the way, only those that it reads stay."""
    _scopes.append(set())
    try:
        got = build()
    except BaseException:
        remove(spark, _scopes.pop())
        raise
    written = _scopes.pop()
    kept = {k for k in tables_of(got)} if written else set()
    remove(spark, {p for p in written if p.rsplit("/", 1)[1] not in kept})
    if _scopes:
        _scopes[-1].update(p for p in written if p.rsplit("/", 1)[1] in kept)
    return got


def tables_of(df: DataFrame) -> set[str]:
    """Names of the written tables that df reads."""
    return {f.rsplit("/strandline/", 1)[1].split("/")[0] for f in df.inputFiles() if "/strandline/" in f}


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back."""
    path = shared_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str, tag: str) -> DataFrame:
    """df with a number for each row in the column ``name``, written once.

    Numbers that each scan makes anew may name other rows each time: Spark cuts a scan by the cores that it has at the moment.
    """
    return materialise(df.withColumn(name, F.monotonically_increasing_id()), tag)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialise`` wrote and nothing reads any more."""
    remove(df.sparkSession, {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/strandline/" in f})
