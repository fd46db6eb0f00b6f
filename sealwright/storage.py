"""Paths in the folder that all executors share, and what was written under them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from .errors import EngineError

#: Paths given out by new_path() and not deleted since, in order.
_written: list[str] = []


@cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="sealwright-")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local run takes a folder of its own and a cluster raises an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise EngineError("spark.checkpoint.dir must name a folder that all executors share", "NO_SHARED_FOLDER")
    return _own_dir()


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/sealwright/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
    if path in _written:
        _written.remove(path)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write `df` as a table in the shared folder and read it back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def forget(*frames: DataFrame | None) -> None:
    """Delete the tables of cut(); only for frames of which nothing is needed any more."""
    for df in frames:
        if path := getattr(df, "cut_path", None):
            delete(df.sparkSession, path)


@contextmanager
def workspace(spark: SparkSession, *keep: str) -> Iterator[list[str]]:
    """Delete on leaving what was written under the shared folder inside, but for the paths put into the list.

    Operators return frames that read what they have written meanwhile, so write their results before leaving.
    """
    before, kept = set(_written), list(keep)
    try:
        yield kept
    finally:
        for path in [p for p in _written if p not in before and p not in kept]:
            delete(spark, path)
