"""The manifest source (id, input_file, contract_name), the batch run over it, and its summary."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import partial, reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..errors import EngineError
from ..operators.reconcile import Status
from ..plans.engine import normalize

SCHEMA = "id string, input_file string, contract_name string"
SAFE = r"^[A-Za-z0-9][A-Za-z0-9._-]*\z"


def load(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the CSV. An empty manifest, an unsafe id and a path that leaves the folder stop the run."""
    rows = spark.read.csv(path, header=True, schema=SCHEMA)
    bad = ~F.coalesce(F.col("id").rlike(SAFE), F.lit(False)) | F.coalesce(F.startswith("input_file", F.lit("/")) | F.col("input_file").rlike(r"(^|/)\.\.(/|\z)"), F.lit(True))
    n, wrong = rows.agg(F.count(F.lit(1)), F.count_if(bad)).first()
    if not n:
        raise EngineError("the manifest is empty", "EMPTY_MANIFEST")
    if wrong:
        raise EngineError(f"{wrong} rows of the manifest have an unsafe id or path", "UNSAFE_MANIFEST")
    return rows


def _exists(folder: str, batches):
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    for batch in batches:
        names = batch.column(0).to_pylist()
        found = store.get_file_info([f"{root}/{n}" for n in names]) if names else []
        yield batch.filter(pa.array([f.type == fs.FileType.NotFound for f in found], pa.bool_()))


def inputs(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """Manifest rows with their file's bytes; a file that is missing stops the run.

    Spark's file sources skip files of no bytes, so rows that find none are looked up, in tasks.
    """
    p = spark._jvm.org.apache.hadoop.fs.Path(folder.rstrip("/"))
    root = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(p).toString()
    name = F.expr(f"substring(path, {len(root) + 2})")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(name.alias("file"), F.col("content").alias("raw"))
    rows = manifest.join(files, F.col("input_file") == F.col("file"), "left").drop("file")
    folder = root if "://" in root else "file://" + root.removeprefix("file:")
    missing = rows.where("raw IS NULL").select("input_file").distinct().mapInArrow(partial(_exists, folder), "input_file string").first()
    if missing:
        raise EngineError(f"no input file {missing[0]}", "MISSING_INPUT")
    return rows.withColumn("raw", F.coalesce("raw", F.lit(b"")))


def run(spark: SparkSession, manifest_path: str, folder: str, contracts: Mapping[str, Any], out: str | None = None, **options: Any) -> tuple[DataFrame, DataFrame]:
    """(artifacts, summary): each contract's rows are normalized by its own compiled plan and put together.

    The manifest's own faults (none of its rows, an unsafe id, an unknown contract, a missing file) stop the run. Rows of
    a contract that can't be compiled fail: their status is FAILED and `error` says why, and the other rows go on. The
    files are read once, into a table by contract. With `out`, artifacts go there as JSON by status, the summary beside
    them, and both results are read from what was written.
    """
    rows = load(spark, manifest_path)
    names = sorted(r[0] for r in rows.select("contract_name").distinct().limit(len(contracts) + 1).collect())
    unknown = [n for n in names if n not in contracts]
    if unknown:
        raise EngineError(f"unknown contract {unknown[0]!r}", "UNKNOWN_CONTRACT")
    ready = storage.cut(inputs(spark, rows, folder), "inputs")
    done: list[DataFrame] = []
    for name in names:
        own = ready.where(F.col("contract_name") == name)
        try:
            done.append(normalize(own, contracts[name], raw="raw", **options).withColumn("error", F.lit(None).cast("string")))
        except (EngineError, ValueError, TypeError) as e:
            done.append(own.drop("raw").select("*", F.lit(Status.FAILED.value).alias("status"), F.lit(f"{type(e).__name__}: {e}").alias("error")))
    found = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), done)
    if not out:
        return found, summarize(found)
    texts = {c: F.to_json(c) for c in ("capability_versions", "normalized") if c in found.columns}
    found.withColumns(texts).write.partitionBy("status").json(f"{out}/artifacts")
    written = spark.read.json(f"{out}/artifacts")
    summarize(written).coalesce(1).write.json(f"{out}/run_summary")
    storage.forget(ready)
    return written, spark.read.schema(SUMMARY).json(f"{out}/run_summary")


SUMMARY = "total long, successful long, unresolved long, failed long"


def summarize(artifacts: DataFrame) -> DataFrame:
    """(total, successful, unresolved, failed) of a run."""
    count = lambda *names: F.count_if(F.col("status").isin(*names))
    return artifacts.agg(F.count(F.lit(1)).alias("total"), count("SUCCESS", "PARTIAL_SUCCESS").alias("successful"), count("UNRESOLVED").alias("unresolved"), F.count_if(~F.col("status").isin("SUCCESS", "PARTIAL_SUCCESS", "UNRESOLVED")).alias("failed"))


class NormalizeTool:
    """normalize() as a tool of an agent: what goes wrong is a result."""

    def __init__(self, contract: Any, function: Callable[..., DataFrame] = normalize, **options: Any):
        self.contract, self.function, self.options = contract, function, options

    def run(self, df: DataFrame, **options: Any) -> dict[str, Any]:
        try:
            return {"success": True, "output": self.function(df, self.contract, **self.options | options), "error": None}
        except Exception as e:
            return {"success": False, "output": None, "error": f"{type(e).__name__}: {e}"}
