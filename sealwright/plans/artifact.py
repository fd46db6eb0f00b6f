"""The sealed result row: status, counts, a replay hash, its check, and JSON lines of it."""

from __future__ import annotations

import json
from decimal import Decimal
from typing import IO, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import HashMismatchError, VersionMismatchError
from ..model import Contract, Policy
from ..operators.registry import Registry, default_registry
from ..sources.contracts import adapt

ENGINE_VERSION = "0.1.0"
PLANNER_VERSION = "0.1.0"
REPLAY_VERSION = "1"


def overall_status(unresolved: Column, required_unresolved: Column, acceptable: bool) -> Column:
    """SUCCESS without an unresolved field; else UNRESOLVED if a required one is and that isn't acceptable."""
    return F.when(unresolved == 0, "SUCCESS").when((required_unresolved > 0) & F.lit(not acceptable), "UNRESOLVED").otherwise("PARTIAL_SUCCESS")


def _hash(contract_id: Column) -> Column:
    """SHA-256 over the parts that make a result: versions, the plan, results by path, diagnostics, the input, counts,
    contract, capabilities."""
    by_path = F.array_sort(F.transform("results", lambda r: F.struct(r["field_path"].alias("p"), r.alias("r"))))
    parts = [F.lit(ENGINE_VERSION), F.lit(PLANNER_VERSION), F.lit(REPLAY_VERSION), F.col("execution_plan"), F.to_json(F.transform(by_path, lambda x: x["r"])), F.to_json("plan_diagnostics"), F.col("profile.content_hash"), F.to_json("statistics"), contract_id, F.to_json(F.array_sort(F.map_entries("capability_versions")))]
    return F.sha2(F.concat_ws("|", *parts), 256)


def seal(rows: DataFrame, contract: Contract, policy: Policy) -> DataFrame:
    """Adds status, normalized, unresolved, statistics, evidence's capability versions and the replay hash."""
    required = [f.path for f in contract.required()]
    missing = F.filter("results", lambda r: r["status"] == "UNRESOLVED")
    rows = rows.withColumn("unresolved", F.transform(missing, lambda r: r["field_path"]))
    of_required = F.size(F.filter("unresolved", lambda p: p.isin(required))) if required else F.lit(0)
    resolved = F.filter("results", lambda r: r["status"] == "RESOLVED")
    refs = F.flatten(F.transform(resolved, lambda r: r["evidence"]))
    names = F.array_sort(F.array_distinct(F.transform(refs, lambda e: e["capability_id"])))
    last = lambda n: F.element_at(F.filter(refs, lambda e: e["capability_id"] == n), -1)["capability_version"]
    rows = rows.select(
        "*",
        overall_status(F.size("unresolved"), of_required, policy.unresolved_acceptable).alias("status"),
        F.map_from_entries(F.transform(resolved, lambda r: F.struct(r["field_path"], r["value"]))).alias("normalized"),
        F.struct(F.size("results").alias("total"), F.size(resolved).alias("resolved"), F.size("unresolved").alias("unresolved")).alias("statistics"),
        F.map_from_entries(F.transform(names, lambda n: F.struct(n.alias("k"), last(n).alias("v")))).alias("capability_versions"),
        F.lit(contract.id).alias("contract_id"),
        F.lit(ENGINE_VERSION).alias("engine_version"),
    )
    return rows.withColumn("replay_hash", _hash(F.col("contract_id")))


# What an artifact's rows say, as array columns of them.


def all_evidence() -> Column:
    """References of the fields that were resolved."""
    return F.flatten(F.transform("results", lambda r: r["evidence"]))


def executed_evidence(candidates: Column) -> Column:
    """References of a step's run: each candidate's, once as the run's and once as the candidate's own."""
    return F.flatten(F.transform(candidates, lambda c: F.concat(c["evidence"], c["evidence"])))


def by_field(refs: Column, path: str) -> Column:
    return F.filter(refs, lambda e: e["field_path"] == path)


def by_capability(refs: Column, capability_id: str) -> Column:
    return F.filter(refs, lambda e: e["capability_id"] == capability_id)


def field_paths(refs: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(refs, lambda e: e["field_path"])))


def capability_ids(refs: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(refs, lambda e: e["capability_id"])))


def all_diagnostics() -> Column:
    """Those of planning and of the fields."""
    return F.concat("plan_diagnostics", F.flatten(F.transform("results", lambda r: r["diagnostics"])))


def by_code(notes: Column, code: str) -> Column:
    return F.filter(notes, lambda d: d["code"] == code)


def by_severity(notes: Column, severity: str) -> Column:
    return F.filter(notes, lambda d: d["severity"] == severity)


def errors(notes: Column) -> Column:
    return by_severity(notes, "ERROR")


def warnings(notes: Column) -> Column:
    return by_severity(notes, "WARNING")


def promoted(notes: Column) -> Column:
    """Those that a run is told of: errors, and warnings that inference isn't to be trusted."""
    return F.filter(notes, lambda d: (d["severity"] == "ERROR") | (d["severity"] == "WARNING") & (d["code"] == "INFERENCE_OUTPUT_UNTRUSTED"))


def _semver(version: Column) -> Column:
    return F.transform(F.split(version, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))


def replay(artifacts: DataFrame, registry: Registry | None = None, strict: bool = False, contract: Any = None) -> DataFrame:
    """`artifacts` with version_ok, capabilities_ok, hash_ok and the first failing reason; nothing is recomputed but the hash.

    The major version must be ours and the version not newer; each capability must be registered under some version.
    strict stops the run at a bad row. A contract that is given must be one that normalize() takes.
    """
    if contract is not None and not isinstance(contract, Contract):
        adapt(contract)
    own = _semver(F.lit(ENGINE_VERSION))
    known = sorted((registry or default_registry()).ids())
    version = (_semver(F.col("engine_version"))[0] == own[0]) & (_semver(F.col("engine_version")) <= own)
    caps = F.forall(F.map_keys("capability_versions"), lambda k: k.isin(known) if known else F.lit(False))
    checked = artifacts.select("*", F.coalesce(version, F.lit(False)).alias("version_ok"), F.coalesce(caps, F.lit(False)).alias("capabilities_ok"), F.coalesce(_hash(F.col("contract_id")) == F.col("replay_hash"), F.lit(False)).alias("hash_ok"))
    reason = F.when(~F.col("version_ok"), VersionMismatchError.code).when(~F.col("capabilities_ok"), "CAPABILITY_MISSING").when(~F.col("hash_ok"), HashMismatchError.code)
    if strict:
        reason = F.when(reason.isNotNull(), F.raise_error(reason).cast("string"))
    return checked.withColumn("reason", reason)


def encode(artifacts: DataFrame) -> DataFrame:
    """One JSON line per artifact, fields in the order of their names."""
    return artifacts.select(F.to_json(F.struct(*[F.col(c) for c in sorted(artifacts.columns)]), {"ignoreNullFields": "false"}).alias("value"))


def decode(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows of JSON lines; a line that is no object stops the run."""
    value = F.when(F.col("value").rlike(r"^\s*\{"), F.col("value")).otherwise(F.raise_error(F.lit("NOT_AN_OBJECT")).cast("string"))
    lines = lines.select(value.alias("value"))
    return lines.select(F.from_json("value", T.StructType(sorted(schema.fields, key=lambda f: f.name))).alias("a")).select("a.*")


def stable_dumps(value) -> str:
    """Compact JSON with sorted keys and ASCII escapes; decimals as text, dates in ISO form, bytes as 0x."""

    def other(x):
        if isinstance(x, Decimal):
            return str(x)
        if isinstance(x, (bytes, bytearray)):
            return "0x" + bytes(x).hex()
        if isinstance(x, (set, frozenset)):
            return sorted(x, key=repr)
        if hasattr(x, "isoformat"):
            return x.isoformat()
        if hasattr(x, "value"):
            return x.value
        if hasattr(x, "__dataclass_fields__"):
            return vars(x)
        if hasattr(x, "hex"):
            return x.hex
        raise TypeError(f"{type(x).__name__} has no JSON form")

    return json.dumps(value, sort_keys=True, separators=(",", ":"), default=other)


def stable_loads(text: str) -> Any:
    return json.loads(text)


def stable_dump(value, file: IO[str]) -> None:
    file.write(stable_dumps(value))


def stable_load(file: IO[str]) -> Any:
    return stable_loads(file.read())
