"""Building blocks of candidate columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import CapabilitySpec
from ..schemas import CANDIDATE, DIAGNOSTIC, EVIDENCE


def evidence(spec_id: str, version: str, tier: int, deterministic: bool, field_path: str, start: Column | None = None, end: Column | None = None, model: Column | None = None, used: tuple[Column, Column] | None = None) -> Column:
    """A reference; `model` and `used` (prompt and completion tokens) are those of an inference."""
    null = F.lit(None).cast("bigint")
    return F.struct(
        F.lit(spec_id).alias("capability_id"),
        F.lit(version).alias("capability_version"),
        F.lit(tier).alias("tier"),
        F.lit(deterministic).alias("deterministic"),
        F.lit(field_path).alias("field_path"),
        (null if start is None else start.cast("bigint")).alias("span_start"),
        (null if end is None else end.cast("bigint")).alias("span_end"),
        (F.lit(None).cast("string") if model is None else model).alias("model_id"),
        (null if used is None else used[0]).cast("int").alias("prompt_tokens"),
        (null if used is None else used[1]).cast("int").alias("completion_tokens"),
    ).cast(EVIDENCE)


def candidate(value: Column, *refs: Column) -> Column:
    return F.struct(
        F.lit(0).alias("pos"),
        value.cast("string").alias("value"),
        F.lit(None).cast("decimal(20,6)").alias("amount"),
        F.lit(None).cast("string").alias("currency"),
        F.array(*refs).alias("evidence"),
    ).cast(CANDIDATE)


def none() -> Column:
    return F.array().cast(f"array<{CANDIDATE}>")


def no_diagnostics() -> Column:
    return F.array().cast(f"array<{DIAGNOSTIC}>")


def diagnostic(code: str, severity: str, message: str | Column, field_path: str) -> Column:
    return F.array(F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), (F.lit(message) if isinstance(message, str) else message).alias("message"), F.lit(field_path).alias("field_path")).cast(DIAGNOSTIC))


def of(spec: CapabilitySpec, field_path: str, start: Column | None = None, end: Column | None = None) -> Column:
    return evidence(spec.id, spec.version, int(spec.tier), spec.deterministic, field_path, start, end)
