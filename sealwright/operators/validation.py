"""Validation: a configured value against configured constraints, always one candidate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.constraints import failures
from ..model import Constraint, Step
from . import candidates as C


def compile_step(step: Step, ctx) -> tuple[Column, Column]:
    from .registry import builtin

    spec = builtin()["validation"].spec
    value = step.config.get("value")
    column = value if isinstance(value, Column) else F.lit(None if value is None else str(value)).cast("string")
    given = step.config.get("constraints", ())
    known = [c for c in given if isinstance(c, Constraint)]
    failed = F.concat(failures(known, column), F.array(*[F.lit("not_a_constraint") for c in given if not isinstance(c, Constraint)]).cast("array<string>"))
    told = C.diagnostic("VALIDATION_FAILED", "WARNING", F.concat(F.lit("validation: "), F.array_join(failed, ",")), ctx.field_id)
    return F.array(C.candidate(column, C.of(spec, ctx.field_id))), F.when(F.size(failed) > 0, told).otherwise(C.no_diagnostics())
