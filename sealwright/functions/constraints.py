"""Constraint predicates as Column expressions: each is (passes, reason), null-safe and never raising."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import Constraint, ConstraintKind


def java_pattern(pattern: str) -> str | None:
    """A Python pattern in Java's dialect, or None if it doesn't compile."""
    try:
        re.compile(pattern)
    except re.error:
        return None
    pattern = pattern.replace("(?P<", "(?<").replace(r"\Z", r"\z")
    pattern = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern)
    return "(?U)" + pattern if re.search(r"\\[dwsbDWSB]", pattern) else pattern


#: Text that is a number; Spark alone would take a type suffix ("1.0d") for part of one.
NUMBER = r"(?i)^[\s\p{Z}]*[+-]?(?:(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:e[+-]?[0-9]+)?|nan|inf|infinity)[\s\p{Z}]*\z"


def number(value: Column) -> Column:
    """A double of an integer, a double or text that is a number; null of decimals, booleans and all else, which bounds
    don't know. The type is known when the plan is made, so one branch is left of it."""
    kind = F.typeof(value)
    text = F.when(value.cast("string").rlike(NUMBER), value.cast("string").try_cast("double"))
    return F.when(kind == "string", text).when(kind.isin("tinyint", "smallint", "int", "bigint", "float", "double"), value.cast("string").try_cast("double"))


def check(c: Constraint, value: Column, is_text: bool = True) -> Column:
    """Whether `value` (text, a number or an array) passes. Null fails, as nothing can be measured on it.

    Bounds are inclusive whatever `inclusive` says, and NaN passes them; an unknown kind passes.
    """
    kind = c.kind
    if kind in (ConstraintKind.MIN_LENGTH, ConstraintKind.MAX_LENGTH):
        size = F.length(value) if is_text else F.size(value)
        bound = c["min"] if kind is ConstraintKind.MIN_LENGTH else c["max"]
        ok = size >= bound if kind is ConstraintKind.MIN_LENGTH else size <= bound
    elif kind is ConstraintKind.PATTERN:
        pattern = java_pattern(c["pattern"])
        ok = value.rlike(pattern) if pattern is not None else F.lit(False)
    elif kind in (ConstraintKind.MIN_VALUE, ConstraintKind.MAX_VALUE):
        x = number(value)
        bound = F.lit(float(c["min"] if kind is ConstraintKind.MIN_VALUE else c["max"]))
        ok = F.isnan(x) | (x >= bound if kind is ConstraintKind.MIN_VALUE else x <= bound)
    elif kind is ConstraintKind.ENUM:
        ok = value.isin(list(c["values"]))
    elif kind is ConstraintKind.ISO_4217:
        ok = value.rlike(r"^[A-Z]{3}\n?\z")
    else:
        ok = F.lit(True)
    return F.coalesce(ok, F.lit(False))


def failures(constraints, value: Column, is_text: bool = True) -> Column:
    """array<string> of the kinds that fail, in order."""
    if not constraints:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(~check(c, value, is_text), F.lit(c.kind.value)) for c in constraints]))
