"""Regex extraction with spans: all matches of a pattern, in Arrow batches of Python's own matcher."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.constraints import java_pattern
from ..model import Step
from . import candidates as C

MATCHES = "array<struct<value:string,start:bigint,end:bigint>>"


def find_all(pattern: str):
    """UDF text -> matches; the value of the one named group if there is one, else the whole match; spans are of the
    whole match, in code points. A named group that took no part gives no match."""

    @F.pandas_udf(MATCHES)
    def found(text: pd.Series) -> pd.Series:
        compiled = re.compile(pattern)
        name = next(iter(compiled.groupindex), 0)
        return text.map(lambda t: [] if t is None else [{"value": m[name], "start": m.start(), "end": m.end()} for m in compiled.finditer(t) if m[name] is not None])

    return found


def values(text: Column, pattern: str, group: int = 0) -> Column:
    """Values alone, which the JVM finds without Python; for patterns that mean the same in both dialects."""
    return F.regexp_extract_all(text, F.lit(java_pattern(pattern)), F.lit(group))


def compile_step(step: Step, ctx) -> tuple[Column, Column]:
    from .registry import builtin

    spec = builtin()["regex_extraction"].spec
    pattern = step.config.get("pattern")
    try:
        if not isinstance(pattern, str) or len(re.compile(pattern).groupindex) > 1:
            raise re.error("a pattern with at most one named group is needed")
    except re.error as e:
        return C.none(), C.diagnostic("CAPABILITY_INVOKE_FAILED", "ERROR", f"regex_extraction: {e}", ctx.field_id)
    found = find_all(pattern)(ctx.text)
    out = F.transform(found, lambda m: C.candidate(m["value"], C.of(spec, ctx.field_id, m["start"], m["end"])))
    return out, F.when(F.size(out) == 0, C.diagnostic("PATTERN_NO_MATCH", "INFO", "no match", ctx.field_id)).otherwise(C.no_diagnostics())
