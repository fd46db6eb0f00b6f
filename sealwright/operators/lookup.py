"""Lookup in a small table of the step's config, or in a table of any size by join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.profile import ASCII_SPACE
from ..model import Step
from . import candidates as C


def compile_step(step: Step, ctx) -> tuple[Column, Column]:
    from .registry import builtin

    spec = builtin()["lookup"].spec
    entries = step.config.get("table")
    if not isinstance(entries, dict) or not all(isinstance(k, str) and isinstance(v, str) for k, v in entries.items()):
        return C.none(), C.diagnostic("CAPABILITY_INVOKE_FAILED", "ERROR", "lookup: a table of strings is needed", ctx.field_id)
    key = step.config.get("key")
    key = F.lit(key) if key is not None else F.regexp_replace(ctx.text, rf"^[{ASCII_SPACE}]+|[{ASCII_SPACE}]+\z", "")
    lowered: dict[str, str] = {}
    for k, v in entries.items():
        lowered.setdefault(k.lower(), v)

    def table(d: dict[str, str]) -> Column:
        return F.create_map(*[F.lit(x) for kv in d.items() for x in kv]) if d else F.create_map().cast("map<string,string>")

    value = F.coalesce(F.try_element_at(table(entries), key), F.try_element_at(table(lowered), F.lower(key)))
    hit = F.coalesce(F.when(F.length(key) > 0, value.isNotNull()), F.lit(False))
    miss = F.when(F.length(key) == 0, C.diagnostic("CAPABILITY_INVOKE_FAILED", "ERROR", "lookup: the key is empty", ctx.field_id)).otherwise(C.diagnostic("PATTERN_NO_MATCH", "INFO", "no entry", ctx.field_id))
    return F.when(hit, F.array(C.candidate(value, C.of(spec, ctx.field_id)))).otherwise(C.none()), F.when(hit, C.no_diagnostics()).otherwise(miss)


def lookup_join(rows: DataFrame, key: str, table: DataFrame, table_key: str, table_value: str, order: str, out: str = "value") -> DataFrame:
    """`rows` with the value of the entry whose key is equal, else of the first entry (by `order`) equal in lower case.

    Catalyst picks a broadcast or a sort-merge join by the table's size; rows of a hot key are split by AQE.
    """
    entries = table.select(F.col(table_key).alias("__k"), F.col(table_value).alias("__v"), F.col(order).alias("__o"))
    first = lambda by: entries.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy("__o"))).where("__n = 1")
    exact = first("__k").select("__k", F.col("__v").alias("__exact"))
    folded = first(F.lower("__k")).select(F.lower("__k").alias("__l"), F.col("__v").alias("__folded"))
    joined = rows.join(exact, F.col(key) == F.col("__k"), "left").join(folded, F.lower(F.col(key)) == F.col("__l"), "left")
    return joined.withColumn(out, F.coalesce("__exact", "__folded")).drop("__k", "__l", "__exact", "__folded")
