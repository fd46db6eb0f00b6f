"""Reconciliation of candidate tables, one row a candidate: aggregations that combine before the shuffle."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ReconciliationError
from ..functions.money import check_rate, quantize
from ..model import Contract, CurrencyPolicy, Merge
from .reconcile import band, score

#: Columns of a candidate table beside its key: order, value and the candidate's only reference.
COLUMNS = ("pos", "value", "capability_id", "tier", "deterministic", "has_span")


def rank() -> Column:
    """Sorts better candidates first; every one has a single reference here."""
    return F.struct(~F.col("has_span"), ~F.col("deterministic"), "tier", "capability_id", "pos")


def check_fields(results: DataFrame, contract: Contract, row: str, field: str = "field_id") -> None:
    """Each field of a row has one result, and the contract knows it; otherwise the run stops."""
    known = [f.id for f in contract.fields]
    wrong = results.groupBy(row, field).agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(~F.coalesce(F.col(field).isin(known), F.lit(False))).alias("unknown"), F.count_if(F.col("n") > 1).alias("twice")).first()
    if wrong["twice"]:
        raise ReconciliationError(f"{wrong['twice']} fields have two results", "DUPLICATE_FIELD_ID")
    if wrong["unknown"]:
        raise ReconciliationError(f"{wrong['unknown']} results are of fields that {contract.id} doesn't have", "UNKNOWN_FIELD_ID")


def against(results: DataFrame, contract: Contract, row: str, field: str = "field_id") -> DataFrame:
    """One line per row and field of the contract, with its result's columns, null where there is none."""
    check_fields(results, contract, row, field)
    every = results.select(row).distinct().withColumn(field, F.explode(F.array(*[F.lit(f.id) for f in contract.fields])))
    return every.join(results, [row, field], "left")


def distinct_values(candidates: DataFrame, key: str) -> DataFrame:
    """(key, pos, value): each distinct value at its first position."""
    return candidates.where("value IS NOT NULL").groupBy(key, "value").agg(F.min("pos").alias("pos"))


def conflicts(candidates: DataFrame, key: str) -> DataFrame:
    """(key, n_values, conflict)."""
    n = distinct_values(candidates, key).groupBy(key).agg(F.count("value").alias("n_values"))
    return n.withColumn("conflict", F.col("n_values") >= 2)


def merge(candidates: DataFrame, key: str, strategy: Merge = Merge.PREFER_BY_EVIDENCE) -> DataFrame:
    """(key, value, strategy)."""
    best = F.min_by("value", rank()).alias("best")
    if strategy is Merge.PREFER_BY_EVIDENCE:
        return candidates.groupBy(key).agg(best).select(key, F.col("best").alias("value"), F.lit(strategy.value).alias("strategy"))
    by_value = candidates.groupBy(key, "value").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"), F.min(rank()).alias("rank"))
    some = F.col("value").isNotNull()
    groups = by_value.groupBy(key).agg(
        F.min_by("value", "rank").alias("best"),
        F.count("value").alias("n_values"),
        F.min_by("value", F.when(some, F.struct((-F.col("n")).alias("n"), "first"))).alias("common"),
        F.max(F.when(some, F.col("n"))).alias("votes"),
        F.min_by("value", F.when(some, F.col("first"))).alias("seen"),
    )
    if strategy is Merge.UNION:
        agreed, value = F.col("n_values") <= 1, F.col("seen")
    else:
        agreed, value = F.coalesce(F.col("votes") >= 2, F.lit(False)), F.col("common")
    return groups.select(key, F.when(agreed, value).otherwise(F.col("best")).alias("value"), F.when(agreed, strategy.value).otherwise(Merge.PREFER_BY_EVIDENCE.value).alias("strategy"))


def confidence(candidates: DataFrame, key: str) -> DataFrame:
    """(key, n_candidates, n_evidence, n_capabilities, conflict, confidence, band) of fields without constraints."""
    n = candidates.groupBy(key).agg(
        F.count("value").alias("n_candidates"), F.count(F.lit(1)).alias("n_evidence"), F.countDistinct("capability_id").alias("n_capabilities"), (F.countDistinct("value") >= 2).alias("conflict")
    )
    n = n.withColumn("confidence", score(F.col("n_candidates"), F.col("n_evidence"), F.lit(True), F.col("conflict"), F.col("n_capabilities")))
    return n.withColumn("band", band(F.col("confidence")))


def resolve(candidates: DataFrame, key: str, threshold: float = 0.80, default: str | None = None, strategy: Merge = Merge.PREFER_BY_EVIDENCE) -> DataFrame:
    """(key, status, value, confidence, band, strategy): merged, scored, held to the threshold, with the default below it."""
    rows = merge(candidates, key, strategy).join(confidence(candidates, key).select(F.col(key).alias("__k"), "confidence", "band"), F.col(key).eqNullSafe(F.col("__k")))
    ok = (F.col("confidence") >= threshold) & F.col("value").isNotNull()
    use = F.lit(default is not None)
    return rows.select(
        key,
        F.when(ok | use, "RESOLVED").otherwise("UNRESOLVED").alias("status"),
        F.when(ok, F.col("value")).otherwise(F.lit(default)).alias("value"),
        F.when(ok, F.col("confidence")).when(use, 0.60).otherwise(0.0).alias("confidence"),
        F.when(ok, F.col("band")).when(use, "MEDIUM").otherwise("UNTRUSTED").alias("band"),
        F.when(ok, F.col("strategy")).when(use, "USE_DEFAULT").alias("strategy"),
    )


def sum_money(rows: DataFrame, key: str, amount: str, currency: str, order: str, policy: CurrencyPolicy = CurrencyPolicy.STRICT_MATCH, rate: Decimal | None = None, precision: int = 2) -> DataFrame:
    """(key, currency, total): exact sums of one currency; of two, in the first's at the rate; null for all else."""
    by = rows.groupBy(key, F.col(currency).alias("cur")).agg(F.sum(F.col(amount).cast("decimal(20,6)").cast("decimal(33,14)")).alias("part"), F.min(order).alias("first"))
    all_ = by.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min_by("cur", "first").alias("base"), F.min_by("part", "first").alias("own"), F.sum("part").alias("both"))
    total = F.when(F.col("n") == 1, F.col("own"))
    if policy is not CurrencyPolicy.STRICT_MATCH:
        other = (F.col("both") - F.col("own")).cast("decimal(25,6)") * F.lit(check_rate(rate)).cast("decimal(12,8)")
        total = total.when(F.col("n") == 2, F.col("own") + other)
    return all_.select(key, F.when(total.isNotNull(), F.col("base")).alias("currency"), quantize(total, precision).cast("decimal(26,2)").alias("total"))
