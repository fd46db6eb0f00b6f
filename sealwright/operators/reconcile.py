"""Reconciliation of a field's candidates to one value, inside the row: no shuffle."""

from __future__ import annotations

import enum
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.constraints import failures
from ..functions.money import check_rate, quantize
from ..model import CurrencyPolicy, Field, FieldType, Merge, Money, Resolution
from ..schemas import EVIDENCE, RESOLVED
from . import candidates as C

#: Phrases of prompt injection (fixed values); a candidate that holds one in any case is dropped.
INJECTION = (
    "ignore all previous instructions",
    "ignore previous instructions",
    "you are now a",
    "disregard the schema",
    "output the literal string",
    "forget your previous instructions",
    "new task:",
    "system: you are",
)


class Status(enum.Enum):
    SUCCESS = "SUCCESS"
    PARTIAL_SUCCESS = "PARTIAL_SUCCESS"
    UNRESOLVED = "UNRESOLVED"
    FAILED = "FAILED"


class Band(enum.Enum):
    """Bands of confidence and where they begin."""

    CERTAIN = 0.95
    HIGH = 0.80
    MEDIUM = 0.60
    LOW = 0.30
    UNTRUSTED = 0.0


def injected(value: Column) -> Column:
    low = F.lower(value)
    found = F.lit(False)
    for phrase in INJECTION:
        found = found | F.contains(low, F.lit(phrase))
    return F.coalesce(found, F.lit(False))


def band(confidence: Column) -> Column:
    return F.when(confidence >= 0.95, "CERTAIN").when(confidence >= 0.80, "HIGH").when(confidence >= 0.60, "MEDIUM").when(confidence >= 0.30, "LOW").otherwise("UNTRUSTED")


def band_midpoint(name: Column) -> Column:
    """The middle of a band's range."""
    ranges = {"CERTAIN": (0.95, 1.0), "HIGH": (0.80, 0.95), "MEDIUM": (0.60, 0.80), "LOW": (0.30, 0.60), "UNTRUSTED": (0.0, 0.30)}
    out = F.lit(None).cast("double")
    for k, (low, high) in ranges.items():
        out = F.when(name == k, F.lit((low + high) / 2)).otherwise(out)
    return out


def score(candidates: Column, evidence: Column, valid: Column, conflict: Column, capabilities: Column, base: float = 0.50) -> Column:
    """Confidence in double precision. The order of the sums decides at band edges, so they are not rearranged."""
    c = F.lit(base) + F.lit(0.10) * F.least(candidates, F.lit(3)).cast("double")
    c = c + F.lit(0.05) * F.least(evidence, F.lit(5)).cast("double")
    c = c + F.when(valid, F.lit(0.10)).otherwise(F.lit(0.0))
    c = c - F.when(conflict, F.lit(0.15)).otherwise(F.lit(0.0))
    c = c + F.lit(0.05) * F.least(capabilities, F.lit(3)).cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def preference(c: Column) -> Column:
    """A struct that sorts better candidates first: more evidence, a span, determinism, a lower tier, ids, position.

    Where both have no evidence nothing but the position differs.
    """
    refs = c["evidence"]
    return F.struct(
        (-F.size(refs)).alias("n"),
        (~F.exists(refs, lambda r: r["span_start"].isNotNull())).alias("no_span"),
        (~F.exists(refs, lambda r: r["deterministic"])).alias("chance"),
        F.coalesce(F.array_min(F.transform(refs, lambda r: r["tier"])), F.lit(10)).alias("tier"),
        F.array_sort(F.transform(refs, lambda r: r["capability_id"])).alias("ids"),
        c["pos"].alias("pos"),
    )


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often the body reads it: the expression stays small, and
    higher-order functions share no common subexpressions of their own."""
    return F.get(F.transform(F.array(value), body), 0)


def numbered(candidates: Column) -> Column:
    """Positions 0.. in the order of the array."""
    return F.transform(candidates, lambda c, i: c.withField("pos", i))


def _at(candidates: Column, pos: Column) -> Column:
    return F.get(F.filter(candidates, lambda c: c["pos"] == pos), 0)


def best(candidates: Column) -> Column:
    return let(F.array_min(F.transform(candidates, preference))["pos"], lambda pos: _at(candidates, pos))


def union_evidence(candidates: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(candidates, lambda c: c["evidence"])))


def _majority(values: Column) -> Column:
    """The most common value among those that two candidates have at least, the first seen of equals; else null."""
    counted = F.transform(F.array_distinct(values), lambda v, i: F.struct((-F.size(F.filter(values, lambda x: x == v))).alias("n"), i.alias("i"), v.alias("v")))
    return let(F.array_min(counted), lambda top: F.when(top["n"] <= -2, top["v"]))


def merge(candidates: Column, strategy: Merge) -> Column:
    """struct<value, evidence, strategy> by a strategy that falls back to the best-evidenced candidate."""

    def made(value: Column, refs: Column, name: Merge) -> Column:
        return F.struct(value.alias("value"), refs.alias("evidence"), F.lit(name.value).alias("strategy"))

    def by(top: Column) -> Column:
        prefer = made(top["value"], top["evidence"], Merge.PREFER_BY_EVIDENCE)
        if strategy is Merge.PREFER_BY_EVIDENCE:
            return prefer
        values = F.filter(F.transform(candidates, lambda c: c["value"]), lambda v: v.isNotNull())
        if strategy is Merge.UNION:
            return let(values, lambda v: F.when(F.size(F.array_distinct(v)) <= 1, made(F.get(v, 0), union_evidence(candidates), Merge.UNION)).otherwise(prefer))
        agreed = lambda value: F.when(value.isNotNull(), made(value, union_evidence(F.filter(candidates, lambda c: c["value"] == value)), Merge.INTERSECTION)).otherwise(prefer)
        return let(values, lambda v: let(_majority(v), agreed))

    return let(best(candidates), by)


def merge_money(candidates: Column, policy: CurrencyPolicy, rate: Decimal | None, precision: int | None) -> Column:
    """struct<value, evidence, strategy> of money candidates, or null where the plain strategy must decide.

    Amounts of one currency are added up; two currencies are added in the first one's at the rate, unless matches
    must be strict; more than two decide nothing.
    """
    add = lambda of: F.aggregate(of, F.lit(0).cast("decimal(38,14)"), lambda s, c: (s + c).cast("decimal(38,14)"))
    wide = lambda c: c["amount"].cast("decimal(38,14)")

    def total(money: Column, currencies: Column) -> Column:
        first = F.get(currencies, 0)
        out = F.when(F.size(currencies) == 1, add(F.transform(money, wide)))
        if policy is CurrencyPolicy.STRICT_MATCH:
            return out
        if rate is None:
            return out  # a missing rate is the row's problem, told by resolve()
        by = F.lit(check_rate(rate)).cast("decimal(12,8)")
        return out.when(F.size(currencies) == 2, add(F.transform(money, lambda c: F.when(c["currency"] == first, wide(c)).otherwise((c["amount"] * by).cast("decimal(38,14)")))))

    def made(money: Column, currencies: Column, sum_: Column) -> Column:
        text = F.concat(quantize(sum_, precision).cast("string"), F.lit(" "), F.get(currencies, 0))
        return F.when(sum_.isNotNull(), F.struct(text.alias("value"), union_evidence(money).alias("evidence"), F.lit("MONEY_RESOLVE").alias("strategy")))

    own = F.filter(candidates, lambda c: c["amount"].isNotNull())
    return let(own, lambda money: let(F.array_distinct(F.transform(money, lambda c: c["currency"])), lambda cur: let(total(money, cur), lambda t: made(money, cur, t))))


def _default(field: Field) -> str:
    if isinstance(field.default, Money):
        return f"{field.default.amount} {field.default.currency}"
    return str(field.default).lower() if isinstance(field.default, bool) else str(field.default)


def resolve(field: Field, candidates: Column | None, strategy: Merge = Merge.PREFER_BY_EVIDENCE, policy: CurrencyPolicy = CurrencyPolicy.STRICT_MATCH, rate: Decimal | None = None) -> Column:
    """RESOLVED of one field: filter, detect conflicts, merge, validate, score, threshold, fall back. Without candidates
    (None), where no step can give any, the fallback alone is left."""
    note = lambda code, severity, message: C.diagnostic(code, severity, message, field.path)
    null = F.lit(None).cast("string")

    def made(status, value, confidence, band_, conflict, name, refs, diagnostics) -> Column:
        return F.struct(
            F.lit(field.id).alias("field_id"), F.lit(field.path).alias("field_path"), F.lit(field.type.name).alias("type"), F.lit(status).alias("status"), value.alias("value"),
            confidence.alias("confidence"), band_.alias("band"), conflict.alias("conflict"), name.alias("strategy"), refs.alias("evidence"), diagnostics.alias("diagnostics"),
        ).cast(RESOLVED)

    def fallback(reason: str | Column, before: Column) -> Column:
        no_refs = F.array().cast(f"array<{EVIDENCE}>")
        if field.fallback is Resolution.USE_DEFAULT and field.default is not None:
            return made("RESOLVED", F.lit(_default(field)), F.lit(0.60), F.lit("MEDIUM"), F.lit(False), F.lit("USE_DEFAULT"), no_refs, F.concat(before, note("CAPABILITY_OK", "INFO", "used field default (fallback policy: USE_DEFAULT)")))
        if field.fallback is Resolution.REQUIRE_HUMAN:
            before = F.concat(before, note("FIELD_UNRESOLVED", "WARNING", "human review required"))
        return made("UNRESOLVED", null, F.lit(0.0), F.lit("UNTRUSTED"), F.lit(False), null, no_refs, F.concat(before, note("CAPABILITY_OK", "INFO", F.concat(F.lit("field unresolved: "), F.lit(reason) if isinstance(reason, str) else reason))))

    if candidates is None:
        return fallback("no_candidates", C.no_diagnostics())

    def merged(safe: Column) -> Column:
        if field.type is FieldType.MONEY:
            return F.coalesce(merge_money(safe, policy, rate, 2), merge(safe, strategy))
        return merge(safe, strategy)

    def facts(safe: Column) -> Column:
        """What the score needs of the candidates."""
        concrete = F.filter(safe, lambda c: c["value"].isNotNull() | c["amount"].isNotNull())
        refs = F.flatten(F.transform(safe, lambda c: c["evidence"]))
        if field.type is FieldType.MONEY:
            codes = F.transform(concrete, lambda c: F.coalesce(c["currency"], F.when(c["value"].rlike(r"^[A-Z]{3}\z"), c["value"])))
            kinds = F.array_distinct(F.filter(codes, lambda x: x.isNotNull()))
        else:
            kinds = F.array_distinct(F.transform(concrete, lambda c: c["value"]))
        return F.struct(F.size(concrete).alias("n"), F.size(refs).alias("refs"), F.size(F.array_distinct(F.transform(refs, lambda r: r["capability_id"]))).alias("caps"), (F.size(kinds) >= 2).alias("conflict"), merged(safe).alias("merged"))

    def scored(f: Column) -> Column:
        failed = F.size(failures(field.constraints, f["merged"]["value"], field.type is not FieldType.ARRAY)) if field.constraints else F.lit(0)
        return let(F.when(f["merged"]["value"].isNull(), F.lit(0)).otherwise(failed), lambda n: let(score(f["n"], f["refs"], n == 0, f["conflict"], f["caps"]), lambda c: decided(f, n, c)))

    def decided(f: Column, failed: Column, confidence: Column) -> Column:
        value = f["merged"]["value"]
        told = F.when(failed == 0, C.no_diagnostics()).otherwise(note("VALIDATION_FAILED", "WARNING", F.concat(F.lit("validation: "), failed.cast("string"), F.lit(" constraint(s) failed"))))
        if field.type is FieldType.MONEY and policy is not CurrencyPolicy.STRICT_MATCH and rate is None:
            told = F.concat(told, F.when(f["conflict"], note("MISSING_FX_RATE", "ERROR", "two currencies need a rate")).otherwise(C.no_diagnostics()))
        doubtful = F.when(f["conflict"], note("CAPABILITY_OK", "INFO", F.format_string("field unresolved: confidence %.3f < threshold %.3f", confidence, F.lit(field.confidence_threshold)))).otherwise(C.no_diagnostics())
        low = confidence < field.confidence_threshold
        reason = F.when(low, "below_threshold").otherwise("no_mergeable_value")
        return F.when(low | value.isNull(), fallback(reason, F.concat(told, doubtful))).otherwise(made("RESOLVED", value, confidence, band(confidence), f["conflict"], f["merged"]["strategy"], f["merged"]["evidence"], told))

    def resolved(given: Column, safe: Column) -> Column:
        empty = F.when(F.size(given) == 0, "no_candidates").otherwise("prompt_injection")
        return F.when(F.size(safe) == 0, fallback(empty, C.no_diagnostics())).otherwise(let(facts(safe), scored))

    return let(numbered(candidates), lambda given: let(F.filter(given, lambda c: ~injected(c["value"])), lambda safe: resolved(given, safe)))
