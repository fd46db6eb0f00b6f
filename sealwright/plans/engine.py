"""normalize(): rows of raw input to resolved, sealed records, as one projection without a shuffle."""

from __future__ import annotations

from decimal import Decimal
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..clock import Clock, stamp
from ..errors import ReconciliationError
from ..functions import profile as P
from ..model import Budget, Contract, CurrencyPolicy, Field, Merge, Plan, Policy
from ..operators import candidates as C
from ..operators.reconcile import resolve
from ..operators.registry import Context, Registry, default_registry, settings
from ..schemas import EVIDENCE
from ..sources.contracts import adapt
from . import planner
from .artifact import executed_evidence, promoted, seal, stable_dumps

PROFILE = "__profile"


@lru_cache(maxsize=512)
def _compiled(gateway: int, field: Field, name: str | None, strategy: Merge, policy: CurrencyPolicy, rate: Decimal | None) -> Column:
    return resolve(field, None if name is None else F.col(name), strategy, policy, rate)


def resolution(field: Field, name: str | None, strategy: Merge, policy: CurrencyPolicy, rate: Decimal | None) -> Column:
    """The field's resolution over the candidates column `name`. It is a few hundred calls to the JVM to build and
    depends on the contract alone, so it is built once a contract and JVM; defaults that can't be hashed build it anew.
    No name stands for a field that no step is planned for."""
    try:
        hash(field)
    except TypeError:
        return resolve(field, None if name is None else F.col(name), strategy, policy, rate)
    return _compiled(id(SparkContext._gateway), field, name, strategy, policy, rate)


def explicit(profile: Column) -> tuple[Column, Column]:
    """Whether the input has text to quote, for STRING fields and for others."""
    dense = ~profile["is_empty"] & (profile["density"] > planner.LEAST_DENSITY)
    return dense, dense & profile["input_type"].isin(*planner.TEXTUAL)


def _field_candidates(made: Plan, registry: Registry, field_id: str, raw: Column, text: Column, profile: Column, type_name: str) -> tuple[Column, Column]:
    """(candidates, diagnostics) of a field's chain, step after step."""
    found, told = [C.none()], [C.no_diagnostics()]
    for f in made.fields:
        for s in f.steps if f.field_id == field_id else ():
            capability = registry.get(s.capability_id, s.capability_version)
            if capability is None:
                told.append(C.diagnostic("CAPABILITY_INVOKE_FAILED", "ERROR", f"{s.capability_id}@{s.capability_version} isn't registered", field_id))
                continue
            one, said = capability.compile(settings(s, capability.spec), Context(raw, text, profile, field_id, type_name))
            found.append(one)
            told.append(said)
    return F.concat(*found), F.concat(*told)


def _written(plan: Plan) -> str:
    """The plan's steps as JSON; what a config holds beside plain values is told by its type."""
    plain = lambda x: x if x is None or isinstance(x, (str, int, float, bool)) else {k: plain(v) for k, v in x.items()} if isinstance(x, dict) else [plain(v) for v in x] if isinstance(x, (list, tuple)) else type(x).__name__
    return stable_dumps([[f.field_id, [[s.capability_id, s.capability_version, plain(s.config)] for s in f.steps]] for f in plan.fields])


def normalize(
    df: DataFrame,
    contract,
    raw: str = "text",
    budget: Budget | None = None,
    policy: Policy | None = None,
    registry: Registry | None = None,
    plan: Plan | None = None,
    strategy: Merge = Merge.PREFER_BY_EVIDENCE,
    currency_policy: CurrencyPolicy = CurrencyPolicy.STRICT_MATCH,
    fx_rate: Decimal | None = None,
    keep_raw: bool = False,
    clock: Clock | None = None,
    run_evidence: bool = False,
    run_diagnostics: bool = False,
) -> DataFrame:
    """`df` with profile, results (a struct per field), status, normalized, unresolved, counts, plan and replay_hash.

    The contract is compiled on the driver: a hand-built `plan` is taken as it is, otherwise the three plans that rows
    can have are made and the row's profile picks one. Null input counts as empty. The transform keeps no state, so a
    streaming DataFrame may be given too. The raw column is left out unless keep_raw. A clock adds created_at, which no
    hash covers; run_evidence adds the references of all that the steps found, resolved or not, and run_diagnostics what
    of the steps' own diagnostics a run is told.
    """
    contract = contract if isinstance(contract, Contract) else adapt(contract)
    registry = registry or default_registry()
    policy = policy or Policy()
    bytes_ = F.coalesce(P.raw_bytes(df, raw), F.lit(b""))
    rows = df.withColumn("__raw", bytes_).withColumn("__text", P.decoded(F.col("__raw"))).withColumn(PROFILE, P.profile(F.col("__raw"), F.col("__text")))
    source, text, profile = F.col("__raw"), F.col("__text"), F.col(PROFILE)
    if plan and (unknown := {f.field_id for f in plan.fields} - {f.id for f in contract.fields}):
        raise ReconciliationError(f"the plan has fields that {contract.id} doesn't have: {sorted(unknown)}", "UNKNOWN_FIELD_ID")
    variants = [(None, plan)] if plan else [(v, planner.plan(contract, registry, v, budget, policy)) for v in planner.VARIANTS]
    for_string, for_other = explicit(profile)
    results, planned, said = [], [], []
    cut = [(v, *planner.affordable(p, registry, budget)) for v, p in variants]

    def pick(columns: list[Column]) -> Column:
        """The variant's column; equal ones are one."""
        if len(columns) == 1:
            return columns[0]
        return F.when(for_other, columns[2]).when(for_string, columns[1]).otherwise(columns[0])

    for f in contract.fields:
        steps = [next((x.steps for x in p.fields if x.field_id == f.id), ()) for _, p, _ in cut]
        both = [_field_candidates(p, registry, f.id, source, text, profile, f.type.name) for _, p, _ in cut]
        if all(s == steps[0] for s in steps):
            both = both[:1]
        results.append((f, pick([found for found, _ in both]) if any(steps) else None))
        said.append(pick([told for _, told in both]))
    for _, p, over in cut:
        rows_ = [*p.diagnostics, *over]
        planned.append(F.concat(*[C.diagnostic(*d) for d in rows_]) if rows_ else C.no_diagnostics())
    names = [None if c is None else f"__c{i}" for i, (_, c) in enumerate(results)]
    written = [F.lit(_written(p)) for _, p, _ in cut]
    # candidates first, so that each is computed once however often the resolution reads it
    rows = rows.select("*", *[c.alias(n) for (_, c), n in zip(results, names, strict=True) if n], (pick(planned) if len(planned) > 1 else planned[0]).alias("__plan_diagnostics"), pick(written).alias("execution_plan"))
    fields = F.array(*[resolution(f, n, strategy, currency_policy, fx_rate) for (f, _), n in zip(results, names, strict=True)])
    more = [stamp(clock).alias("created_at")] if clock else []
    if run_diagnostics:
        rows = rows.withColumn("__said", F.concat(*said))
        more.append(promoted(F.col("__said")).alias("run_diagnostics"))
    if run_evidence:
        more.append(F.concat(F.array().cast(f"array<{EVIDENCE}>"), *[executed_evidence(F.col(n)) for n in names if n]).alias("run_evidence"))
    keep = [c for c in df.columns if c != raw or keep_raw]
    out = rows.select(*keep, F.col(PROFILE).alias("profile"), F.col("__plan_diagnostics").alias("plan_diagnostics"), "execution_plan", fields.alias("results"), *more)
    return seal(out, contract, policy)
