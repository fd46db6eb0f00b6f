"""Planning on the driver: chains of capabilities for each required field, pruned by policy and budget."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from decimal import Decimal
from typing import Any, Protocol

from ..model import Budget, Contract, Field, FieldPlan, FieldType, Plan, Policy, Step, Tier
from ..operators.registry import Registry

#: A total cost cap below this can pay for no inference.
INFERENCE_FLOOR = Decimal("0.001")
#: Profile types that hold text which a field of any type may quote.
TEXTUAL = ("html", "text", "pdf_text", "email")
LEAST_DENSITY = 0.1


@dataclass(frozen=True)
class Variant:
    """What a row's profile decides about its plan: whether text is extracted first for STRING and for other fields."""

    for_string: bool
    for_other: bool

    def explicit(self, field: Field) -> bool:
        return self.for_string if field.type is FieldType.STRING else self.for_other


#: All that occur: nothing, dense input of a type without text, dense text.
VARIANTS = (Variant(False, False), Variant(True, False), Variant(True, True))


class Heuristic(Protocol):
    """Reorders or thins out a field's chain after it is built."""

    def apply(self, field: Field, steps: tuple[Step, ...]) -> tuple[Step, ...]: ...


def chain_cost(estimates: Iterable[Sequence[Any]]) -> Decimal:
    """The sum of dollars over (tokens, ms, dollars); a short or mistyped estimate is an error, as it would count too little."""
    total = Decimal(0)
    for k, estimate in enumerate(estimates):
        if len(estimate) < 3:
            raise ValueError(f"estimate {k} has {len(estimate)} parts, not 3")
        usd = estimate[2]
        if isinstance(usd, bool) or not isinstance(usd, (Decimal, int, float)):
            raise TypeError(f"estimate {k} has the dollars {usd!r}")
        total += usd if isinstance(usd, Decimal) else Decimal(str(usd))
    return total


def chain_latency_ms(estimates: Iterable[Sequence[Any]]) -> int:
    """The sum of milliseconds over (tokens, ms, dollars); what has none counts as none."""
    return sum(int(e[1]) for e in estimates if len(e) > 1)


def inference_allowed(budget: Budget | None, policy: Policy) -> tuple[bool, bool, list[tuple[str, str, str, str]]]:
    """(local, remote, diagnostics)."""
    told = []
    local, remote = policy.allow_local_inference, policy.allow_remote_inference
    if budget and budget.max_total_cost_usd is not None and budget.max_total_cost_usd < INFERENCE_FLOOR:
        told.append(("BUDGET_EXCLUDES_INFERENCE", "INFO", "the budget can't pay for inference", ""))
        local = remote = False
    if not policy.allow_remote_inference:
        told.append(("POLICY_EXCLUDES_REMOTE_INFERENCE", "INFO", "the policy excludes remote inference", ""))
    if not policy.allow_local_inference:
        told.append(("POLICY_EXCLUDES_LOCAL_INFERENCE", "INFO", "the policy excludes local inference", ""))
    return local, remote, told


def chain(field: Field, registry: Registry, explicit: bool, local: bool, remote: bool) -> tuple[Step, ...]:
    """Text extraction first where the input quotes the field, then each tier's capabilities by (score, id)."""
    steps = []
    if explicit and (text := registry.latest("text_extraction")) and text.spec.accepts(field.type):
        steps.append(Step("text_extraction", text.spec.version, {}, "explicit evidence"))
    tiers = [Tier.LOCAL_DETERMINISTIC, Tier.STRUCTURED_LOOKUP] + [Tier.LOCAL_INFERENCE] * local + [Tier.REMOTE_INFERENCE] * remote
    for tier in tiers:
        own = sorted((s for s in registry.specs() if s.tier is tier and s.accepts(field.type)), key=lambda s: (s.score, s.id))
        steps += [Step(s.id, s.version, {}, tier.name.lower()) for s in own]
    return tuple(steps)


def plan(contract: Contract, registry: Registry, variant: Variant, budget: Budget | None = None, policy: Policy | None = None, heuristic: Heuristic | None = None) -> Plan:
    """One chain per required field, in contract order."""
    local, remote, told = inference_allowed(budget, (policy or Policy()).under(contract.policy))
    fields = []
    for f in contract.required():
        steps = chain(f, registry, variant.explicit(f), local, remote)
        steps = heuristic.apply(f, steps) if heuristic else steps
        if not steps:
            told.append(("FIELD_UNRESOLVED", "WARNING", "no capability accepts the field", f.path))
        fields.append(FieldPlan(f.id, steps))
    return Plan(contract.id, tuple(fields), tuple(told))


def affordable(made: Plan, registry: Registry, budget: Budget | None) -> tuple[Plan, list[tuple[str, str, str, str]]]:
    """The plan cut where declared costs first exceed the budget: running sums over steps in order, caps strict.

    The field that trips keeps the steps before; later fields get none. Costs are declared, so the cut is the same
    for all rows and is folded here rather than computed in each.
    """
    if budget is None or budget == Budget():
        return made, []
    caps = (budget.max_total_cost_usd, budget.max_total_latency_ms, budget.max_remote_inferences, budget.max_capability_invocations)
    spent, fields, told, over = [Decimal(0), 0, 0, 0], [], [], False
    for f in made.fields:
        kept = []
        if over:
            told.append(("BUDGET_EXCLUDES", "WARNING", "the budget is exhausted", f.field_id))
        for s in () if over else f.steps:
            c = registry.get(s.capability_id, s.capability_version)
            if c is None:
                kept.append(s)
                continue
            next_ = [spent[0] + c.spec.cost.usd, spent[1] + c.spec.cost.latency_ms, spent[2] + (c.spec.tier is Tier.REMOTE_INFERENCE), spent[3] + 1]
            if any(cap is not None and x > cap for x, cap in zip(next_, caps, strict=True)):
                over = True
                told.append(("BUDGET_EXCLUDES", "WARNING", f"{s.capability_id} would exceed the budget", f.field_id))
                break
            spent = next_
            kept.append(s)
        fields.append(FieldPlan(f.field_id, tuple(kept)))
    return Plan(made.contract_id, tuple(fields), made.diagnostics), told
