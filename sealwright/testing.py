"""Hypothesis strategies for contracts, inputs, budgets, policies, registries, candidates and artifacts' values."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from decimal import Decimal
from typing import Any

from hypothesis import strategies as st

from .model import Budget, CapabilitySpec, Contract, Cost, Field, FieldType, Policy, Resolution, Tier
from .operators import candidates as C
from .operators import registry as R

NAMES = st.text("abcdefghijklmnopqrstuvwxyz_", min_size=1, max_size=12)
_IDS = ("text_extraction", "regex_extraction", "lookup", "validation", "inference")


@st.composite
def fields(draw: st.DrawFn, name: str | None = None) -> Field:
    name = name or draw(NAMES)
    kind = draw(st.sampled_from(FieldType))
    choices = tuple(draw(st.lists(st.text("abc", min_size=1), min_size=1, max_size=4, unique=True))) if kind is FieldType.ENUM else None
    return Field(f"field_{name}", name, name, kind, draw(st.booleans()), nullable=draw(st.booleans()), confidence_threshold=draw(st.sampled_from((0.0, 0.5, 0.8, 0.95, 1.0))), fallback=draw(st.sampled_from((Resolution.UNRESOLVED, Resolution.REQUIRE_HUMAN))), enum_values=choices)


@st.composite
def contracts(draw: st.DrawFn, most: int = 5) -> Contract:
    names = draw(st.lists(NAMES, min_size=1, max_size=most, unique=True))
    return Contract("contract_" + draw(NAMES), tuple(draw(fields(n)) for n in names))


def inputs() -> st.SearchStrategy[bytes]:
    """Raw input of any kind: empty, blank, text, JSON, HTML, malformed UTF-8."""
    text = st.text(max_size=200).map(lambda t: t.encode("utf-8", "surrogatepass"))
    return st.one_of(st.just(b""), st.binary(max_size=200), text, st.sampled_from((b" \t\n", b'{"a": 1}', b"<html><p>x</p>", b"%PDF-1.4", b"a,b,c,d\n1,2,3,4", b"From x\nSubject: y\n")))


def budgets() -> st.SearchStrategy[Budget]:
    some = lambda s: st.one_of(st.none(), s)
    return st.builds(Budget, some(st.decimals(0, 10, places=4)), some(st.integers(1, 60_000)), some(st.integers(0, 100)), some(st.integers(1, 1000)))


def policies() -> st.SearchStrategy[Policy]:
    return st.builds(Policy, st.booleans(), st.booleans(), st.booleans(), st.floats(0, 1), st.booleans())


def _nothing(step, ctx):
    return C.none(), C.no_diagnostics()


def registries() -> st.SearchStrategy[R.Registry]:
    """Registries of capabilities that find nothing."""
    spec = st.builds(lambda i, t, ms, usd: CapabilitySpec(i, "1.0", t, cost=Cost(0, ms, usd)), st.sampled_from(_IDS), st.sampled_from(Tier), st.integers(0, 2000), st.decimals(0, 1, places=3))
    return st.lists(spec, max_size=5, unique_by=lambda s: s.id).map(lambda own: R.Registry(*(R.Capability(s, _nothing) for s in own)))


@contextmanager
def registered(registry: R.Registry) -> Iterator[R.Registry]:
    """For a while, the registry that normalize() takes where none is given."""
    before = R.shared()
    R.share(registry)
    try:
        yield registry
    finally:
        R.share(before)


@st.composite
def candidate_sets(draw: st.DrawFn, most: int = 3) -> list[dict[str, Any]]:
    """Candidates of one field as rows of the candidate type."""
    out = []
    for pos in range(draw(st.integers(0, most))):
        refs = [
            {"capability_id": draw(st.sampled_from(_IDS)), "capability_version": "1.0", "tier": draw(st.sampled_from((1, 2, 5))), "deterministic": draw(st.booleans()), "field_path": "f", "span_start": None, "span_end": None, "model_id": None, "prompt_tokens": None, "completion_tokens": None}
            for _ in range(draw(st.integers(0, 3)))
        ]
        out.append({"pos": pos, "value": draw(st.one_of(st.none(), st.text("abc", max_size=4))), "amount": None, "currency": None, "evidence": refs})
    return out


def amounts() -> st.SearchStrategy[Decimal]:
    return st.decimals(-(10**9), 10**9, places=4)
