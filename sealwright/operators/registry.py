"""Capabilities: their specs and how each compiles to a column of candidates."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from decimal import Decimal
from typing import Any

from pyspark.sql import Column

from ..errors import CapabilityError
from ..model import CapabilitySpec, Cost, Step, Tier


@dataclass(frozen=True)
class Context:
    """What a step is compiled with: columns of the row's raw bytes, decoded text and profile, and its field."""

    raw: Column
    text: Column
    profile: Column
    field_id: str
    type_name: str

    def __post_init__(self):
        if not isinstance(self.field_id, str) or not self.field_id:
            raise ValueError("a context needs a field id")
        if not isinstance(self.type_name, str) or not self.type_name:
            raise ValueError("a context needs its field's type")


def settings(step: Step, spec: CapabilitySpec) -> Step:
    """The step with a config of its own, in which the capability's tier is named unless the caller names one."""
    return replace(step, config={"tier": spec.tier.name} | dict(step.config))


#: compile(step, context) gives (candidates without pos, diagnostics) as array columns.
Compile = Callable[[Step, Context], tuple[Column, Column]]


@dataclass(frozen=True)
class Capability:
    spec: CapabilitySpec
    compile: Compile


def _version(v: str) -> tuple[int, ...]:
    return tuple(int(p) if p.isdigit() else -1 for p in v.split("."))


class Registry:
    """Capabilities by id and version, in order of registration."""

    def __init__(self, *capabilities: Capability):
        self._all: dict[tuple[str, str], Capability] = {}
        for c in capabilities:
            self.register(c)

    def register(self, capability: Capability, replace: bool = False) -> None:
        key = (capability.spec.id, capability.spec.version)
        if key in self._all and not replace:
            raise CapabilityError(f"{key} is registered already", "DUPLICATE_CAPABILITY")
        self._all[key] = capability

    def unregister(self, id_: str, version: str) -> None:
        if self._all.pop((id_, version), None) is None:
            raise CapabilityError(f"{id_}@{version} isn't registered", "UNKNOWN_CAPABILITY")

    def get(self, id_: str, version: str) -> Capability | None:
        return self._all.get((id_, version))

    def latest(self, id_: str) -> Capability | None:
        """The highest version; of equal ones the last registered."""
        own = [(_version(c.spec.version), k, c) for k, c in enumerate(self._all.values()) if c.spec.id == id_]
        return max(own, key=lambda x: x[:2])[2] if own else None

    def __iter__(self):
        return iter(list(self._all.values()))

    def specs(self) -> list[CapabilitySpec]:
        return [c.spec for c in self._all.values()]

    def ids(self) -> set[str]:
        return {k[0] for k in self._all}

    def rows(self) -> list[dict[str, Any]]:
        return [
            {"id": s.id, "version": s.version, "tier": int(s.tier), "input_types": ",".join(s.input_types), "tokens": s.cost.tokens, "latency_ms": s.cost.latency_ms, "cost_usd": float(s.cost.usd), "deterministic": s.deterministic, "score": s.score}
            for s in self.specs()
        ]


def builtin() -> dict[str, Capability]:
    """The five capabilities by id, with their declared costs (fixed values)."""
    from . import inference, lookup, regex, text, validation

    all_types = ("STRING", "INTEGER", "DECIMAL", "BOOLEAN", "DATE", "ENUM", "OBJECT", "ARRAY", "MONEY")
    made = [
        (CapabilitySpec("text_extraction", "1.0", Tier.LOCAL_DETERMINISTIC, ("STRING",), cost=Cost(0, 5)), text.compile_step),
        (CapabilitySpec("regex_extraction", "1.0", Tier.LOCAL_DETERMINISTIC, ("STRING", "HTML_TEXT"), cost=Cost(0, 1)), regex.compile_step),
        (CapabilitySpec("lookup", "1.0", Tier.STRUCTURED_LOOKUP, ("STRING",), cost=Cost(0, 1)), lookup.compile_step),
        (CapabilitySpec("validation", "1.0", Tier.LOCAL_DETERMINISTIC, all_types, cost=Cost(0, 1)), validation.compile_step),
        (CapabilitySpec("inference", "1.0", Tier.REMOTE_INFERENCE, ("STRING", "HTML_TEXT", "MIXED"), cost=Cost(500, 1500, Decimal("0.001")), deterministic=False), inference.compile_step),
    ]
    return {spec.id: Capability(spec, f) for spec, f in made}


_shared: Registry | None = None


def shared() -> Registry:
    """The registry that is taken where none is given: lookup alone until something is registered."""
    global _shared
    if _shared is None:
        _shared = Registry(builtin()["lookup"])
    return _shared


def share(registry: Registry) -> None:
    global _shared
    _shared = registry


def register_capability(capability: Capability, replace: bool = False) -> None:
    shared().register(capability, replace)


def unregister_capability(id_: str, version: str) -> None:
    shared().unregister(id_, version)


def get_capability(id_: str, version: str | None = None) -> Capability | None:
    return shared().latest(id_) if version is None else shared().get(id_, version)


def default_registry() -> Registry:
    """A registry of what the shared one holds now."""
    return Registry(*shared())


def full_registry() -> Registry:
    return Registry(*builtin().values())
