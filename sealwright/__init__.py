"""Contract-driven normalization on Spark. Names are imported when they are first used."""

from __future__ import annotations

from importlib import import_module
from typing import Any

_WHERE = {
    "errors": ("BudgetExceededError", "CapabilityError", "CapabilityNotFoundError", "ConfigurationError", "EngineError", "ExecutionError", "HashMismatchError", "InferenceProviderError", "InvalidContractError", "ReconciliationError", "ReplayError", "VersionMismatchError"),
    "model": ("Budget", "Contract", "CurrencyPolicy", "Field", "FieldPlan", "FieldType", "Merge", "Plan", "Policy", "Resolution", "Step"),
    "operators.registry": ("Capability", "Registry", "default_registry", "full_registry", "get_capability", "register_capability", "unregister_capability"),
    "operators.reconcile": ("Band", "Status"),
    "plans.artifact": ("decode", "encode", "replay"),
    "plans.engine": ("normalize",),
    "sources.contracts.registry": ("Adapter", "adapt", "export", "get_adapter", "register_adapter", "unregister_adapter"),
}
_HOME = {name: module for module, names in _WHERE.items() for name in names}
__all__ = sorted(_HOME)  # noqa: PLE0605


def __getattr__(name: str) -> Any:
    if name not in _HOME:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    found = getattr(import_module(f".{_HOME[name]}", __name__), name)
    globals()[name] = found
    return found


def __dir__() -> list[str]:
    return [*globals(), *__all__]
