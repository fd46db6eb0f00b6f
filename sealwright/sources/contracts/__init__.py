"""Contract sources and sinks: external schemas to contracts and back."""

from __future__ import annotations

from .registry import adapt, adapters, detect, export, get_adapter, register_adapter, unregister_adapter

__all__ = ["adapt", "adapters", "detect", "export", "get_adapter", "register_adapter", "unregister_adapter"]
