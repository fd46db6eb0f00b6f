"""Adapters by format, and the format of an external schema."""

from __future__ import annotations

from typing import Any, Protocol

from ...errors import InvalidContractError
from ...model import Contract
from . import dsl, json_schema, model_class, openapi, struct_type


class Adapter(Protocol):
    def adapt(self, external: Any) -> Contract: ...

    def export(self, contract: Contract) -> Any: ...


_ADAPTERS: dict[str, Any] = {"dict_dsl": dsl, "json_schema:2020-12": json_schema, "openapi:3.x": openapi, "pydantic:v2": model_class, "spark_struct": struct_type}
#: Another name that detection gives to a format.
_ALIASES = {"openapi:3.0": "openapi:3.x"}

#: Keys that mark a dict as JSON Schema (fixed values). `title`, `description`, `default` and `required` are among
#: them, so a dict of the other language must not have them at its top.
MARKERS = frozenset(
    (
        "$schema",
        "openapi",
        "$defs",
        "definitions",
        "properties",
        "patternProperties",
        "additionalProperties",
        "propertyNames",
        "required",
        "allOf",
        "anyOf",
        "oneOf",
        "not",
        "items",
        "prefixItems",
        "contains",
        "minProperties",
        "maxProperties",
        "minItems",
        "maxItems",
        "uniqueItems",
        "pattern",
        "const",
        "enum",
        "multipleOf",
        "minimum",
        "maximum",
        "exclusiveMinimum",
        "exclusiveMaximum",
        "minLength",
        "maxLength",
        "format",
        "$id",
        "$ref",
        "$comment",
        "$anchor",
        "title",
        "description",
        "default",
        "examples",
        "readOnly",
        "writeOnly",
        "deprecated",
        "contentEncoding",
        "contentMediaType",
    )
)


def register_adapter(format_id: str, adapter: Any, replace: bool = False) -> None:
    if not format_id or format_id != format_id.lower():
        raise ValueError("a format id is lower case and not empty")
    if format_id in _ADAPTERS and not replace:
        raise ValueError(f"{format_id} is registered already")
    _ADAPTERS[format_id] = adapter


def unregister_adapter(format_id: str) -> None:
    del _ADAPTERS[format_id]


def get_adapter(format_id: str) -> Any:
    try:
        return _ADAPTERS[_ALIASES.get(format_id, format_id)]
    except KeyError:
        raise InvalidContractError(f"no adapter for {format_id!r}", "UNKNOWN_FORMAT") from None


def adapters() -> list[str]:
    return list(_ADAPTERS)


def detect(external: Any) -> str:
    if hasattr(external, "model_fields"):
        return "pydantic:v2"
    if struct_type.is_struct(external):
        return "spark_struct"
    if isinstance(external, dict):
        if "openapi" in external:
            return "openapi:3.x"
        return "json_schema:2020-12" if MARKERS & external.keys() else "dict_dsl"
    if isinstance(external, str):
        return "json_schema:2020-12"
    raise InvalidContractError(f"a {type(external).__name__} is no contract", "UNKNOWN_FORMAT")


def adapt(external: Any, format_id: str | None = None) -> Contract:
    return get_adapter(format_id or detect(external)).adapt(external)


def export(contract: Contract, format_id: str) -> Any:
    return get_adapter(format_id).export(contract)
