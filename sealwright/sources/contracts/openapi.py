"""The first schema of an OpenAPI 3 document."""

from __future__ import annotations

from typing import Any

from ...model import Contract
from . import json_schema
from .dsl import bad

VERSIONS = ("3.0.0", "3.0.1", "3.0.2", "3.0.3", "3.1.0", "3.1.1")
REFUSED = ("oneOf", "anyOf", "allOf", "discriminator")
ROOT = "#/components/schemas/"


def inline(node: Any, schemas: dict[str, Any], path: tuple[str, ...] = ()) -> Any:
    """`node` with references to component schemas replaced by what they name; nullable becomes a null type."""
    if isinstance(node, list):
        return [inline(x, schemas, path) for x in node]
    if not isinstance(node, dict):
        return node
    for key in REFUSED:
        if key in node:
            raise bad("UNSUPPORTED_OPENAPI_FEATURE", f"the schema uses {key}")
    if "$ref" in node:
        ref = node["$ref"]
        name = ref.removeprefix(ROOT) if isinstance(ref, str) and ref.startswith(ROOT) else None
        if name is None or name not in schemas or name in path:
            raise bad("INVALID_REF", f"{ref!r} leads nowhere or back to itself")
        return inline(schemas[name], schemas, (*path, name))
    out = {k: inline(v, schemas, path) if k == "items" else {n: inline(p, schemas, path) for n, p in v.items()} if k == "properties" and isinstance(v, dict) else v for k, v in node.items() if k != "nullable"}
    if node.get("nullable") is True and isinstance(out.get("type"), str):
        out["type"] = [out["type"], "null"]
    return out


def adapt(external: Any) -> Contract:
    if not isinstance(external, dict):
        raise bad("INVALID_OPENAPI_DOCUMENT", "a dict is needed")
    if external.get("openapi") not in VERSIONS:
        raise bad("INVALID_OPENAPI_VERSION", f"OpenAPI {external.get('openapi')!r} isn't read")
    for key in REFUSED:
        if key in external:
            raise bad("UNSUPPORTED_OPENAPI_FEATURE", f"the document uses {key}")
    components = external.get("components")
    schemas = components.get("schemas") if isinstance(components, dict) else None
    if not isinstance(schemas, dict) or not schemas:
        raise bad("INVALID_OPENAPI_DOCUMENT", "the document has no component schema")
    name = next(iter(schemas))
    info = external.get("info")
    return json_schema.adapt(inline(schemas[name], schemas, (name,)), (info.get("title") if isinstance(info, dict) else None) or name)


def export(contract: Contract) -> dict[str, Any]:
    schema = {k: v for k, v in json_schema.export(contract).items() if k not in ("$schema", "title")}
    for p in schema["properties"].values():
        if isinstance(p.get("type"), list):
            p["type"], p["nullable"] = p["type"][0], True
    return {"openapi": "3.0.3", "info": {"title": contract.id, "version": contract.version}, "paths": {}, "components": {"schemas": {contract.id: schema}}}
