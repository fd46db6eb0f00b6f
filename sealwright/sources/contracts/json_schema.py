"""JSON Schema objects, as dicts or JSON text."""

from __future__ import annotations

import json
import re
from decimal import Decimal
from typing import Any

from ...model import Constraint, ConstraintKind, Contract, Field, FieldType, Money
from .dsl import bad, money

#: Drafts that are read (fixed values).
DRAFTS = ("draft/2020-12", "draft/2019-09", "draft-07", "draft-06", "draft-04")
MONEY_MARK, MONEY_NAME = "x-field-type", "MONEY"
#: The keys by which a property says that it is money: x-field-type, or another maker's x-...-type.
MONEY_MARKS = r"x-[a-z0-9]+-type"
REFUSED = ("const", "oneOf", "anyOf", "allOf", "$ref")
TYPES = {"string": FieldType.STRING, "integer": FieldType.INTEGER, "number": FieldType.DECIMAL, "boolean": FieldType.BOOLEAN, "object": FieldType.OBJECT, "array": FieldType.ARRAY}


def constraints(kind: FieldType, spec: dict[str, Any]) -> tuple[Constraint, ...]:
    out = []
    sized = {FieldType.STRING: ("minLength", "maxLength"), FieldType.ARRAY: ("minItems", "maxItems")}.get(kind, ())
    for key, name, param in zip(sized, (ConstraintKind.MIN_LENGTH, ConstraintKind.MAX_LENGTH), ("min", "max"), strict=False):
        if key in spec:
            out.append(Constraint.of(name, **{param: spec[key]}))
    if kind is FieldType.STRING and "pattern" in spec:
        out.append(Constraint.of(ConstraintKind.PATTERN, pattern=spec["pattern"]))
    if kind in (FieldType.INTEGER, FieldType.DECIMAL):
        for name, param, closed, open_ in ((ConstraintKind.MIN_VALUE, "min", "minimum", "exclusiveMinimum"), (ConstraintKind.MAX_VALUE, "max", "maximum", "exclusiveMaximum")):
            if closed in spec:
                out.append(Constraint.of(name, **{param: spec[closed]}))
            elif open_ in spec and not isinstance(spec[open_], bool):
                out.append(Constraint.of(name, **{param: spec[open_], "inclusive": False}))
    return tuple(out)


def prop(contract_id: str, name: str, spec: Any, required: bool, marks: str = MONEY_MARKS) -> Field:
    if not isinstance(spec, dict):
        raise bad("INVALID_FIELD", f"{name} is not an object")
    for key in REFUSED:
        if key in spec:
            raise bad("UNSUPPORTED_JSON_SCHEMA_FEATURE", f"{name} uses {key}")
    if spec.get("additionalProperties") is False:
        raise bad("UNSUPPORTED_JSON_SCHEMA_FEATURE", f"{name} closes its properties")
    declared, nullable = spec.get("type", "string"), False
    if isinstance(declared, list):
        nullable = "null" in declared
        declared = [t for t in declared if t != "null"]
        if len(declared) != 1:
            raise bad("UNSUPPORTED_FIELD_TYPE", f"{name} has the types {spec['type']!r}")
        declared = declared[0]
    if declared == "null":
        declared, nullable, required = "string", True, False
    choices, rules, value = None, (), spec.get("default")
    if any(re.fullmatch(marks, k) and str(v).upper() == MONEY_NAME for k, v in spec.items()):
        kind, rules, value = FieldType.MONEY, (Constraint.of(ConstraintKind.ISO_4217),), None if value is None else money(value)
    elif "enum" in spec:
        kind, choices = FieldType.ENUM, tuple(spec["enum"])
        if not choices:
            raise bad("MISSING_ENUM_VALUES", f"{name} has no values")
        rules = (Constraint.of(ConstraintKind.ENUM, values=choices),)
    elif declared == "string" and spec.get("format") in ("date", "date-time"):
        kind = FieldType.DATE
    elif declared in TYPES:
        kind = TYPES[declared]
        rules = constraints(kind, spec)
    else:
        raise bad("UNSUPPORTED_FIELD_TYPE", f"{name} has the type {declared!r}")
    try:
        return Field(f"field_{contract_id}_{name}", name, name, kind, required, nullable=nullable, description=spec.get("description"), enum_values=choices, default=value, constraints=rules)
    except ValueError as e:
        raise bad("INVALID_FIELD", str(e)) from None


def adapt(external: Any, contract_id: str | None = None) -> Contract:
    if isinstance(external, str):
        try:
            external = json.loads(external)
        except ValueError:
            raise bad("INVALID_CONTRACT", "not JSON") from None
    if not isinstance(external, dict) or external.get("type", "object") != "object":
        raise bad("INVALID_CONTRACT", "an object schema is needed")
    if "$schema" in external and not any(d in str(external["$schema"]) for d in DRAFTS):
        raise bad("UNSUPPORTED_JSON_SCHEMA_FEATURE", f"unknown draft {external['$schema']!r}")
    for key in REFUSED:
        if key in external:
            raise bad("UNSUPPORTED_JSON_SCHEMA_FEATURE", f"the schema uses {key}")
    properties = external.get("properties")
    if not isinstance(properties, dict) or not properties:
        raise bad("EMPTY_FIELDS", "a schema needs a property")
    required = external.get("required", [])
    if not isinstance(required, list) or not all(isinstance(r, str) for r in required):
        raise bad("INVALID_CONTRACT", "required must be a list of names")
    id_ = contract_id or external.get("title") or str(external.get("$id", "")).rstrip("/").rpartition("/")[2] or "untitled"
    return Contract(id_, tuple(prop(id_, n, s, n in required) for n, s in properties.items()))


def export(contract: Contract) -> dict[str, Any]:
    names = {v: k for k, v in TYPES.items()}

    def one(f: Field) -> dict[str, Any]:
        if f.type is FieldType.MONEY:
            out: dict[str, Any] = {"type": "object", MONEY_MARK: MONEY_NAME, "properties": {"amount": {"type": "number"}, "currency": {"type": "string"}}}
        elif f.type is FieldType.ENUM:
            out = {"enum": list(f.enum_values)}
        elif f.type is FieldType.DATE:
            out = {"type": "string", "format": "date"}
        else:
            out = {"type": [names[f.type], "null"] if f.nullable else names[f.type]}
        items = f.type is FieldType.ARRAY
        keys = {ConstraintKind.MIN_LENGTH: ("minItems" if items else "minLength", "min"), ConstraintKind.MAX_LENGTH: ("maxItems" if items else "maxLength", "max"), ConstraintKind.PATTERN: ("pattern", "pattern"), ConstraintKind.MIN_VALUE: ("minimum", "min"), ConstraintKind.MAX_VALUE: ("maximum", "max")}
        for c in f.constraints:
            if c.kind in keys:
                key, param = keys[c.kind]
                if c["inclusive"] is False:
                    key = "exclusive" + key.capitalize()
                out[key] = c[param]
        if f.description:
            out["description"] = f.description
        if f.default is not None:
            d = f.default
            out["default"] = {"amount": str(d.amount), "currency": d.currency} if isinstance(d, Money) else float(d) if isinstance(d, Decimal) else d
        return out

    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": contract.id, "type": "object", "properties": {f.name: one(f) for f in contract.fields}, "required": [f.name for f in contract.required()]}
