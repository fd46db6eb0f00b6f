"""The dict language of contracts: {id, version, fields: [{name, type, required, ...}], policies}."""

from __future__ import annotations

import re
from decimal import Decimal, InvalidOperation
from typing import Any

from ...errors import InvalidContractError
from ...model import CURRENCY, Constraint, ConstraintKind, Contract, ContractPolicy, Field, FieldType, Money

TAG = re.compile(r"[a-z][a-z0-9-]*")
PARAMETER = {ConstraintKind.MIN_LENGTH: "min", ConstraintKind.MAX_LENGTH: "max", ConstraintKind.PATTERN: "pattern", ConstraintKind.MIN_VALUE: "min", ConstraintKind.MAX_VALUE: "max", ConstraintKind.ENUM: "values"}
POLICY_KEYS = ("confidence_floor", "unresolved_acceptable", "stop_on_first_unresolved")


def bad(code: str, message: str) -> InvalidContractError:
    return InvalidContractError(message, code)


def constraint(spec: Any) -> Constraint:
    if not isinstance(spec, dict) or "kind" not in spec:
        raise bad("INVALID_CONSTRAINT", f"not a constraint: {spec!r}")
    try:
        kind = ConstraintKind(str(spec["kind"]).lower())
    except ValueError:
        raise bad("UNKNOWN_CONSTRAINT_KIND", f"unknown constraint kind {spec['kind']!r}") from None
    params = {k: v for k, v in (spec.get("params") or {k: v for k, v in spec.items() if k != "kind"}).items()}
    need = PARAMETER.get(kind)
    if need and need not in params:
        raise bad("CONSTRAINT_PARAM_MISSING", f"{kind.value} needs {need}")
    if kind is ConstraintKind.PATTERN:
        try:
            re.compile(params["pattern"])
        except (re.error, TypeError):
            raise bad("INVALID_REGEX_PATTERN", f"{params['pattern']!r} doesn't compile") from None
    if kind is ConstraintKind.ENUM:
        if not isinstance(params["values"], (list, tuple)):
            raise bad("INVALID_CONSTRAINT", "enum values must be a list")
        params["values"] = tuple(params["values"])
    return Constraint.of(kind, **params)


def money(value: Any) -> Money:
    if not isinstance(value, dict) or "currency" not in value:
        raise bad("MONEY_REQUIRES_CURRENCY", f"{value!r} has no currency")
    if not isinstance(value["currency"], str) or not CURRENCY.fullmatch(value["currency"]):
        raise bad("INVALID_ISO_4217", f"{value['currency']!r} is not a currency code")
    try:
        return Money(Decimal(str(value["amount"])), value["currency"])
    except (KeyError, InvalidOperation):
        raise bad("DEFAULT_TYPE_MISMATCH", f"{value!r} has no amount") from None


def default(kind: FieldType, value: Any, choices) -> Any:
    if value is None:
        return None
    if kind is FieldType.MONEY:
        return money(value)
    if kind is FieldType.DECIMAL:
        if isinstance(value, (bool, float)) or not isinstance(value, (str, int, Decimal)):
            raise bad("DEFAULT_TYPE_MISMATCH", f"{value!r} is no exact decimal")
        try:
            return Decimal(value)
        except InvalidOperation:
            raise bad("DEFAULT_TYPE_MISMATCH", f"{value!r} is no decimal") from None
    plain = {FieldType.STRING: str, FieldType.INTEGER: int, FieldType.BOOLEAN: bool, FieldType.DATE: str, FieldType.OBJECT: dict, FieldType.ARRAY: (list, tuple)}.get(kind, object)
    if not isinstance(value, plain) or kind is FieldType.INTEGER and isinstance(value, bool) or kind is FieldType.ENUM and value not in choices:
        raise bad("DEFAULT_TYPE_MISMATCH", f"{value!r} doesn't suit {kind.name}")
    return value


def field(contract_id: str, spec: Any) -> Field:
    if not isinstance(spec, dict):
        raise bad("INVALID_FIELD", f"not a field: {spec!r}")
    name = spec.get("name")
    if not isinstance(name, str) or not name:
        raise bad("MISSING_FIELD_NAME", "a field needs a name")
    if "type" not in spec:
        raise bad("MISSING_TYPE", f"{name} needs a type")
    try:
        kind = FieldType[str(spec["type"]).upper()]
    except KeyError:
        raise bad("UNKNOWN_FIELD_TYPE", f"{name} has the unknown type {spec['type']!r}") from None
    if not isinstance(spec.get("required"), bool):
        raise bad("MISSING_REQUIRED_FLAG", f"{name} needs required: true or false")
    tags = tuple(spec.get("semantic_tags", ()))
    if not all(isinstance(t, str) and TAG.fullmatch(t) for t in tags):
        raise bad("INVALID_FIELD", f"bad tags of {name}: {tags!r}")
    constraints = tuple(constraint(c) for c in spec.get("constraints", ()))
    choices = None
    if kind is FieldType.ENUM:
        choices = spec.get("enum_values") or next((c["values"] for c in constraints if c.kind is ConstraintKind.ENUM), None)
        if not choices:
            raise bad("MISSING_ENUM_VALUES", f"{name} needs values")
        choices = tuple(choices)
    try:
        return Field(
            f"field_{contract_id}_{name}", name, name, kind, spec["required"], bool(spec.get("critical", False)), bool(spec.get("nullable", False)), spec.get("description"),
            float(spec.get("confidence_threshold", 0.80)), bool(spec.get("evidence_required", False)), tags, enum_values=choices, default=default(kind, spec.get("default"), choices), constraints=constraints,
        )
    except ValueError as e:
        raise bad("INVALID_FIELD", str(e)) from None


def policies(spec: Any) -> ContractPolicy:
    if not isinstance(spec, dict) or set(spec) - set(POLICY_KEYS):
        raise bad("INVALID_POLICY_KEY", f"policies have the keys {', '.join(POLICY_KEYS)}")
    floor = spec.get("confidence_floor")
    if floor is not None and (isinstance(floor, bool) or not isinstance(floor, (int, float)) or not 0 <= floor <= 1):
        raise bad("INVALID_CONFIDENCE_FLOOR", f"{floor!r} doesn't lie in [0, 1]")
    return ContractPolicy(**spec)


def adapt(external: Any) -> Contract:
    if not isinstance(external, dict):
        raise bad("INVALID_CONTRACT", "a dict is needed")
    id_ = external.get("id")
    if not isinstance(id_, str) or not id_:
        raise bad("MISSING_CONTRACT_ID", "a contract needs an id")
    if "fields" not in external or not isinstance(external["fields"], (list, tuple)):
        raise bad("MISSING_FIELDS", "a contract needs a list of fields")
    if not external["fields"]:
        raise bad("EMPTY_FIELDS", "a contract needs a field")
    version = external.get("version", "1")
    if not isinstance(version, str) or not version:
        raise bad("INVALID_VERSION", f"bad version {version!r}")
    fields = tuple(field(id_, f) for f in external["fields"])
    return Contract(id_, fields, version, policy=policies(external.get("policies", {})))


def export(contract: Contract) -> dict[str, Any]:
    """The dict of a contract; defaults that adapt() can't read back are written as it reads them."""

    def one(f: Field) -> dict[str, Any]:
        out: dict[str, Any] = {"name": f.name, "type": f.type.name, "required": f.required}
        plain = {"critical": f.critical, "nullable": f.nullable, "description": f.description, "evidence_required": f.evidence_required, "semantic_tags": list(f.semantic_tags), "enum_values": list(f.enum_values or ())}
        out |= {k: v for k, v in plain.items() if v}
        if f.confidence_threshold != 0.80:
            out["confidence_threshold"] = f.confidence_threshold
        if f.default is not None:
            d = f.default
            out["default"] = {"amount": str(d.amount), "currency": d.currency} if isinstance(d, Money) else str(d) if f.type is FieldType.DECIMAL else d
        if f.constraints:
            out["constraints"] = [{"kind": c.kind.value, **{k: list(v) if isinstance(v, tuple) else v for k, v in c.params}} for c in f.constraints]
        return out

    policy = {k: getattr(contract.policy, k) for k in POLICY_KEYS if getattr(contract.policy, k) is not None}
    return {"id": contract.id, "version": contract.version, "fields": [one(f) for f in contract.fields]} | ({"policies": policy} if policy else {})
