"""Pydantic-style model classes: anything with model_fields."""

from __future__ import annotations

import datetime
import enum
import types
import typing
from decimal import Decimal
from typing import Any

from ...model import Constraint, ConstraintKind, Contract, Field, FieldType, Money
from .dsl import bad

_UNSET = ("PydanticUndefined", "Undefined")


def _is_money(kind: Any) -> bool:
    """Money itself, or a model of an amount and a currency."""
    return kind is Money or isinstance(kind, type) and set(getattr(kind, "model_fields", ())) >= {"amount", "currency"} and "money" in kind.__name__.lower()


def classify(kind: Any) -> tuple[FieldType, bool, tuple[Any, ...] | None]:
    """(type, optional, choices) of an annotation."""
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if origin in (typing.Union, types.UnionType):
        rest = [a for a in args if a is not type(None)]
        if len(rest) != 1:
            raise bad("UNSUPPORTED_FIELD_TYPE", f"{kind!r} has several types")
        return classify(rest[0])[0], len(rest) < len(args), classify(rest[0])[2]
    if origin is typing.Annotated:
        return classify(args[0])
    if origin is typing.Literal:
        return FieldType.ENUM, False, tuple(args)
    if _is_money(kind):
        return FieldType.MONEY, False, None
    if isinstance(kind, type) and hasattr(kind, "model_fields"):
        return FieldType.OBJECT, False, None
    if isinstance(kind, type) and issubclass(kind, enum.Enum):
        return FieldType.ENUM, False, tuple(m.value for m in kind)
    for types_, name in (((bool,), FieldType.BOOLEAN), ((str,), FieldType.STRING), ((int,), FieldType.INTEGER), ((float, Decimal), FieldType.DECIMAL), ((datetime.date, datetime.datetime), FieldType.DATE), ((dict,), FieldType.OBJECT), ((list, tuple, set, frozenset), FieldType.ARRAY)):
        if (origin or kind) in types_:
            return name, False, None
    raise bad("UNSUPPORTED_FIELD_TYPE", f"{kind!r} has no field type")


def _constraints(kind: FieldType, metadata) -> tuple[Constraint, ...]:
    out = []
    for m in metadata:
        if (low := getattr(m, "min_length", None)) is not None:
            out.append(Constraint.of(ConstraintKind.MIN_LENGTH, min=low))
        if (high := getattr(m, "max_length", None)) is not None:
            out.append(Constraint.of(ConstraintKind.MAX_LENGTH, max=high))
        if (pattern := getattr(m, "pattern", None)) is not None:
            out.append(Constraint.of(ConstraintKind.PATTERN, pattern=getattr(pattern, "pattern", pattern)))
        if kind in (FieldType.INTEGER, FieldType.DECIMAL, FieldType.MONEY):
            for name, to, param, more in (("ge", ConstraintKind.MIN_VALUE, "min", {}), ("gt", ConstraintKind.MIN_VALUE, "min", {"inclusive": False}), ("le", ConstraintKind.MAX_VALUE, "max", {}), ("lt", ConstraintKind.MAX_VALUE, "max", {"inclusive": False})):
                if (x := getattr(m, name, None)) is not None:
                    out.append(Constraint.of(to, **{param: x}, **more))
    return tuple(out)


def adapt(external: Any) -> Contract:
    found = getattr(external, "model_fields", None)
    if not found:
        raise bad("EMPTY_FIELDS", "a model class with fields is needed")
    id_, fields = external.__name__, []
    for name, info in found.items():
        kind, optional, choices = classify(info.annotation)
        value = None if type(info.default).__name__ + "Type" in _UNSET or type(info.default).__name__ in ("PydanticUndefinedType", "ellipsis") else info.default
        has = value is not None or info.default_factory is not None or optional and not info.is_required()
        if isinstance(value, enum.Enum):
            value = value.value
        if isinstance(value, (datetime.date, datetime.datetime)):
            value = value.isoformat()
        if kind is FieldType.MONEY and value is not None and not isinstance(value, Money):
            value = Money(Decimal(str(value.amount)), value.currency)
        fields.append(Field(f"field_{id_}_{name}", name, name, kind, not has and not optional, nullable=optional, description=info.description, enum_values=choices, default=value, constraints=_constraints(kind, info.metadata)))
    return Contract(id_, tuple(fields))


def export(contract: Contract) -> type:
    """A model class made by pydantic, which must be installed for this alone."""
    from pydantic import create_model

    to = {FieldType.STRING: str, FieldType.INTEGER: int, FieldType.DECIMAL: Decimal, FieldType.BOOLEAN: bool, FieldType.DATE: str, FieldType.OBJECT: dict, FieldType.ARRAY: list, FieldType.MONEY: dict}

    def one(f: Field):
        kind = typing.Literal[f.enum_values] if f.type is FieldType.ENUM else to[f.type]
        kind = kind | None if f.nullable and f.type is not FieldType.ENUM else kind
        return kind, ... if f.required else f.default

    return create_model(contract.id.replace("-", "_"), **{f.name: one(f) for f in contract.fields})
