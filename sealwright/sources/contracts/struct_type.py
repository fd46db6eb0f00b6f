"""Spark struct types as contracts, and contracts as struct types."""

from __future__ import annotations

from typing import Any

from pyspark.sql import types as T

from ...model import Contract, Field, FieldType
from ...schemas import contract_to_struct
from .dsl import bad


def is_struct(external: Any) -> bool:
    return isinstance(external, T.StructType)


def _kind(t: T.DataType) -> FieldType:
    if isinstance(t, T.StructType):
        return FieldType.MONEY if {"amount", "currency"} <= set(t.names) else FieldType.OBJECT
    for types_, kind in (((T.StringType,), FieldType.STRING), ((T.BooleanType,), FieldType.BOOLEAN), ((T.IntegralType,), FieldType.INTEGER), ((T.FractionalType,), FieldType.DECIMAL), ((T.DateType, T.TimestampType, T.TimestampNTZType), FieldType.DATE), ((T.ArrayType,), FieldType.ARRAY), ((T.MapType, T.VariantType), FieldType.OBJECT)):
        if isinstance(t, types_):
            return kind
    raise bad("UNSUPPORTED_FIELD_TYPE", f"{t.simpleString()} has no field type")


def adapt(external: T.StructType, contract_id: str = "struct") -> Contract:
    if not external.fields:
        raise bad("EMPTY_FIELDS", "a struct needs a field")
    fields = []
    for f in external.fields:
        meta = f.metadata or {}
        kind = FieldType[meta["type"]] if meta.get("type") in FieldType.__members__ and meta["type"] != "ENUM" else _kind(f.dataType)
        fields.append(Field(f"field_{contract_id}_{f.name}", meta.get("path", f.name), f.name, kind, not f.nullable, nullable=f.nullable, confidence_threshold=meta.get("threshold", 0.80)))
    return Contract(contract_id, tuple(fields))


def export(contract: Contract) -> T.StructType:
    return contract_to_struct(contract)
