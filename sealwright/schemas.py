"""Struct types of what travels in a row."""

from __future__ import annotations

from pyspark.sql import types as T

from .model import Contract, FieldType

EVIDENCE = "struct<capability_id:string,capability_version:string,tier:int,deterministic:boolean,field_path:string,span_start:bigint,span_end:bigint,model_id:string,prompt_tokens:int,completion_tokens:int>"
DIAGNOSTIC = "struct<code:string,severity:string,message:string,field_path:string>"
#: pos orders the candidates of a field; amount and currency are set for money alone.
CANDIDATE = f"struct<pos:int,value:string,amount:decimal(20,6),currency:string,evidence:array<{EVIDENCE}>>"
RESOLVED = f"struct<field_id:string,field_path:string,type:string,status:string,value:string,confidence:double,band:string,conflict:boolean,strategy:string,evidence:array<{EVIDENCE}>,diagnostics:array<{DIAGNOSTIC}>>"

MONEY = T.StructType([T.StructField("amount", T.DecimalType(20, 6)), T.StructField("currency", T.StringType()), T.StructField("precision", T.IntegerType())])

TO_SPARK = {
    FieldType.STRING: T.StringType(),
    FieldType.INTEGER: T.LongType(),
    FieldType.DECIMAL: T.DecimalType(38, 18),
    FieldType.BOOLEAN: T.BooleanType(),
    FieldType.DATE: T.StringType(),
    FieldType.ENUM: T.StringType(),
    FieldType.OBJECT: T.VariantType(),
    FieldType.ARRAY: T.VariantType(),
    FieldType.MONEY: MONEY,
}


def contract_to_struct(contract: Contract) -> T.StructType:
    """The Spark schema of resolved rows; what a StructField can't say goes into its metadata."""
    return T.StructType([
        T.StructField(f.name, TO_SPARK[f.type], not f.required or f.nullable, {"path": f.path, "type": f.type.name, "threshold": f.confidence_threshold, "tags": list(f.semantic_tags)}) for f in contract.fields
    ])
