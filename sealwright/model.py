"""The contract, the plan and the policies: frozen objects of the driver."""

from __future__ import annotations

import enum
import math
import re
from dataclasses import dataclass, field, replace
from decimal import Decimal
from typing import Any

from .errors import InvalidContractError, InvalidPathError, InvalidSemanticTagError

PATH = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(\[\])?(\.[A-Za-z_][A-Za-z0-9_]*(\[\])?)*")
CURRENCY = re.compile(r"[A-Z]{3}")


class FieldType(enum.Enum):
    STRING = "string"
    INTEGER = "integer"
    DECIMAL = "decimal"
    BOOLEAN = "boolean"
    DATE = "date"
    ENUM = "enum"
    OBJECT = "object"
    ARRAY = "array"
    MONEY = "money"


class ConstraintKind(enum.Enum):
    MIN_LENGTH = "min_length"
    MAX_LENGTH = "max_length"
    PATTERN = "pattern"
    MIN_VALUE = "min_value"
    MAX_VALUE = "max_value"
    ENUM = "enum"
    ISO_4217 = "iso_4217"


#: Which constraints a field type may carry; checked by Contract.validate() alone.
LEGAL = {
    ConstraintKind.MIN_LENGTH: (FieldType.STRING, FieldType.ARRAY),
    ConstraintKind.MAX_LENGTH: (FieldType.STRING, FieldType.ARRAY),
    ConstraintKind.PATTERN: (FieldType.STRING,),
    ConstraintKind.MIN_VALUE: (FieldType.INTEGER, FieldType.DECIMAL, FieldType.MONEY),
    ConstraintKind.MAX_VALUE: (FieldType.INTEGER, FieldType.DECIMAL, FieldType.MONEY),
    ConstraintKind.ENUM: (FieldType.STRING, FieldType.INTEGER),
    ConstraintKind.ISO_4217: (FieldType.STRING, FieldType.MONEY),
}


class Resolution(enum.Enum):
    UNRESOLVED = "UNRESOLVED"
    USE_DEFAULT = "USE_DEFAULT"
    REQUIRE_HUMAN = "REQUIRE_HUMAN"


class Merge(enum.Enum):
    UNION = "UNION"
    INTERSECTION = "INTERSECTION"
    PREFER_BY_EVIDENCE = "PREFER_BY_EVIDENCE"


class CurrencyPolicy(enum.Enum):
    STRICT_MATCH = "STRICT_MATCH"
    ALLOW_FX = "ALLOW_FX"
    REJECT_WITHOUT_RATE = "REJECT_WITHOUT_RATE"


class Tier(enum.IntEnum):
    LOCAL_DETERMINISTIC = 1
    STRUCTURED_LOOKUP = 2
    LOCAL_INFERENCE = 4
    REMOTE_INFERENCE = 5


@dataclass(frozen=True)
class Constraint:
    kind: ConstraintKind
    params: tuple[tuple[str, Any], ...] = ()
    message: str | None = None

    @classmethod
    def of(cls, kind: str | ConstraintKind, message: str | None = None, **params) -> Constraint:
        return cls(ConstraintKind(kind), tuple(sorted(params.items())), message)

    def __getitem__(self, name: str):
        return dict(self.params).get(name)


@dataclass(frozen=True)
class Money:
    amount: Decimal
    currency: str
    precision: int | None = 2

    def __post_init__(self):
        if not isinstance(self.amount, Decimal):
            raise TypeError("amount must be a Decimal")
        if not CURRENCY.fullmatch(self.currency):
            raise ValueError(f"{self.currency!r} is not a currency code")
        if self.precision is not None and self.precision < 0:
            raise ValueError("precision must not be negative")


def _suits(kind: FieldType, value: Any) -> bool:
    plain = not isinstance(value, bool)
    return {
        FieldType.STRING: isinstance(value, str),
        FieldType.INTEGER: plain and isinstance(value, int),
        FieldType.DECIMAL: plain and isinstance(value, (int, float, Decimal)),
        FieldType.BOOLEAN: isinstance(value, bool),
        FieldType.DATE: isinstance(value, str),
        FieldType.OBJECT: isinstance(value, dict),
        FieldType.ARRAY: isinstance(value, (list, tuple)),
        FieldType.MONEY: isinstance(value, Money),
        FieldType.ENUM: True,
    }[kind]


@dataclass(frozen=True)
class Field:
    id: str
    path: str
    name: str
    type: FieldType
    required: bool = True
    critical: bool = False
    nullable: bool = False
    description: str | None = None
    confidence_threshold: float = 0.80
    evidence_required: bool = False
    semantic_tags: tuple[str, ...] = ()
    fallback: Resolution = Resolution.UNRESOLVED
    enum_values: tuple[Any, ...] | None = None
    default: Any = None
    constraints: tuple[Constraint, ...] = ()

    def __post_init__(self):
        if not self.id or not self.name or "." in self.name or "[]" in self.name:
            raise ValueError(f"bad field id or name: {self.id!r}, {self.name!r}")
        if not PATH.fullmatch(self.path):
            raise InvalidPathError(f"bad field path: {self.path!r}")
        if not 0 <= self.confidence_threshold <= 1:
            raise ValueError("confidence_threshold must lie in [0, 1]")
        if (self.type is FieldType.ENUM) != (self.enum_values is not None):
            raise ValueError("enum_values go with ENUM fields, and only with them")
        if self.enum_values is not None:
            values = tuple(dict.fromkeys(self.enum_values))
            if not values:
                raise ValueError("enum_values must not be empty")
            object.__setattr__(self, "enum_values", values)
        if self.default is not None and (not _suits(self.type, self.default) or self.type is FieldType.ENUM and self.default not in self.enum_values):
            raise ValueError(f"default {self.default!r} doesn't suit {self.type.name}")


@dataclass(frozen=True)
class ContractPolicy:
    confidence_floor: float | None = None
    unresolved_acceptable: bool | None = None
    allow_remote_inference: bool | None = None
    allow_local_inference: bool | None = None
    stop_on_first_unresolved: bool | None = None


@dataclass(frozen=True)
class Contract:
    id: str
    fields: tuple[Field, ...]
    version: str = "1"
    constraints: tuple[Constraint, ...] = ()
    policy: ContractPolicy = ContractPolicy()

    def __post_init__(self):
        if not self.fields:
            raise InvalidContractError("a contract needs a field", "EMPTY_FIELDS")
        for what in ("id", "path"):
            names = [getattr(f, what) for f in self.fields]
            if len(set(names)) < len(names):
                raise InvalidContractError(f"two fields have one {what}", "DUPLICATE_FIELD")

    def required(self) -> tuple[Field, ...]:
        return tuple(f for f in self.fields if f.required)

    def by_path(self, path: str) -> Field | None:
        return next((f for f in self.fields if f.path == path), None)

    def by_id(self, field_id: str) -> Field | None:
        return next((f for f in self.fields if f.id == field_id), None)

    def with_field(self, path: str, **changes) -> Contract:
        return replace(self, fields=tuple(replace(f, **changes) if f.path == path else f for f in self.fields))

    def validate(self) -> None:
        """The checks that adapters don't make: constraints that suit their type, and tags in normal form."""
        for f in self.fields:
            for c in f.constraints:
                if f.type not in LEGAL[c.kind]:
                    raise InvalidContractError(f"{c.kind.name} doesn't suit {f.type.name} field {f.path}", "ILLEGAL_CONSTRAINT")
            if normal_tags(f.semantic_tags) != tuple(f.semantic_tags):
                raise InvalidSemanticTagError(f"tags of {f.path} aren't sorted and distinct", "BAD_TAGS")


#: Tags that hint at a field's type, and what they hint at (fixed values).
TYPE_TAGS = {
    "iso4217": FieldType.STRING,
    "email": FieldType.STRING,
    "url": FieldType.STRING,
    "phone": FieldType.STRING,
    "date": FieldType.DATE,
    "datetime": FieldType.DATE,
}
#: Tags that hint at planning (fixed values).
PLANNING_TAGS = (
    "pii",
    "currency-sensitive",
    "high-stakes",
    "regex-able",
    "lookup-able",
)


def is_known_tag(tag: str) -> bool:
    return tag in TYPE_TAGS or tag in PLANNING_TAGS


def suggested_type(tags) -> FieldType | None:
    """What the first tag that hints at a type hints at."""
    return next((TYPE_TAGS[t] for t in tags if t in TYPE_TAGS), None)


def normal_tags(tags) -> tuple[str, ...]:
    for t in tags:
        if not (t.isascii() and t.islower()):
            raise InvalidSemanticTagError(f"tag {t!r} isn't lower-case ASCII", "BAD_TAGS")
    return tuple(sorted(set(tags)))


def _cap(value, name: str, whole: bool = True):
    if value is None:
        return None
    if isinstance(value, bool):
        raise TypeError(f"{name} must be a number")
    if not whole:
        value = Decimal(str(value))
        if not value.is_finite():
            raise ValueError(f"{name} must be finite")
    elif not isinstance(value, int):
        raise TypeError(f"{name} must be an int")
    if value < 0:
        raise ValueError(f"{name} must not be negative")
    return value


@dataclass(frozen=True)
class Budget:
    max_total_cost_usd: Decimal | None = None
    max_total_latency_ms: int | None = None
    max_remote_inferences: int | None = None
    max_capability_invocations: int | None = None

    def __post_init__(self):
        object.__setattr__(self, "max_total_cost_usd", _cap(self.max_total_cost_usd, "max_total_cost_usd", False))
        for name in ("max_total_latency_ms", "max_remote_inferences", "max_capability_invocations"):
            _cap(getattr(self, name), name)


@dataclass(frozen=True)
class Policy:
    allow_remote_inference: bool = True
    allow_local_inference: bool = True
    unresolved_acceptable: bool = True
    confidence_floor: float = 0.80
    stop_on_first_unresolved: bool = False
    emit_metrics: bool = False
    log_raw_input: bool = False
    record_inference_io: bool = False
    embed_evidence_payload: bool = False

    def __post_init__(self):
        if not 0 <= self.confidence_floor <= 1 or math.isnan(self.confidence_floor):
            raise ValueError("confidence_floor must lie in [0, 1]")

    def under(self, own: ContractPolicy) -> Policy:
        """This policy with what the contract sets itself."""
        return replace(self, **{k: v for k, v in vars(own).items() if v is not None})


@dataclass(frozen=True)
class Cost:
    tokens: int = 0
    latency_ms: int = 0
    usd: Decimal = Decimal(0)


@dataclass(frozen=True)
class CapabilitySpec:
    id: str
    version: str
    tier: Tier
    input_types: tuple[str, ...] = ()
    output_type: str = "STRING"
    cost: Cost = Cost()
    deterministic: bool = True
    required_providers: tuple[str, ...] = ()

    def accepts(self, kind: FieldType) -> bool:
        return not self.input_types or kind.name in self.input_types

    @property
    def score(self) -> float:
        return int(self.tier) * 10_000 + float(self.cost.usd) * 1e6 + self.cost.latency_ms


@dataclass(frozen=True)
class Step:
    capability_id: str
    capability_version: str = "1.0"
    config: dict[str, Any] = field(default_factory=dict, hash=False)
    note: str = ""


@dataclass(frozen=True)
class FieldPlan:
    field_id: str
    steps: tuple[Step, ...] = ()


@dataclass(frozen=True)
class Plan:
    """Chains of fields, with the diagnostics (code, severity, message, field path) of planning."""

    contract_id: str
    fields: tuple[FieldPlan, ...]
    diagnostics: tuple[tuple[str, str, str, str], ...] = ()

    def __post_init__(self):
        ids = [f.field_id for f in self.fields]
        if len(set(ids)) < len(ids):
            raise ValueError("two field plans have one field id")
