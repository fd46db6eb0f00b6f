"""Queries of the engine's smaller parts: contracts, registry, policies, providers, selections, the batch run."""

from __future__ import annotations

import io
from decimal import Decimal
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import errors, storage
from ..clock import FixedClock
from ..errors import EngineError
from ..functions import ids
from ..functions import money as M
from ..functions.constraints import check
from ..model import Budget, Constraint, Contract, ContractPolicy, Field, FieldPlan, FieldType, Plan, Policy, Resolution, Step, is_known_tag, normal_tags, suggested_type
from ..operators import inference, reconcile, reconcile_long
from ..operators.registry import Capability, Registry, builtin, full_registry
from ..sources import manifest
from ..sources.contracts import adapt, export
from . import artifact, planner
from .catalog import _FLAT, CONTACTS, _contacts, query, table
from .engine import normalize


def _values(rows: list[tuple], names: str) -> str:
    text = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS t({names})"


def _attempt(f) -> str:
    """The code of the error that f raises, or OK."""
    try:
        f()
    except EngineError as e:
        return e.code
    except (ValueError, TypeError) as e:
        return type(e).__name__
    return "OK"


# Contracts: what each source makes of the same kinds of fields, written out by hand beside it


def _info(annotation, default=..., **metadata):
    """A field as a model class has it."""
    kinds = [SimpleNamespace(**{k: v}) for k, v in metadata.items()]
    return SimpleNamespace(annotation=annotation, default=default, default_factory=None, metadata=kinds, description=None, is_required=lambda: default is ...)


class _Model:
    model_fields = {"name": _info(str, min_length=1), "total": _info(float, ge=0), "note": _info(str | None, None), "paid": _info(bool, False), "lines": _info(list[int])}


_DSL = {
    "id": "bill",
    "fields": [
        {"name": "name", "type": "string", "required": True, "semantic_tags": ["pii"], "constraints": [{"kind": "min_length", "min": 1}, {"kind": "pattern", "params": {"pattern": "^a"}}]},
        {"name": "code", "type": "ENUM", "required": True, "constraints": [{"kind": "enum", "values": ["x", "y"]}]},
        {"name": "total", "type": "MONEY", "required": False, "default": {"amount": "1.50", "currency": "USD"}, "constraints": [{"kind": "min_value", "min": 0}]},
        {"name": "rate", "type": "DECIMAL", "required": False, "nullable": True, "default": "0.25", "confidence_threshold": 0.5},
    ],
    "policies": {"confidence_floor": 0.85},
}
_SCHEMA = {
    "$schema": "https://json-schema.org/draft/2020-12/schema", "title": "bill", "type": "object", "required": ["name", "n"],
    "properties": {"name": {"type": "string", "minLength": 2, "maxLength": 9}, "n": {"type": "integer", "exclusiveMinimum": 3}, "d": {"type": ["string", "null"], "format": "date"}, "m": {"type": "object", "x-field-type": "MONEY"}, "o": {"type": "object", "x-note": "MONEY"}, "e": {"enum": ["x", "y"], "default": "x"}, "l": {"type": "array", "minItems": 1}},
}
_API = {"openapi": "3.0.3", "info": {"title": "bill"}, "components": {"schemas": {"Bill": {"type": "object", "required": ["x"], "properties": {"x": {"$ref": "#/components/schemas/X"}, "y": {"type": "boolean", "nullable": True}}}, "X": {"type": "number", "minimum": 0, "maximum": 5}}}}
_DETAILS = [
    ("dict_dsl", "name", "STRING", True, False, None, "min_length,pattern"), ("dict_dsl", "code", "ENUM", True, False, None, "enum"), ("dict_dsl", "total", "MONEY", False, False, "1.50 USD", "min_value"), ("dict_dsl", "rate", "DECIMAL", False, True, "0.25", ""),
    ("json_schema:2020-12", "name", "STRING", True, False, None, "min_length,max_length"), ("json_schema:2020-12", "n", "INTEGER", True, False, None, "min_value"), ("json_schema:2020-12", "d", "DATE", False, True, None, ""),
    ("json_schema:2020-12", "m", "MONEY", False, False, None, "iso_4217"), ("json_schema:2020-12", "o", "OBJECT", False, False, None, ""), ("json_schema:2020-12", "e", "ENUM", False, False, "x", "enum"), ("json_schema:2020-12", "l", "ARRAY", False, False, None, "min_length"),
    ("openapi:3.x", "x", "DECIMAL", True, False, None, "min_value,max_value"), ("openapi:3.x", "y", "BOOLEAN", False, True, None, ""),
    ("pydantic:v2", "name", "STRING", True, False, None, "min_length"), ("pydantic:v2", "total", "DECIMAL", True, False, None, "min_value"), ("pydantic:v2", "note", "STRING", False, True, None, ""), ("pydantic:v2", "paid", "BOOLEAN", False, False, "false", ""), ("pydantic:v2", "lines", "ARRAY", True, False, None, ""),
    ("spark_struct", "k", "INTEGER", True, False, None, ""), ("spark_struct", "t", "DATE", False, True, None, ""),
]


@query(_values(_DETAILS, "format, path, type, required, nullable, default_value, constraints"))
def contract_details(spark, sf_dir):
    """Fields of each source language, with what their declarations say; formats are detected."""
    from pyspark.sql.types import StructType

    struct = StructType.fromDDL("k bigint NOT NULL, t timestamp")
    rows = []
    for name, external in (("dict_dsl", _DSL), ("json_schema:2020-12", _SCHEMA), ("openapi:3.x", _API), ("pydantic:v2", _Model), ("spark_struct", struct)):
        for f in adapt(external).fields:
            rows.append((name, f.path, f.type.name, f.required, f.nullable, None if f.default is None else reconcile._default(f), ",".join(c.kind.value for c in f.constraints)))
    return spark.createDataFrame(rows, "format string, path string, type string, required boolean, nullable boolean, default_value string, constraints string")


@query(_values([(k, n, "STRING", n == "email", 1 if n == "email" and k != "spark_struct" else 0) for k in ("dict_dsl", "json_schema:2020-12", "openapi:3.x", "spark_struct") for n in ("email", "ip", "phone")], "format, path, type, required, n_constraints"))
def contract_fields(spark, sf_dir):
    """One contract written in each language and read back."""
    rows = [(k, f.path, f.type.name, f.required, len(f.constraints)) for k in ("dict_dsl", "json_schema:2020-12", "openapi:3.x", "spark_struct") for f in adapt(export(CONTACTS, k), k).fields]
    return spark.createDataFrame(rows, "format string, path string, type string, required boolean, n_constraints int")


def _one(**more) -> dict:
    return {"id": "x", "fields": [{"name": "a", "type": "STRING", "required": True} | more]}


_BAD = {
    "no id": ({"fields": []}, "MISSING_CONTRACT_ID"), "no fields": ({"id": "x"}, "MISSING_FIELDS"), "empty fields": ({"id": "x", "fields": []}, "EMPTY_FIELDS"), "no name": (_one(name=""), "MISSING_FIELD_NAME"), "unknown type": (_one(type="BLOB"), "UNKNOWN_FIELD_TYPE"),
    "no flag": (_one(required=None), "MISSING_REQUIRED_FLAG"), "no values": (_one(type="ENUM"), "MISSING_ENUM_VALUES"), "float default": (_one(type="DECIMAL", default=1.5), "DEFAULT_TYPE_MISMATCH"), "no currency": (_one(type="MONEY", default={"amount": "1"}), "MONEY_REQUIRES_CURRENCY"),
    "bad currency": (_one(type="MONEY", default={"amount": "1", "currency": "usd"}), "INVALID_ISO_4217"), "unknown rule": (_one(constraints=[{"kind": "prime"}]), "UNKNOWN_CONSTRAINT_KIND"), "no parameter": (_one(constraints=[{"kind": "max_length"}]), "CONSTRAINT_PARAM_MISSING"),
    "bad pattern": (_one(constraints=[{"kind": "pattern", "pattern": "("}]), "INVALID_REGEX_PATTERN"), "bad tag": (_one(semantic_tags=["Not OK"]), "INVALID_FIELD"), "policy key": (_one() | {"policies": {"x": 1}}, "INVALID_POLICY_KEY"), "policy floor": (_one() | {"policies": {"confidence_floor": 2}}, "INVALID_CONFIDENCE_FLOOR"),
    "version": (_one() | {"version": 3}, "INVALID_VERSION"), "union": ({"type": "object", "properties": {"a": {"oneOf": []}}}, "UNSUPPORTED_JSON_SCHEMA_FEATURE"), "draft": ({"$schema": "draft-99", "properties": {"a": {}}}, "UNSUPPORTED_JSON_SCHEMA_FEATURE"), "not JSON": ("{", "INVALID_CONTRACT"),
    "api version": ({"openapi": "3.0.4"}, "INVALID_OPENAPI_VERSION"), "circle": ({"openapi": "3.0.0", "components": {"schemas": {"A": {"$ref": "#/components/schemas/A"}}}}, "INVALID_REF"), "number": (5, "UNKNOWN_FORMAT"), "fine": (_one(), "OK"),
}


@query(_values([(k, code) for k, (_, code) in _BAD.items()], "fault, code"))
def contract_errors(spark, sf_dir):
    return spark.createDataFrame([(k, _attempt(lambda e=e: adapt(e))) for k, (e, _) in _BAD.items()], "fault string, code string")


_F = lambda **more: Field("f", "f", "f", **({"type": FieldType.STRING} | more))
_INVARIANTS = {
    "path": (lambda: Field("f", "a..b", "f", FieldType.STRING), "INVALID_PATH"), "name": (lambda: Field("f", "f", "a.b", FieldType.STRING), "ValueError"), "threshold": (lambda: _F(confidence_threshold=2), "ValueError"), "enum of text": (lambda: _F(enum_values=("x",)), "ValueError"),
    "default": (lambda: _F(type=FieldType.INTEGER, default=True), "ValueError"), "two ids": (lambda: Contract("c", (_F(), _F())), "DUPLICATE_FIELD"), "illegal rule": (lambda: Contract("c", (_F(type=FieldType.MONEY, constraints=(Constraint.of("pattern", pattern="x"),)),)).validate(), "ILLEGAL_CONSTRAINT"),
    "tags": (lambda: Contract("c", (_F(semantic_tags=("b", "a")),)).validate(), "BAD_TAGS"), "tag": (lambda: normal_tags(["X"]), "BAD_TAGS"), "budget type": (lambda: Budget(max_total_latency_ms=True), "TypeError"), "budget sign": (lambda: Budget(max_remote_inferences=-1), "ValueError"),
    "budget cost": (lambda: Budget(max_total_cost_usd=Decimal("NaN")), "ValueError"), "floor": (lambda: Policy(confidence_floor=1.5), "ValueError"), "plan": (lambda: Plan("c", (FieldPlan("f"), FieldPlan("f"))), "ValueError"), "id": (lambda: ids.parse_id("art_xyz"), "ValueError"), "version": (lambda: ids.parse_version("1.2"), "ValueError"),
    "no rate": (lambda: M.check_rate(None), "MISSING_FX_RATE"), "rate of zero": (lambda: M.check_rate(Decimal(0)), "INVALID_FX_RATE"), "rate type": (lambda: M.check_rate(1.5), "INVALID_FX_RATE"), "currency": (lambda: M.convert(F.lit(Decimal(1)), F.lit("USD"), "euro", Decimal(1)), "CURRENCY_MISMATCH"),
    "twice registered": (lambda: full_registry().register(builtin()["lookup"]), "DUPLICATE_CAPABILITY"), "not registered": (lambda: Registry().unregister("lookup", "1.0"), "UNKNOWN_CAPABILITY"), "usage": (lambda: inference.Usage(-1), "ValueError"), "prompt": (lambda: inference.Request(""), "ValueError"),
    "temperature": (lambda: inference.Request("x", 3), "ValueError"), "completion": (lambda: inference.Completion("x", "m", inference.Usage(1, 1, 2)), "OK"), "chain cost": (lambda: planner.chain_cost([(1, 2)]), "ValueError"), "version order": (lambda: ids.bump("1.2.3", "minor") == "1.3.0" or 1 / 0, "OK"),
}


@query(_values([(k, code) for k, (_, code) in _INVARIANTS.items()], "fault, code"))
def invariant_errors(spark, sf_dir):
    """What contracts, plans, budgets, policies, ids, money, the registry and inference refuse."""
    return spark.createDataFrame([(k, _attempt(f)) for k, (f, _) in _INVARIANTS.items()], "fault string, code string")


_CODES = [
    ("EngineError", "ENGINE_ERROR"), ("InvalidContractError", "INVALID_CONTRACT"), ("UnsupportedFieldTypeError", "UNSUPPORTED_FIELD_TYPE"), ("InvalidConstraintError", "INVALID_CONSTRAINT"), ("InvalidPathError", "INVALID_PATH"), ("InvalidSemanticTagError", "INVALID_SEMANTIC_TAG"), ("PlanningError", "PLANNING_ERROR"),
    ("ExecutionError", "EXECUTION_ERROR"), ("CapabilityError", "CAPABILITY_ERROR"), ("InferenceProviderError", "INFERENCE_PROVIDER_ERROR"), ("BudgetExceededError", "BUDGET_EXCEEDED"), ("ReconciliationError", "RECONCILIATION_ERROR"), ("ReplayError", "REPLAY_ERROR"), ("VersionMismatchError", "VERSION_MISMATCH"),
    ("HashMismatchError", "HASH_MISMATCH"), ("CapabilityNotFoundError", "CAPABILITY_NOT_FOUND"), ("ConfigurationError", "CONFIGURATION_ERROR"), ("InvalidBudgetError", "INVALID_BUDGET"), ("InvalidPolicyError", "INVALID_POLICY"), ("MoneyError", "MONEY_ERROR"), ("CurrencyMismatchError", "CURRENCY_MISMATCH"),
    ("MissingFxRateError", "MISSING_FX_RATE"), ("InvalidFxRateError", "INVALID_FX_RATE"),
]


@query(_values(_CODES, "error, code"))
def error_codes(spark, sf_dir):
    found = [(k, v("x").code) for k, v in vars(errors).items() if isinstance(v, type) and issubclass(v, EngineError)]
    return spark.createDataFrame(found, "error string, code string")


_TAGS = [("iso4217", True, "STRING"), ("email", True, "STRING"), ("url", True, "STRING"), ("phone", True, "STRING"), ("date", True, "DATE"), ("datetime", True, "DATE"), ("pii", True, None), ("currency-sensitive", True, None), ("high-stakes", True, None), ("regex-able", True, None), ("lookup-able", True, None), ("colour", False, None)]


@query(_values(_TAGS, "tag, known, hint"))
def tag_hints(spark, sf_dir):
    hint = lambda t: (s := suggested_type([t])) and s.name
    return spark.createDataFrame([(t, is_known_tag(t), hint(t)) for t, _, _ in _TAGS], "tag string, known boolean, hint string")


# Registry, plans and policies


@query(_values([("lookup", "1.10.0", 5), ("regex_extraction", "1.0", 5)], "id, version, n_ids"))
def registry_versions(spark, sf_dir):
    """The highest version of each id, whatever the order of registration."""
    from dataclasses import replace

    own = full_registry()
    lookup = builtin()["lookup"]
    for v in ("1.9.0", "1.10.0", "1.2.0"):
        own.register(Capability(replace(lookup.spec, version=v), lookup.compile))
    return spark.createDataFrame([(i, own.latest(i).spec.version, len(own.ids())) for i in ("lookup", "regex_extraction")], "id string, version string, n_ids int")


_POLICIES = {
    "all": ({}, {}, None, "inference", ""), "no remote": ({"allow_remote_inference": False}, {}, None, "", "POLICY_EXCLUDES_REMOTE_INFERENCE"), "own policy": ({}, {"allow_remote_inference": False}, None, "", "POLICY_EXCLUDES_REMOTE_INFERENCE"),
    "own policy allows": ({"allow_remote_inference": False}, {"allow_remote_inference": True}, None, "inference", ""), "poor": ({}, {}, "0.0009", "", "BUDGET_EXCLUDES_INFERENCE"), "rich": ({}, {}, "0.001", "inference", ""),
}


@query(_values([(k, last, codes) for k, (*_, last, codes) in _POLICIES.items()], "given, inference, codes"))
def policy_effects(spark, sf_dir):
    """Whether inference is planned under a policy, the contract's own policy and a budget, and what is told."""
    rows = []
    for name, (policy, own, usd, *_) in _POLICIES.items():
        contract = Contract("c", (_F(),), policy=ContractPolicy(**own))
        made = planner.plan(contract, full_registry(), planner.VARIANTS[0], Budget(max_total_cost_usd=usd and Decimal(usd)), Policy(**policy))
        rows.append((name, ",".join(s.capability_id for s in made.fields[0].steps if s.capability_id == "inference"), ",".join(d[0] for d in made.diagnostics)))
    return spark.createDataFrame(rows, "given string, inference string, codes string")


@query(_values([("all", "0.001", 1508), ("local", "0", 8)], "chain, usd, ms"))
def chain_estimates(spark, sf_dir):
    costs = {s.id: (s.cost.tokens, s.cost.latency_ms, s.cost.usd) for s in full_registry().specs()}
    rows = [(n, str(planner.chain_cost(c).normalize()), planner.chain_latency_ms(c)) for n, c in (("all", list(costs.values())), ("local", [v for k, v in costs.items() if k != "inference"]))]
    return spark.createDataFrame(rows, "chain string, usd string, ms int")


class _ValidateFirst:
    def apply(self, field: Field, steps: tuple[Step, ...]) -> tuple[Step, ...]:
        return tuple(sorted(steps, key=lambda s: s.capability_id != "validation"))


@query(_values([(1, "validation"), (2, "regex_extraction"), (3, "lookup"), (4, "inference")], "step, id"))
def planner_heuristic(spark, sf_dir):
    """A heuristic of the caller reorders a chain."""
    made = planner.plan(Contract("c", (_F(),)), Registry(*(c for c in full_registry() if c.spec.id != "text_extraction")), planner.VARIANTS[0], heuristic=_ValidateFirst())
    return spark.createDataFrame([(k + 1, s.capability_id) for k, s in enumerate(made.fields[0].steps)], "step int, id string")


# Ids, versions, bands, JSON, clock


@query("SELECT p_partkey, p_size * 100 + p_partkey % 7 * 10 + p_partkey % 3 > 2531 AS newer, p_partkey % 5 <> 0 AS is_id FROM part")
def ids_and_versions(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    version = F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 7).cast("string"), (F.col("p_partkey") % 3).cast("string"))
    made = F.concat(F.lit("field_"), F.when(F.col("p_partkey") % 5 == 0, "xyz").otherwise(F.lpad(F.hex("p_partkey"), 12, "0")))
    return part.select("p_partkey", (ids.version_key(version) > ids.version_key(F.lit("25.3.1"))).alias("newer"), ids.is_id(made, "field").alias("is_id"))


@query("SELECT e.event_id, CASE b WHEN 'CERTAIN' THEN 0.975e0 WHEN 'HIGH' THEN 0.875e0 WHEN 'MEDIUM' THEN 0.7e0 WHEN 'LOW' THEN 0.45e0 ELSE 0.15e0 END AS midpoint FROM (SELECT event_id, CASE WHEN event_id % 100 >= 95 THEN 'CERTAIN' WHEN event_id % 100 >= 80 THEN 'HIGH' WHEN event_id % 100 >= 60 THEN 'MEDIUM' WHEN event_id % 100 >= 30 THEN 'LOW' ELSE 'UNTRUSTED' END AS b FROM events) e")
def band_midpoints(spark, sf_dir):
    share = (F.col("event_id") % 100).cast("double") / 100
    return table(spark, sf_dir, "events").select("event_id", F.round(reconcile.band_midpoint(reconcile.band(share)), 6).alias("midpoint"))


_JSON = [("sorted", '{"a":[1,3],"b":"1.50"}'), ("bytes", '"0x01ff"'), ("date", '"2024-01-02"'), ("escaped", '"\\u00e9"'), ("enum", '"string"'), ("file", '{"k":[true,null]}')]


@query(_values(_JSON, "given, text"))
def stable_json(spark, sf_dir):
    """JSON in one form: sorted, compact, ASCII; through a file and back for the last."""
    import datetime

    file = io.StringIO()
    artifact.stable_dump({"k": [True, None]}, file)
    file.seek(0)
    given = [{"b": Decimal("1.50"), "a": {3, 1}}, b"\x01\xff", datetime.date(2024, 1, 2), "é", FieldType.STRING, artifact.stable_load(file)]
    return spark.createDataFrame([(n, artifact.stable_dumps(v)) for (n, _), v in zip(_JSON, given, strict=True)], "given string, text string")


@query("SELECT n_nationkey, 1704067200 AS made_at FROM nation")
def normalize_clock(spark, sf_dir):
    """A given clock stamps all rows alike, and no hash depends on it."""
    nation, contract = table(spark, sf_dir, "nation"), Contract("c", (_F(),))
    later = FixedClock()
    later.advance(60)
    a = normalize(nation, contract, raw="n_name", clock=FixedClock()).select("n_nationkey", F.unix_timestamp("created_at").alias("made_at"), "replay_hash")
    b = normalize(nation, contract, raw="n_name", clock=later).select("n_nationkey", "replay_hash")
    return a.join(b, ["n_nationkey", "replay_hash"]).select("n_nationkey", "made_at")


@query("SELECT c_custkey, c_acctbal >= 0 AS of_double, false AS of_decimal, c_acctbal >= 0 AS of_text, false AS of_suffix, false AS of_boolean, true AS of_nan FROM customer")
def constraint_value_types(spark, sf_dir):
    """Bounds know doubles and text that is a number, and neither decimals, booleans nor text with a type suffix."""
    rule, x = Constraint.of("min_value", min=0), F.col("c_acctbal")
    given = {"of_double": x, "of_decimal": x.cast("decimal(12,2)"), "of_text": F.concat(F.lit(" "), x.cast("string")), "of_suffix": F.concat(x.cast("string"), F.lit("d")), "of_boolean": F.lit(True), "of_nan": F.lit("nan")}
    return table(spark, sf_dir, "customer").select("c_custkey", *[check(rule, v).alias(n) for n, v in given.items()])


# Providers


@query("""SELECT conv_id, turn, (['ACME Corp', 'Globex Industries', 'Initech LLC'])[(call % 3 + 1)::INT] AS completion, length(text)::INT AS prompt_tokens
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS call FROM conversations)""")
def inference_cycling(spark, sf_dir):
    """The cycling stub, called once a turn."""
    call = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    rows = table(spark, sf_dir, "conversations").withColumn("call", call).withColumn("a", inference.cycling(F.col("text"), F.col("call")))
    return rows.select("conv_id", "turn", F.col("a.text").alias("completion"), F.col("a.prompt_tokens").alias("prompt_tokens"))


def _asked(spark: SparkSession, sf_dir: str, provider) -> DataFrame:
    plan = Plan("c", (FieldPlan("f", (Step("inference", "1.0", {"provider": provider}),)),))
    return normalize(table(spark, sf_dir, "conversations"), Contract("c", (_F(),)), registry=full_registry(), plan=plan, run_evidence=True, run_diagnostics=True)


@query("SELECT conv_id, turn, CASE WHEN text <> '' THEN 'stub-v1' END AS model_id, CASE WHEN text <> '' THEN 0 END AS prompt_tokens, CASE WHEN text <> '' THEN 'INFERENCE_OUTPUT_UNTRUSTED' ELSE 'CAPABILITY_INVOKE_FAILED' END AS promoted FROM conversations")
def inference_evidence(spark, sf_dir):
    """An answer's evidence names the model and what it used, and the run is told not to trust it."""
    first = F.get("run_evidence", 0)
    return _asked(spark, sf_dir, inference.stub).select("conv_id", "turn", first["model_id"].alias("model_id"), first["prompt_tokens"].alias("prompt_tokens"), F.get("run_diagnostics", 0)["code"].alias("promoted"))


class Moody:
    """A provider that answers in a task, and fails on prompts of an odd length."""

    def complete(self, request: inference.Request) -> inference.Completion:
        if len(request.prompt) % 2:
            raise errors.InferenceProviderError("odd")
        return inference.Completion(request.prompt[:3], "moody", inference.Usage(len(request.prompt), 3, len(request.prompt) + 3))


@query("""SELECT conv_id, turn, CASE WHEN text <> '' AND length(text) % 2 = 0 THEN 'moody' END AS model_id, CASE WHEN text <> '' AND length(text) % 2 = 0 THEN length(text)::INT END AS prompt_tokens,
  CASE WHEN text = '' THEN 'CAPABILITY_INVOKE_FAILED' WHEN length(text) % 2 = 0 THEN 'INFERENCE_OUTPUT_UNTRUSTED' ELSE 'INFERENCE_PROVIDER_ERROR' END AS promoted FROM conversations""")
def inference_provider(spark, sf_dir):
    """A provider object: its failures are its rows' diagnostics, and the other rows go on."""
    first = F.get("run_evidence", 0)
    return _asked(spark, sf_dir, Moody()).select("conv_id", "turn", first["model_id"].alias("model_id"), first["prompt_tokens"].alias("prompt_tokens"), F.get("run_diagnostics", 0)["code"].alias("promoted"))


class Measuring:
    """An extraction provider that tells how many bytes it got."""

    def extract(self, raw: bytes, content_type: str) -> str:
        return f"{content_type}:{len(raw)}"


@query("SELECT page_id, 'text/html:' || octet_length(encode(coalesce(html, ''))) AS value, 0::BIGINT AS span_start, octet_length(encode(coalesce(html, '')))::BIGINT AS span_end FROM pages")
def text_provider(spark, sf_dir):
    plan = Plan("c", (FieldPlan("f", (Step("text_extraction", "1.0", {"provider": Measuring(), "content_type": "text/html"}),)),))
    done = normalize(table(spark, sf_dir, "pages"), Contract("c", (_F(confidence_threshold=0.5),)), raw="html", registry=full_registry(), plan=plan)
    r = F.get("results", 0)
    return done.select("page_id", r["value"].alias("value"), F.get(r["evidence"], 0)["span_start"].alias("span_start"), F.get(r["evidence"], 0)["span_end"].alias("span_end"))


# Selections over artifacts

_FOUND = "list_filter([CASE WHEN {e} THEN '{p}_email' END, CASE WHEN {i} THEN '{p}_ip' END, CASE WHEN {t} THEN '{p}_phone' END], lambda x: x IS NOT NULL)".format(p="field_contacts", e="email IS NOT NULL", i="ip IS NOT NULL", t="phone <> 'none'")


@query(f"WITH {_FLAT} SELECT doc_id, array_to_string({_FOUND}, ',') AS paths, CASE WHEN len({_FOUND}) > 0 THEN 'regex_extraction' ELSE '' END AS capabilities, len(list_filter({_FOUND}, lambda x: x = 'field_contacts_ip'))::INT AS n_ip FROM flat")
def evidence_sets(spark, sf_dir):
    """Distinct fields and capabilities of the evidence, and how much of it is one field's."""
    refs = artifact.all_evidence()
    return _contacts(table(spark, sf_dir, "documents")).select("doc_id", F.array_join(artifact.field_paths(refs), ",").alias("paths"), F.array_join(artifact.capability_ids(refs), ",").alias("capabilities"), F.least(F.size(artifact.by_field(refs, "field_contacts_ip")), F.lit(1)).alias("n_ip"))


@query(f"WITH {_FLAT} SELECT doc_id, (2 * (len(v_email) + len(v_ip) + len(v_phone)))::INT AS n_run FROM m")
def evidence_of_run(spark, sf_dir):
    """All that the steps found is in the run's evidence twice: as the run's and as the candidate's."""
    return _contacts(table(spark, sf_dir, "documents"), run_evidence=True).select("doc_id", F.size("run_evidence").alias("n_run"))


@query(f"WITH {_FLAT} SELECT m.doc_id, 0 AS n_errors, (len(v_email) > 0 AND length(v_email[1]) > 27)::INT AS n_warnings, 0 AS n_promoted, (len(v_email) > 0 AND length(v_email[1]) > 27)::INT AS n_failed FROM m")
def diagnostics_selected(spark, sf_dir):
    notes = artifact.all_diagnostics()
    done = _contacts(table(spark, sf_dir, "documents"))
    return done.select("doc_id", F.size(artifact.errors(notes)).alias("n_errors"), F.size(artifact.warnings(notes)).alias("n_warnings"), F.size(artifact.promoted(notes)).alias("n_promoted"), F.size(artifact.by_code(notes, "VALIDATION_FAILED")).alias("n_failed"))


@query(f"WITH {_FLAT} SELECT doc_id, n_resolved::INT AS n_values, email, phone, CASE WHEN len({_FOUND}) > 0 THEN '1.0' END AS version FROM flat")
def normalized_values(spark, sf_dir):
    """The map of resolved values by path, and the versions of the capabilities they rest on."""
    value = lambda k: F.try_element_at("normalized", F.lit(k)).alias(k)
    return _contacts(table(spark, sf_dir, "documents")).select("doc_id", F.size("normalized").alias("n_values"), value("email"), value("phone"), F.try_element_at("capability_versions", F.lit("regex_extraction")).alias("version"))


@query("SELECT doc_id, true AS version_ok, true AS capabilities_ok, true AS hash_ok FROM documents")
def replay_with_contract(spark, sf_dir):
    done = _contacts(table(spark, sf_dir, "documents"))
    return artifact.replay(done, full_registry(), strict=True, contract=export(CONTACTS, "dict_dsl")).select("doc_id", "version_ok", "capabilities_ok", "hash_ok")


@query("SELECT r_regionkey, field_id, CASE field_id WHEN 'a' THEN r_name WHEN 'b' THEN 'b' || r_regionkey END AS value FROM region, (VALUES ('a'), ('b'), ('c')) AS f(field_id)")
def reconcile_against_contract(spark, sf_dir):
    """Results held against the contract: one line per field, null for what no step gave."""
    own = Contract("c", tuple(Field(n, n, n, FieldType.STRING) for n in "abc"))
    region = table(spark, sf_dir, "region")
    results = region.select("r_regionkey", F.explode(F.array(F.struct(F.lit("a").alias("field_id"), F.col("r_name").alias("value")), F.struct(F.lit("b").alias("field_id"), F.concat(F.lit("b"), F.col("r_regionkey").cast("string")).alias("value")))).alias("r")).select("r_regionkey", "r.*")
    return reconcile_long.against(results, own, "r_regionkey")


# The batch run


@query("SELECT count(*) AS total, count(*) FILTER (WHERE n_nationkey % 5 < 3) AS successful, count(*) FILTER (WHERE n_nationkey % 5 = 3) AS unresolved, count(*) FILTER (WHERE n_nationkey % 5 = 4) AS failed FROM nation")
def manifest_batch(spark, sf_dir):
    """A manifest of one file per nation under three contracts, one of which nothing can compile."""
    root = storage.new_path(spark, "batch")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    nation.withColumn("name", F.col("n_nationkey")).repartition("name").select("name", F.concat(F.col("n_name"), F.lit(" is a nation")).alias("value")).write.partitionBy("name").text(f"{root}/in")
    kind = F.when(F.col("n_nationkey") % 5 < 3, "text").when(F.col("n_nationkey") % 5 == 3, "none").otherwise("broken")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/in").select(F.regexp_extract("path", r"/in/(name=[0-9]+/[^/]+)$", 1).alias("input_file"), F.regexp_extract("path", r"/name=([0-9]+)/", 1).cast("int").alias("n_nationkey"))
    files.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), "input_file", kind.alias("contract_name")).coalesce(1).write.option("header", "true").csv(f"{root}/manifest")
    contracts = {"text": {"id": "t", "fields": [{"name": "body", "type": "STRING", "required": True}]}, "none": {"id": "n", "fields": [{"name": "total", "type": "MONEY", "required": True}]}, "broken": {"id": "b", "fields": [{"name": "x"}]}}
    _, summary = manifest.run(spark, f"{root}/manifest", f"{root}/in", contracts, f"{root}/out", registry=full_registry(), policy=Policy(unresolved_acceptable=False))
    return summary


@query("SELECT true AS good, false AS bad, 'InvalidContractError' AS error, count(*) AS n FROM nation")
def agent_tool(spark, sf_dir):
    """The tool gives a result whatever happens."""
    nation = table(spark, sf_dir, "nation")
    good = manifest.NormalizeTool(Contract("c", (_F(),)), raw="n_name").run(nation)
    bad = manifest.NormalizeTool({"id": "x"}).run(nation)
    return good["output"].agg(F.count(F.lit(1)).alias("n")).select(F.lit(good["success"]).alias("good"), F.lit(bad["success"]).alias("bad"), F.lit(bad["error"].split(":")[0]).alias("error"), "n")


# The workload of the reference's published figure: twenty fields over texts of about 100 KB

_KINDS = ["STRING"] * 5 + ["INTEGER"] * 3 + ["DECIMAL"] * 3 + ["BOOLEAN"] * 2 + ["DATE"] * 3 + ["ENUM"] * 2 + ["MONEY", "ARRAY"]
PROCUREMENT = Contract("procurement-v1", tuple(Field(f"field_p_{k}", f"f{k}", f"f{k}", FieldType[t], enum_values=("a", "b") if t == "ENUM" else None, fallback=Resolution.UNRESOLVED) for k, t in enumerate(_KINDS)))
BUNDLE = 40


@query(f"""SELECT bundle, sha256(raw) AS content_hash, octet_length(encode(raw))::BIGINT AS size, 'UNRESOLVED' AS status, 20 AS n_unresolved, 64 AS hash_length
FROM (SELECT doc_id // {BUNDLE} AS bundle, string_agg(coalesce(text, ''), '' ORDER BY doc_id) AS raw FROM documents GROUP BY 1)""")
def normalize_sealed(spark, sf_dir):
    """Bundles of documents, about 100 KB each: profile, plan, twenty fields, status and replay hash, all of it kept."""
    docs = table(spark, sf_dir, "documents").select(F.expr(f"doc_id div {BUNDLE}").alias("bundle"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    whole = docs.groupBy("bundle").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda d: d["text"]), "").alias("raw"))
    done = normalize(whole, PROCUREMENT, raw="raw", policy=Policy(unresolved_acceptable=False))
    return done.select("bundle", "profile.content_hash", "profile.size", "status", F.size("unresolved").alias("n_unresolved"), F.length("replay_hash").alias("hash_length"))


