"""The engine: profiles, constraints, planning, reconciliation, money, artifacts, contracts, sources and streams."""

import json
import random
from decimal import ROUND_HALF_EVEN, Decimal

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__
from sealwright.errors import EngineError, InvalidContractError, InvalidFxRateError, MissingFxRateError
from sealwright.functions import ids
from sealwright.functions import money as M
from sealwright.functions import profile as P
from sealwright.functions.constraints import check, java_pattern
from sealwright.model import Budget, Constraint, Contract, CurrencyPolicy, Field, FieldPlan, FieldType, Merge, Money, Plan, Policy, Resolution, Step, Tier
from sealwright.operators import reconcile, reconcile_long
from sealwright.operators.registry import Registry, builtin, default_registry, full_registry
from sealwright.operators.text import html_to_text
from sealwright.plans import artifact, planner
from sealwright.plans.engine import normalize
from sealwright.schemas import CANDIDATE
from sealwright.sources import manifest
from sealwright.sources.contracts import adapt, detect, export
from sealwright.streaming import normalize as streaming

SF = "/root/testdata/sf0.001"

INVOICE = {
    "id": "invoice-v1",
    "fields": [
        {"name": "supplier", "type": "STRING", "required": True, "semantic_tags": ["pii"], "constraints": [{"kind": "min_length", "min": 1}, {"kind": "max_length", "max": 500}]},
        {"name": "currency", "type": "ENUM", "required": True, "enum_values": ["USD", "EUR"], "constraints": [{"kind": "iso_4217"}]},
        {"name": "total", "type": "MONEY", "required": True, "constraints": [{"kind": "min_value", "min": 0}]},
        {"name": "date", "type": "DATE", "required": True},
        {"name": "lines", "type": "ARRAY", "required": False, "default": []},
        {"name": "paid", "type": "BOOLEAN", "required": False, "default": False},
    ],
    "policies": {"confidence_floor": 0.85, "unresolved_acceptable": False},
}


def py_profile(raw: bytes):
    import re

    def kind():
        if not raw:
            return "empty"
        if raw.startswith(b"%PDF-"):
            return "pdf_text"
        if raw.lstrip()[:1] in (b"{", b"["):
            try:
                json.loads(raw[:8192])
                return "json"
            except ValueError:
                pass
        head = raw[:4096].decode("utf-8", "replace")
        if re.search(r"^From ", head, re.M) and re.search(r"^Subject:", head, re.M):
            return "email"
        if re.search(r"<\s*html|<!doctype\s+html", head, re.I):
            return "html"
        return "csv" if raw.split(b"\n", 1)[0].lstrip().count(b",") >= 3 else "text"

    text = raw.decode("utf-8", "replace")
    solid = len(raw) - sum(raw.count(c) for c in b"\t\n\x0b\x0c\r ") if len(text) == len(raw) else sum(not c.isspace() for c in text)
    return kind(), len(raw), (solid / len(raw) if raw else 0.0), not raw.strip()


RAW = [b"", b"  \t\n", b"%PDF-1.4 x", b'{"a": 1}', b"{not valid json", b" [1, 2]", b"a,b", b"a,b,c,d\n1,2,3,4", b"\na,b,c,d", b"From: x\nSubject: y\n", b"hi\nFrom me\nSubject: y", b"<!DOCTYPE html><p>", b"x < html >", "é 　z".encode(), b"\xff\xfe\x00\x01", b"\x1c\x1d a", "ü\x1c b".encode(), b'{"a": "' + b"x" * 9000 + b'"}']


def test_profile(spark):
    df = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(RAW)], "i int, raw binary")
    got = {r.i: r.p for r in df.select("i", P.profile(F.col("raw")).alias("p")).collect()}
    for i, raw in enumerate(RAW):
        kind, size, density, empty = py_profile(raw)
        assert (got[i].input_type, got[i].size, got[i].is_empty) == (kind, size, empty), raw
        assert got[i].density == pytest.approx(density), raw


def test_raw_input_must_be_text_or_bytes(spark):
    with pytest.raises(TypeError):
        P.raw_bytes(spark.range(1), "id")


def test_constraints(spark):
    df = spark.createDataFrame([("", ), ("abc",), ("5",), (" 5 ",), ("nan",), ("USD",), ("USD\n",), ("x1y",), (None,)], "v string")
    rules = {
        "min_length": (Constraint.of("min_length", min=2), lambda v: v is not None and len(v) >= 2),
        "max_length": (Constraint.of("max_length", max=3), lambda v: v is not None and len(v) <= 3),
        "pattern": (Constraint.of("pattern", pattern=r"\d"), lambda v: v is not None and any(c.isdigit() for c in v)),
        "broken": (Constraint.of("pattern", pattern="("), lambda v: False),
        "min": (Constraint.of("min_value", min=5, inclusive=False), lambda v: v is not None and v.strip() in ("5", "nan")),
        "max": (Constraint.of("max_value", max=4), lambda v: v == "nan"),
        "enum": (Constraint.of("enum", values=("abc", "5")), lambda v: v in ("abc", "5")),
        "iso": (Constraint.of("iso_4217"), lambda v: v in ("USD", "USD\n")),
    }
    rows = df.select("v", *[check(c, F.col("v")).alias(n) for n, (c, _) in rules.items()]).collect()
    for r in rows:
        for n, (_, want) in rules.items():
            assert r[n] == want(r.v), (n, r.v)


def test_java_pattern():
    assert java_pattern(r"(?P<a>x)(?P=a)\Z") == r"(?<a>x)\k<a>\z"
    assert java_pattern("(") is None


def test_html_text():
    page = '<html><!-- no --><b>a&amp;b</b><style>p{margin:0}</style><script>var t="</p>";</script><p>x &lt; y&nbsp;z'
    assert html_to_text(page) == 'a&bp{margin:0}var t="</p>";x < y z'


def test_text_extract_html_equals_sql_on_cut_references(spark, tmp_path):
    """A reference that is cut before its semicolon, as some pages of sf0.1 have it; null and empty pages."""
    pages = [(1, "<p>a &amp;&copy; b&&&amp</p><!-- &amp --><p>&ampc &quot;&q; &amp"), (2, None), (3, ""), (4, '<p>&\ue000</p><script>var t="</p>"; a && b</script>')]
    spark.createDataFrame(pages, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = dict(con.execute(__spark_entry__.oracle_sql()["text_extract_html"]).fetchall())
    got = {r.page_id: r.text for r in __spark_entry__.queries()["text_extract_html"](spark, str(tmp_path)).collect()}
    assert got == want
    assert got[1] == 'a &© b&&&amp&ampc "&q; &amp'
    assert html_to_text(pages[0][1]) == 'a &© b&&&&c "&q; &'
    assert html_to_text("&lt;&#60;&#x3C;&#60 &lt &nope;", ended=True) == "<<<&#60 &lt &nope;"


def test_registry():
    r = default_registry()
    assert r.ids() == {"lookup"}
    with pytest.raises(EngineError):
        r.register(builtin()["lookup"])
    r.register(builtin()["lookup"], replace=True)
    assert r.latest("nothing") is None and r.get("lookup", "2.0") is None
    r.unregister("lookup", "1.0")
    assert not r.ids()
    assert sorted(s.score for s in full_registry().specs()) == [10001, 10001, 10005, 20001, 52500]


def test_planner():
    contract = Contract("c", (Field("s", "s", "s", FieldType.STRING), Field("o", "o", "o", FieldType.DATE, required=False), Field("m", "m", "m", FieldType.MONEY)))
    made = planner.plan(contract, full_registry(), planner.Variant(True, True))
    assert [[s.capability_id for s in f.steps] for f in made.fields] == [["text_extraction", "regex_extraction", "validation", "text_extraction", "lookup", "inference"], ["validation"]]
    cheap = planner.plan(contract, full_registry(), planner.Variant(False, False), Budget(max_total_cost_usd=Decimal("0.0009")))
    assert "inference" not in [s.capability_id for s in cheap.fields[0].steps] and cheap.diagnostics[0][0] == "BUDGET_EXCLUDES_INFERENCE"
    none = planner.plan(contract, Registry(), planner.Variant(True, True), policy=Policy(allow_remote_inference=False))
    assert [d[0] for d in none.diagnostics] == ["POLICY_EXCLUDES_REMOTE_INFERENCE", "FIELD_UNRESOLVED", "FIELD_UNRESOLVED"]
    cut, told = planner.affordable(made, full_registry(), Budget(max_total_latency_ms=7))
    assert [len(f.steps) for f in cut.fields] == [3, 0] and len(told) == 2
    assert planner.affordable(made, full_registry(), Budget(max_remote_inferences=0))[0].fields[0].steps[-1].capability_id == "lookup"


# A plain restatement of the reconciliation rules, as the oracle of the column expressions.


def py_best(cands):
    def key(c):
        refs = c["evidence"]
        return (-len(refs), not any(r["span_start"] is not None for r in refs), not any(r["deterministic"] for r in refs), min((r["tier"] for r in refs), default=10), sorted(r["capability_id"] for r in refs), c["pos"])

    return min(cands, key=key)


def py_resolve(cands, strategy, threshold, default):
    cands = [c | {"pos": i} for i, c in enumerate(cands)]
    if not cands:
        return None
    safe = [c for c in cands if not (c["value"] and any(p in c["value"].lower() for p in reconcile.INJECTION))]
    if not safe:
        return None
    values = [c["value"] for c in safe if c["value"] is not None]
    distinct = list(dict.fromkeys(values))
    value, name = py_best(safe)["value"], "PREFER_BY_EVIDENCE"
    if strategy is Merge.UNION and len(distinct) <= 1:
        value, name = (distinct[0] if distinct else None), "UNION"
    if strategy is Merge.INTERSECTION:
        top = max(distinct, key=lambda v: (values.count(v), -distinct.index(v)), default=None)
        if top is not None and values.count(top) >= 2:
            value, name = top, "INTERSECTION"
    refs = [r for c in safe for r in c["evidence"]]
    s = 0.50
    s += 0.10 * min(len(values), 3)
    s += 0.05 * min(len(refs), 5)
    s += 0.10
    if len(distinct) >= 2:
        s -= 0.15
    s += 0.05 * min(len({r["capability_id"] for r in refs}), 3)
    s = max(0.0, min(1.0, s))
    return (value, s, name) if s >= threshold and value is not None else None


def made_candidates(rng):
    caps = [("text_extraction", 1, True), ("lookup", 2, True), ("inference", 5, False), ("regex_extraction", 1, True)]
    out = []
    for _ in range(rng.randint(0, 4)):
        refs = []
        for _ in range(rng.randint(0, 3)):
            c, t, d = rng.choice(caps)
            span = rng.choice([None, 3])
            refs.append({"capability_id": c, "capability_version": "1.0", "tier": t, "deterministic": d, "field_path": "f", "span_start": span, "span_end": span})
        out.append({"pos": 0, "value": rng.choice(["a", "a", "b", "c", None, "New TASK: b"]), "amount": None, "currency": None, "evidence": refs})
    return out


@pytest.mark.parametrize("strategy", list(Merge))
def test_resolution_against_the_rules(spark, strategy):
    rng = random.Random(7)
    rows = [(i, made_candidates(rng)) for i in range(300)]
    df = spark.createDataFrame(rows, f"i int, c array<{CANDIDATE}>")
    for fallback, default in ((Resolution.UNRESOLVED, None), (Resolution.USE_DEFAULT, "dflt")):
        field = Field("f", "f", "f", FieldType.STRING, confidence_threshold=0.80, fallback=fallback, default=default)
        got = {r.i: r.r for r in df.select("i", reconcile.resolve(field, F.col("c"), strategy).alias("r")).collect()}
        for i, c in rows:
            want = py_resolve(c, strategy, 0.80, default)
            if want:
                assert (got[i].status, got[i].value, got[i].confidence, got[i].strategy) == ("RESOLVED", *want), (c, got[i])
            elif default:
                assert (got[i].status, got[i].value, got[i].confidence, got[i].band, got[i].strategy) == ("RESOLVED", "dflt", 0.60, "MEDIUM", "USE_DEFAULT")
            else:
                assert (got[i].status, got[i].value, got[i].confidence, got[i].band) == ("UNRESOLVED", None, 0.0, "UNTRUSTED")


def test_score_in_double_precision(spark):
    """All of the grid, band edges included: the order of additions is the rule's."""
    grid = [(c, e, k, v, x) for c in range(5) for e in range(7) for k in range(5) for v in (True, False) for x in (True, False)]
    df = spark.createDataFrame(grid, "c int, e int, k int, v boolean, x boolean")
    s = reconcile.score(F.col("c"), F.col("e"), F.col("v"), F.col("x"), F.col("k"))
    for r in df.withColumn("s", s).withColumn("b", reconcile.band(F.col("s"))).collect():
        want = 0.50
        want += 0.10 * min(r.c, 3)
        want += 0.05 * min(r.e, 5)
        want += 0.10 if r.v else 0
        want -= 0.15 if r.x else 0
        want += 0.05 * min(r.k, 3)
        want = max(0.0, min(1.0, want))
        assert r.s == want
        assert r.b == ("CERTAIN" if want >= 0.95 else "HIGH" if want >= 0.8 else "MEDIUM" if want >= 0.6 else "LOW" if want >= 0.3 else "UNTRUSTED")


def test_long_and_row_forms_agree(spark):
    rng = random.Random(8)
    flat, rows = [], []
    for i in range(80):
        own = []
        for k in range(rng.randint(1, 5)):
            cap, tier, det = rng.choice([("text_extraction", 1, True), ("lookup", 2, True), ("inference", 5, False)])
            value, span = rng.choice(["a", "b", None]), rng.random() < 0.5
            flat.append((i, k, value, cap, tier, det, span))
            own.append({"pos": k, "value": value, "amount": None, "currency": None, "evidence": [{"capability_id": cap, "capability_version": "1.0", "tier": tier, "deterministic": det, "field_path": "f", "span_start": 1 if span else None, "span_end": 1 if span else None}]})
        rows.append((i, own))
    long = spark.createDataFrame(flat, "k int, pos int, value string, capability_id string, tier int, deterministic boolean, has_span boolean")
    wide = spark.createDataFrame(rows, f"k int, c array<{CANDIDATE}>")
    field = Field("f", "f", "f", FieldType.STRING)
    for strategy in Merge:
        a = {r.k: (r.status, r.value, r.confidence, r.strategy) for r in reconcile_long.resolve(long, "k", strategy=strategy).collect()}
        b = {r.k: (r.r.status, r.r.value, r.r.confidence, r.r.strategy) for r in wide.select("k", reconcile.resolve(field, F.col("c"), strategy).alias("r")).collect()}
        assert a == b


def test_money(spark):
    rng = random.Random(9)
    rows = [(i, Decimal(rng.randrange(-10**9, 10**9)) / 1000, rng.choice(["USD", "EUR"]), Decimal(rng.randrange(10**6)) / 1000, rng.choice(["USD", "EUR"])) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, a decimal(20,6), ac string, b decimal(20,6), bc string")
    rate, cent = Decimal("1.12345678"), Decimal("0.01")
    a, ac, b, bc = (F.col(c) for c in ("a", "ac", "b", "bc"))
    fx = CurrencyPolicy.ALLOW_FX
    got = df.select("*", M.add(a, ac, b, bc).alias("strict"), M.add(a, ac, b, bc, fx, rate).alias("add"), M.subtract(a, ac, b, bc, fx, rate).alias("sub"), M.multiply(a, Decimal("0.5")).alias("mul"), M.convert(a, ac, "EUR", rate).alias("conv"), M.compare(a, ac, b, bc, fx, rate).alias("cmp")).collect()
    q = lambda x: x.quantize(cent, ROUND_HALF_EVEN)
    for r in got:
        other = r.b if r.ac == r.bc else r.b * rate
        assert r["strict"] == (q(r.a + r.b) if r.ac == r.bc else None)
        assert (r["add"], r["sub"], r["mul"]) == (q(r.a + other), q(r.a - other), q(r.a * Decimal("0.5")))
        assert r["conv"] == (r.a if r.ac == "EUR" else q(r.a * rate))
        assert r["cmp"] == (r.a > other) - (r.a < other)
    for bad, error in ((None, MissingFxRateError), (1.5, InvalidFxRateError), (Decimal(0), InvalidFxRateError), (True, InvalidFxRateError)):
        with pytest.raises(error):
            M.check_rate(bad)
    with pytest.raises(EngineError):
        M.convert(a, ac, "euro", rate)
    with pytest.raises(TypeError):
        M.multiply(a, 0.5)


def test_money_candidates_are_added_up(spark):
    ref = {"capability_id": "x", "capability_version": "1", "tier": 1, "deterministic": True, "field_path": "f", "span_start": None, "span_end": None}
    c = lambda amount, cur: {"pos": 0, "value": None, "amount": Decimal(amount), "currency": cur, "evidence": [ref]}
    df = spark.createDataFrame([(0, [c("1.005", "USD"), c("2", "USD")]), (1, [c("1", "USD"), c("2", "EUR")]), (2, [c("1", "USD"), c("1", "EUR"), c("1", "GBP")])], f"i int, c array<{CANDIDATE}>")
    field = Field("f", "f", "f", FieldType.MONEY, confidence_threshold=0.5)
    got = {r.i: r.r.value for r in df.select("i", reconcile.resolve(field, F.col("c"), policy=CurrencyPolicy.ALLOW_FX, rate=Decimal("1.5")).alias("r")).collect()}
    assert got == {0: "3.00 USD", 1: "4.00 USD", 2: None}
    strict = {r.i: r.r.value for r in df.select("i", reconcile.resolve(field, F.col("c")).alias("r")).collect()}
    assert strict == {0: "3.00 USD", 1: None, 2: None}


def test_full_chain_takes_the_whole_text(spark):
    df = spark.createDataFrame([(1, "plain dense text, whole")], "id int, text string")
    contract = Contract("c", (Field("s", "s", "s", FieldType.STRING), Field("opt", "opt", "opt", FieldType.STRING, required=False)))
    r = normalize(df, contract, registry=full_registry()).collect()[0]
    first = r.results[0]
    assert (first.value, first.confidence, first.band, first.strategy) == ("plain dense text, whole", 1.0, "CERTAIN", "PREFER_BY_EVIDENCE")
    assert (first.evidence[0].span_start, first.evidence[0].span_end) == (0, 23)
    assert r.status == "PARTIAL_SUCCESS" and r.unresolved == ["opt"] and r.normalized == {"s": "plain dense text, whole"}
    assert r.statistics.asDict() == {"total": 2, "resolved": 1, "unresolved": 1} and r.capability_versions == {"text_extraction": "1.0"}


def test_configured_plan_and_lookup(spark):
    df = spark.createDataFrame([(1, "usa"), (2, "DE"), (3, ""), (4, None), (5, "x")], "id int, text string")
    plan = Plan("c", (FieldPlan("s", (Step("lookup", "1.0", {"table": {"USA": "United States", "usa": "low", "de": "Germany"}}), Step("missing", "1.0"))),))
    got = {r.id: r.results[0].value for r in normalize(df, Contract("c", (Field("s", "s", "s", FieldType.STRING, confidence_threshold=0.5),)), registry=full_registry(), plan=plan).collect()}
    assert got == {1: "low", 2: "Germany", 3: None, 4: None, 5: None}


def test_hash_and_replay(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "id int, text string")
    run = lambda n: normalize(df.repartition(n), Contract("c", (Field("s", "s", "s", FieldType.STRING),)), registry=full_registry())
    a, b = ({r.id: r.replay_hash for r in run(n).collect()} for n in (1, 7))
    assert a == b and len(set(a.values())) == 20
    done = run(2)
    ok = artifact.replay(done, full_registry()).collect()
    assert all(r.version_ok and r.capabilities_ok and r.hash_ok and r.reason is None for r in ok)
    assert {r.reason for r in artifact.replay(done, default_registry()).collect()} == {"CAPABILITY_MISSING"}
    assert {r.reason for r in artifact.replay(done.withColumn("engine_version", F.lit("9.0.0")), full_registry()).collect()} == {"VERSION_MISMATCH"}
    with pytest.raises(Exception, match="HASH_MISMATCH"):
        artifact.replay(done.withColumn("contract_id", F.lit("x")), full_registry(), strict=True).collect()


def test_adapters_round_trip():
    contract = adapt(INVOICE)
    assert detect(INVOICE) == "dict_dsl" and contract.policy.unresolved_acceptable is False
    assert adapt(export(contract, "dict_dsl"), "dict_dsl") == contract
    for kind in ("json_schema:2020-12", "openapi:3.x", "spark_struct"):
        again = adapt(export(contract, kind), kind)
        assert [(f.name, f.required) for f in again.fields] == [(f.name, f.required) for f in contract.fields]
    schema = {"title": "T", "type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "exclusiveMinimum": 3}, "b": {"type": ["string", "null"], "pattern": "x"}, "d": {"type": "string", "format": "date"}, "m": {"type": "object", "x-field-type": "MONEY", "default": {"amount": "1.5", "currency": "USD"}}, "e": {"enum": ["x", 1]}}}
    got = adapt(json.dumps(schema))
    assert [f.type.name for f in got.fields] == ["INTEGER", "STRING", "DATE", "MONEY", "ENUM"] and got.fields[3].default == Money(Decimal("1.5"), "USD") and got.fields[1].nullable
    api = {"openapi": "3.0.3", "info": {"title": "Api"}, "components": {"schemas": {"A": {"type": "object", "properties": {"x": {"$ref": "#/components/schemas/X"}}}, "X": {"type": "string", "nullable": True}}}}
    assert adapt(api).id == "Api" and adapt(api).fields[0].nullable
    struct = T.StructType([T.StructField("n", T.LongType(), False), T.StructField("t", T.TimestampType())])
    assert [(f.type.name, f.required) for f in adapt(struct).fields] == [("INTEGER", True), ("DATE", False)]


@pytest.mark.parametrize(
    ("contract", "code"),
    [
        ({"fields": []}, "MISSING_CONTRACT_ID"), ({"id": "x"}, "MISSING_FIELDS"), ({"id": "x", "fields": []}, "EMPTY_FIELDS"), ({"id": "x", "fields": [{"type": "STRING"}]}, "MISSING_FIELD_NAME"),
        ({"id": "x", "fields": [{"name": "a"}]}, "MISSING_TYPE"), ({"id": "x", "fields": [{"name": "a", "type": "BLOB"}]}, "UNKNOWN_FIELD_TYPE"), ({"id": "x", "fields": [{"name": "a", "type": "STRING"}]}, "MISSING_REQUIRED_FLAG"),
        ({"id": "x", "fields": [{"name": "a", "type": "ENUM", "required": True}]}, "MISSING_ENUM_VALUES"), ({"id": "x", "fields": [{"name": "a", "type": "DECIMAL", "required": True, "default": 1.5}]}, "DEFAULT_TYPE_MISMATCH"),
        ({"id": "x", "fields": [{"name": "a", "type": "STRING", "required": True, "constraints": [{"kind": "pattern", "pattern": "("}]}]}, "INVALID_REGEX_PATTERN"),
        ({"id": "x", "fields": [{"name": "a", "type": "STRING", "required": True, "constraints": [{"kind": "min_length"}]}]}, "CONSTRAINT_PARAM_MISSING"),
        ({"id": "x", "fields": [{"name": "a", "type": "STRING", "required": True}] * 2}, "DUPLICATE_FIELD"), ({"id": "x", "fields": [{"name": "a", "type": "STRING", "required": True}], "policies": {"x": 1}}, "INVALID_POLICY_KEY"),
        ({"type": "object", "properties": {"a": {"oneOf": []}}}, "UNSUPPORTED_JSON_SCHEMA_FEATURE"), ({"openapi": "2.0"}, "INVALID_OPENAPI_VERSION"),
        ({"openapi": "3.0.0", "components": {"schemas": {"A": {"$ref": "#/components/schemas/A"}}}}, "INVALID_REF"), (5, "UNKNOWN_FORMAT"),
    ],
)
def test_bad_contracts(contract, code):
    with pytest.raises(InvalidContractError) as e:
        adapt(contract)
    assert e.value.code == code


def test_model_class():
    pydantic = pytest.importorskip("pydantic")
    from typing import Literal

    class Line(pydantic.BaseModel):
        n: int

    class Invoice(pydantic.BaseModel):
        name: str = pydantic.Field(min_length=1, pattern="^a")
        total: float = pydantic.Field(ge=0)
        paid: bool = False
        note: str | None = None
        kind: Literal["x", "y"]
        lines: list[Line] = pydantic.Field(default_factory=list)
        first: Line

    got = adapt(Invoice)
    assert [(f.name, f.type.name, f.required, f.nullable) for f in got.fields] == [
        ("name", "STRING", True, False), ("total", "DECIMAL", True, False), ("paid", "BOOLEAN", False, False), ("note", "STRING", False, True), ("kind", "ENUM", True, False), ("lines", "ARRAY", False, False), ("first", "OBJECT", True, False),
    ]
    assert [c.kind.value for c in got.fields[0].constraints] == ["min_length", "pattern"]
    assert set(export(got, "pydantic:v2").model_fields) == {f.name for f in got.fields}


def test_contract_invariants():
    with pytest.raises(ValueError):
        Field("a", "a..b", "a", FieldType.STRING)
    with pytest.raises(ValueError):
        Field("a", "a", "a", FieldType.STRING, enum_values=("x",))
    with pytest.raises(TypeError):
        Budget(max_total_latency_ms=True)
    with pytest.raises(InvalidContractError):
        Contract("c", (Field("a", "a", "a", FieldType.MONEY, constraints=(Constraint.of("pattern", pattern="x"),)),)).validate()
    assert adapt(INVOICE).by_path("total").type is FieldType.MONEY and adapt(INVOICE).by_id("none") is None
    assert int(Tier.REMOTE_INFERENCE) == 5


def test_ids_and_versions(spark):
    one = ids.new_id("art")
    assert ids.parse_id(one)[0] == "art" and ids.bump("1.2.3", "minor") == "1.3.0" and ids.compare_versions("1.10.0", "1.9.9") == 1
    with pytest.raises(ValueError):
        ids.parse_id("art_xyz")
    rows = spark.range(3).select(ids.new_id_column("plan").alias("p")).select("p", ids.is_id(F.col("p"), "plan").alias("ok")).collect()
    assert all(r.ok for r in rows) and len({r.p for r in rows}) == 3


def test_stable_dumps():
    assert artifact.stable_dumps({"b": Decimal("1.50"), "a": {3, 1}, "c": b"\x01", "d": "é"}) == '{"a":[1,3],"b":"1.50","c":"0x01","d":"\\u00e9"}'


def test_manifest(spark, tmp_path):
    (tmp_path / "in/deep").mkdir(parents=True)
    (tmp_path / "in/a.txt").write_text("alpha text")
    (tmp_path / "in/deep/b.txt").write_text("")
    (tmp_path / "m.csv").write_text("id,input_file,contract_name\none,a.txt,c\ntwo,deep/b.txt,c\n")
    contract = Contract("c", (Field("s", "s", "s", FieldType.STRING),))
    done, summary = manifest.run(spark, f"{tmp_path}/m.csv", f"{tmp_path}/in", {"c": contract}, f"{tmp_path}/out", registry=full_registry(), policy=Policy(unresolved_acceptable=False))
    assert {r.id: r.status for r in done.collect()} == {"one": "SUCCESS", "two": "UNRESOLVED"}
    assert summary.first().asDict() == {"total": 2, "successful": 1, "unresolved": 1, "failed": 0}
    assert spark.read.json(f"{tmp_path}/out/artifacts").count() == 2 and spark.read.json(f"{tmp_path}/out/run_summary").first().total == 2
    (tmp_path / "m2.csv").write_text("id,input_file,contract_name\none,a.txt,c\ntwo,deep/b.txt,broken\n")
    done, summary = manifest.run(spark, f"{tmp_path}/m2.csv", f"{tmp_path}/in", {"c": contract, "broken": {"id": "x", "fields": []}}, registry=full_registry())
    assert {r.id: (r.status, r.error) for r in done.collect()} == {"one": ("SUCCESS", None), "two": ("FAILED", "InvalidContractError: a contract needs a field")}
    assert summary.first().failed == 1
    for text, code in (("id,input_file,contract_name\n", "EMPTY_MANIFEST"), ("id,input_file,contract_name\nx,../a.txt,c\n", "UNSAFE_MANIFEST"), ("id,input_file,contract_name\nx,a.txt,d\n", "UNKNOWN_CONTRACT"), ("id,input_file,contract_name\nx,z.txt,c\n", "MISSING_INPUT")):
        (tmp_path / "bad.csv").write_text(text)
        with pytest.raises(EngineError) as e:
            manifest.run(spark, f"{tmp_path}/bad.csv", f"{tmp_path}/in", {"c": contract})
        assert e.value.code == code
    tool = manifest.NormalizeTool({"id": "x"})
    assert tool.run(spark.createDataFrame([("a",)], "text string"))["success"] is False


def test_command_line(spark, tmp_path, capsys):
    from sealwright.__main__ import main

    assert main([]) == 2 and main(["m.csv", "in", f"{tmp_path}/none.json", "out"]) == 2
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("alpha")
    (tmp_path / "contracts.json").write_text(json.dumps({"c": {"id": "c", "fields": [{"name": "s", "type": "STRING", "required": True}]}, "b": {"id": "b"}}))
    for rows, code in (("one,a.txt,c", 0), ("one,a.txt,c\ntwo,a.txt,b", 1), ("one,z.txt,c", 2)):
        (tmp_path / "m.csv").write_text(f"id,input_file,contract_name\n{rows}\n")
        assert main([f"{tmp_path}/m.csv", f"{tmp_path}/in", f"{tmp_path}/contracts.json", f"{tmp_path}/out{code}"]) == code
    assert "failed: 1" in capsys.readouterr().out


def test_public_names_are_lazy():
    import subprocess
    import sys

    code = "import sys, sealwright; assert 'pyspark' not in sys.modules; sealwright.EngineError; assert 'pyspark' not in sys.modules; sealwright.normalize; assert 'pyspark' in sys.modules"
    subprocess.run([sys.executable, "-c", code], check=True)
    import sealwright

    assert all(getattr(sealwright, n) is not None for n in sealwright.__all__) and "replay" in dir(sealwright)
    with pytest.raises(AttributeError):
        sealwright.nothing  # noqa: B018


def test_logging():
    import io
    import logging

    from sealwright import log

    for replay in (True, False):
        out = io.StringIO()
        log.logger().handlers.clear()
        log.configure("info", json_output=True, replay_mode=replay, stream=out)
        log.configure("debug")
        log.logger("planner").info("planned", extra={"steps": 3})
        log.logger("planner").debug("hidden")
        line = json.loads(out.getvalue())
        assert ("time" in line) is not replay and {k: v for k, v in line.items() if k != "time"} == {"event": "planned", "level": "info", "logger": "sealwright.planner", "steps": 3}
    log.logger().handlers.clear()
    with pytest.raises(ValueError):
        log.configure("loud")
    assert logging.getLogger("sealwright") is log.logger()


def test_clocks():
    import datetime

    from sealwright.clock import FixedClock, SystemClock

    c = FixedClock()
    before = c.now()
    c.advance(2.5)
    assert c.now() - before == datetime.timedelta(seconds=2.5) and c.monotonic() == 2.5
    assert SystemClock().now().tzinfo is not None and SystemClock().monotonic() <= SystemClock().monotonic()
    with pytest.raises(ValueError):
        c.advance(-1)


def test_strategies(spark):
    from hypothesis import HealthCheck, given, settings

    from sealwright import testing
    from sealwright.operators import registry as R

    seen = []

    @settings(max_examples=25, deadline=None, database=None, suppress_health_check=list(HealthCheck))
    @given(testing.contracts(), testing.inputs(), testing.budgets(), testing.policies(), testing.registries())
    def planned(contract, raw, budget, policy, registry):
        for v in planner.VARIANTS:
            made, _ = planner.affordable(planner.plan(contract, registry, v, budget, policy), registry, budget)
            assert [f.field_id for f in made.fields] == [f.id for f in contract.required()]
            assert all(registry.get(s.capability_id, s.capability_version) for f in made.fields for s in f.steps)
        seen.append(raw)

    planned()
    rows = []

    @settings(max_examples=60, deadline=None, database=None, suppress_health_check=list(HealthCheck))
    @given(testing.candidate_sets())
    def drawn(own):
        rows.append((len(rows), own))

    drawn()
    df = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(seen)], "i int, raw binary")
    for r in df.select("i", P.profile(F.col("raw")).alias("p")).collect():
        assert (r.p.input_type, r.p.size, r.p.is_empty) == tuple(py_profile(seen[r.i])[k] for k in (0, 1, 3))
    cands = spark.createDataFrame(rows, f"i int, c array<{CANDIDATE}>")
    for r in cands.select("i", "c", reconcile.resolve(Field("f", "f", "f", FieldType.STRING), F.col("c")).alias("r")).collect():
        want = py_resolve([c.asDict(recursive=True) for c in r.c], Merge.PREFER_BY_EVIDENCE, 0.80, None)
        assert (r.r.value if r.r.status == "RESOLVED" else None) == (want[0] if want else None)
    with testing.registered(Registry()):
        assert not R.shared().ids()
    assert R.shared().ids() == {"lookup"}


def test_missing_rate_is_the_rows_problem(spark):
    ref = {"capability_id": "x", "capability_version": "1", "tier": 1, "deterministic": True, "field_path": "f", "span_start": None, "span_end": None}
    c = lambda amount, cur: {"pos": 0, "value": None, "amount": Decimal(amount), "currency": cur, "evidence": [ref]}
    df = spark.createDataFrame([(0, [c("1", "USD"), c("2", "USD")]), (1, [c("1", "USD"), c("2", "EUR")])], f"i int, c array<{CANDIDATE}>")
    field = Field("f", "f", "f", FieldType.MONEY, confidence_threshold=0.5)
    got = {r.i: (r.r.value, [d.code for d in r.r.diagnostics if d.severity == "ERROR"]) for r in df.select("i", reconcile.resolve(field, F.col("c"), policy=CurrencyPolicy.ALLOW_FX).alias("r")).collect()}
    assert got == {0: ("3.00 USD", []), 1: (None, ["MISSING_FX_RATE"])}


def test_fields_of_results_are_checked(spark):
    contract = Contract("c", (Field("a", "a", "a", FieldType.STRING),))
    for rows, code in (([(1, "a"), (1, "a")], "DUPLICATE_FIELD_ID"), ([(1, "a"), (1, "z")], "UNKNOWN_FIELD_ID")):
        with pytest.raises(EngineError) as e:
            reconcile_long.against(spark.createDataFrame(rows, "row int, field_id string"), contract, "row")
        assert e.value.code == code
    with pytest.raises(EngineError) as e:
        normalize(spark.createDataFrame([("x",)], "text string"), contract, plan=Plan("c", (FieldPlan("z"),)))
    assert e.value.code == "UNKNOWN_FIELD_ID"


def test_lines_must_be_objects(spark):
    schema = T.StructType([T.StructField("a", T.IntegerType())])
    assert artifact.decode(spark.createDataFrame([(' {"a": 1}',)], "value string"), schema).first().a == 1
    with pytest.raises(Exception, match="NOT_AN_OBJECT"):
        artifact.decode(spark.createDataFrame([("[1]",)], "value string"), schema).collect()


def test_formats_are_told_by_their_markers():
    assert detect({"id": "x", "type": "whatever", "fields": []}) == "dict_dsl"
    assert detect({"id": "x", "uniqueItems": True}) == "json_schema:2020-12" and detect({"openapi": "3.0.0"}) == "openapi:3.x"


def test_shared_registry():
    from dataclasses import replace

    from sealwright.operators import registry as R

    lookup = builtin()["lookup"]
    newer = R.Capability(replace(lookup.spec, version="2.0"), lookup.compile)
    R.register_capability(newer)
    try:
        assert R.get_capability("lookup") is newer and R.get_capability("lookup", "1.0").spec.version == "1.0"
        assert default_registry().latest("lookup") is newer
    finally:
        R.unregister_capability("lookup", "2.0")
    assert R.get_capability("lookup").spec.version == "1.0"
    step = R.settings(Step("lookup", "1.0", {"key": "k"}), lookup.spec)
    assert step.config == {"tier": "STRUCTURED_LOOKUP", "key": "k"}
    with pytest.raises(ValueError):
        R.Context(None, None, None, "", "STRING")


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "one"), (2, "two")], "id int, text string").withColumn("at", F.lit("2024-01-01 00:01:00").cast("timestamp")).write.parquet(f"{tmp_path}/in")
    stream = streaming.read(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
    done = streaming.normalize_stream(stream, Contract("c", (Field("s", "s", "s", FieldType.STRING),)), registry=full_registry())
    assert done.isStreaming
    counts = streaming.status_windows(done, "at")
    q = counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.status, r.n) for r in spark.table("counts").collect()] == [("SUCCESS", 2)]


def test_no_shuffle_in_normalize(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = __spark_entry__.queries()["normalize_documents"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan and docs.columns


def test_queries_match_their_sql(spark):
    """Every query of the engine with SQL, over the smallest tables."""
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages conversations labels".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    from sealwright.plans import catalog

    assert __spark_entry__.entry(spark).count() > 0
    for name, sql in catalog.ORACLES.items():
        df = catalog.QUERIES[name](spark, SF)
        cols = sorted(df.columns)
        got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
        cur = con.execute(sql)
        names = [x[0] for x in cur.description]
        assert sorted(names) == cols, name
        want = sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in cur.fetchall())
        assert got == want, name
    for name in catalog.QUERIES.keys() - catalog.ORACLES.keys():
        assert catalog.QUERIES[name](spark, SF).count() >= 0
