"""Mixing sources to target weights by Poisson replication, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, cut, table, unused

#: Target weights of sources; every other source has the weight 1. They are relative: the sum of all is the whole.
WEIGHTS = {"src0": 6.0, "src1": 3.0, "src2": 0.5}
SEED = 20240501
#: Larger means are the sum of independent draws of at most this mean, so that exp(-mean) stays a normal number.
PART = 16.0
#: A table of sources of at most so many rows is broadcast; a larger one is joined by shuffle.
SOURCES_BROADCAST = 10_000
_STEPS = 80


def uniform(seed: Column, *key: Column) -> Column:
    """A double in [0, 1) from the first 52 bits of a SHA-256 digest."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", seed.cast("string"), *[k.cast("string") for k in key]), 256), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 52))


def _cdf(mean: Column) -> Column:
    """P(X <= k) for k = 0.. of a Poisson distribution of mean <= PART, far beyond which u can't reach."""
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k.cast("double")
        c = acc["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), F.concat(acc["all"], F.array(c)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(_STEPS)), start, step)["all"]


def rates(docs: DataFrame, weights: dict[str, float] | None = None, source_col: str = "source", size: float = 1.0) -> DataFrame:
    """(source, n, rate, parts, cdf), a written table: each source's rows and mean number of copies of a row.

    rate = size * rows of all * weight / sum of weights / rows of the source, so the expected result has `size`
    times as many rows, dealt to the sources by weight. A null source is a source of its own.
    """
    weights = WEIGHTS if weights is None else weights
    w = F.lit(1.0)
    for name, x in weights.items():
        w = F.when(F.col("source") == name, F.lit(float(x))).otherwise(w)
    n = cut(docs.select(F.col(source_col).alias("source")).groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("w", w), "sources")
    total, weight = n.agg(F.sum("n").cast("double"), F.sum("w")).first()
    n = n.withColumn("rate", F.lit(float(size)) * F.lit(total) * F.col("w") / F.lit(weight) / F.col("n").cast("double"))
    n = n.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int"))
    return n.select("source", "n", "rate", "parts", _cdf(F.col("rate") / F.col("parts")).alias("cdf"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source", seed: int = SEED, size: float = 1.0, keep_draw: bool = False) -> DataFrame:
    """`docs` with each row repeated by its Poisson count, in a globally shuffled order.

    The count inverts the Poisson distribution at a uniform number hashed from (seed, id): smallest k with
    u < P(X <= k). Rows without id draw from (seed, ''); rows that repeat an id draw alike; sources of weight 0 go;
    an empty table gives an empty one. All columns of `docs` stay as they are, whatever their names: our own get names
    that none of them has. keep_draw adds three as the last ones: copy (1..count), copies, and order, the shuffle key,
    each named so with two underscores before it, or more where `docs` has such a column.
    """
    r = rates(docs, weights, source_col, size)
    small = r.limit(SOURCES_BROADCAST + 1).count() <= SOURCES_BROADCAST
    copy, copies, order, source, parts, cdf, u = unused(docs, "__copy", "__copies", "__order", "__source", "__parts", "__cdf", "__u")
    r = r.select(F.col("source").alias(source), F.col("parts").alias(parts), F.col("cdf").alias(cdf))
    rows = docs.join(F.broadcast(r) if small else r, F.col(source_col).eqNullSafe(F.col(source)))
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    # u is hashed once a part, not once a step of the distribution
    one = F.transform(F.sequence(F.lit(1), F.col(parts)), lambda j: uniform(F.lit(seed), ident, j))
    rows = rows.withColumn(u, one)
    count = F.aggregate(F.col(u), F.lit(0), lambda acc, x: acc + F.size(F.filter(F.col(cdf), lambda c: c <= x)))
    rows = rows.withColumn(copies, count).where(F.col(copies) > 0)
    rows = rows.select(*columns(docs), copies, F.explode(F.sequence(F.lit(1), F.col(copies))).alias(copy))
    rows = rows.withColumn(order, F.sha2(F.concat_ws(":", F.lit("order"), F.lit(seed).cast("string"), ident, F.col(copy).cast("string")), 256))
    return rows.orderBy(order).select(*columns(docs), *([copy, copies, order] if keep_draw else []))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per copy; the whole documents travel through the global shuffle."""
    out = mix(table(spark, sf_dir, "documents"), keep_draw=True)
    return out.select("doc_id", "source", F.col("__copy").cast("long").alias("copy"), F.col("__copies").cast("long").alias("copies"), F.col("__order").alias("order_key"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def _op8_sql() -> str:
    weight = "".join(f"WHEN source = '{k}' THEN {v}::DOUBLE " for k, v in WEIGHTS.items())
    u = f"('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || j), 1, 13))::BIGINT::DOUBLE / {1 << 52}::DOUBLE"
    return f"""
WITH RECURSIVE s AS (SELECT source, count(*) AS n, CASE {weight}ELSE 1::DOUBLE END AS w FROM documents GROUP BY 1),
r AS (SELECT source, (SELECT sum(n) FROM s)::DOUBLE * w / (SELECT sum(w) FROM s) / n::DOUBLE AS rate FROM s),
q AS (SELECT source, rate, greatest(1, ceil(rate / {PART}::DOUBLE))::INT AS parts FROM r),
d(source, k, mean, p, c) AS (
  SELECT source, 0, rate / parts, exp(-(rate / parts)), exp(-(rate / parts)) FROM q
  UNION ALL SELECT source, k + 1, mean, p * mean / (k + 1)::DOUBLE, c + p * mean / (k + 1)::DOUBLE FROM d WHERE k < {_STEPS}),
u AS (SELECT doc_id, documents.source, text, {u} AS u
      FROM documents JOIN q ON documents.source IS NOT DISTINCT FROM q.source, unnest(generate_series(1, parts)) AS g(j)),
n AS (SELECT doc_id, u.source, any_value(text) AS text, count(c) AS copies
      FROM u LEFT JOIN d ON u.source IS NOT DISTINCT FROM d.source AND c <= u GROUP BY 1, 2)
SELECT doc_id, source, i AS copy, copies, sha256('order:{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || i) AS order_key,
       sha256(coalesce(text, '')) AS text_sha256
FROM n, unnest(generate_series(1, copies)) AS g(i)
"""


OP8_SQL = _op8_sql()
