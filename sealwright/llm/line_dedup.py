"""Line dedup by content-defined chunks of lines, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, join_dealt, table

#: A chunk ends after a line where the rolling hash over this line and the one before is 0 modulo DIVISOR.
DIVISOR = 3
#: Chunks of fewer lines are never removed.
MIN_LINES = 2
_PRIME, _FACTOR = 2_147_483_647, 1_000_003
#: In the joined text, \x01\x03 ends a chunk; \x01 of the text itself is written \x01\x02 meanwhile.
_MARK, _END = "\x01", "\x01\x03"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once; higher-order functions don't share common subexpressions."""
    return F.get(F.transform(F.array(value), body), 0)


def chunked(text: Column) -> Column:
    """array<string>: the lines of a text in chunks, in order; null text counts as empty.

    A boundary depends on two neighbouring lines alone, so an insertion shifts no boundary but those beside it.
    Every step is linear in the text.
    """
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    hashed = F.transform(lines, lambda x: F.struct(F.replace(x, F.lit(_MARK), F.lit(_MARK + "\x02")).alias("line"), F.conv(F.substring(F.md5(x), 1, 7), 16, 10).cast("bigint").alias("h")))

    def joined(each: Column) -> Column:
        before = F.concat(F.array(F.lit(0).cast("bigint")), F.slice(each["h"], F.lit(1), F.size(each) - 1))
        ends = lambda x, h: F.pmod(F.pmod(h * F.lit(_FACTOR) + x["h"], F.lit(_PRIME)), F.lit(DIVISOR)) == 0
        return F.array_join(F.zip_with(each, before, lambda x, h: F.concat(x["line"], F.when(ends(x, h), F.lit(_END)).otherwise(F.lit("\n")))), "")

    def parts(marked: Column) -> Column:
        # the last part is empty if the last line closed a chunk; otherwise it ends with a line end too many
        whole = F.when(F.endswith(marked, F.lit(_END)), F.substring(marked, F.lit(1), F.length(marked) - len(_END))).otherwise(F.substring(marked, F.lit(1), F.length(marked) - 1))
        return F.transform(F.split(whole, _END, -1), lambda x: F.replace(x, F.lit(_MARK + "\x02"), F.lit(_MARK)))

    return _let(_let(hashed, joined), parts)


def _lines(chunk: Column) -> Column:
    return F.length(chunk) - F.length(F.replace(chunk, F.lit("\n"), F.lit(""))) + 1


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_lines, n_chunks, n_removed, kept): the text without multi-line chunks that occur before.

    Of equal chunks, the first in (id, position) order stays. Chunks are equal when all their bytes are: the rows of a
    digest are compared by smallest and largest content, and a digest of two contents stops the run. Null text counts
    as empty; rows of null id keep all their chunks; rows that repeat an id share what is removed; an empty table
    gives an empty one. Other columns are never read.
    """
    rows = docs.select(F.col(id_col).alias("id"), chunked(F.col(text_col)).alias("chunks"))
    # outer: a text has one chunk at least, and Spark would compute the chunks once more to filter empty arrays
    each = rows.where("id IS NOT NULL").select("id", F.posexplode_outer("chunks").alias("at", "chunk")).where(_lines(F.col("chunk")) >= MIN_LINES)
    key = (F.col("id").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("at")).cast("decimal(38,0)")
    each = each.select("id", "at", "chunk", F.sha2("chunk", 256).alias("digest"), key.alias("key"))
    first = each.groupBy("digest").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.min("chunk").alias("lo"), F.max("chunk").alias("hi"), F.count(F.lit(1)).alias("n")).where(F.col("first") < F.col("last"))
    same = F.when(F.col("lo") == F.col("hi"), F.col("first")).otherwise(F.raise_error(F.lit("two chunks have one SHA-256 digest")).cast("decimal(38,0)"))
    first = cut(first.select("digest", same.alias("first"), "n"), "repeated")
    gone = join_dealt(each.select("id", "at", "digest", "key"), first, "digest", F.col("id")).where("key > first")
    gone = gone.groupBy(F.col("id").alias("gone_id")).agg(F.collect_set("at").alias("gone"))
    out = rows.join(gone, F.col("id") == F.col("gone_id"), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("chunks") - 1), F.coalesce("gone", F.array().cast("array<int>")))
    out = out.select("id", "chunks", stay.alias("stay"))
    kept = F.array_join(F.transform("stay", lambda i: F.get("chunks", i)), "\n")
    n_lines = F.aggregate("chunks", F.lit(0).cast("bigint"), lambda a, c: a + _lines(c))
    return out.select(F.col("id").alias(id_col), n_lines.alias("n_lines"), F.size("chunks").cast("bigint").alias("n_chunks"), (F.size("chunks") - F.size("stay")).cast("bigint").alias("n_removed"), kept.alias("kept"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_chunks", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP6_SQL = f"""
WITH l AS (SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line
           FROM documents, unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS g(i)),
h AS (SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT AS h FROM l),
e AS (SELECT *, ((coalesce(lag(h) OVER w, 0) * {_FACTOR} + h) % {_PRIME}) % {DIVISOR} = 0 AS ends FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM e),
c AS (SELECT doc_id, pos, count(*) AS lines, string_agg(line, chr(10) ORDER BY i) AS chunk FROM n GROUP BY 1, 2),
r AS (SELECT *, lines >= {MIN_LINES} AND row_number() OVER (PARTITION BY chunk ORDER BY doc_id, pos) > 1 AS gone FROM c)
SELECT doc_id, sum(lines)::BIGINT AS n_lines, count(*) AS n_chunks, sum(gone::INT)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(chunk, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM r GROUP BY 1
"""
