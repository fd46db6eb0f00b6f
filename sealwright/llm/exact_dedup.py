"""Exact dedup by skew-safe combining, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, columns, cut, join_dealt, table, unused

#: Salts of one digest group. A group of copies that holds a third of all rows is merged in so many places first.
SALTS = 32


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """(digest, content, keep_id, group_size): one row per distinct normalised text.

    Three merges compare the full content, as it is a grouping key beside its digest: rows of a task (the map-side
    combine), rows of a (digest, salt) group, and the salts' winners.
    """
    text = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("content"))
    rows = rows.select("id", "content", F.sha2("content", 256).alias("digest"), F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"))
    salted = rows.groupBy("digest", "salt", "content").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    return salted.groupBy("digest", "content").agg(F.min("id").alias("keep_id"), F.sum("n").alias("group_size"))


def _texts(docs: DataFrame, id_col: str, text_col: str, salts: int) -> DataFrame:
    """(d, keep_id, group_size): one row per digest. Two texts of one digest are two groups, and stop the run."""
    by_digest = groups(docs, id_col, text_col, salts).groupBy(F.col("digest").alias("d"))
    found = by_digest.agg(F.count(F.lit(1)).alias("texts"), F.min("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))
    checked = F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts have one SHA-256 digest"))).otherwise(F.col("keep_id"))
    return found.select("d", checked.alias("keep_id"), "group_size")


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per row of `docs`: id_col, keep_id, group_size, kept, text_sha256.

    The smallest id of equal texts stays. Null text counts as empty; null ids sort after all others (a group of
    null ids only has a null keep_id and stays); rows that repeat an id stay or go together; an empty table gives
    an empty result. Other columns of `docs` are never read, so their names can't clash. The rows meet the groups by
    digest, where those of a hot group are dealt to several places.
    """
    found = cut(_texts(docs, id_col, text_col, salts), "texts").select(F.col("d").alias("digest"), "keep_id", "group_size", F.col("group_size").alias("n"))
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("content")).select("id", F.sha2("content", 256).alias("digest"))
    known = join_dealt(rows, found, "digest", F.col("id"))
    return known.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row of `docs` per distinct text, all columns kept: the one of the id that assign() keeps.

    Rows are told by digest and id together, so an id that several texts share stays with those it is the least of,
    and a copy of null id goes. Of rows that repeat both text and id any one stays. Columns of any name stay as they
    are: our own keys get names that none of them has.
    """
    # null ids are a key of their own; plain equality lets the last step use the join's order and places
    key = lambda x: [F.coalesce(x.cast("string"), F.lit("")), x.isNull()]
    names = unused(docs, "__digest", "__id", "__none")
    found = _texts(docs, id_col, text_col, salts).select(*(c.alias(n) for c, n in zip([F.col("d"), *key(F.col("keep_id"))], names, strict=True)))
    own = [F.sha2(normalised(F.col(text_col)), 256), *key(F.col(id_col))]
    rows = docs.withColumns(dict(zip(names, own, strict=True)))
    return rows.join(found, names, "left_semi").dropDuplicates(names).select(*columns(docs))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS c FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept,
       sha256(c) AS text_sha256
FROM t WINDOW w AS (PARTITION BY c)
"""
