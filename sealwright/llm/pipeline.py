"""Stages of the corpus pipeline: each works on all rows that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, langid, minhash, mixing, sentencepiece_nbest
from .common import cut, forget, table, workspace

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; all of them if nothing is labelled, as nothing can be told from anything then."""
    known = langid.profiles(docs)
    return langid.keep_known(docs, known) if known[0] else docs


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_nbest.digests(sentencepiece_nbest.encode(docs))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("minhash_dedup", near),
    ("mix_sources", mix),
    ("sentencepiece_encode", encode),
]
#: Language prediction and the piece lattice are beyond SQL; the stages are tested one by one instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written as Parquet and read again, and what a stage has read
    or written meanwhile is deleted then."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with workspace(spark) as kept:
            done = cut(stage(spark, docs, sf_dir), "stage")
            kept.append(done.cut_path)
        forget(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
