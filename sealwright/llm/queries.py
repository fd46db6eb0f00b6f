"""Queries of the operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .embedding_dedup import OP4_SQL, op4_embedding_dedup
from .exact_dedup import OP7_SQL, op7_exact_dedup
from .langid import op9_language_id
from .line_dedup import OP6_SQL, op6_line_dedup
from .minhash import OP10_SQL, op10_minhash_dedup
from .mixing import OP8_SQL, op8_mix_sources
from .pii import op2_pii_spans
from .sentencepiece_nbest import op5_sentencepiece_nbest
from .substring_dedup import OP1_SQL, op1_substring_dedup
from .warc import OP3_SQL, op3_warc_archive

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_pii_spans": op2_pii_spans,
    "op3_warc_archive": op3_warc_archive,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_sentencepiece_nbest": op5_sentencepiece_nbest,
    "op6_line_dedup": op6_line_dedup,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_mix_sources": op8_mix_sources,
    "op9_language_id": op9_language_id,
    "op10_minhash_dedup": op10_minhash_dedup,
}
#: Language ID, the patterns' spans by code point and the piece lattice are tested against Python instead.
ORACLES: dict[str, str] = {
    "op1_substring_dedup": OP1_SQL,
    "op3_warc_archive": OP3_SQL,
    "op4_embedding_dedup": OP4_SQL,
    "op6_line_dedup": OP6_SQL,
    "op7_exact_dedup": OP7_SQL,
    "op8_mix_sources": OP8_SQL,
    "op10_minhash_dedup": OP10_SQL,
}
