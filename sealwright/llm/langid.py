"""Language ID with hyperdimensional profiles of letter trigrams."""

from __future__ import annotations

from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, mix64, table

DIMENSIONS = 1024
#: Documents with crc32(id as text) mod FOLDS = HELD_OUT are never learned from.
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
#: Distinct labels that can be learned: a profile of each travels to the driver and to every task.
MOST_LANGUAGES = 2000
#: Distinct trigrams that are expanded to vectors at a time, which bounds a task's memory.
AT_ONCE = 16_000
_SHIFT = 21
#: Standard deviation of the cosine of unrelated bundles. See least_score() for the others: of 5,000 documents of
#: sf0.1 (those below 20,000 characters), all of FEW distinct trigrams and more lay above 0.027 times their root, all of
#: 100 and more above 0.5.
NOISE = DIMENSIONS**-0.5
FEW, SLOPE, MOST = 8, 0.8, 8.0


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def trigrams(text: str | None) -> np.ndarray:
    """Codes of the letter trigrams of a lower-cased text; a run of anything else is one space, as are both ends."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = _letters()[points]
    if not letter.any():
        return np.empty(0, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of a run of others, the first
    points = np.where(letter, points, 32)[keep]
    points = np.concatenate(([32] * int(points[0] != 32), points, [32] * int(points[-1] != 32))).astype(np.int64)
    return (points[:-2] << 2 * _SHIFT) | (points[1:-1] << _SHIFT) | points[2:]


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """A random vector of +1 and -1 for each code point, made of its hash and so the same everywhere."""
    words = np.arange(1, DIMENSIONS // 64 + 1, dtype=np.uint64) << np.uint64(32)
    bits = np.unpackbits(mix64(mix64(words[None, :] + points[:, None].astype(np.uint64))).view(np.uint8), axis=1)
    return (bits.astype(np.int8) << 1) - 1


def trigram_vectors(codes: np.ndarray) -> np.ndarray:
    """Letters bound by product, each permuted (rolled) by its place in the trigram."""
    places = [(codes >> s) & ((1 << _SHIFT) - 1) for s in (2 * _SHIFT, _SHIFT, 0)]
    points, at = np.unique(np.concatenate(places), return_inverse=True)
    base = letter_vectors(points)
    a, b, c = at.reshape(3, -1)
    return np.roll(base, 2, axis=1)[a] * np.roll(base, 1, axis=1)[b] * base[c]


def bundles(texts: list[np.ndarray]) -> np.ndarray:
    """The sum of the trigram vectors of each text, exact in single precision below 2^24 trigrams of a kind."""
    out = np.zeros((len(texts), DIMENSIONS))
    counted = [np.unique(t, return_counts=True) for t in texts]
    codes, at = np.unique(np.concatenate([c for c, _ in counted]) if counted else np.empty(0, np.int64), return_inverse=True)
    sizes = [len(c) for c, _ in counted]
    rows, counts = np.repeat(np.arange(len(texts)), sizes), np.concatenate([n for _, n in counted]) if counted else np.empty(0, np.int64)
    for low in range(0, len(codes), AT_ONCE):
        vectors = trigram_vectors(codes[low : low + AT_ONCE]).astype(np.float32)
        for first in range(0, len(texts), 100):
            mine = (rows >= first) & (rows < first + 100) & (at >= low) & (at < low + AT_ONCE)
            dense = np.zeros((min(100, len(texts) - first), len(vectors)), np.float32)
            dense[rows[mine] - first, at[mine] - low] = counts[mine]
            out[first : first + 100] += dense @ vectors
    return out


def _learn(batches):
    profiles: dict[str, np.ndarray] = {}
    for batch in batches:
        texts: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            texts.setdefault(lang, []).append(trigrams(text.as_py()))
        for lang, found in texts.items():
            profiles[lang] = profiles.get(lang, 0) + bundles([np.concatenate(found)])[0]
    for lang, profile in profiles.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMENSIONS), pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(profile)], ["lang", "at", "x"])


def _best(langs: list[str], profiles: np.ndarray, texts: list[np.ndarray]) -> tuple[list[str], np.ndarray]:
    own = bundles(texts)
    length = np.linalg.norm(own, axis=1)
    cosine = (own @ profiles.T) / np.where(length > 0, length, 1)[:, None]
    has = np.array([len(t) > 0 for t in texts], bool)
    best = cosine.argmax(axis=1)
    return [langs[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)], np.where(has, np.clip(cosine.max(axis=1), 0, 1), 0.0)


def _predict(langs: list[str], profiles: np.ndarray, batches):
    for batch in batches:
        pred, score = _best(langs, profiles, [trigrams(t.as_py()) for t in batch.column(1)])
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(pred, pa.string()), pa.array(score)], ["id", "lang_pred", "score"])


def least_score(codes: np.ndarray) -> float:
    """The cosine that a text of these trigrams must exceed to count as one in a known language.

    The cosine of a text with profiles it has nothing to do with is noise of NOISE whatever its length, while that of
    a text in a language grows with the root of its distinct trigrams (here the inverse of the sum of their squared
    shares, so that one line said a thousand times is as short as the line). Below FEW of them both look alike.
    """
    counts = np.unique(codes, return_counts=True)[1].astype(float)
    distinct = counts.sum() ** 2 / (counts**2).sum() if len(counts) else 0.0
    return 0.0 if distinct < FEW else NOISE * min(SLOPE * distinct**0.5, MOST)


def _known(langs: list[str], profiles: np.ndarray, at: int, batches):
    for batch in batches:
        texts = [trigrams(t.as_py()) for t in batch.column(at)]
        pred, score = _best(langs, profiles, texts)
        keep = [p != UNKNOWN and (s > NOISE * MOST or s > least_score(t)) for p, s, t in zip(pred, score, texts, strict=True)]
        yield batch.filter(pa.array(keep, pa.bool_()))


def held_out(id_col: str):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order and their profiles of length 1, learned from all labelled rows that aren't held out.

    Tasks send the DIMENSIONS sums of each language, added up in Spark; the driver gets one vector a language. More
    than MOST_LANGUAGES of them raise an error.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    if rows.select(lang_col).distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"{lang_col} has more than {MOST_LANGUAGES} languages")
    sums = map_texts(rows.select(F.col(lang_col).cast("string"), F.col(text_col)), _learn, "lang string, at int, x double").groupBy("lang", "at").agg(F.sum("x").alias("x"))
    vectors: dict[str, np.ndarray] = {}
    for lang, at, x in sums.collect():
        vectors.setdefault(lang, np.zeros(DIMENSIONS))[at] = x
    langs = sorted(k for k, v in vectors.items() if v.any())
    return langs, np.array([vectors[k] / np.linalg.norm(vectors[k]) for k in langs]).reshape(len(langs), DIMENSIONS)


def identify(docs: DataFrame, known: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) of each row: the profile of largest cosine with the text's bundle.

    Null text, and text without a letter, is `und` with score 0; so is every text if nothing was learned. Equal
    cosines go to the first language in order. A negative cosine counts as 0. Rows that repeat an id are rows of
    their own, null ids are kept, an empty table gives an empty one, and other columns are never read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if not known[0]:
        return rows.select(F.col("id").alias(id_col), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return map_texts(rows, partial(_predict, *known), "id long, lang_pred string, score double").withColumnRenamed("id", id_col)


def keep_known(docs: DataFrame, known: tuple[list[str], np.ndarray], text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns kept, whose text is in a language of `known` by least_score(); each row is
    decided by its own text, whatever its id. Text without a letter goes, and text too short to tell stays."""
    return map_texts(docs, partial(_known, *known, docs.columns.index(text_col)), docs.schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, profiles(docs))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
