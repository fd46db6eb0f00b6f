"""What the operators share: tables, cut lineage, vectorised words and connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import cut, forget, new_path, workspace  # noqa: F401

#: ASCII white space as the contracts define it: space, tab, LF, VT, FF, CR.
SPACE = r"[\x20\x09-\x0D]+"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(df: DataFrame) -> list[Column]:
    """All columns, whatever their names hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of `df` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


#: A key of a HOT-th of all rows or more is hot, so there are HOT of them at most; its rows are dealt to so many places.
HOT, PLACES = 1000, 64


def join_dealt(rows: DataFrame, found: DataFrame, key: str, ident: Column, how: str = "inner") -> DataFrame:
    """rows.join(found, key), where the rows of a hot key are dealt by `ident` to several places.

    `found` is a written table with one row per key and the number `n` of rows that have it. The hot keys, which are
    HOT at most, are broadcast to the rows, and the rows of `found` that they need are repeated. `n` isn't kept.
    """
    total = F.lit(found.agg(F.sum("n").cast("double")).first()[0])
    hot = F.col("n").cast("double") * HOT >= total
    named = F.broadcast(found.where(hot).select(F.col(key).alias("__hot")))
    place = F.when(F.col("__hot").isNotNull(), F.pmod(F.xxhash64(ident), F.lit(PLACES)).cast("int")).otherwise(F.lit(0))
    rows = rows.join(named, F.col(key) == F.col("__hot"), "left").withColumn("__place", place).drop("__hot")
    places = F.when(hot, F.sequence(F.lit(0), F.lit(PLACES - 1))).otherwise(F.array(F.lit(0)))
    found = found.withColumn("__place", F.explode(places)).drop("n")
    return rows.join(found, [key, "__place"], how).drop("__place")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of one UTF-8 text as byte ranges, with a 64-bit hash of each, all vectorised."""

    _powers = np.ones(1, np.uint64)
    _inverse = np.ones(1, np.uint64)

    def __init__(self, data: bytes):
        self.data = data
        raw = np.frombuffer(data, np.uint8)
        word = ~_IS_SPACE[raw]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
        self.start, self.end = edge[::2], edge[1::2]
        self.n = len(self.start)
        self._raw = raw

    @classmethod
    def _grow(cls, n: int) -> None:
        size = 1 << max(12, int(n).bit_length())
        with np.errstate(over="ignore"):
            inv = np.uint64(pow(int(_BASE), -1, 1 << 64))
            cls._powers = np.concatenate(([np.uint64(1)], np.cumprod(np.full(size, _BASE))))
            cls._inverse = np.concatenate(([np.uint64(1)], np.cumprod(np.full(size, inv))))

    def hashes(self) -> np.ndarray:
        if not self.n:
            return np.empty(0, np.uint64)
        if len(self._raw) >= len(self._powers):
            self._grow(len(self._raw))
        with np.errstate(over="ignore"):
            # each byte is mixed first, so that the polynomial modulo 2^64 has no weak low bits
            sums = np.concatenate(([np.uint64(0)], np.cumsum(_MIXED[self._raw] * self._powers[: len(self._raw)])))
            return mix64((sums[self.end] - sums[self.start]) * self._inverse[self.start] + (self.end - self.start).astype(np.uint64))


_MIXED = mix64(np.arange(1, 257, dtype=np.uint64) * _BASE)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of k consecutive words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = (out ^ words[i : i + n]) * _BASE + (out >> np.uint64(29))
        return mix64(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of `width` values, by doubling."""
    done, out = 1, x
    while done * 2 <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components by alternating large-star and small-star steps, each an aggregation and a join.

    Returns (id, component): the smallest id that is reachable, for every id with an edge to another one. No
    neighbour list is ever gathered; a hub's edges stay rows. The driver sees two numbers a round. The result reads a
    written table, which forget() deletes.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = cut(e, "edges")
    seen = None
    while True:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: every node of `large` points down; tie its lower neighbours to the lowest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        new = cut(small, "edges")
        state = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        forget(e)
        e = new
        if state == seen:
            break
        seen = state
    out = e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    out = out.union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
    out.cut_path = e.cut_path
    return out


#: Rows and bytes of the pieces that Arrow batches are handed on in: whole texts travel in them, some of them very long.
PIECE_ROWS, PIECE_BYTES = 400, 8 << 20


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of the batch, in order, of few rows and bytes; a larger row is a slice of its own."""
    if batch.num_rows > 1 and (batch.num_rows > PIECE_ROWS or batch.nbytes > PIECE_BYTES):
        half = batch.num_rows // 2
        yield from pieces(batch.slice(0, half))
        yield from pieces(batch.slice(half))
    else:
        yield batch


def give_back() -> None:
    """Give memory that is free in this process back to the system: workers outlive tasks, and other stages need it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def _in_pieces(function, batches):
    try:
        yield from function(piece for batch in batches for piece in pieces(batch))
    finally:
        give_back()


def map_texts(df: DataFrame, function, schema: StructType | str) -> DataFrame:
    """mapInArrow in small pieces of the batches, whose bytes Spark bounds. `function` takes an iterator of record batches."""
    return df.mapInArrow(partial(_in_pieces, function), schema)


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")
