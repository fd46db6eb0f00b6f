"""MinHash near-dedup: bands propose, odd sketches estimate and bound, full shingle sets decide."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, components, cut, forget, gram_hashes, join_dealt, map_texts, mix64, table, unused, utf8

WORDS, PERCENT = 5, 75
#: A pair at similarity 0.75 shares a band of 4 samples with chance 0.316, and none of 32 bands with chance 5e-6.
BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
#: Bits of the odd sketch, in 64-bit words.
SKETCH_WORDS = 8
SKETCH_BITS = 64 * SKETCH_WORDS
#: A pair at 0.75 is passed on with all but 1e-6: the cut lies 5 deviations (MinHash's and the bitmap's) below it.
LEAST_ESTIMATE = 0.44
#: Words of the odd sketch of the whole shingle set. A bit of it differs only where the sets do, so that its count of
#: differing bits never exceeds the symmetric difference: what it rules out is ruled out for certain.
SET_WORDS = 64
#: Rounds in which a document meets one member of each bucket, another in every bucket and round. What they leave open
#: is compared in full, so their number changes speed only.
ROUNDS = 2
#: A bucket is compared pair by pair while its members have so many members of other components on average, which bounds
#: the work of a document; documents in larger ones meet over their rarest shingles instead, and no pair is lost either
#: way. Members of a group are dealt to places of so many.
FEW, DEAL = 2000, 1000
#: At most so many ids are broadcast to pick the texts to compare; more are joined by shuffle.
IDS_BROADCAST = 500_000

_RNG = np.random.default_rng(10)
_A = _RNG.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
_SEAT = _RNG.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles; of the whole sequence if it has fewer words."""
    h = Words(utf8(text).lower()).hashes()  # bytes.lower() changes A-Z only
    if len(h) < WORDS:
        return gram_hashes(h ^ np.uint64(len(h)), len(h)) if len(h) else h
    return np.unique(gram_hashes(h, WORDS))


def minhash(s: np.ndarray) -> np.ndarray:
    out = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(s), 4096):  # bounded memory for very long texts
            np.minimum(out, (np.multiply.outer(s[i : i + 4096], _A) + _B).min(axis=0), out=out)
    return out


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Each (seat, sample) flips one bit, so that equal samples of two documents cancel in the XOR."""
    with np.errstate(over="ignore"):
        bit = mix64(samples ^ _SEAT) % np.uint64(SKETCH_BITS)
    odd = np.bincount(bit.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def set_sketch(s: np.ndarray) -> np.ndarray:
    odd = np.bincount((mix64(s) % np.uint64(64 * SET_WORDS)).astype(np.int64), minlength=64 * SET_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def most_bits(similarity: float) -> int:
    """The number of differing bits that odd sketches of this similarity have on average."""
    return math.ceil(SKETCH_BITS / 2 * (1 - math.exp(-4 * SAMPLES * (1 - similarity) / SKETCH_BITS)))


def _sign(batches):
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        n, digests, bands, sketches, whole = [], [], [], [], []
        for text in texts:
            s = shingles(text.as_py())
            n.append(len(s))
            if not len(s):
                digests.append(None)
                bands.append(None)
                sketches.append(None)
                whole.append(None)
                continue
            m = minhash(s)
            digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            with np.errstate(over="ignore"):
                key = np.arange(BANDS, dtype=np.uint64)
                for row in m.reshape(BANDS, ROWS).T:
                    key = mix64((key ^ row) * _A[0] + _B[0])
            bands.append(key.view(np.int64))
            sketches.append(odd_sketch(m).view(np.int64))
            whole.append(set_sketch(s).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [ids.cast(pa.int64()), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64())), pa.array(whole, pa.list_(pa.int64()))],
            ["id", "n", "digest", "bands", "sketch", "whole"],
        )


def _sets(batches):
    for batch in batches:
        found = [shingles(t.as_py()).tobytes() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(found, pa.binary())], ["id", "shingles"])


def _rarest(batches):
    for batch in batches:
        found = [shingles(t.as_py()).view(np.int64) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(f) for f in found], pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["id", "n", "shingles"])


def _compare(batches):
    """Keeps the pairs with 100 * |intersection| >= 75 * |union| of their full sets."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            p, q = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
            both = len(np.intersect1d(p, q, assume_unique=True))
            keep.append(100 * both >= PERCENT * (len(p) + len(q) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _differ(x: str, y: str) -> Column:
    """Bits that differ, by a fold: sixty-four terms in a row are too long a method for the JVM to compile."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, k: n + k)


def _likely() -> Column:
    """Sketches x, y of samples: the estimate isn't far below the threshold."""
    return _differ("x", "y") <= most_bits(LEAST_ESTIMATE)


def _possible() -> Column:
    """Sets of sizes p and q and sketches v, w: the difference that is seen for certain leaves room for a link.

    |A and B| / |A or B| = (s - m) / (s + m) for s = p + q and the symmetric difference m, of which the bits that
    differ are a lower bound, as are the sizes' difference.
    """
    m = F.greatest(_differ("v", "w").cast("long"), F.abs(F.col("p") - F.col("q")))
    return F.lit(100 + PERCENT) * m <= F.lit(100 - PERCENT) * (F.col("p") + F.col("q"))


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of the ids in the written table (needed)."""
    small = ids.count() <= IDS_BROADCAST
    return docs.join(F.broadcast(ids) if small else ids, F.col("id") == F.col("needed"), "left_semi").select("id", "text")


def _confirm(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of the pairs (a, b), those that hold on full sets. Sets are made again of the texts that some pair names."""
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("needed")).distinct(), "needed")
    sets = map_texts(_texts_of(docs, ids), _sets, "id long, shingles binary")
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    out = cut(both.select("a", "b", "x", "y").mapInArrow(_compare, "a long, b long"), "links")
    forget(ids)
    return out


def _groups(seats: DataFrame) -> DataFrame:
    """(key, n, lead, cross), a written table: of keys whose seats (key, id, comp, short) hold several components, the
    number of seats, the largest component, and the pairs of seats of different components, counted both ways."""
    by = seats.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"), F.bool_or("short").alias("short"))
    all_ = by.groupBy("key").agg(F.sum("c").alias("n"), F.max_by("comp", F.struct("c", "comp")).alias("lead"), (F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))).alias("cross"), F.bool_or("short").alias("short"))
    return cut(all_.where("cross > 0 AND short").drop("short"), "groups")


def _rare_seats(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, id, comp, short): each document of the written table (needed, comp) at its rarest shingles.

    Two sets with |A and B| >= 0.75 |A or B| share one of the |A| - ceil(0.75 |A|) + 1 rarest shingles of the one with one
    of those of the other, whatever the order of rarity; of the smaller set |A| - ceil(6/7 |A|) + 1 will do (`short`),
    as 6/7 of it at least are common. Shingles of one document alone are the rarest and need no seat.
    """
    found = map_texts(_texts_of(docs, wanted.select("needed")), _rarest, "id long, n long, shingles array<long>")
    sets = cut(found.withColumn("set", F.xxhash64("shingles")), "sets")  # rows that repeat an id may have several
    each = sets.select("id", "set", F.explode("shingles").alias("key"))
    common = cut(each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "n", F.col("n").alias("often")), "common")
    own = join_dealt(each, common, "key", F.col("id")).groupBy("id", "set").agg(F.array_sort(F.collect_list(F.struct("often", "key"))).alias("own"))
    size = own.join(sets.select("id", "set", "n").distinct(), ["id", "set"]).join(wanted.select(F.col("needed").alias("id"), "comp"), "id")
    long = F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1
    short = F.col("n") - F.ceil(F.col("n") * (2 * PERCENT) / (100 + PERCENT)) + 1
    alone = F.col("n") - F.size("own")
    size = size.select("id", "comp", alone.alias("alone"), short.alias("least"), F.slice("own", F.lit(1), F.greatest(F.lit(0), long - alone).cast("int")).alias("own"))
    seats = size.select("id", "comp", "alone", "least", F.posexplode("own").alias("at", "s")).select(F.col("s.key").alias("key"), "id", "comp", (F.col("at") + F.col("alone") < F.col("least")).alias("short"))
    out = cut(seats.distinct(), "rare")
    forget(sets, common)
    return out


def _meet(seats: DataFrame, groups: DataFrame, nodes: DataFrame, rare: bool) -> DataFrame:
    """Pairs (a, b) of seats of one key and different components, the smaller set's seat a short one, whose sketches
    leave room for a link.

    Seats of a key's largest component meet those of the others alone. Seats on one side are dealt to places by id, and
    those on the other are repeated for each of them. Sketches are compared inside the join; of `rare` seats, of which
    a document has many, those of samples there and those of whole sets after it.
    """
    places = F.ceil(F.col("members") / DEAL).cast("int")
    sketch = ["sketch"] if rare else ["sketch", "whole"]
    known = join_dealt(seats, groups.withColumn("members", F.col("n")), "key", F.col("id")).join(nodes.select("id", F.col("n").alias("size"), *sketch), "id")
    led = F.col("comp") == F.col("lead")
    one = known.where("short").select("key", led.cast("int").alias("of"), F.explode(F.sequence(F.lit(0), places - 1)).alias("place"), F.col("id").alias("a"), F.col("comp").alias("ca"), F.col("size").alias("p"), *[F.col(c).alias(n) for c, n in zip(sketch, "xv", strict=False)])
    two = known.select(F.col("key").alias("key_"), F.explode(F.when(led, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("of_"), F.pmod(F.xxhash64("id"), places).cast("int").alias("place_"), F.col("id").alias("b"), F.col("comp").alias("cb"), F.col("size").alias("q"), *[F.col(c).alias(n) for c, n in zip(sketch, "yw", strict=False)])
    smaller = (F.col("p") < F.col("q")) | (F.col("p") == F.col("q")) & (F.col("a") < F.col("b"))
    same = (F.col("key") == F.col("key_")) & (F.col("of") == F.col("of_")) & (F.col("place") == F.col("place_"))
    near = F.lit(100) * F.col("p") >= F.lit(PERCENT) * F.col("q")
    met = one.join(two, same & (F.col("ca") != F.col("cb")) & smaller & near & _likely() & (F.lit(True) if rare else _possible()))
    pairs = met.select("a", "b").distinct()
    return _possible_pairs(pairs, nodes).select("a", "b") if rare else pairs


def _possible_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose whole sketches leave room for a link, with these (v, w)."""
    one = nodes.select(F.col("id").alias("a"), F.col("n").alias("p"), F.col("whole").alias("v"))
    two = nodes.select(F.col("id").alias("b"), F.col("n").alias("q"), F.col("whole").alias("w"))
    return pairs.join(one, "a").join(two, "b").where(_possible())


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, components): (id, n, digest) of each document, (digest, component) of each set that isn't empty.

    Documents of one set are one class, named by its smallest id. In each of a few rounds every class that isn't yet
    of one component with a member of its buckets, chosen by hash, is compared with those members, and the likeliest
    pair confirmed; that costs rows in proportion to the seats and joins large groups. Then pairs of a bucket that are
    still of different components are compared by their sketches, inside the join, and those that could be links
    confirmed. Where a bucket holds many components, say those of documents with one long passage in common, its
    documents meet over their rarest shingles instead, which loses no pair: no link between components is lost, and
    pairs inside a component are never listed.

    Shingles are told by 64-bit hashes. Two of a pair of documents of m shingles each collide with a chance of
    m^2 / 2^64, which is 5e-14 for a thousand of them.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = cut(map_texts(docs, _sign, "id long, n long, digest binary, bands array<long>, sketch array<long>, whole array<long>"), "signed")
    classes = signed.where("id IS NOT NULL AND digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("class"))
    named = signed.join(classes.select(F.col("class").alias("c")).distinct(), F.col("id") == F.col("c"), "left_semi").where("digest IS NOT NULL")
    seats = named.select("id", F.explode("bands").alias("band"))
    shared = seats.groupBy("band").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("band")
    seats = cut(seats.join(shared, "band", "left_semi").distinct(), "seats")
    nodes = cut(named.select("id", "n", "sketch", "whole").join(seats.select("id").distinct(), "id", "left_semi"), "nodes")
    found = comp = None

    def open_seats() -> DataFrame:
        """Seats in buckets that hold several components."""
        now = seats.withColumn("comp", F.col("id"))
        if comp is not None:
            now = seats.join(comp, "id", "left").select("band", "id", F.coalesce("component", "id").alias("comp"))
        split = now.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("band")
        return now.join(split, "band", "left_semi")

    def confirmed(pairs: DataFrame) -> DataFrame | None:
        """The links among pairs (a, b)."""
        pairs = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        out = None if pairs.isEmpty() else _confirm(docs, pairs)
        forget(pairs)
        return out

    def add(new: DataFrame) -> None:
        nonlocal found, comp
        both = new if found is None else cut(found.union(new), "links")
        if found is not None:
            forget(found, new)
        old, found, comp = comp, both, components(both)
        forget(old)

    for k in range(ROUNDS):
        now = open_seats()
        lead = now.groupBy("band").agg(F.min_by(F.struct("id", "comp"), F.xxhash64("band", "id", F.lit(k))).alias("lead"))
        met = now.join(lead, "band").where("comp <> lead.comp").select(F.col("id").alias("a"), F.col("lead.id").alias("b")).distinct()
        one, two = nodes.select(F.col("id").alias("a"), F.col("sketch").alias("x")), nodes.select(F.col("id").alias("b"), F.col("sketch").alias("y"))
        close = _possible_pairs(met.join(one, "a").join(two, "b").where(_likely()).select("a", "b"), nodes)
        best = close.groupBy("a").agg(F.min_by("b", F.struct(_differ("v", "w"), "b")).alias("b"))
        if (new := confirmed(best)) is None:
            break
        add(new)
    rest = cut(open_seats().select(F.col("band").alias("key"), "id", "comp", F.lit(True).alias("short")), "open")
    groups = _groups(rest)
    many = F.col("cross") > FEW * F.col("n")
    wanted = cut(rest.join(groups.where(many).select("key"), "key", "left_semi").select(F.col("id").alias("needed"), "comp").distinct(), "wanted")
    pairs = _meet(rest, groups.where(~many), nodes, False)
    if not wanted.isEmpty():
        rare = _rare_seats(docs, wanted)
        pairs = pairs.union(_meet(rare, _groups(rare), nodes, True))
    if (new := confirmed(pairs)) is not None:
        add(new)
    forget(rest, groups, wanted, seats, nodes)
    if comp is None:
        return signed.select("id", "n", "digest"), classes.select(F.col("digest").alias("d"), F.col("class").alias("component"))
    of = classes.join(comp, F.col("class") == F.col("id"), "left").select(F.col("digest").alias("d"), F.coalesce("component", "class").alias("component"))
    return signed.select("id", "n", "digest"), of


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id, kept), one row per row of `docs`.

    Documents without words (null or empty text) have no shingles and are linked with nothing. Rows of null id are
    linked with nothing and stay. Rows that repeat an id are one node: their links count together. An empty table
    gives an empty result; other columns are never read.
    """
    signed, of = links(docs, id_col, text_col)
    out = signed.join(of, F.col("digest") == F.col("d"), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one document of each component, the one of smallest id; all columns kept, whatever their names."""
    (name,) = unused(docs, "__drop")
    drop = assign(docs, id_col, text_col).where(~F.col("kept")).select(F.col(id_col).alias(name)).distinct()
    return docs.join(drop, F.col(id_col) == F.col(name), "left_anti")


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))


def _op10_sql() -> str:
    """Exact, without MinHash: shingle sets, all pairs that share a shingle, and a recursive closure."""
    return rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {WORDS} THEN [array_to_string(words, ' ')]
        ELSE list_distinct(list_transform(generate_series(1, len(words) - {WORDS - 1}), lambda i: array_to_string(words[i:i + {WORDS - 1}], ' '))) END AS sh FROM w),
d AS (SELECT sh, min(doc_id) AS c FROM (SELECT doc_id, list_sort(sh) AS sh FROM s) WHERE len(sh) > 0 GROUP BY 1),
x AS (SELECT c, len(sh) AS n, unnest(sh) AS g FROM d),
p AS (SELECT a.c AS a, b.c AS b FROM x a JOIN x b ON a.g = b.g AND a.c < b.c GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT c AS a, c AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS component FROM r GROUP BY 1),
k AS (SELECT s.doc_id, len(s.sh) AS n, coalesce(m.component, s.doc_id) AS component FROM s LEFT JOIN d ON list_sort(s.sh) = d.sh LEFT JOIN m ON m.a = d.c)
SELECT doc_id, n::BIGINT AS n_shingles, component AS component_id, doc_id = component AS kept FROM k
"""


OP10_SQL = _op10_sql()
