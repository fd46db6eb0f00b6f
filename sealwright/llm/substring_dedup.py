"""Substring dedup by super-k-mer partitioning over words."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, cut, forget, gram_hashes, join_dealt, map_texts, sliding_min, table, utf8

#: Words of a window, and of the grams whose smallest hash is the window's minimiser.
WINDOW, GRAM = 50, 8
#: A run of windows that share a minimiser is split after so many windows, as text may repeat itself without end.
MOST_WINDOWS = 64
#: A task sorts buckets of so many distinct super-k-mers and bytes of them. Larger ones are sorted by all tasks: their
#: windows, dealt by content.
MOST_IN_BUCKET, MOST_BYTES = 4096, 2 << 20


def runs(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and minimiser of each super-k-mer of a text."""
    if words.n < WINDOW:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    low = sliding_min(gram_hashes(words.hashes(), GRAM), WINDOW - GRAM + 1)
    first = np.concatenate(([0], np.flatnonzero(low[1:] != low[:-1]) + 1))
    size = np.diff(np.append(first, len(low)))
    if size.max() > MOST_WINDOWS:
        pieces = -(-size // MOST_WINDOWS)
        within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = np.repeat(first, pieces) + within * MOST_WINDOWS
        size = np.diff(np.append(first, len(low)))
    return first, size, low[first].view(np.int64)


class Packed:
    """The words of a text joined by one space, to be sliced by word positions."""

    def __init__(self, words: Words):
        self.text = b" ".join([words.data[s:e] for s, e in zip(words.start.tolist(), words.end.tolist(), strict=True)])
        size = words.end - words.start
        self.end = np.cumsum(size + 1) - 1
        self.start = self.end - size

    def of(self, first: int, n: int) -> bytes:
        return self.text[self.start[first] : self.end[first + n - 1]]


def _minimisers(batches):
    for batch in batches:
        ids, minis = [], []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found = np.unique(runs(Words(utf8(text.as_py())))[2])
            ids.append(np.full(len(found), i, np.int64))
            minis.append(found)
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(minis)), pa.array(np.concatenate(ids))], ["mini", "id"])


def _super_kmers(batches):
    """Of (id, text, shared minimisers): the super-k-mers in buckets that some other document shares."""
    for batch in batches:
        out = [[], [], [], [], [], []]
        for i, text, shared in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            words = Words(utf8(text.as_py()))
            first, size, mini = runs(words)
            hit = np.isin(mini, shared.values.to_numpy(zero_copy_only=False))
            if not hit.any():
                continue
            packed = Packed(words)
            for f, n, m in zip(first[hit].tolist(), size[hit].tolist(), mini[hit].tolist(), strict=True):
                body = packed.of(f, n + WINDOW - 1)
                for column, x in zip(out, (hashlib.blake2b(body, digest_size=16).digest(), m, i, f, n, body), strict=True):
                    column.append(x)
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["digest", "mini", "id", "first", "n", "packed"])


def _windows(packed: bytes) -> list[bytes]:
    ends = [i for i, c in enumerate(packed) if c == 32]
    starts = [0, *[i + 1 for i in ends]]
    ends.append(len(packed))
    return [packed[a:b] for a, b in zip(starts, ends[WINDOW - 1 :], strict=False)]


def _count_bucket(rows: list[tuple[bytes, int, bytes]]) -> dict[bytes, list[int]]:
    """Sorts the windows of a bucket's super-k-mers; those that an earlier document holds too, by digest."""
    each = sorted((w, low, digest, at) for digest, low, packed in rows for at, w in enumerate(_windows(packed)))
    found: dict[bytes, list[int]] = {}
    last, first = None, 0
    for w, low, digest, at in each:
        if w != last:
            last, first = w, low
        elif low > first:
            found.setdefault(digest, []).append(at)
    return found


def _buckets(batches):
    """Rows (mini, digest, low, packed) come sorted by mini; a bucket may go on in the next batch."""
    schema = pa.schema([("digest", pa.binary()), ("found", pa.list_(pa.int32()))])
    mini, rows = None, []

    def told():
        found = _count_bucket(rows)
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.list_(pa.int32()))], schema=schema)

    for batch in batches:
        for m, digest, low, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if m != mini:
                if len(rows) > 1:
                    yield told()
                mini, rows = m, []
            rows.append((digest, low, packed))
    if len(rows) > 1:
        yield told()


def _single_hashes(batches):
    for batch in batches:
        out = [[], [], [], []]
        for digest, low, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            h = gram_hashes(Words(packed).hashes(), WINDOW).view(np.int64).tolist()
            for column, x in zip(out, ([digest] * len(h), [low] * len(h), range(len(h)), h), strict=True):
                column.extend(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.binary(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["digest", "low", "at", "hash"])


def _single_windows(batches):
    for batch in batches:
        out = [[], [], [], []]
        for digest, low, packed, ats in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            each = _windows(packed)
            for at in ats:
                for column, x in zip(out, (digest, low, at, each[at]), strict=True):
                    column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.binary(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["digest", "low", "at", "window"])


def _strip(batches):
    for batch in batches:
        n_words, n_removed, kept = [], [], []
        for text, ranges in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            words = Words(utf8(text.as_py()))
            stay = np.ones(words.n, bool)
            for x in ranges or ():
                stay[x["first"] : x["past"]] = False
            n_words.append(words.n)
            n_removed.append(int(words.n - stay.sum()))
            kept.append(b" ".join([words.data[s:e] for s, e in zip(words.start[stay].tolist(), words.end[stay].tolist(), strict=True)]).decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept"])


def repeated(docs: DataFrame) -> DataFrame:
    """(rid, ranges): word ranges of documents (id, text) that windows of documents of smaller id cover too."""
    docs = docs.where("id IS NOT NULL")
    minis = cut(map_texts(docs, _minimisers, "mini long, id long"), "minimisers")
    shared = minis.groupBy("mini").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("mini")
    wanted = minis.join(shared, "mini", "left_semi").groupBy(F.col("id").alias("wid")).agg(F.collect_set("mini").alias("minis"))
    found = docs.join(wanted, F.col("id") == F.col("wid")).select("id", "text", "minis")
    kmers = cut(map_texts(found, _super_kmers, "digest binary, mini long, id long, first int, n int, packed binary"), "superkmers")
    forget(minis)
    # equal super-k-mers are one row: the content is a grouping key beside its digest
    distinct = cut(kmers.groupBy("digest", "mini", "packed").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("holders")), "distinct")
    sizes = distinct.groupBy("mini").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("packed")).alias("bytes")).where("n > 1")
    sizes = cut(sizes.withColumn("fits", (F.col("n") <= MOST_IN_BUCKET) & (F.col("bytes") <= MOST_BYTES)), "buckets")
    sized = join_dealt(distinct.select("digest", "mini", "packed", "low"), sizes, "mini", F.col("digest"))
    bucket = sized.where("fits").select("mini", "digest", "low", "packed").repartition("mini").sortWithinPartitions("mini")
    cold = bucket.mapInArrow(_buckets, "digest binary, found array<int>")
    # written, as each is read several times: otherwise every reading meets all super-k-mers with their buckets again
    large = cut(sized.where("NOT fits").select("digest", "low", "packed"), "large")
    hashes = cut(large.mapInArrow(_single_hashes, "digest binary, low long, at int, hash long"), "hashes")
    twice = hashes.groupBy("hash").agg(F.min("low").alias("lo"), F.max("low").alias("hi")).where("lo < hi").select("hash")
    ats = hashes.join(twice, "hash", "left_semi").groupBy(F.col("digest").alias("d")).agg(F.collect_list("at").alias("ats"))
    single = large.join(ats, F.col("digest") == F.col("d")).select("digest", "low", "packed", "ats").mapInArrow(_single_windows, "digest binary, low long, at int, window binary")
    least = single.groupBy(F.col("window").alias("w")).agg(F.min("low").alias("least"))
    hot = single.join(least, F.col("window") == F.col("w")).where("low > least").groupBy("digest").agg(F.collect_list("at").alias("found"))
    told = cold.union(hot).select(F.col("digest").alias("td"), "found")
    known = cut(distinct.select("digest", "low", F.col("holders").alias("n")).join(told, F.col("digest") == F.col("td"), "left").select("digest", "low", "found", "n"), "known")
    forget(distinct, sizes, large, hashes)
    spans = join_dealt(kmers.select("digest", "id", "first", F.col("n").alias("windows")), known, "digest", F.col("id")).where("id > low OR found IS NOT NULL")
    window = lambda a, b: F.struct(a.alias("first"), b.alias("past"))
    ranges = F.when(F.col("id") > F.col("low"), F.array(window(F.col("first"), F.col("first") + F.col("windows") + WINDOW - 1))).otherwise(
        F.transform("found", lambda at: window(F.col("first") + at, F.col("first") + at + WINDOW))
    )
    return spans.groupBy(F.col("id").alias("rid")).agg(F.flatten(F.collect_list(ranges)).alias("ranges"))


def strip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_removed, kept): the text without words in a 50-word window of a document of smaller id.

    Consecutive windows that share a minimiser travel as one string of words, a super-k-mer, to the minimiser's
    bucket, where sorting finds equal windows exactly. Minimisers of one document alone travel only as numbers. Equal
    super-k-mers are merged before they meet in a bucket, so a group of copies is one row there. Buckets that are
    still too large for a task are sorted as single windows by all tasks, by content, after those whose hash no other
    document has are left out; the windows found are the same.
    Null text counts as empty; rows of null id keep all words; rows that repeat an id must repeat its text; texts of
    fewer than 50 words stay whole; an empty table gives an empty one; other columns are never read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    gone = repeated(docs)
    out = map_texts(docs.join(gone, F.col("id") == F.col("rid"), "left").select("id", "text", "ranges"), _strip, "id long, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("id", id_col)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = strip(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP1_SQL = rf"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT doc_id, unnest(generate_series(1, len(ws))) AS i, unnest(ws) AS word, ws FROM t),
k AS (SELECT doc_id, i, word, CASE WHEN i + {WINDOW - 1} <= len(ws) THEN array_to_string(ws[i:i + {WINDOW - 1}], ' ') END AS win FROM w),
f AS (SELECT doc_id, i, word, win IS NOT NULL AND min(doc_id) OVER (PARTITION BY win) < doc_id AS dup FROM k),
c AS (SELECT doc_id, i, word, bool_or(dup) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone FROM f),
a AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE gone) AS r, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '')) AS h FROM c GROUP BY 1)
SELECT t.doc_id, coalesce(n, 0) AS n_words, coalesce(r, 0) AS n_removed, coalesce(h, sha256('')) AS kept_sha256 FROM t LEFT JOIN a USING (doc_id)
"""
