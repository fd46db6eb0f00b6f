"""Embedding near-dedup over a robust-pruned flat graph."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, forget, map_texts, table

LEAST_COSINE = 0.9
#: Centres are fitted on so many rows, those of smallest hash; there is one for CLUSTER rows. Where these would be more
#: than MOST_CENTRES, each of so many centres is split into finer ones, which tasks fit on as many of its own rows.
SAMPLE, CLUSTER, MOST_CENTRES, ROUNDS = 20_000, 1500, 2000, 8
#: Clusters that a vector belongs to; doubled until the audit is content.
OVERLAP, MOST_OVERLAP = 3, 12
#: A larger cluster is dealt into blocks of about so many rows, each with a graph of its own; any two of them meet.
BLOCK = 3000
#: Robust pruning: nearest rows considered, edges kept, and how much nearer a kept edge must be to rule another out.
POOL, DEGREE, ALPHA = 64, 24, 1.2
#: Nearest rows that stay beside the pruned edges, so that a clump of near copies stays connected.
NEAREST = 6
#: Width of the greedy search, and how far below the threshold a row may be for the range search to go on from it.
BEAM, SLACK = 32, 0.05
#: Queries searched at once in a task, which bounds its memory.
AT_ONCE = 128
#: The audit compares so many queries with all rows, half of them rows with links, and asks for so much recall.
AUDIT_QUERIES, LEAST_RECALL = 200, 0.95

FOUND = "rid long, n long, other long"


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _stack(column) -> np.ndarray:
    return np.array([np.asarray(x, np.float64) for x in column], np.float64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The rows of a list column of that many doubles each."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), width)


def distinct_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(embedding, rid, copies): one row per distinct usable vector; equal vectors are linked without any search."""
    usable = F.col(vector_col).isNotNull() & ~F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vector_col, lambda x: x != 0)
    rows = vectors.where(usable & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    return rows.groupBy("embedding").agg(F.min("id").alias("rid"), F.count(F.lit(1)).alias("copies"))


def kmeans(sample: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means over unit vectors, from evenly spaced rows of the sample."""
    at = sample[np.linspace(0, len(sample) - 1, k).astype(int)]
    for _ in range(ROUNDS):
        near = np.concatenate([(sample[i : i + 2000] @ at.T).argmax(axis=1) for i in range(0, len(sample), 2000)])
        total = np.zeros_like(at)
        np.add.at(total, near, sample)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        at = np.where(size > 0, total / np.where(size > 0, size, 1), at)
    return at


def centres(rows: DataFrame, n: int, width: int) -> np.ndarray:
    """Centres of a bounded sample, on the driver."""
    taken = rows.select("embedding").orderBy(F.xxhash64("rid")).limit(SAMPLE).toArrow().column(0).combine_chunks()
    sample = _unit(_matrix(taken, width))
    return kmeans(sample, min(MOST_CENTRES, len(sample), max(1, n // CLUSTER)))


def _nearest(own: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The k nearest centres of each row, the nearest first."""
    sims = own @ at.T
    top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(sims, top, 1), axis=1, kind="stable"), 1)


def _assign(at: np.ndarray, overlap: int, batches):
    """Rows (rid, embedding, copies) once for each of their clusters; `place` 0 is the nearest."""
    for batch in batches:
        k, n = min(overlap, len(at)), batch.num_rows
        near = _nearest(_unit(_matrix(batch.column(1), at.shape[1])), at, k) if n else np.empty((0, k), int)
        rows = pa.array(np.repeat(np.arange(n), k))
        yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in batch.columns), pa.array(near.ravel().astype(np.int64)), pa.array(np.tile(np.arange(k, dtype=np.int32), n))], ["rid", "embedding", "copies", "cluster", "place"])


MEMBER = "rid long, embedding array<double>, copies long, cluster long, place int"


def _split(own: pd.DataFrame) -> pd.DataFrame:
    """Finer centres of one cluster's sample; `parts` says how many it should have."""
    sample = _unit(_stack(own["embedding"]))
    fine = kmeans(sample, min(len(sample), int(own["parts"].iloc[0])))
    return pd.DataFrame({"of": own["cluster"].iloc[0], "centre": list(fine)})


def _finer(overlap: int, own: pd.DataFrame, fine: pd.DataFrame) -> pd.DataFrame:
    """A cluster's rows in its finer clusters: in `overlap` of their nearest cluster, in one of each other cluster."""
    none = pd.DataFrame({"rid": [], "embedding": [], "copies": [], "cluster": [], "place": []})
    if not len(own) or not len(fine):
        return none
    at = np.stack(fine["centre"].to_numpy())
    k = min(overlap, len(at))
    near = _nearest(_unit(_stack(own["embedding"])), at, k)
    taken = (np.arange(k)[None, :] == 0) | (own["place"].to_numpy() == 0)[:, None]
    rows, place = np.nonzero(taken)
    out = own.iloc[rows]
    return pd.DataFrame({"rid": out["rid"].to_numpy(), "embedding": out["embedding"].to_numpy(), "copies": out["copies"].to_numpy(), "cluster": (out["cluster"].to_numpy() << 32) + near[rows, place], "place": out["place"].to_numpy() + place})


def members(rows: DataFrame, at: np.ndarray, overlap: int, n: int) -> DataFrame:
    """(rid, embedding, copies, cluster, place), a written table: each row in its clusters, which stay small as rows grow."""
    member = cut(map_texts(rows.select("rid", "embedding", "copies"), partial(_assign, at, overlap), MEMBER), "members")
    if n // CLUSTER <= MOST_CENTRES:
        return member
    sizes = member.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))  # MOST_CENTRES rows at most
    sizes = F.broadcast(cut(sizes.select("cluster", "size", F.ceil(F.col("size") / (CLUSTER * overlap)).alias("parts"), F.ceil(F.col("size") / SAMPLE).cast("int").alias("places")), "sizes"))
    dealt = member.join(sizes, "cluster")
    chance = F.pmod(F.xxhash64("rid", F.lit("sample")), F.lit(1 << 20)) * F.col("size") < F.lit(SAMPLE << 20)
    fine = cut(dealt.where(chance).groupBy("cluster").applyInPandas(_split, "of long, centre array<double>"), "centres")
    own = dealt.withColumn("at", F.pmod(F.xxhash64("rid"), F.col("places")).cast("int"))
    fine = fine.join(sizes, F.col("of") == F.col("cluster")).select("of", "centre", F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("to"))
    out = cut(own.select("cluster", "at", "rid", "embedding", "copies", "place").groupBy("cluster", "at").cogroup(fine.groupBy("of", "to")).applyInPandas(partial(_finer, overlap), MEMBER), "members")
    forget(member)
    return out


def robust_prune(own: np.ndarray) -> np.ndarray:
    """Edges [n, DEGREE] (-1: none) of rows of unit vectors: of the nearest rows, those that no kept one rules out."""
    n = len(own)
    pool = min(POOL, n - 1)
    near = np.empty((n, pool), np.int64)
    for i in range(0, n, 512):
        s = own[i : i + 512] @ own.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        top = np.argpartition(-s, pool - 1, axis=1)[:, :pool] if pool else np.empty((len(s), 0), int)
        near[i : i + 512] = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)
    edges = np.full((n, DEGREE), -1, np.int64)
    for i in range(0, n, 256):
        mine = near[i : i + 256]
        away = 1 - np.einsum("npd,nd->np", own[mine], own[i : i + 256])
        open_ = np.ones_like(mine, bool)
        rows = np.arange(len(mine))
        for d in range(DEGREE):
            some = open_.any(axis=1)
            if not some.any():
                break
            pick = open_.argmax(axis=1)  # the nearest that is left
            kept = mine[rows, pick]
            edges[i : i + 256, d] = np.where(some, kept, -1)
            between = 1 - np.einsum("npd,nd->np", own[mine], own[kept])
            open_ &= ALPHA * between > away
            open_[rows, pick] = False
    return np.concatenate([edges, near[:, :NEAREST], np.full((n, max(0, NEAREST - pool)), -1)], axis=1)


def _build(shard: pd.DataFrame) -> pd.DataFrame:
    ids, cluster = shard["rid"].to_numpy(), shard["cluster"].iloc[0]
    if len(ids) < 2:
        return pd.DataFrame({"rid": ids, "edges": [[] for _ in ids], "cluster": cluster})
    edges = robust_prune(_unit(_stack(shard["embedding"])))
    return pd.DataFrame({"rid": ids, "edges": [ids[np.unique(e[e >= 0])].tolist() for e in edges], "cluster": cluster})


def graph_search(own: np.ndarray, edges: np.ndarray, queries: np.ndarray, least: float, known: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, row) of rows with a cosine of about `least` or more: greedy from the medoid, and from the rows that each
    query knows (-1: none), then outwards in range; a pair of arrays for every AT_ONCE queries."""
    n, total = len(own), len(queries)
    mean = own.mean(axis=0)
    starts = np.unique(np.concatenate(([int((own @ mean).argmax())], np.linspace(0, n - 1, min(n, 8)).astype(int))))
    for first in range(0, total, AT_ONCE):
        q = queries[first : first + AT_ONCE]
        m = len(q)
        rows = np.arange(m)[:, None]
        sims = np.full((m, n), -np.inf)
        sims[:, starts] = q @ own[starts].T
        seen = np.zeros((m, n), bool)
        seen[:, starts] = True
        if known is not None:
            qi, at = np.nonzero(known[first : first + m] >= 0)
            at = known[first + qi, at]
            seen[qi, at] = True
            sims[qi, at] = np.einsum("ij,ij->i", q[qi], own[at])
        spent = np.zeros((m, n), bool)
        width = min(BEAM, n)
        while True:
            beam = np.argpartition(-sims, width - 1, axis=1)[:, :width]
            waiting = ~spent[rows, beam] & (sims[rows, beam] > -np.inf)
            if not waiting.any():
                break
            order = np.argsort(np.where(waiting, -sims[rows, beam], np.inf), axis=1, kind="stable")[:, :4]
            next_, real = np.take_along_axis(beam, order, 1), np.take_along_axis(waiting, order, 1)
            qi, at = np.nonzero(real)
            _visit(q, own, edges, qi, next_[qi, at], sims, seen, spent)
        while True:  # the range search goes on from all that lie in range
            qi, at = np.nonzero((sims >= least - SLACK) & ~spent)
            if not len(qi):
                break
            for i in range(0, len(qi), 20_000):
                _visit(q, own, edges, qi[i : i + 20_000], at[i : i + 20_000], sims, seen, spent)
        qi, at = np.nonzero(sims >= least - 1e-6)
        yield qi + first, at


def _visit(q, own, edges, qi, at, sims, seen, spent) -> None:
    spent[qi, at] = True
    to = edges[at]
    qs, rs = np.repeat(qi, to.shape[1]), to.ravel()
    new = rs >= 0
    qs, rs = qs[new], rs[new]
    new = ~seen[qs, rs]
    qs, rs = qs[new], rs[new]
    seen[qs, rs] = True
    sims[qs, rs] = np.einsum("ij,ij->i", q[qs], own[rs])


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))


def _verify(near: np.ndarray, x: np.ndarray, x_ids: np.ndarray, y: np.ndarray, y_ids: np.ndarray, least: float) -> np.ndarray:
    """Of the pairs that `near` marks, those of other rows with a cosine of `least` or more in double precision."""
    out = np.zeros_like(near)
    for first in range(0, len(x), AT_ONCE):
        i, j = np.nonzero(near[first : first + AT_ONCE])
        i += first
        keep = x_ids[i] != y_ids[j]
        i, j = i[keep], j[keep]
        swap = (x_ids[i] > y_ids[j])[:, None]  # the same order of operands, whichever was the query
        p, q = np.where(swap, y[j], x[i]), np.where(swap, x[i], y[j])
        good = cosine(p, q) >= least
        out[i[good], j[good]] = True
    return out


def _span(links: np.ndarray, x_ids: np.ndarray, y_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that tie together what the links of two sides tie together, one for each node but one of a component."""
    a, b = [], []
    fresh_x, fresh_y = links.any(axis=1), links.any(axis=0)
    while fresh_x.any():
        edge = np.array([int(fresh_x.argmax())])
        root = x_ids[edge[0]]
        fresh_x[edge] = False
        while len(edge):
            over = np.flatnonzero(links[edge].any(axis=0) & fresh_y)
            fresh_y[over] = False
            edge = np.flatnonzero(links[:, over].any(axis=1) & fresh_x)
            fresh_x[edge] = False
            for found in (y_ids[over], x_ids[edge]):
                found = found[found != root]
                a.append(np.full(len(found), root))
                b.append(found)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64), np.empty(0, np.int64))


def _told(links: np.ndarray, x: pd.DataFrame, y: pd.DataFrame, one: bool) -> pd.DataFrame:
    """FOUND rows: each node's number of links, and pairs that span the links. `one`: both sides are the same rows."""
    x_ids, y_ids = x["rid"].to_numpy(), y["rid"].to_numpy()
    counted = [(x_ids, links @ y["copies"].to_numpy())] + ([] if one else [(y_ids, links.T @ x["copies"].to_numpy())])
    ids, n = (np.concatenate([c[k] for c in counted]) for k in (0, 1))
    a, b = _span(links, x_ids, y_ids)
    some = n > 0
    return pd.DataFrame({"rid": np.concatenate([ids[some], a]), "n": pd.array(np.concatenate([n[some], np.zeros(len(a), np.int64)]), "Int64"), "other": pd.array([None] * int(some.sum()) + b.tolist(), "Int64")})


def _edges(of: pd.DataFrame, to: pd.DataFrame) -> np.ndarray:
    """The lists of `of` as places in `to`; -1 where the other end is in another shard."""
    place = pd.Index(to["rid"].to_numpy())
    lists = [place.get_indexer(np.asarray(e, np.int64)) if len(e) else np.empty(0, np.int64) for e in of["edges"]]
    edges = np.full((len(of), max(1, max(map(len, lists)))), -1, np.int64)
    for k, e in enumerate(lists):
        edges[k, : len(e)] = e
    return edges


def _first_shared(x: pd.DataFrame, y: pd.DataFrame, cluster: int) -> np.ndarray:
    """Whether the two share no cluster before this one: a pair is decided in one cluster alone, and so counted once."""
    out = np.ones((len(x), len(y)), bool)
    width = max(max(map(len, x["homes"])), max(map(len, y["homes"])))
    low = lambda side, none: np.array([[*[h for h in own if h < cluster], *[none] * width][:width] for own in side["homes"]])
    p, q = low(x, -1), low(y, -2)
    for k in range(width):
        mine = p[:, k]
        if (mine >= 0).any():
            for m in range(width):
                if (q[:, m] >= 0).any():
                    out &= mine[:, None] != q[:, m][None, :]
    return out


def _search(least: float, key: tuple, both: pd.DataFrame) -> pd.DataFrame:
    """FOUND rows of the links between two blocks of a cluster, or within one: each side's rows are queries in the
    other's graph, and what either finds is verified."""
    cluster, a, b = (int(k) for k in key)
    x = both[both["block"] == a]
    y = x if a == b else both[both["block"] == b]
    if not len(x) or not len(y):
        return pd.DataFrame({"rid": pd.Series([], dtype="int64"), "n": pd.array([], "Int64"), "other": pd.array([], "Int64")})
    raw_x = _stack(x["embedding"])
    raw_y = raw_x if a == b else _stack(y["embedding"])
    unit_x, unit_y = _unit(raw_x), _unit(raw_y)
    near = np.zeros((len(x), len(y)), bool)
    # a query knows itself, if it is a row of the shard, and the rows of the shard in its lists from all shards
    known = np.arange(len(x))[:, None] if a == b else _edges(x, y)
    for i, j in graph_search(unit_y, _edges(y, y), unit_x, least, known):
        near[i, j] = True
    if a == b:
        near |= near.T
    else:
        for j, i in graph_search(unit_x, _edges(x, x), unit_y, least, _edges(y, x)):
            near[i, j] = True
    near &= _first_shared(x, y, cluster)
    return _told(_verify(near, raw_x, x["rid"].to_numpy(), raw_y, y["rid"].to_numpy(), least), x, y, a == b)


def search(rows: DataFrame, at: np.ndarray, overlap: int, n: int, least: float) -> DataFrame:
    """FOUND rows, a written table: each vector's links (n) by cluster, and pairs (rid, other) that span the links."""
    member = members(rows, at, overlap, n)
    sizes = member.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    few = n // CLUSTER <= MOST_CENTRES  # then there are as few clusters
    written = member
    member = member.join(F.broadcast(sizes) if few else sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    lists = member.select("cluster", "block", "rid", "embedding").groupBy("cluster", "block").applyInPandas(_build, "rid long, edges array<long>, cluster long")
    # The union of the shards' lists, beside the shards' own names.
    graph = cut(lists.groupBy("rid").agg(F.array_distinct(F.flatten(F.collect_list("edges"))).alias("edges"), F.collect_set("cluster").alias("homes")), "graph")
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("block", k).alias("a"), F.greatest("block", k).alias("b")))
    nodes = member.join(graph, "rid").select("cluster", "block", "rid", "embedding", "copies", "edges", "homes", F.explode(meets).alias("m")).select("*", "m.a", "m.b").drop("m")
    found = cut(nodes.groupBy("cluster", "a", "b").applyInPandas(lambda key, own: _search(least, key, own), FOUND), "found")
    forget(written, graph)
    return found


def links_of(found: DataFrame) -> DataFrame:
    """(a, far): the number of links of each vector that has any, copies counted."""
    return found.where("other IS NULL").groupBy(F.col("rid").alias("a")).agg(F.sum("n").alias("far"))


def _angles(at: np.ndarray, batches):
    for batch in batches:
        sims = _unit(_matrix(batch.column(1), at.shape[1])) @ at.T if batch.num_rows else np.empty((0, len(at)))
        near = sims.argmax(axis=1) if batch.num_rows else np.empty(0, int)
        far = np.arccos(np.clip(sims.max(axis=1), -1, 1)) if batch.num_rows else np.empty(0)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int64)), pa.array(far)], ["rid", "embedding", "copies", "cluster", "angle"])


def _asking(at: np.ndarray, radius: np.ndarray, batches):
    """Each row once for every cluster whose radius and the link's angle together reach it: by the triangle inequality of
    angles, no other cluster holds a row that it could be linked with."""
    for batch in batches:
        n = batch.num_rows
        away = np.arccos(np.clip(_unit(_matrix(batch.column(1), at.shape[1])) @ at.T, -1, 1)) if n else np.empty((0, len(at)))
        rows, to = np.nonzero(away <= radius[None, :] + 1e-6)
        yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows)) for c in batch.columns), pa.array(to.astype(np.int64))], ["rid", "embedding", "copies", "of"])


def _compare(least: float, own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    if not len(own) or not len(asked):
        return pd.DataFrame({"rid": pd.Series([], dtype="int64"), "n": pd.array([], "Int64"), "other": pd.array([], "Int64")})
    x, y = _stack(asked["embedding"]), _stack(own["embedding"])
    links = _verify(_unit(x) @ _unit(y).T >= least - 1e-9, x, asked["rid"].to_numpy(), y, own["rid"].to_numpy(), least)
    return _told(links, asked, own, True)  # the other side asks too, elsewhere


def exact_search(rows: DataFrame, at: np.ndarray, least: float) -> DataFrame:
    """FOUND rows, a written table, without a graph: every row against the rows of each cluster that may hold a link."""
    home = cut(map_texts(rows.select("rid", "embedding", "copies"), partial(_angles, at), "rid long, embedding array<double>, copies long, cluster long, angle double"), "homes")
    facts = home.groupBy("cluster").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("size")).collect()  # MOST_CENTRES rows at most
    radius, blocks = np.full(len(at), -np.inf), np.ones(len(at), int)
    for cluster, far, size in facts:
        radius[cluster], blocks[cluster] = far + np.arccos(least), -(-size // BLOCK)
    asking = cut(map_texts(rows.select("rid", "embedding", "copies"), partial(_asking, at, radius), "rid long, embedding array<double>, copies long, of long"), "asking")
    asks = np.ones(len(at), int)
    for of, size in asking.groupBy("of").count().collect():
        asks[of] = -(-size // BLOCK)
    number = lambda counts, key: F.array(*[F.lit(int(c)) for c in counts])[F.col(key).cast("int")]
    deal = lambda df, own, key, others: df.withColumn("block", F.pmod(F.xxhash64("rid"), number(own, key)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), number(others, key) - 1)))
    mine, theirs = deal(home, blocks, "cluster", asks).groupBy("cluster", "block", "other"), deal(asking, asks, "of", blocks).groupBy("of", "other", "block")
    found = cut(mine.cogroup(theirs).applyInPandas(partial(_compare, least), FOUND), "found")
    forget(home, asking)
    return found


def _brute(ids: np.ndarray, queries: np.ndarray, least: float, batches):
    for batch in batches:
        near = _unit(queries) @ _unit(_matrix(batch.column(1), queries.shape[1])).T >= least + 1e-9 if batch.num_rows else np.zeros((len(ids), 0), bool)
        near &= ids[:, None] != batch.column(0).to_numpy()[None, :]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(near @ batch.column(2).to_numpy())], ["query", "total"])


def audit(rows: DataFrame, found: DataFrame, least: float = LEAST_COSINE, n: int = AUDIT_QUERIES) -> float:
    """Recall of the links of n queries against a comparison of them with all rows: the lower of that of all links and
    of the mean over the queries with links, so that a few queries of many links hide nothing. Half of the queries are
    the rows of smallest hash, the others those among the rows with links."""
    far = links_of(found)
    order = F.xxhash64("rid", F.lit("audit"))
    pick = lambda df, k: df.select("rid", "embedding").orderBy(order).limit(k).collect()
    linked = pick(rows.join(far.select(F.col("a").alias("rid")), "rid", "left_semi"), n // 2)
    asked = {r[0]: r[1] for r in [*linked, *pick(rows, n - n // 2)]}
    if not asked:
        return 1.0
    ids, queries = np.array(list(asked), np.int64), _stack(asked.values())
    true = map_texts(rows.select("rid", "embedding", "copies"), partial(_brute, ids, queries, least), "query long, total long").groupBy("query").agg(F.sum("total").alias("total")).where("total > 0")
    each = true.join(far, F.col("query") == F.col("a"), "left").withColumn("got", F.least(F.coalesce("far", F.lit(0)), F.col("total")))
    total, got, mean = each.agg(F.sum("total"), F.sum("got"), F.avg(F.col("got") / F.col("total"))).first()
    return min(got / total, mean) if total else 1.0


def links(rows: DataFrame, width: int, least: float) -> DataFrame:
    """FOUND rows of vectors of one length: by the graph, with more overlap until the audit is content, else exactly."""
    n = rows.count()
    at = centres(rows, n, width)
    overlap = OVERLAP
    while overlap <= MOST_OVERLAP:
        found = search(rows, at, overlap, n, least)
        if audit(rows, found, least) >= LEAST_RECALL:
            return found
        forget(found)
        overlap *= 2
    return exact_search(rows, at, least)


def assign(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = LEAST_COSINE) -> DataFrame:
    """(id_col, n_links, component_id, kept), one row per row of `vectors`.

    Rows with the same vector are one node and linked with each other. Nodes are searched in overlapping clusters'
    graphs; a pair is decided in the first cluster that both are in, where each is a query in the other's graph, and
    verified in double precision, so that a task gives out counts and pairs that span its links, but no list of links.
    An audit compares a few queries with all rows and doubles the overlap until its recall is LEAST_RECALL; below that
    at MOST_OVERLAP all rows are compared exactly, but for clusters that the triangle inequality rules out. Vectors of
    several lengths are searched apart. Rows whose vector is null, zero or holds null or non-finite components are
    linked with nothing, as are rows of null id (component null, kept). Rows that repeat an id are nodes of that id. An
    empty table gives an empty one; other columns are never read.
    """
    rows = cut(distinct_vectors(vectors, id_col, vector_col), "vectors")
    found = rows.sparkSession.createDataFrame([], FOUND)
    for (width,) in sorted(rows.select(F.size("embedding")).distinct().collect()):
        found = found.union(links(rows.where(F.size("embedding") == width), width, least))
    far = links_of(found)
    comp = components(found.where("other IS NOT NULL").select(F.col("rid").alias("a"), F.col("other").alias("b")))
    node = rows.join(far, F.col("rid") == F.col("a"), "left").join(comp, F.col("rid") == F.col("id"), "left")
    node = node.select(F.col("embedding").alias("e"), (F.col("copies") - 1 + F.coalesce("far", F.lit(0))).alias("n"), F.coalesce("component", "rid").alias("component"))
    rows_in = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    out = rows_in.join(node, (F.col("embedding") == F.col("e")) & F.col("id").isNotNull(), "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "embeddings"))


OP4_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= {LEAST_COSINE}::DOUBLE),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
m AS (SELECT a, min(b) AS c FROM r GROUP BY 1),
l AS (SELECT a, count(*) AS n FROM p GROUP BY 1)
SELECT v.vec_id, coalesce(l.n, 0) AS n_links, m.c AS component_id, m.c = v.vec_id AS kept FROM v JOIN m ON m.a = v.vec_id LEFT JOIN l ON l.a = v.vec_id
"""
