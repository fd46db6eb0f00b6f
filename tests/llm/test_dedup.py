"""Exact, near, line and substring dedup against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sealwright.llm import exact_dedup, line_dedup, minhash, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def clashing(df):
    """The same rows with columns named as the operators name theirs."""
    return df.withColumns({c: F.lit("clash") for c in ("id", "digest", "content", "n", "a", "b", "component", "d", "chunks", "rid", "ranges", "key", "salt", "kept")})


def test_exact(docs, corpus):
    groups = defaultdict(list)
    for i, t, *_ in corpus:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    got = {r.doc_id: r for r in exact_dedup.assign(clashing(docs)).collect()}
    assert len(got) == len(corpus)
    for text, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (min(ids), len(ids), i == min(ids), hashlib.sha256(text.encode()).hexdigest())
    kept = exact_dedup.dedup(clashing(docs))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(min(v) for v in groups.values())
    assert kept.first()["digest"] == "clash"


def test_exact_odd_rows(spark, no_docs):
    assert exact_dedup.assign(no_docs).collect() == []
    rows = spark.createDataFrame([(None, "a"), (None, "a"), (5, "a"), (5, "a"), (None, "b")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in exact_dedup.assign(rows).collect())
    assert got == [(0, 0, 1, True), (0, 5, 4, False), (0, 5, 4, False), (5, 5, 4, True), (5, 5, 4, True)]


def test_exact_keeps_one_row_a_text(spark, no_docs):
    odd = [(None, "a"), (None, "a"), (5, "a"), (5, "a"), (None, "b"), (None, "b "), (None, "b\n"), (7, None), (0, "c"), (None, "c"), (0, "c")]
    got = exact_dedup.dedup(spark.createDataFrame(odd, "doc_id long, text string")).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in got if (r.text or "")[:1] != "b") == [(0, "c"), (5, "a"), (7, "")]
    assert sorted(r.text for r in got if (r.text or "")[:1] == "b") in (["b", "b "], ["b", "b\n"])
    shared = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b")], "doc_id long, text string")
    assert sorted(map(tuple, exact_dedup.dedup(shared).collect())) == [(1, "a"), (2, "b")]
    assert exact_dedup.dedup(no_docs).collect() == []


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def test_minhash(docs, corpus):
    sets = {i: shingles(t) for i, t, *_ in corpus}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = {r.doc_id: r for r in minhash.assign(clashing(docs)).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(s), find(i), i == find(i)) for i, s in sets.items()}
    assert sum(not r.kept for r in got.values()) >= 9


def components_of(sets):
    """Smallest reachable id by brute force over all pairs."""
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        a = sets[i]
        for j in ids[k + 1 :]:
            b = sets[j]
            if 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)) and 100 * (both := len(a & b)) >= 75 * (len(a) + len(b) - both):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("few", [2000, 0])
def test_minhash_with_a_common_passage(spark, monkeypatch, few):
    """Distinct documents that share most of their text meet over their rarest shingles, and the links among them are found;
    also if all buckets are too large to be compared pair by pair."""
    monkeypatch.setattr(minhash, "FEW", few)
    monkeypatch.setattr(minhash, "DEAL", 50)
    rng = random.Random(11)
    word = lambda: f"u{rng.randrange(10**9)}"
    passage = [f"p{k}" for k in range(120)]
    texts = []
    for share in (30, 50, 80, 100, 104, 106, 110):
        texts += [passage[:share] + [word() for _ in range(120 - share)] for _ in range(40 if few == 0 else 120)]
    for k in range(0, len(texts), 9):  # near copies of some
        texts.append([*texts[k][:-3], word(), word(), word()])
    rows = [(7 * i + 1, " ".join(t)) for i, t in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in minhash.assign(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = components_of({i: shingles(t) for i, t in rows})
    assert got == want and len(set(want.values())) < len(rows) - 20


def test_minhash_of_repeated_ids_in_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(minhash, "FEW", 0)
    rows = [(1, "a b c d e f g h i j"), (1, "k l m n o p q r s t"), (2, "a b c d e f g h i j x"), (3, "k l m n o p q r s t x")]
    got = {(r.doc_id, r.component_id) for r in minhash.assign(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1)}


def test_dedups_keep_columns_of_any_name(spark):
    names = ["__drop", "__digest", "__id", "__none", "__place", "__hot", "a.b"]
    rows = spark.createDataFrame([(i, "same words in all of these rows" if i % 2 else f"own words of row {i} and of no other", *[f"{c}{i}" for c in names]) for i in range(9)], ["doc_id", "text", *names])
    for dedup in (exact_dedup.dedup, minhash.dedup):
        got = dedup(rows)
        assert got.columns == rows.columns
        assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in rows.collect() if r.doc_id % 2 == 0 or r.doc_id == 1)


def test_minhash_chain(spark):
    """A long chain of near copies, whose ends have little in common, is one component."""
    words = [f"w{i}" for i in range(400)]
    rows = [(100 - k, " ".join(words[k * 8 : k * 8 + 120])) for k in range(30)]
    got = minhash.assign(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {71}


def test_minhash_odd_rows(spark, no_docs):
    assert minhash.assign(no_docs).collect() == []
    t = "a b c d e f g"
    rows = spark.createDataFrame([(None, t), (2, t), (2, t), (9, t), (4, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in minhash.assign(rows).collect())
    assert got == [(0, 3, 0, True), (2, 3, 2, True), (2, 3, 2, True), (4, 0, 4, True), (9, 3, 2, False)]


def test_odd_sketch_estimates():
    import numpy as np

    rng = np.random.default_rng(0)
    for share in (0.95, 0.75):
        far = []
        for _ in range(40):
            both = rng.integers(0, 1 << 62, 1000, dtype=np.uint64)
            own = int(1000 * (1 - share) / (1 + share))
            a, b = (np.concatenate([both[: 1000 - own], rng.integers(0, 1 << 62, own, dtype=np.uint64)]) for _ in range(2))
            x, y = minhash.odd_sketch(minhash.minhash(a)), minhash.odd_sketch(minhash.minhash(b))
            far.append(sum(bin(int(v)).count("1") for v in x ^ y))
        assert abs(np.mean(far) - minhash.most_bits(share)) < 8
        assert max(far) <= minhash.most_bits(minhash.LEAST_ESTIMATE)


def brute_windows(corpus, k=50):
    first = {}
    words = {i: WORD.findall(t or "") for i, t, *_ in corpus if i is not None}
    for i in sorted(words):
        for s in range(len(words[i]) - k + 1):
            first.setdefault(tuple(words[i][s : s + k]), i)
    out = {}
    for i, w in words.items():
        stay = [True] * len(w)
        for s in range(len(w) - k + 1):
            if first[tuple(w[s : s + k])] < i:
                stay[s : s + k] = [False] * k
        out[i] = (len(w), len(w) - sum(stay), " ".join(x for x, y in zip(w, stay, strict=True) if y))
    return out


@pytest.mark.parametrize(("name", "most"), [("MOST_IN_BUCKET", 4096), ("MOST_IN_BUCKET", 3), ("MOST_BYTES", 1000)])
def test_substring(docs, corpus, monkeypatch, name, most):
    """Also with so small a bound that shared buckets are split into single windows."""
    monkeypatch.setattr(substring_dedup, name, most)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.strip(clashing(docs)).collect()}
    want = brute_windows(corpus)
    assert got == want
    assert sum(1 for _, n, _ in want.values() if n) > 12


def test_substring_odd_rows(spark, no_docs):
    assert substring_dedup.strip(no_docs).collect() == []
    t = " ".join(map(str, range(60)))
    rows = spark.createDataFrame([(None, t), (3, t), (3, t), (4, None), (8, "x " + t)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substring_dedup.strip(rows).collect())
    assert got == [(0, 60, 0), (3, 60, 0), (3, 60, 0), (4, 0, 0), (8, 61, 60)]


def brute_chunks(text):
    def h(line):
        return int(hashlib.md5(line.encode()).hexdigest()[:7], 16)

    chunks, run, last = [], [], 0
    for line in (text or "").split("\n"):
        run.append(line)
        if (last * line_dedup._FACTOR + h(line)) % line_dedup._PRIME % line_dedup.DIVISOR == 0:
            chunks.append("\n".join(run))
            run = []
        last = h(line)
    return chunks + (["\n".join(run)] if run else [])


def test_lines(spark):
    import random

    rng = random.Random(3)
    block = [f"line {k}" for k in range(30)]
    rows = [(1, "\n".join(block)), (2, "new\n" + "\n".join(block) + "\nend"), (3, None), (4, ""), (5, "\n\n\n"), (6, "a\x01b\n\x01\x03\n\x01\x02"), (7, "\n".join(block[:15] * 2)), (None, "\n".join(block))]
    rows += [(10 + k, "\n".join(rng.choice(block) for _ in range(40))) for k in range(5)]
    rows += [(20 + k, "\n".join([*block[:k], f"inserted {k}", *block[k:]])) for k in (7, 19)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(clashing(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    seen, removed = set(), 0
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        kept, chunks = [], brute_chunks(t)
        assert "\n".join(chunks) == (t or "")
        for c in chunks:
            if c.count("\n") + 1 >= line_dedup.MIN_LINES and c in seen:
                removed += 1
                continue
            seen.add(c)
            kept.append(c)
        assert (got[i].n_lines, got[i].n_chunks, got[i].n_removed, got[i].kept) == ((t or "").count("\n") + 1, len(chunks), len(chunks) - len(kept), "\n".join(kept))
    assert removed > 5
    assert got[None].n_removed == 0


def test_lines_of_long_texts(spark):
    long = "\n".join(f"line {k % 5000} {'y' * (k % 7)}" for k in range(60_000))
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame([(1, long), (2, "z" * 3_000_000), (3, long)], "doc_id long, text string")).collect()}
    chunks = brute_chunks(long)
    assert got[2].kept == "z" * 3_000_000 and got[1].n_chunks == len(chunks) == got[3].n_chunks
    assert got[3].n_removed == sum("\n" in c for c in chunks)


def test_lines_empty(no_docs):
    assert line_dedup.dedup_lines(no_docs).collect() == []
