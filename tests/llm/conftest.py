import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng: random.Random, n: int, words: int = 400) -> str:
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture
def corpus():
    """Documents with null, empty, blank and long texts, copies, near copies and shared passages."""
    rng = random.Random(1)
    base = [sentence(rng, rng.choice([3, 30, 80, 200])) for _ in range(30)]
    passage = sentence(rng, 70)
    texts = [None, "", "  \t\n ", "one", "a b c d", *base]
    texts += [base[3], base[3].replace(" ", "\n"), base[5] + " tail", base[5].replace("w1", "W1")]
    texts += [sentence(rng, 20) + " " + passage + " " + sentence(rng, k) for k in range(12)]
    long = sentence(rng, 6000)
    texts += [long, long[: len(long) // 2] + " changed " + long[len(long) // 2 :], "x" * 50_000, "same " * 300, "same " * 300]
    texts += [sentence(rng, 120)] * 6
    return [(i * 3 + 1, t, ("en", "de", None)[i % 3], ("a", "b", None)[i % 3] if i % 4 else "a", None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
