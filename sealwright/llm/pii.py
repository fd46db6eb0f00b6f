"""Personal data by patterns and by a semi-Markov conditional random field over what the patterns leave."""

from __future__ import annotations

import hashlib
import random
import re
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table

KINDS = ("email", "ip", "card", "phone")
#: The longest entity in tokens, and how many tokens' candidates are scored at a time, which bounds a task's memory.
MOST_TOKENS, AT_ONCE = 32, 2000
#: Training: number of made-up islands, passes, step, ridge and seed.
EXAMPLES, PASSES, STEP, RIDGE, SEED = 360, 40, 0.4, 1e-3, 7

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only begin at the first digit of a run, as a later one fails alike; so long runs cost one pass.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
# A written at or dot stands in brackets, or bare between words, where an at needs a dot after it.
_IN = r"[\[({](?i:%s)[\])}]"
_AT, _DOT = _IN % "at", _IN % "dot"
_BARE_AT = rf"(?<=\w) (?i:at) (?=[\w-]++(?: (?i:dot) | ?{_DOT}))"
_TRIGGER = re.compile(rf"[0-9@]|{_AT}|{_BARE_AT}")
_ATS = re.compile(rf"@|{_AT}|{_BARE_AT}")
_DOTS = re.compile(rf"[^\W_]\s?(?:\.|{_DOT}|(?<= )(?i:dot)(?= ))\s?[^\W_]")
_BARE_DOT = re.compile(r"(?<=\w) (?i:dot) (?=\w)")
_IS_DOT = re.compile(rf"(?i:dot)|{_DOT}")
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s|.", re.S)
_MORE = re.compile(rf" (?:[(+\[]*[0-9@][^\s]*+|{_IN % 'at|dot'}[^\s]*+|(?i:dot) [^\s]++)|{_BARE_AT}[^\s]++")
_WORD = re.compile(r" [^\s]++")
_CHUNK = re.compile(r"[^\s]*+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind's pattern that pass its check, by kind and start."""
    out: list[Span] = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    if not _DIGIT.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def islands(text: str):
    """(start, end) of the stretches that may hold an entity: chunks around a digit, an @ or a written at.

    A stretch is as long as its chunks go on; nothing cuts one by length, and each ends before white space.
    """
    done = 0
    for m in _TRIGGER.finditer(text):
        s = m.start()
        if s < done:
            continue
        while s > done and not text[s - 1].isspace():
            s -= 1
        while s - 1 > done and text[s - 1] == " ":  # a name before a spaced @, and one that has written dots
            low = s - 1
            while low > done and not text[low - 1].isspace():
                low -= 1
            if text[s] not in "@[({" and not _IS_DOT.match(text, s) and not _IS_DOT.fullmatch(text, low, s - 1):
                break
            s = low
        e = _CHUNK.match(text, m.start()).end()
        while more := _MORE.match(text, e) or (_WORD.match(text, e) if text[e - 1] in "@])}" else None):
            e = more.end()
        yield s, e
        done = e


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text)


def _bucket(n: int, bounds: tuple[int, ...]) -> int:
    return sum(n >= b for b in bounds)


def span_features(toks: list[str], i: int, j: int) -> list[str]:
    """Features of the whole candidate tokens[i:j] and of what stands beside it."""
    own = toks[i:j]
    body = "".join(own)
    numbers = [t for t in own if t[0].isdigit()]
    digits = "".join(numbers)
    words = [t for t in own if t[0].isalpha()]
    parts = _ATS.split(body)
    ats, dots = len(parts) - 1, len(_DOTS.findall(parts[-1]))
    joined = _BARE_DOT.sub(".", "@".join(parts)) if ats else body
    left, right = toks[i - 1] if i else " ", toks[j] if j < len(toks) else " "
    marks = {t for t in own if not t[0].isalnum()}
    out = [
        "bias",
        f"digits{_bucket(len(digits), (1, 4, 7, 9, 10, 11, 12, 13, 16, 17, 20))}",
        f"groups{min(len(numbers), 6)}",
        f"words{min(len(words), 3)}",
        f"ats{min(ats, 2)}{min(dots, 2)}",
        f"spaces{min(body.count(' '), 4)}{bool(ats)}",
        f"gap{bool(re.search(r'[^_0-9\W] [^_0-9\W]', joined))}{bool(ats)}",
        f"whole{min(ats, 2)}{bool(dots)}{own[0].isalnum()}{left.isspace()}{right.isspace()}",
        f"first{own[0] if not own[0].isalnum() else 'd' if own[0].isdigit() else 'w'}",
        f"last{own[-1] if not own[-1].isalnum() else 'd' if own[-1].isdigit() else 'w'}",
        f"left{'n' if left.isalnum() else 's' if left.isspace() else left if left in '+@.-=' else 'p'}",
        f"right{'n' if right.isalnum() else 's' if right.isspace() else right if right in '@.-=' else 'p'}",
    ]
    if numbers and not words:
        sizes = "-".join(str(min(len(n), 5)) for n in numbers[:5])
        out += [f"sizes{sizes}", f"marks{''.join(sorted(marks & set(' .-()+/:')))}"]
        if 13 <= len(digits) <= 19:
            out.append(f"luhn{luhn(digits)}")
        if len(numbers) == 4 and body.count(".") == 3:
            out.append(f"quad{all(len(n) <= 3 and int(n) <= 255 for n in numbers)}")
    if marks & set("=\"'<>|"):
        out.append("code")
    if words and numbers and not ats:
        out.append("mixed")
    return out


def candidates(toks: list[str], closed: list[bool] | None = None, first: int = 0, end: int | None = None) -> list[tuple[int, int]]:
    """Spans of at most MOST_TOKENS tokens that hold a trigger and neither begin nor end with a space, by start; only
    those that start in first..end."""
    out = []
    for i in range(first, len(toks) if end is None else min(end, len(toks))):
        if toks[i].isspace():
            continue
        hot = False
        for j in range(i + 1, min(len(toks), i + MOST_TOKENS) + 1):
            last = toks[j - 1]
            if closed and closed[j - 1]:
                break
            hot = hot or last[0].isdigit() or last == "@" or last.lower() == "at"
            if hot and not last.isspace():
                out.append((i, j))
    return out


def _made_up(rng: random.Random) -> tuple[str, list[Span]]:
    """One made-up stretch of text with its entities."""
    word = lambda a=3, b=9: "".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(a, b)))
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card() -> str:
        body = rng.choice("3456") + num(14)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def entity() -> tuple[str, str]:
        kind = rng.choice(KINDS)
        if kind == "email":
            at, dot = rng.choice([("@", "."), ("@", "."), ("[at]", "."), ("(at)", "."), (" [at] ", "."), (" (at) ", "."), (" @ ", "."), (" [at] ", "[dot]"), (" [at] ", " [dot] "), (" (at) ", " (dot) "), ("{at}", "{dot}"), (" at ", " dot "), (" at ", " dot ")])
            at, dot = rng.choice([(at, dot), (at, dot), (at.upper(), dot.upper())])
            return kind, word() + rng.choice([".", "_", "", dot]) + rng.choice([num(2), word()]) + at + word() + rng.choice(["", num(1)]) + dot + rng.choice(["", rng.choice([word(), "example"]) + dot]) + rng.choice(["com", "org", "net"])
        if kind == "ip":
            return kind, ".".join(str(rng.randint(0, 255)) for _ in range(4))
        if kind == "card":
            c, s = card(), rng.choice(["", " ", "-", "."])
            return kind, s.join(c[k : k + 4] for k in range(0, 16, 4))
        a, b, c = num(3), num(3), num(4)
        return kind, rng.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"({a}) {b} {c}", f"+{num(2)} {a} {b} {c}", f"{a}.{b}.{c}", f"+{num(11)}", f"0{num(2)} {num(7)}", f"0{num(3)}/{num(6)}", f"0{num(2)}-{num(8)}"])

    def other() -> str:
        return rng.choice([
            f"20{num(2)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}", f"{rng.randint(0, 23)}:{rng.randint(10, 59)}", f"{num(rng.randint(1, 6))}", f"{rng.randint(1, 99)}.{num(2)}",
            f"{rng.randint(0, 9)}.{rng.randint(0, 30)}.{rng.randint(0, 9)}", f"password={num(1)}a{num(2)}ce{num(5)}f{num(4)}b{num(2)}", f'token = "{num(2)}e{num(6)}bc{num(7)}a{num(3)}"', f"{num(rng.randint(17, 24))}",
            f"{word()}{num(2)}", f"v{num(1)}.{num(1)}", f"({num(4)})", f"{num(2)}-{num(2)}", f"@{word()}", f"{num(3)},{num(3)}", f"{num(1)}.{num(3)}.{num(1)}.{rng.randint(300, 999)}", f"{num(12)}", f"{word()}-{num(3)}/{num(4)}", f"{rng.randint(256, 999)}.{num(3)}.{num(3)}.{num(4)}",
            f"{word()} at {rng.randint(1, 12)}:{num(2)}", f"{num(2)} at {word()}",
        ])

    text, spans = "", []
    for _ in range(rng.randint(1, 2)):
        text += rng.choice(["", f"{word()} ", f"{word()}, "])
        if rng.random() < 0.5:
            kind, body = entity()
            spans.append((kind, len(text), len(text) + len(body)))
            text += body + rng.choice(["", ".", ",", ""])
        else:
            text += other()
        text += " "
    return text.rstrip(), spans


def excluded(own: list[str], features: list[str]) -> list[int]:
    """Kinds that a candidate can't be, whatever the weights: a card passes Luhn and has no marks but spaces, dots and
    hyphens, an address of four numbers has them in range, a mail has an at, and a phone number has 7 to 15 digits."""
    out, digits = [], sum(len(t) for t in own if t[0].isdigit())
    if "luhnTrue" not in features or any(not t[0].isdigit() and t not in " .-" for t in own):
        out.append(KINDS.index("card"))
    if "quadTrue" not in features:
        out.append(KINDS.index("ip"))
    if any(f.startswith("ats0") for f in features):
        out.append(KINDS.index("email"))
    if not 7 <= digits <= 15:
        out.append(KINDS.index("phone"))
    return out


class Model:
    """Weights of each (feature, kind); what no entity covers scores 0, and an excluded kind minus infinity."""

    def __init__(self, names: dict[str, int], weights: np.ndarray):
        self.names, self.weights = names, weights

    def scores(self, toks: list[str], spans: list[tuple[int, int]]) -> np.ndarray:
        out = np.zeros((len(spans), len(KINDS)))
        for k, (i, j) in enumerate(spans):
            features = span_features(toks, i, j)
            out[k] = self.weights[[self.names[f] for f in features if f in self.names]].sum(axis=0)
            out[k, excluded(toks[i:j], features)] = -np.inf
        return out

    def decode(self, toks: list[str], closed: list[bool] | None = None) -> list[tuple[str, int, int]]:
        """Boundaries and kinds of the segmentation of the largest sum, in one pass over entities of bounded length."""
        best, back = [0.0] + [-np.inf] * len(toks), [None] * (len(toks) + 1)
        for first in range(0, len(toks), AT_ONCE):
            end = min(first + AT_ONCE, len(toks))
            spans = candidates(toks, closed, first, end)
            scores = self.scores(toks, spans)
            kinds, tops = scores.argmax(axis=1).tolist(), scores.max(axis=1).tolist()
            k = 0
            for i in range(first, end):
                while k < len(spans) and spans[k][0] == i:
                    if (s := best[i] + tops[k]) > best[spans[k][1]]:
                        best[spans[k][1]], back[spans[k][1]] = s, (KINDS[kinds[k]], *spans[k])
                    k += 1
                if best[i] >= best[i + 1]:  # all that ends at i + 1 is known here
                    best[i + 1], back[i + 1] = best[i], None
        out, j = [], len(toks)
        while j:
            if back[j]:
                out.append(back[j])
            j = back[j][1] if back[j] else j - 1
        return out[::-1]


def _expected(spans: list[tuple[int, int]], scores: np.ndarray, n: int) -> np.ndarray:
    """Probability of each (segment, kind) by the forward and backward sums over all segmentations."""
    ending, starting = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
    for k, (i, j) in enumerate(spans):
        ending[j].append(k)
        starting[i].append(k)
    with np.errstate(invalid="ignore"):
        both = np.logaddexp.reduce(scores, axis=1) if len(spans) else np.empty(0)
    begin, end = [s[0] for s in spans], [s[1] for s in spans]
    ahead, behind = np.zeros(n + 1), np.zeros(n + 1)
    for j in range(1, n + 1):
        own = ending[j]
        ahead[j] = np.logaddexp.reduce([ahead[j - 1], *[ahead[begin[k]] + both[k] for k in own]]) if own else ahead[j - 1]
    for i in range(n - 1, -1, -1):
        own = starting[i]
        behind[i] = np.logaddexp.reduce([behind[i + 1], *[behind[end[k]] + both[k] for k in own]]) if own else behind[i + 1]
    return np.exp(ahead[begin][:, None] + scores + behind[end][:, None] - ahead[n])


@cache
def train(examples: int = EXAMPLES, passes: int = PASSES, seed: int = SEED) -> Model:
    """Maximum likelihood with a ridge over made-up islands, by full-batch steps of Adagrad; a few seconds on the driver."""
    rng = random.Random(seed)
    names: dict[str, int] = {}
    data, rows, barred = [], [], []
    for _ in range(examples):
        text, gold = _made_up(rng)
        toks = tokens(text)
        place = np.concatenate(([0], np.cumsum([len(t) for t in toks])))
        spans = candidates(toks)
        truth = {(a, b): KINDS.index(k) for k, a, b in gold}
        goal = np.zeros((len(spans), len(KINDS)))
        for k, (i, j) in enumerate(spans):
            features = span_features(toks, i, j)
            rows.append([names.setdefault(f, len(names)) for f in features])
            barred.append(excluded(toks[i:j], features))
            if (kind := truth.get((place[i], place[j]))) is not None:
                goal[k, kind] = 1
        data.append((spans, goal, len(toks)))
    table_ = np.zeros((len(rows), len(names)), np.float32)
    for k, row in enumerate(rows):
        table_[k, row] = 1
    bars = np.zeros((len(rows), len(KINDS)))
    for k, own in enumerate(barred):
        bars[k, own] = -np.inf
    weights, seen = np.zeros((len(names), len(KINDS))), np.full((len(names), len(KINDS)), 1e-6)
    for _ in range(passes):
        scores = table_ @ weights + bars
        lack, at = np.zeros_like(scores), 0
        for spans, goal, n in data:
            if spans:
                part = slice(at, at + len(spans))
                lack[part] = goal - _expected(spans, scores[part], n)
                at += len(spans)
        slope = table_.T @ lack / examples - RIDGE * weights
        seen += slope**2
        weights = weights + STEP * slope / np.sqrt(seen)
    return Model(names, weights)


def all_spans(text: str, model: Model) -> tuple[list[Span], list[Span]]:
    """Base spans, and base spans with those that the model adds, by kind and start."""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    added, at = [], 0
    for s, e in islands(text):
        while at < len(taken) and taken[at][1] <= s:
            at += 1
        over, k = [], at
        while k < len(taken) and taken[k][0] < e:
            over.append(taken[k])
            k += 1
        closed, toks, place = None, None, s
        if over:
            rest, taken_up = list(text[s:e]), bytearray(e - s)
            for a, b in over:
                low, high = max(a, s) - s, min(b, e) - s
                if low < high:
                    rest[low:high] = " " * (high - low)
                    taken_up[low:high] = b"\1" * (high - low)
            if not _TRIGGER.search("".join(rest)):
                continue  # base spans cover all that could be an entity
        toks = tokens(text[s:e])
        places = [place]
        for t in toks:
            place += len(t)
            places.append(place)
        if over:
            closed = [taken_up.find(1, places[i] - s, places[i + 1] - s) >= 0 for i in range(len(toks))]
        added += [(kind, places[i], places[j]) for kind, i, j in model.decode(toks, closed)]
    order = lambda x: (KINDS.index(x[0]), x[1])
    return sorted(base, key=order), sorted(base + added, key=order)


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _find(model: Model, batches):
    for batch in batches:
        out = [[] for _ in range(6)]
        for text in batch.column(1).to_pylist():
            base, every = all_spans(text or "", model)
            for column, kind in zip(out, KINDS, strict=False):
                column.append(sum(k == kind for k, _, _ in base))
            out[4].append(hashlib.sha256(_joined(base).encode()).hexdigest())
            out[5].append(_joined(every))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]], ["id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans), one row per row of `docs`.

    Base spans are the patterns' checked matches. The model segments each stretch around a digit, an @ or a written
    at that base spans don't cover, and adds entities of at most MOST_TOKENS tokens; base spans stay as they are.
    Offsets are code points. Null text counts as empty, which has no spans; null ids, rows that repeat an id and an
    empty table need nothing special; other columns are never read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return map_texts(rows, partial(_find, train()), schema).withColumnRenamed("id", id_col)


def op2_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
