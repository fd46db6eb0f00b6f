"""SentencePiece encoding and decoding with the N best segmentations."""

from __future__ import annotations

import re
from array import array
from bisect import insort
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NBEST = 3
#: Characters of units that a worker remembers; beyond them, it starts anew. It changes speed only.
REMEMBERED = 4_000_000
#: Characters of texts whose units are solved together, unless one text alone has more; it bounds memory.
TOGETHER = 2_000_000
#: Units of more characters are solved one by one, by the same search; it changes speed only.
ONE_BY_ONE = 64
SPACE = "▁"
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def load(path: str = MODEL) -> tuple[list[str], list[float], list[int]]:
    """Pieces, scores and kinds (0 piece, 1 byte, 2 special), read on the driver; tasks get them by value."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    kinds = [1 if sp.is_byte(i) else 2 if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else 0 for i in range(n)]
    return [sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)], kinds


class Known:
    """What is known of units: best ids, their score and the loss of the second best, in arrays with a number for each unit."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.n, self.filled = 0, 0
        self.score, self.loss = np.empty(1024), np.empty(1024)
        self.start, self.size = np.empty(1024, np.int64), np.empty(1024, np.int64)
        self.ids = np.empty(4096, "<i4")

    def __len__(self) -> int:
        return len(self.number)

    def __getitem__(self, unit: str) -> tuple[bytes, float, float]:
        k = self.number[unit]
        return self.ids[self.start[k] : self.start[k] + self.size[k]].tobytes(), float(self.score[k]), float(self.loss[k])

    @staticmethod
    def _room(x: np.ndarray, n: int) -> np.ndarray:
        if n <= len(x):
            return x
        out = np.empty(max(n, len(x) * 3 // 2), x.dtype)
        out[: len(x)] = x
        return out

    def add(self, units: list[str], ids: np.ndarray, sizes, scores, losses) -> None:
        """The units' ids one after another, and how many each has."""
        n, filled = self.n + len(units), self.filled + len(ids)
        self.score, self.loss, self.start, self.size = (self._room(x, n) for x in (self.score, self.loss, self.start, self.size))
        self.ids = self._room(self.ids, filled)
        own = slice(self.n, n)
        self.score[own], self.loss[own], self.size[own] = scores, losses, sizes
        self.start[own] = self.filled + np.cumsum(self.size[own]) - self.size[own]
        self.ids[self.filled : filled] = ids
        self.number.update(zip(units, range(self.n, n), strict=True))
        self.n, self.filled = n, filled

    def joined(self, numbers: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The ids of units one after another, and where each unit's end."""
        sizes = self.size[numbers]
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.start[numbers] - ends + sizes, sizes) + np.arange(ends[-1])].tobytes(), ends


class Codec:
    """Encodes by the piece lattice: the sum of piece scores is largest; a character that no piece holds is its bytes.

    A backward A* search takes the segmentations out in order of their sums. Its heuristic, the forward Viterbi score
    of what is left, is exact, so the priority of an entry is the sum of the best segmentation that goes on from it,
    another one for each entry: of n that are asked for, the n first entries are all that matter, and the queue holds
    no more, however many sums are equal.

    No piece holds a space after another character, nor a line end, so the lattice of a text is a chain of the
    lattices of its units: spaces with the characters up to the next space, and single line ends. Forward scores add
    up along the chain, and the search goes over it by units, each of which is searched once and remembered.
    """

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[int]):
        self.pieces = {p: (i, s) for i, (p, s, k) in enumerate(zip(pieces, scores, kinds, strict=True)) if k == 0}
        self.byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == 1}
        if len(self.byte) != 256:
            raise ValueError("the model has no byte fallback, so texts could not be restored")
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.pieces):
            raise ValueError("a piece goes beyond a unit of text")
        self.fallback = min(s for _, s in self.pieces.values()) - 10.0
        self.longest = max(map(len, self.pieces))
        self.spelled = pa.array([b"" if k == 2 else bytes([int(p[3:5], 16)]) if k == 1 else p.replace(SPACE, " ").encode() for p, k in zip(pieces, kinds, strict=True)], pa.binary())
        begun: dict[str, tuple[int, float]] = {}
        longer: set[str] = set()
        for p, (i, score) in self.pieces.items():
            longer.update(p[:w] for w in range(1, len(p)))
            begun[p] = (i, score)
        for p in longer:
            begun.setdefault(p, (-1, -np.inf))
        #: Of each length, the beginnings of pieces by hash: (hashes, ids or -1, scores, whether a longer piece goes on).
        self.by_size = {}
        for size in range(1, self.longest + 1):
            own = sorted((self._hash(p), i, s, p in longer) for p, (i, s) in begun.items() if len(p) == size)
            if len({h for h, *_ in own}) != len(own):
                raise ValueError("two beginnings of pieces have one hash")
            self.by_size[size] = [np.array(c, t) for c, t in zip(zip(*own, strict=True), (np.uint64, np.int32, float, bool), strict=True)]
        widths: dict[str, set[int]] = {}
        for p in self.pieces:
            if len(p) > 1:
                widths.setdefault(p[-2:], set()).add(len(p))
        #: Lengths of the pieces that end in two given characters.
        self.widths = {k: tuple(sorted(v)) for k, v in widths.items()}
        # spaces, then others; a literal U+2581 stands alone and is spelled in bytes
        self.unit = re.compile(f"{SPACE}|\n| *[^ \n{SPACE}]+| +")
        self.known = Known()
        self.lists: dict[tuple[str, int], list[tuple[float, bytes]]] = {}
        self.held = 0

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_FACTOR) + ord(c) + 1) % (1 << 64)
        return h

    def _spell(self, text: str) -> list[int]:
        return [self.byte[b] for b in text.encode("utf-8", "surrogatepass")]

    def into(self, text: str, j: int) -> Iterator[tuple[int, float, int]]:
        """(start, score, id) of the edges that end at j; -1 is a character that is spelled in bytes."""
        i, s = self.pieces.get(text[j - 1], (-1, self.fallback))
        yield j - 1, s, i
        for w in self.widths.get(text[j - 2 : j], ()) if j > 1 else ():
            if w <= j and (hit := self.pieces.get(text[j - w : j])):
                yield j - w, hit[1], hit[0]

    def unit_nbest(self, unit: str, n: int) -> list[tuple[float, bytes]]:
        """The n best (score, ids) of a unit of any length; of equal sums, the one of longer last pieces first."""
        if unit == SPACE:
            return [(self.fallback, array("i", self._spell(unit)).tobytes())]
        text = unit.replace(" ", SPACE)
        best = array("d", [0.0])
        for j in range(1, len(text) + 1):
            best.append(max(best[i] + s for i, s, _ in self.into(text, j)))
        # (minus the priority, place, number, score so far, ids from here to the end as a linked list)
        queue: list[tuple[float, int, int, float, tuple | None]] = [(-best[-1], len(text), 0, 0.0, None)]
        out, number = [], 0
        while queue:
            _, at, _, done, ids = queue.pop(0)
            room = n - len(out) - 1  # beside the entry that goes down
            while at:
                edges = sorted([(-(best[i] + s + done), i, s, piece) for i, s, piece in self.into(text, at)])
                for rank, i, s, piece in edges[1 : room + 1]:
                    if len(queue) < room or (rank, i) < queue[-1][:2]:
                        number += 1
                        insort(queue, (rank, i, number, s + done, (piece if piece >= 0 else -1 - i, ids)))
                        del queue[room:]
                _, at, s, piece = edges[0]
                done, ids = s + done, (piece if piece >= 0 else -1 - at, ids)
            out.append((done, self._unlinked(unit, ids)))
            if len(out) == n:
                break
        return out

    def _unlinked(self, unit: str, ids: tuple | None) -> bytes:
        flat = array("i")
        while ids:
            piece, ids = ids
            if piece >= 0:
                flat.append(piece)
            else:
                flat.extend(self._spell(unit[-1 - piece]))
        return flat.tobytes()

    def solve(self, units: list[str], n: int = NBEST) -> None:
        """Best ids, their score and the loss of the second best, of units that aren't known yet; all of one length at once."""
        by_size: dict[int, list[str]] = {}
        for u in units:
            by_size.setdefault(len(u), []).append(u)
        for size, own in by_size.items():
            if size > ONE_BY_ONE or size == 1:
                for u in own:
                    found = self.lists[u, n] = self.unit_nbest(u, n)
                    two = found if n > 1 else self.unit_nbest(u, 2)
                    self._add(u, two[0][1], two[0][0], two[0][0] - two[1][0] if len(two) > 1 else np.inf)
            else:
                for k in range(0, len(own), 20_000):
                    self._solve(own[k : k + 20_000], size)

    def _add(self, unit: str, ids: bytes, score: float, loss: float) -> None:
        self.known.add([unit], np.frombuffer(ids, "<i4"), [len(ids) // 4], [score], [loss])

    def _solve(self, own: list[str], size: int) -> None:
        """Forward scores of n units of one length, of the best and of the second best, then the searches in lockstep.

        A row of an array is one place of all units. Each search goes down along its best entry, whose priority stays
        the best sum; the second result's sum is the second best forward score.
        """
        n = len(own)
        points = np.frombuffer("".join(own).replace(" ", SPACE).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, size).T.astype(np.uint64) + np.uint64(1)
        widest = min(size, self.longest)
        score = np.full((widest + 1, size, n), -np.inf)
        ids = np.full((widest + 1, size, n), -1, np.int32)
        used = np.zeros((widest + 1, size), bool)  # whether pieces of a length begin at a place
        # a place stays open while what begins there begins a piece too
        flat, at = points.ravel(), np.arange(size * n)
        rolling = np.zeros(size * n, np.uint64)
        with np.errstate(over="ignore"):
            for w in range(1, widest + 1):
                rolling = rolling * _FACTOR + flat[at + (w - 1) * n]
                hashes, piece, value, goes_on = self.by_size[w]
                row = np.minimum(np.searchsorted(hashes, rolling), len(hashes) - 1)
                hit = hashes[row] == rolling
                row, at, rolling = row[hit], at[hit], rolling[hit]
                whole = piece[row] >= 0
                if whole.any():
                    found, row_of = at[whole], row[whole]
                    used[w, found // n] = True
                    score[w].ravel()[found], ids[w].ravel()[found] = value[row_of], piece[row_of]
                stays = goes_on[row] & (at < (size - w) * n)
                at, rolling = at[stays], rolling[stays]
                if not len(at):
                    break
        score[1] = np.where(ids[1] < 0, self.fallback, score[1])
        ahead, second, last = np.full((size + 1, n), -np.inf), np.full((size + 1, n), -np.inf), np.ones((size + 1, n), np.int8)
        ahead[0] = 0
        for j in range(1, size + 1):
            best, beside = ahead[j], second[j]
            np.add(ahead[j - 1], score[1, j - 1], out=best)
            np.add(second[j - 1], score[1, j - 1], out=beside)
            for w in range(2, min(j, widest) + 1):
                if used[w, j - w]:
                    s = ahead[j - w] + score[w, j - w]
                    np.maximum(beside, second[j - w] + score[w, j - w], out=beside)
                    np.maximum(beside, np.minimum(best, s), out=beside)
                    np.copyto(last[j], w, where=s >= best)  # on a tie the longer last piece
                    np.maximum(best, s, out=best)
        at, rows = np.full(n, size), np.arange(n)
        path, taken = np.full((n, size), -1, np.int32), np.zeros((n, size), bool)
        while len(rows):
            here = at[rows]
            down = last[here, rows]
            start = here - down
            path[rows, start], taken[rows, start], at[rows] = ids[down, start, rows], True, start
            rows = rows[start > 0]
        best, loss = ahead[size], ahead[size] - second[size]
        spelled = (taken & (path < 0)).any(axis=1)
        whole = np.flatnonzero(~spelled)
        self.known.add([own[k] for k in whole.tolist()], path[whole][taken[whole]], taken[whole].sum(axis=1), best[whole], loss[whole])
        for k in np.flatnonzero(spelled).tolist():
            found: list[int] = []
            for i in np.flatnonzero(taken[k]).tolist():
                found += [int(path[k, i])] if path[k, i] >= 0 else self._spell(own[k][i])
            self._add(own[k], np.asarray(found, "<i4").tobytes(), best[k], loss[k])

    def units(self, text: str) -> list[str]:
        return self.unit.findall(" " + text) if text else []

    def learn(self, texts: list[list[str]], n: int = NBEST) -> None:
        """Solve the units of texts that aren't known; what is known is dropped first where it would be too much."""
        every = set().union(*texts)
        new = list(every.difference(self.known.number))
        size = sum(map(len, new))
        if self.held and self.held + size > REMEMBERED:
            self.forget()
            new = list(every)
            size = sum(map(len, new))
        self.held += size
        self.solve(new, n)

    def forget(self) -> None:
        self.known.clear()
        self.lists.clear()
        self.held = 0

    def encode(self, text: str, n: int = NBEST) -> list[tuple[float, bytes]]:
        """The n best (score, ids as little-endian int32) of a text, the best first; '' has one empty segmentation."""
        units = self.units(text)
        self.learn([units], n)
        return self.choose(units, n)

    def choose(self, units: list[str], n: int) -> list[tuple[float, bytes]]:
        """The n best of a text whose units are known, by the search over the chain of units.

        An entry says which unit has which of its own segmentations; all others have their best. Its priority is the
        total of the forward scores less what these lose. Going down along an entry changes nothing, so entries are
        told by what differs alone, and of the units beside the best the n - 1 of least loss fill the queue.
        """
        if not units:
            return [(0.0, b"")]
        known = self.known
        numbers = np.fromiter(map(known.number.__getitem__, units), np.int64, len(units))
        best_ids, ends = known.joined(numbers)
        total = sum(known.score[numbers].tolist())
        out = [(total, best_ids)]
        losses = known.loss[numbers]
        near = np.argsort(losses, kind="stable")[: n - 1] if len(losses) < 4 * n else np.flatnonzero(losses <= np.partition(losses, n - 1)[n - 1])
        open_units = sorted(near.tolist(), key=lambda k: (losses[k], k))[: n - 1]
        choices = []
        for k in open_units:
            if losses[k] < np.inf:
                if (key := (units[k], n)) not in self.lists:
                    self.lists[key] = self.unit_nbest(*key)
                choices.append((k, self.lists[key]))
        # (loss, number, first unit that may still change, choice of each open unit)
        queue, number = [(c[0][0] - c[1][0], i, i, tuple(int(j == i) for j in range(len(choices)))) for i, (_, c) in enumerate(choices)], len(choices)
        queue.sort()
        while queue and len(out) < n:
            loss, _, first, pick = queue.pop(0)
            ids, done = [], 0
            for k, p, c in sorted((k, p, c) for (k, c), p in zip(choices, pick, strict=True) if p):
                end = 4 * int(ends[k])
                ids += [best_ids[done : end - 4 * int(known.size[numbers[k]])], c[p][1]]
                done = end
            out.append((total - loss, b"".join([*ids, best_ids[done:]])))
            for i in range(first, len(choices)):
                c = choices[i][1]
                if pick[i] + 1 < len(c):
                    number += 1
                    insort(queue, (loss + c[pick[i]][0] - c[pick[i] + 1][0], number, i, (*pick[:i], pick[i] + 1, *pick[i + 1 :])))
            del queue[n - len(out) :]
        return out

    def decode(self, ids: bytes) -> str:
        """The text; the space that encoding puts first is taken off."""
        n = len(ids) // 4
        _, ends, spelled = self.spelled.take(pa.Array.from_buffers(pa.int32(), n, [None, pa.py_buffer(ids)])).buffers()
        return str(memoryview(spelled)[: np.frombuffer(ends, np.int32)[n]], "utf-8", "surrogatepass")[1:] if n else ""


_CODECS: dict[int, Codec] = {}


def _codec(model) -> Codec:
    """One codec a worker and model, as its tables take time to make; what it remembers of texts lasts for a task."""
    key = hash((len(model[0]), tuple(model[0][-50:]), tuple(model[1][-50:])))
    if key not in _CODECS:
        _CODECS[key] = Codec(*model)
    return _CODECS[key]


def _together(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of TOGETHER characters at most; a longer text is a run of its own."""
    run, size = [], 0
    for text in texts:
        if run and size + len(text) > TOGETHER:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run


def _encode(model, n: int, batches):
    codec = _codec(model)
    try:
        for batch in batches:
            ids, scores, same = [], [], []
            for texts in _together([t or "" for t in batch.column(1).to_pylist()]):
                units = [codec.units(t) for t in texts]
                codec.learn(units, n)
                for text, own in zip(texts, units, strict=True):
                    found = codec.choose(own, n)
                    ids.append([i for _, i in found])
                    scores.append([s for s, _ in found])
                    same.append(all(codec.decode(i) == text for _, i in found))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(ids, pa.list_(pa.binary())), pa.array(scores, pa.list_(pa.float64())), pa.array(same, pa.bool_())], ["id", "nbest_ids", "scores", "restored"])
    finally:
        codec.forget()  # the worker outlives the task, and other stages need the memory


def _decode(model, batches):
    codec = _codec(model)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([None if x is None else codec.decode(x) for x in batch.column(1).to_pylist()], pa.string())], ["id", "text"])


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, n: int = NBEST) -> DataFrame:
    """(id_col, ids, nbest_ids, scores, restored): little-endian int32 ids of the best segmentation and of the n best
    in order, their scores, and whether decoding each of them gives the text back.

    Null text counts as empty, which has no ids and the score 0. Rows that repeat an id, null ids and an empty table
    are encoded like any; other columns are never read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    coded = map_texts(rows, partial(_encode, load(model), n), "id long, nbest_ids array<binary>, scores array<double>, restored boolean")
    return coded.select(F.col("id").alias(id_col), F.col("nbest_ids")[0].alias("ids"), "nbest_ids", "scores", "restored")


def decode(coded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """(id_col, text) of ids as encode() gives them; null ids give null."""
    rows = coded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids"))
    return map_texts(rows, partial(_decode, load(model)), "id long, text string").withColumnRenamed("id", id_col)


def digests(coded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, best_score, nbest_scores, restored, nbest_sha256): digest columns of encode()'s
    result; those of the n best are joined by commas, in order."""
    return coded.select(id_col, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.col("scores")[0].alias("best_score"), F.array_join(F.transform("scores", lambda s: s.cast("decimal(20,3)").cast("string")), ",").alias("nbest_scores"), "restored", F.array_join(F.transform("nbest_ids", lambda i: F.sha2(i, 256)), ",").alias("nbest_sha256"))


def op5_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode(table(spark, sf_dir, "documents")))
