"""Exact token counts of every prefix of a text, by dynamic programming over its characters.

Byte-pair merging of a prefix ends in exactly one piece t, and what comes before t is the encoding of
the prefix without it. So with the last piece of every shorter prefix known, the last piece of the
next prefix is the one suffix that is a piece and that merging leaves apart from the piece before it:
n[i] = n[i - len(t)] + 1. Whether two pieces stay apart is found once by merging both, and kept. Pieces
never run on past a mark of white space, so a text is a sequence of stretches from mark to mark and
counts of a stretch are made once and added up.

``prefixes`` keeps the counts of a text as an array; ``tokens_of``, ``longest_within`` and
``windows_within`` answer questions about truncation and budgets from that array, as columns, without
encoding anything again. ``count`` gives the totals and the place where the limit is met.

A vocabulary is a BPE model of the sentencepiece library with byte fallback and without normalisation;
others are refused. Control strings inside a text are ordinary text, as they are for the library.

Defined cases: a null text is empty; an empty text has no tokens and the counts ``[0]``; a text of any
length is counted whole; repeated and null ids are rows like any other; other columns are not read and
may have any names; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import stash
from .tokens import bytes_of, slices

#: The library's mark of white space.
MARK = "▁"
#: Characters of stretches whose counts a worker keeps; beyond, it starts afresh. Results don't depend on it.
KEPT_CHARS = 1 << 23
KEPT_PAIRS = 1 << 20


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces that merging may make, with their scores, of a model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.GetPieceSize())
    probe = " Åﬁ  x\t"
    if sum(model.IsByte(i) for i in ids) != 256 or model.Normalize(probe) != MARK + probe.replace(" ", MARK):
        raise ValueError("a model with byte fallback and without normalisation is needed")
    return [(model.IdToPiece(i), model.GetScore(i)) for i in ids if not (model.IsControl(i) or model.IsUnknown(i) or model.IsByte(i) or model.IsUnused(i))]


class Stretches(dict):
    """Numbers of the stretches whose counts are kept; a new one gets a number and waits for its counts."""

    def __init__(self):
        self.new: list[str] = []
        self.size = 0

    def __missing__(self, stretch: str) -> int:
        found = self[stretch] = self.size
        self.size += 1
        self.new.append(stretch)
        return found


class Counter:
    """Counts of all prefixes of stretches and texts for one vocabulary."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.score = dict(pieces)
        crossing = any(MARK in p.lstrip(MARK) for p in self.score)
        self.stretch = re.compile("(?s).+" if crossing else f"{MARK}*[^{MARK}]+|{MARK}+$")
        # every ending of a piece; those that may end an encoding know what they stand apart from
        self.endings: dict[str, dict[str, bool] | None] = {}
        for piece in self.score:
            for i in range(1, len(piece)):
                self.endings.setdefault(piece[i:], None)
        for piece in list(self.endings):
            if piece in self.score or len(piece) == 1:
                self.endings[piece] = {}
        self.endings |= {piece: {} for piece in self.score}
        self.pairs = 0
        self.clear()

    def clear(self) -> None:
        self.known = Stretches()
        self.flat, self.at, self.total = np.zeros(1 << 16, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def merge(self, text: str) -> list[str]:
        """The pieces of a short text, by merging the best pair, the first of equals, until none is left."""
        parts, get, none = list(text), self.score.get, float("-inf")
        scores = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while scores and (best := max(scores)) > none:
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(scores):
                scores[i] = get(parts[i] + parts[i + 1], none)
        return parts

    def stay(self, before: str, piece: str) -> bool:
        """Whether merging leaves ``before`` and ``piece`` as they are, side by side (``before`` may be empty); kept."""
        self.pairs += 1
        found = self.endings[piece][before] = self.merge(before + piece) == ([before, piece] if before else [piece])
        return found

    def counts(self, stretches: list[str]) -> np.ndarray:
        """Tokens of the prefixes of 1, 2, ... characters of each of the sorted ``stretches``, one after the other.

        Neighbours in the order begin alike, and what is known of a prefix holds for both.
        """
        endings, score, stay = self.endings, self.score, self.stay
        out: list[int] = []
        previous, last, n = "", [""], [0]
        for stretch in stretches:
            same = 0
            for a, b in zip(previous, stretch, strict=False):
                if a != b:
                    break
                same += 1
            del last[same + 1 :], n[same + 1 :]
            for i in range(same + 1, len(stretch) + 1):
                j = i - 1
                piece = stretch[j:i]
                apart = endings.get(piece, False)
                while apart is not False:
                    if apart is not None:
                        before = last[j]
                        fits = apart.get(before)
                        if stay(before, piece) if fits is None else fits:
                            break
                    j -= 1
                    piece = stretch[j:i]
                    apart = endings.get(piece, False) if j >= 0 else False
                if apart is False:  # a character that ends no piece
                    j, piece = i - 1, stretch[i - 1]
                last.append(piece)
                n.append(n[j] + (1 if piece in score else len(piece.encode())))
            out += n[1:]
            previous = stretch
        return np.array(out, np.int32)

    def settle(self) -> None:
        """Counts of the stretches that wait for them."""
        new, self.known.new = self.known.new, []
        if not new:
            return
        order = sorted(range(len(new)), key=new.__getitem__)
        flat = self.counts([new[i] for i in order])
        size = np.fromiter(map(len, new), np.int64, len(new))
        sorted_ends = np.cumsum(size[order])
        at, total = np.empty(len(new), np.int64), np.empty(len(new), np.int64)
        at[order], total[order] = sorted_ends - size[order], flat[sorted_ends - 1]
        used = int(self.at[-1])
        if used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat[:used], np.zeros(max(used, len(flat)) * 2, np.int32)])
        self.flat[used : used + len(flat)] = flat
        # the last entry of ``at`` is where the next counts go
        self.at = np.concatenate([self.at[:-1], at + used, [used + len(flat)]])
        self.total = np.concatenate([self.total, total])
        self.size = np.concatenate([self.size, size]) if len(self.total) > len(new) else size

    def of(self, texts: list[str]) -> Iterator[np.ndarray]:
        """For each text the counts of its prefixes of 0, 1, ... characters."""
        if self.at[-1] > KEPT_CHARS:
            self.clear()
        if self.pairs > KEPT_PAIRS:
            self.pairs = 0
            for apart in filter(None, self.endings.values()):
                apart.clear()
        number, cut = self.known.__getitem__, self.stretch.findall
        numbers = [np.array(list(map(number, cut(MARK + t.replace(" ", MARK)))), np.int64) if t else None for t in texts]
        self.settle()
        for ids in numbers:
            if ids is None:
                yield np.zeros(1, np.int32)
                continue
            wide, total = self.size[ids], self.total[ids]
            first = np.cumsum(wide) - wide
            n = self.flat[np.repeat(self.at[ids] - first, wide) + np.arange(first[-1] + wide[-1])]
            n += np.repeat((np.cumsum(total) - total).astype(np.int32), wide)
            n[0] = 0  # the mark that stands before a text is no text of its own
            yield n


_COUNTERS: dict[int, Counter] = {}


def _counter(held) -> Counter:
    """The worker's counter of a broadcast vocabulary."""
    if held.id not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[held.id] = Counter(held.value)
    return _COUNTERS[held.id]


class _Held:
    """A broadcast (of the vocabulary: as large as the model, whatever the input) and what tells it apart."""

    def __init__(self, spark, pieces):
        self.cast = spark.sparkContext.broadcast(pieces)
        self.id = hash((len(pieces), tuple(pieces[-50:])))

    @property
    def value(self):
        return self.cast.value


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [x or "" for x in batch.column(1).to_pylist()]


def count(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, and fit_chars: the most characters a prefix of at most ``limit`` tokens has."""
    held = _Held(docs.sparkSession, vocabulary(model))
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        counter = _counter(held)
        for batch in batches:
            for part in slices(batch):
                tokens, fit = [], []
                for n in counter.of(_texts(part)):
                    tokens.append(int(n[-1]))
                    fit.append(len(n) - 1 if n[-1] <= limit else int(np.flatnonzero(n <= limit)[-1]))
                size = np.diff(bytes_of(part.column(1))[1])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), pa.array([x > limit for x in tokens]), pa.array(fit, pa.int64())],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"],
                )

    return stash(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long"), "token-counts")


def prefixes(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and counts: the i-th element (from 0) is the number of tokens of the first i characters."""
    held = _Held(docs.sparkSession, vocabulary(model))
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        counter = _counter(held)
        for batch in batches:
            for part in slices(batch):
                found = list(counter.of(_texts(part)))
                ends = np.cumsum([0, *map(len, found)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "counts"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, counts array<int>")


def tokens_of(counts: str | Column, chars: int | Column) -> Column:
    """Tokens of the first ``chars`` characters (of the whole text where it is shorter)."""
    counts = F.col(counts) if isinstance(counts, str) else counts
    chars = F.lit(chars) if isinstance(chars, int) else chars
    return F.element_at(counts, F.least(chars + 1, F.size(counts)))


def longest_within(counts: str | Column, budget: int | Column) -> Column:
    """Characters of the longest prefix with at most ``budget`` tokens; counts may fall as a prefix grows."""
    counts = F.col(counts) if isinstance(counts, str) else counts
    budget = F.lit(budget) if isinstance(budget, int) else budget
    return F.array_max(F.transform(counts, lambda n, i: F.when(n <= budget, i)))


def windows_within(counts: str | Column, budget: int) -> Column:
    """How many consecutive parts of at most ``budget`` tokens of the whole text's count the text fills."""
    counts = F.col(counts) if isinstance(counts, str) else counts
    return F.ceil(F.element_at(counts, -1) / F.lit(budget)).cast("long")
