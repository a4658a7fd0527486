"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages. Word weights are inverse frequencies over blocks of
``BLOCK`` words of all documents, counted in a table of fixed size. A randomised SVD of the
passages' TF-IDF matrix, its products summed over partitions, gives the latent axes. Windows of two
and of four blocks of every document are folded onto these axes and compared with the passages by
cosine, the larger of the latent one and the untruncated one: axes that are fewer than passages leave
out a part of every window. A window's words bound its cosine with any passage from above, and one that
can't reach the limit is not folded. Candidates are then checked on words: the longest common subsequence of the
passage and a stretch of the window with its surroundings, not much longer than the passage, must cover
``least`` of it, and the answer - the item's answer if there is one, else the passage's
rarest words - must be in that stretch too.

The benchmark is taken in chunks of about ``CHUNK`` passages, each with a pass over all documents, so what
is held at once has a fixed bound: a larger benchmark takes more passes and no more memory.

Defined cases: null and empty texts match nothing, and items without words are never matched; items
of fewer than ``SHORT`` words must occur whole and are looked up at every place, without a cosine of
windows (theirs is given as 1); ids of any type, null ones included, are returned as they are; repeated
rows and items are each reported; an empty benchmark or table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import tokens as tk
from .store import partition_sums, stash

#: Words of a block; windows are of 2 and of 4 blocks.
BLOCK = 16
#: Counters of the frequency table.
TABLE = 1 << 18
SHIFT = np.uint64(64 - 18)
#: Longest passage of an item in words, and the length under which it must occur whole.
PASSAGE, SHORT = 64, 8
#: Latent axes, and terms of the latent space, at most; terms beyond share cells by hash.
RANK, TERMS = 256, 1 << 15
#: Passages a term is listed for, at most.
LISTED = 8
#: Terms below this share of the largest inverse frequency are not listed.
RARE = 0.4
#: Passages up to which sums are kept in a table of blocks and passages.
DENSE = 512
#: Cells of a table of terms and passages, or of blocks and passages.
CELLS = 1 << 20
#: Passages that a pass over the documents compares with, about; a larger benchmark takes more passes.
CHUNK = 2048
#: Bytes of text, and blocks, that are compared at once.
SLICE, RANGE = 1 << 18, 1 << 12
#: Words of windows that are folded at once, and how much single precision may take from a cosine (sums of 64 and of 256 products: less than 1e-4).
FOLDED, SINGLE = 1 << 15, 1e-3
#: In 64 words the square of 1 + log t is at least this share of t, for any t.
REPEATED = (1.0 + math.log(64)) ** 2 / 64


def stripped(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of lower-cased words without outer punctuation, and where each text's begin."""
    words = tk.trim(tk.split(column, lower=True))
    hashes = tk.word_hashes(words)
    real = words.end > words.start
    return hashes[real], np.concatenate([[0], np.cumsum(real)])[words.off]


def block_frequencies(docs: DataFrame) -> tuple[np.ndarray, float]:
    """For each table cell the blocks that have a word of it, over all documents; and the number of blocks."""

    def run(batches):
        total = np.zeros(TABLE + 1)
        for batch in batches:
            for part in tk.slices(batch):
                hashes, off = stripped(part.column(0))
                count = np.diff(off)
                blocks = -(-count // BLOCK)
                inside = np.arange(len(hashes)) - np.repeat(off[:-1], count)
                block = np.repeat(np.concatenate([[0], np.cumsum(blocks)])[:-1], count) + inside // BLOCK
                pair = np.sort(block * TABLE + (hashes >> SHIFT).astype(np.int64))
                once = pair[np.concatenate([[True], pair[1:] != pair[:-1]])[: len(pair)]]
                total[:TABLE] += np.bincount(once % TABLE, minlength=TABLE)
                total[TABLE] += blocks.sum()
        return total

    total = partition_sums(docs.select("text"), run, (TABLE + 1,))
    return total[:TABLE], float(total[TABLE])


@dataclass
class Space:
    """Weights of words, the terms of the latent space, and its axes (terms x rank)."""

    idf: np.ndarray
    terms: np.ndarray | None  # sorted hashes of the benchmark's words; None: any word is one, in a cell by its hash
    cell: np.ndarray | None  # row of each term
    axes: np.ndarray

    def weight(self, hashes: np.ndarray) -> np.ndarray:
        return self.idf[(hashes >> SHIFT).astype(np.int64)]

    def cells(self) -> np.ndarray:
        """Which table cells have a term."""
        if not hasattr(self, "_cells"):
            self._cells = np.zeros(TABLE, bool)
            self._cells[(self.terms >> SHIFT).astype(np.int64)] = True
        return self._cells

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each word, or -1 for words that are not in the benchmark."""
        if self.terms is None:
            return (hashes % np.uint64(TERMS)).astype(np.int64)
        if not len(self.terms):
            return np.full(len(hashes), -1)
        maybe = np.flatnonzero(self.cells()[(hashes >> SHIFT).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.terms, hashes[maybe]), len(self.terms) - 1)
        out = np.full(len(hashes), -1)
        out[maybe] = np.where(self.terms[at] == hashes[maybe], self.cell[at], -1)
        return out

    def vector(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Rows, TF-IDF weights, and the length of the whole vector, words outside the benchmark included."""
        word, times = np.unique(hashes, return_counts=True)
        value = (1.0 + np.log(times)) * self.weight(word)
        row = self.rows(word)
        return row[row >= 0], value[row >= 0], float(np.sqrt((value * value).sum()))

    def fold(self, hashes: np.ndarray) -> np.ndarray:
        row, value, length = self.vector(hashes)
        return value @ self.axes[row] / length if length > 0 else np.zeros(self.axes.shape[1])


def randomised_svd(passages: DataFrame, space: Space, rows: int, rank: int, seed: int = 3, power: int = 2) -> np.ndarray:
    """The leading right singular vectors of the passages' TF-IDF matrix A.

    Subspace iteration on A'A from a Gaussian start; each product A'(A Q) is a sum over partitions,
    and only its ``rows`` x ``rank`` result, of bounded size, comes to the driver.
    """
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(rows, min(rank, rows))))[0]
    for _ in range(power + 1):
        held = passages.sparkSession.sparkContext.broadcast((space, q))

        def product(batches, held=held):
            space, q = held.value
            total = np.zeros(q.shape)
            for batch in batches:
                for raw in batch.column(0):
                    row, value, length = space.vector(np.frombuffer(raw.as_py(), np.uint64))
                    if length > 0:
                        np.add.at(total, row, np.outer(value / length, (value / length) @ q[row]))
            return total.ravel()

        b = partition_sums(passages.select("words"), product, q.shape)
        held.destroy()
        left, values, _ = np.linalg.svd(b, full_matrices=False)
        q = left[:, values > 1e-10 * max(values[0], 1e-300)] if len(values) else left
    return q


def lcs(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Length of the longest common subsequence, and the stretch of b that it lies in."""
    n, m = len(a), len(b)
    table = np.zeros((n + 1, m + 1), np.int32)
    for i in range(n):
        hit = table[i, :-1] + (b == a[i])
        table[i + 1, 1:] = np.maximum.accumulate(np.maximum(hit, table[i, 1:]))
    i, j, first, last = n, m, m, 0
    while i and j:
        if table[i, j] == table[i - 1, j]:
            i -= 1
        elif table[i, j] == table[i, j - 1]:
            j -= 1
        else:
            first, last = j - 1, max(last, j)
            i, j = i - 1, j - 1
    return int(table[n, m]), first, last


def stretches(a: np.ndarray, b: np.ndarray, most: int, need: float):
    """Length and place of long common subsequences in stretches of at most ``most`` words of b, the best ones first.

    The first is the whole subsequence, if its stretch is short enough; then, for every word of b that is in a,
    the longest subsequence within ``most`` words from there on, in the shortest such stretch. Only lengths of
    ``need`` or more are given.
    """
    length, lo, hi = lcs(a, b)
    if length < max(need, 1):
        return
    if hi - lo <= most:
        yield length, lo, hi
    starts = np.flatnonzero(np.isin(b, a))
    at = starts[:, None] + np.arange(most)
    there = at < len(b)
    near = b[np.minimum(at, len(b) - 1)]
    table = np.zeros((len(starts), most + 1), np.int16)
    for word in a:
        hit = table[:, :-1] + ((near == word) & there)
        table[:, 1:] = np.maximum.accumulate(np.maximum(hit, table[:, 1:]), axis=1)
    best = table[:, -1]
    ends = (table == best[:, None]).argmax(axis=1)
    for i in np.lexsort((ends, -best)):
        if best[i] < need:
            return
        yield int(best[i]), int(starts[i]), int(starts[i] + ends[i])


@dataclass
class Postings:
    """For each row of the space the passages that have it, with their unit-length TF-IDF weights."""

    off: np.ndarray
    passage: np.ndarray
    value: np.ndarray

    @staticmethod
    def of(words: list[np.ndarray], space: Space) -> Postings:
        found = [space.vector(w) for w in words]
        row = np.concatenate([r for r, _, _ in found])
        order = np.argsort(row, kind="stable")
        passage = np.repeat(np.arange(len(words)), [len(r) for r, _, _ in found])[order]
        value = np.concatenate([v / max(length, 1e-12) for _, v, length in found])[order]
        return Postings(np.searchsorted(row[order], np.arange(len(space.axes) + 1)), passage, value)

    def dense(self, a: int, z: int, passages: int) -> np.ndarray:
        """The weights of rows ``a`` to ``z`` as a table of rows and passages."""
        own = slice(self.off[a], self.off[z])
        row = np.repeat(np.arange(z - a), np.diff(self.off[a : z + 1]))
        return np.bincount(row * passages + self.passage[own], self.value[own], (z - a) * passages).reshape(z - a, passages)

    def sums(self, row: np.ndarray, value: np.ndarray, passages: int) -> np.ndarray:
        """The product of a vector with every passage."""
        size = self.off[row + 1] - self.off[row]
        at = np.repeat(self.off[row] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.bincount(self.passage[at], np.repeat(value, size) * self.value[at], passages)


@dataclass
class Passages:
    item: list
    times: list[int]  # rows of the benchmark that are this passage
    words: list[np.ndarray]
    answer: list[np.ndarray]
    latent: np.ndarray  # unit rows
    whole: Postings | None = None  # where the axes leave something out

    def cosines(self, space: Space, hashes: np.ndarray) -> np.ndarray:
        """Cosine of a window with every passage: the latent one, or the untruncated one if that is larger."""
        row, value, length = space.vector(hashes)
        if length <= 0:
            return np.zeros(len(self.words))
        near = self.latent @ (value @ space.axes[row] / length)
        return near if self.whole is None else np.maximum(near, self.whole.sums(row, value, len(self.words)) / length)


@dataclass
class Bounds:
    """For each term: the passages it adds most to, with how much, and a limit for what it adds to any other."""

    off: np.ndarray
    passage: np.ndarray
    value: np.ndarray
    other: np.ndarray

    @staticmethod
    def of(product: np.ndarray, rare: np.ndarray) -> Bounds:
        """``product`` (terms x passages): what a unit of each term's weight adds to each passage's cosine.

        Only terms marked ``rare`` are listed; frequent ones weigh little and are bounded together.
        """
        terms, n = product.shape
        k = min(LISTED, n)
        top = np.argsort(-product, axis=1, kind="stable")[:, : k + 1]
        values = np.maximum(np.take_along_axis(product, top, axis=1), 0.0)
        rest = values[:, k] if n > k else np.zeros(terms)
        # a term that adds about as much to many passages is not listed: its largest value bounds all
        listed = (rare & (rest < 0.5 * values[:, 0]))[:, None] & (values[:, :k] > rest[:, None])
        return Bounds(np.concatenate([[0], np.cumsum(listed.sum(1))]), top[:, :k][listed], values[:, :k][listed], np.where(listed.any(1), rest, values[:, 0]))

    @staticmethod
    def over(space: Space, passages: Passages, rare: np.ndarray) -> Bounds:
        """Bounds of all terms, from tables of at most ``CELLS`` terms and passages."""
        n = len(passages.words)
        step, parts = max(1, CELLS // n), []
        for a in range(0, len(space.axes), step):
            z = min(a + step, len(space.axes))
            product = space.axes[a:z] @ passages.latent.T
            parts.append(Bounds.of(product if passages.whole is None else np.maximum(product, passages.whole.dense(a, z, n)), rare[a:z]))
        off = np.cumsum(np.concatenate([[0]] + [np.diff(b.off) for b in parts]))
        return Bounds(off, *(np.concatenate([getattr(b, name) for b in parts]) for name in ("passage", "value", "other")))


def _dense(block: np.ndarray, passage: np.ndarray, value: np.ndarray, first: np.ndarray, passages: int) -> list[np.ndarray]:
    """The largest sum over passages of windows of 2 and 4 blocks; ``first`` is the first block of each block's text.

    Entries come in the order of blocks; a table holds about ``CELLS`` of them and the three blocks that follow.
    """
    n, tops = len(first), (np.zeros(len(first)), np.zeros(len(first)))
    width = max(8, CELLS // passages)
    for a in range(0, n, width):
        z = min(n, a + width + 3)
        own = slice(*np.searchsorted(block, [a, z]))
        one = np.bincount((block[own] - a) * passages + passage[own], value[own], (z - a) * passages).reshape(z - a, passages).astype(np.float32)
        for step, top in zip((1, 2), tops):
            one[:-step] += one[step:] * (first[a + step : z] == first[a : z - step])[:, None]
            top[a : a + width] = one[:width].max(axis=1, initial=0.0).astype(np.float64)[: len(top[a : a + width])] * (1 + 1e-5)
    return list(tops)


def _sparse(block: np.ndarray, passage: np.ndarray, value: np.ndarray, first: np.ndarray, passages: int) -> list[np.ndarray]:
    """The same without a table of blocks and passages."""
    tops = []
    for span in (2, 4):
        window = np.concatenate([block - j for j in range(span)])
        keep = (window >= 0) & (first[np.maximum(window, 0)] == np.tile(first[block], span))
        key, v = window[keep] * passages + np.tile(passage, span)[keep], np.tile(value, span)[keep]
        order = np.argsort(key, kind="stable")
        key, v, most = key[order], v[order], np.zeros(len(first))
        if len(key):
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            np.maximum.at(most, key[start] // passages, np.add.reduceat(v, start))
        tops.append(most)
    return tops


def _crowded(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Blocks that hold a word four times or more; only windows with one can hold a word 13 times."""
    at = begin[:, None] + np.arange(BLOCK)
    words = np.where(at < end[:, None], hashes[np.minimum(at, len(hashes) - 1)], np.arange(at.size, dtype=np.uint64).reshape(at.shape))
    words.sort(axis=1)
    return (words[:, 3:] == words[:, :-3]).any(axis=1)


def _range(hashes, begin, end, first, space: Space, bounds: Bounds, passages: int, cosine: float) -> list[np.ndarray]:
    """For blocks (word positions ``begin`` to ``end``, first block of their text): whether the window of 2, and of 4, may reach the limit."""
    row, idf = space.rows(hashes), space.weight(hashes)
    inside = row >= 0
    loose, whole = (np.concatenate([[0.0], np.cumsum(x)]) for x in (np.where(inside, idf * bounds.other[row], 0.0), idf * idf))
    # entries of listed terms: block, passage, product
    token = np.flatnonzero(inside & (bounds.off[row + 1] > bounds.off[row]))
    size = bounds.off[row[token] + 1] - bounds.off[row[token]]
    at = np.repeat(bounds.off[row[token]] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    block = np.repeat(np.searchsorted(begin, token, "right") - 1, size)
    value, passage = np.repeat(idf[token], size) * bounds.value[at], bounds.passage[at]
    sums = _dense if passages <= DENSE else _sparse
    crowded = np.concatenate([[0], np.cumsum(_crowded(hashes, begin, end))])
    out, n = [], len(begin)
    for span, most in zip((2, 4), sums(block, passage, value, first, passages)):
        last = np.minimum(np.arange(n) + span, n) - 1
        while (other := first[last] != first).any():
            last[other] -= 1
        stop = end[last]
        # a word repeated t times weighs 1 + log t times, whose square is at least t up to 12 times
        least = np.where(crowded[last + 1] > crowded[:-1], REPEATED, 1.0) * np.maximum(whole[stop] - whole[begin], 0.0)
        out.append(loose[stop] - loose[begin] + most >= (1 - 1e-6) * cosine * np.sqrt(least))
    return out


def screen(hashes: np.ndarray, off: np.ndarray, space: Space, bounds: Bounds, passages: int, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (text, start, end in words) whose cosine with some passage may reach the limit.

    What the listed terms of a window add is summed by passage; the rest is bounded by one sum. Blocks
    are taken ``RANGE`` at once, with the three that follow, however long a text is.
    """
    count = np.diff(off)
    blocks = -(-count // BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)])
    text = np.repeat(np.arange(len(count)), blocks)
    begin = off[text] + BLOCK * (np.arange(len(text)) - first[text])
    end = np.minimum(begin + BLOCK, off[text + 1])
    out = []
    for a in range(0, len(text), RANGE):
        z = min(len(text), a + RANGE + 3)
        lo, hi = begin[a], end[z - 1]
        ok = _range(hashes[lo:hi], begin[a:z] - lo, end[a:z] - lo, first[text[a:z]], space, bounds, passages, cosine)
        for span, good in zip((2, 4), ok):
            at = a + np.flatnonzero(good[:RANGE])
            out.append((text[at], begin[at] - off[text[at]], np.minimum(begin[at] + span * BLOCK, off[text[at] + 1]) - off[text[at]]))
    found = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
    order = np.argsort(found[0], kind="stable")
    return found[0][order], found[1][order], found[2][order]


class Shorts:
    """Passages of fewer than ``SHORT`` words by the hash of their sequence of words."""

    def __init__(self, passages: Passages):
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in range(1, SHORT):
            # the answer must be among the words, or there is nothing to find
            own = [p for p, w in enumerate(passages.words) if len(w) == n and not (len(passages.answer[p]) and np.isin(passages.answer[p], w).mean() < 0.5)]
            if own:
                key = self._keys(np.concatenate([passages.words[p] for p in own]), n)[::n]
                order = np.argsort(key, kind="stable")
                self.tables[n] = key[order], np.array(own)[order]

    @staticmethod
    def _keys(hashes: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the ``n`` words from each place on."""
        key = hashes[: len(hashes) - n + 1].copy()
        for i in range(1, n):
            key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + hashes[i : len(hashes) - n + 1 + i]
        return key

    def find(self, hashes: np.ndarray, off: np.ndarray) -> dict[int, dict[int, tuple[float, float, int, int]]]:
        """For each text that has some: the passages found, each at its first place, as ``find`` gives them."""
        found: dict[int, dict] = {}
        text = np.repeat(np.arange(len(off) - 1), np.diff(off))
        for n, (keys, owner) in self.tables.items():
            if len(hashes) < n:
                continue
            key = self._keys(hashes, n)
            first, last = np.searchsorted(keys, key), np.searchsorted(keys, key, side="right")
            for i in np.flatnonzero((last > first) & (text[: len(key)] == text[n - 1 :])):
                start = int(i - off[text[i]])
                for p in owner[first[i] : last[i]]:
                    found.setdefault(int(text[i]), {}).setdefault(int(p), (1.0, 1.0, start, start + n))
        return found


def likely(hashes: np.ndarray, off: np.ndarray, text: np.ndarray, start: np.ndarray, end: np.ndarray, space: Space, passages: Passages, cosine: float) -> np.ndarray:
    """Which windows (text, start, end in words) have a latent cosine of about the limit or more with some passage.

    Many windows are folded together in single precision, with ``SINGLE`` left for its error, so ``find`` takes the exact
    cosine of those alone that may have one. Where the axes leave something out, every window stays.
    """
    if passages.whole is not None or not len(text):
        return np.ones(len(text), bool)
    if not hasattr(passages, "_single"):
        passages._single = space.axes.astype(np.float32), np.ascontiguousarray(passages.latent.T, np.float32)
    axes, latent = passages._single
    word, code = np.unique(hashes, return_inverse=True)
    row, weight, n = space.rows(word), space.weight(word), len(word)
    begin, size, keep = off[text] + start, end - start, []
    cuts = np.searchsorted(np.cumsum(size), np.arange(FOLDED, size.sum() + FOLDED, FOLDED), "left")
    for a, z in zip(np.concatenate([[0], cuts]), np.append(cuts, len(text))):
        own, many = size[a:z], z - a
        at = np.repeat(begin[a:z] - np.cumsum(own) + own, own) + np.arange(own.sum())
        key = np.sort(np.repeat(np.arange(many), own) * n + code[at])
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
        window, term = np.divmod(key[first], n)
        value = (1.0 + np.log(np.diff(np.append(first, len(key))))) * weight[term]
        length = np.sqrt(np.bincount(window, value * value, many))
        known = np.flatnonzero(row[term] >= 0)
        folded = np.zeros((many, axes.shape[1]), np.float32)
        if len(known):
            window = window[known]
            at = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]]))
            folded[window[at]] = np.add.reduceat(axes[row[term[known]]] * value[known, None].astype(np.float32), at, axis=0)
        keep.append((folded @ latent).max(axis=1, initial=-1e30) >= (cosine - SINGLE) * np.maximum(length, 1e-12))
    return np.concatenate(keep)


def find(hashes: np.ndarray, windows: list[tuple[int, int]], space: Space, passages: Passages, cosine: float, least: float) -> dict[int, tuple[float, float, int, int]]:
    """In windows of one document: the passages found, each with cosine, covered share, and the stretch of words."""
    n = len(hashes)
    found: dict[int, tuple[float, float, int, int]] = {}
    for start, end in windows:
        near = passages.cosines(space, hashes[start:end])
        for p in np.flatnonzero(near >= cosine):
            words = passages.words[p]
            if len(words) < SHORT or p in found and found[p][1] >= 0.999:
                continue
            a, b = max(0, start - len(words)), min(n, end + len(words))
            if np.isin(words, hashes[a:b]).sum() < least * len(words):
                continue  # a common subsequence is no longer than the words found at all
            answer = passages.answer[p]
            for length, lo, hi in stretches(words, hashes[a:b], int(1.5 * len(words) + 4), least * len(words)):
                if len(answer) and np.isin(answer, hashes[a + lo : a + hi]).mean() < 0.5:
                    continue
                share = length / len(words)
                if p not in found or share > found[p][1]:
                    found[p] = (float(near[p]), share, int(a + lo), int(a + hi))
                break
    return found


def _passages(benchmark: DataFrame, answer: str | None) -> DataFrame:
    """Distinct passages (item_id, words, answer), how often each occurs, and the chunk it is in."""
    item = benchmark.schema["item_id"].dataType

    def cut(batches):
        for batch in batches:
            at, words, answers = [], [], []
            hashes, off = stripped(batch.column(1))
            wanted, wanted_off = stripped(batch.column(2))
            for i in range(batch.num_rows):
                own = hashes[off[i] : off[i + 1]]
                parts = max(1, -(-len(own) // PASSAGE))
                for part in np.array_split(own, parts):
                    if len(part):
                        at.append(i)
                        words.append(part.tobytes())
                        answers.append(wanted[wanted_off[i] : wanted_off[i + 1]].tobytes() if parts == 1 else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(words, pa.binary()), pa.array(answers, pa.binary())], ["item_id", "words", "answer"])

    wanted = F.col(answer).cast("string") if answer else F.lit("")
    rows = benchmark.select("item_id", "text", wanted.alias("answer")).mapInArrow(cut, f"item_id {item.simpleString()}, words binary, answer binary")
    return stash(rows.groupBy("item_id", "words", "answer").agg(F.count(F.lit(1)).alias("times")), "leak-passages")


def _terms(passages: DataFrame) -> np.ndarray | None:
    """The distinct words of all passages in order, or None if they are more than ``TERMS``."""

    def run(batches):
        for batch in batches:
            for part in tk.slices(batch, "words"):
                words = np.unique(np.frombuffer(b"".join(x.as_py() for x in part.column(0)), np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(tk.signed(words))], ["term"])

    found = stash(passages.select("words").mapInArrow(run, "term long").distinct(), "leak-terms")
    rows = found.limit(TERMS + 1).collect()
    return np.sort(np.array([r.term for r in rows], np.int64).view(np.uint64)) if len(rows) <= TERMS else None


def _known(rows: list, space: Space, whole: bool) -> Passages:
    """The passages of a chunk, with latent vectors, answers, and the untruncated weights if ``whole``."""
    words = [np.frombuffer(r.words, np.uint64) for r in rows]
    latent = np.array([space.fold(w) for w in words])
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)

    def rarest(w: np.ndarray) -> np.ndarray:
        own = np.unique(w)
        return own[np.argsort(-space.weight(own), kind="stable")[: max(1, len(own) // 4)]]

    answers = [np.unique(np.frombuffer(r.answer, np.uint64)) if r.answer else rarest(w) for r, w in zip(rows, words)]
    return Passages([r.item_id for r in rows], [r.times for r in rows], words, answers, latent, Postings.of(words, space) if whole else None)


def search(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.3, least: float = 0.6, answer: str | None = None) -> DataFrame:
    """doc_id, item_id, cosine, covered (share of the passage's words), start and n_words (in words) of each passage found."""
    spark = docs.sparkSession
    types = [t.schema[c].dataType for t, c in ((docs, "doc_id"), (benchmark, "item_id"))]
    schema = f"doc_id {types[0].simpleString()}, item_id {types[1].simpleString()}, cosine double, covered double, start int, n_words int"
    arrow = [to_arrow_type(t) for t in types] + [pa.float64(), pa.float64(), pa.int32(), pa.int32()]
    passages = _passages(benchmark, answer)
    n = passages.count()
    if not n:
        return spark.createDataFrame([], schema)
    counts, blocks = block_frequencies(docs)
    idf = np.log((blocks + 1.0) / (counts + 1.0)) + 0.01
    terms = _terms(passages)
    n_rows = TERMS if terms is None else len(terms)
    axes = randomised_svd(passages, Space(idf, terms, None if terms is None else np.arange(n_rows), np.zeros((n_rows, 0))), n_rows, RANK)
    chunks = -(-n // CHUNK)
    passages = passages.withColumn("chunk", F.pmod(F.xxhash64("item_id", "words", "answer"), F.lit(chunks)))
    found = []
    for chunk in range(chunks):
        rows = passages.where(F.col("chunk") == chunk).orderBy("words", "item_id").collect()  # about CHUNK of them
        if not rows:
            continue
        if terms is not None:
            space = Space(idf, terms, np.arange(n_rows), axes)
        else:  # the words of the chunk, on the axes of all
            own = np.unique(np.concatenate([np.frombuffer(r.words, np.uint64) for r in rows]))
            used, cell = np.unique(own % np.uint64(TERMS), return_inverse=True)
            space = Space(idf, own, cell, axes[used.astype(np.int64)])
        # with as many axes as passages and a row for each term the latent cosine is the untruncated one
        known = _known(rows, space, n > RANK or terms is None)
        largest = np.zeros(len(space.axes))
        np.maximum.at(largest, space.cell, space.weight(space.terms))
        held = spark.sparkContext.broadcast((space, known, Bounds.over(space, known, largest >= RARE * largest.max())))

        def run(batches, held=held):
            space, passages, bounds = held.value
            shorts = Shorts(passages)
            for batch in batches:
                for part in tk.slices(batch, most=SLICE):
                    hashes, off = stripped(part.column(1))
                    text, start, end = screen(hashes, off, space, bounds, len(passages.words), cosine)
                    near = likely(hashes, off, text, start, end, space, passages, cosine)
                    text, start, end = text[near], start[near], end[near]
                    whole = shorts.find(hashes, off)
                    at, out = [], []
                    for i in np.unique(np.concatenate([text, np.array(list(whole), np.int64)])):
                        own = slice(*np.searchsorted(text, [i, i + 1]))
                        hits = find(hashes[off[i] : off[i + 1]], list(zip(start[own], end[own])), space, passages, cosine, least)
                        hits |= whole.get(int(i), {})
                        for p, (c, s, a, b) in sorted(hits.items()):
                            at += [i] * passages.times[p]
                            out += [(passages.item[p], c, s, a, b - a)] * passages.times[p]
                    ids = part.column(0).take(pa.array(at, pa.int64())).cast(arrow[0])
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[j] for r in out], t) for j, t in enumerate(arrow[1:]))], ["doc_id", "item_id", "cosine", "covered", "start", "n_words"])

        found.append(docs.select("doc_id", "text").mapInArrow(run, schema))
    return reduce(DataFrame.unionByName, found)
