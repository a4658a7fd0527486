"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over blocks of examples.

Labelled rows outside the held-out fold give the examples: up to ``most`` of each class, the first
ones in the order of a hash of their ids (a documented bound; votes are weighted back to the class
sizes). Words are lower-cased and stripped of ASCII punctuation. The vector space is made of the
words that tell the classes apart on distinct example texts (chi-squared at least ``chi2``, and a
larger share of the toxic texts than of the clean ones has them, whatever the sizes of the two samples;
at most ``terms`` of them), weighted by document frequencies over all documents. The index holds the
weights of the common words in all examples and the postings of the others; block maxima of the cosines
in single precision bound the k-th neighbour from below, and all that may be nearer are computed again in
double precision, so the neighbours are exact.

Votes are weighted by distance, and made probabilities by an isotonic curve through the
leave-one-out votes of the examples. A text without any of these words has no neighbour; its score
is the share of toxic rows among such examples.

Defined cases: null and empty texts count as texts without words; without examples of both classes
every score is the toxic share of the labels (0 without labels); several labels of one document
count as their highest; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .quality import isotonic
from .store import held_out, partition_sums, stash

#: Examples of an index block.
SPAN = 128
#: Terms that are kept in a table of terms and examples; others have postings only.
COMMON = 256
#: Queries of a matrix product.
BATCH = 64
#: More than twice what single precision can be off over 2,048 terms.
SLACK = 5e-4
#: Query vectors whose result a task remembers.
REMEMBERED = 50_000


def term_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the stripped words of each text, and where each text's begin."""
    words = tk.trim(tk.split(column, lower=True))
    hashes = tk.word_hashes(words)
    real = words.end > words.start
    return hashes[real], np.concatenate([[0], np.cumsum(real)])[words.off]


@dataclass
class Vocabulary:
    """Sorted term hashes with their inverse document frequencies."""

    terms: np.ndarray
    idf: np.ndarray

    def at(self, hashes: np.ndarray) -> np.ndarray:
        """The index of each term, or -1."""
        if not len(self.terms):
            return np.full(len(hashes), -1)
        i = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[i] == hashes, i, -1)

    def vectors(self, column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """Term indices and unit-length weights of each text."""
        hashes, off = term_hashes(column)
        at = self.at(hashes)
        text = np.repeat(np.arange(len(off) - 1), np.diff(off))[at >= 0]
        pair, times = np.unique(text * (len(self.terms) + 1) + at[at >= 0], return_counts=True)
        text, term = np.divmod(pair, len(self.terms) + 1)
        weight = (1.0 + np.log(times)) * self.idf[term] if len(term) else np.zeros(0)
        edge = np.searchsorted(text, np.arange(len(off)))
        out = []
        for a, b in zip(edge[:-1], edge[1:]):
            norm = np.sqrt((weight[a:b] ** 2).sum())
            out.append((term[a:b], weight[a:b] / norm) if norm > 0 else (term[:0], weight[:0]))
        return out


class Index:
    """Examples in blocks, with the postings of each term and the terms of each example."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, label: np.ndarray, share: np.ndarray, n_terms: int):
        self.ids, self.label, self.share, self.n, self.n_terms = ids, label, share, len(ids), n_terms
        self.blocks = max(1, -(-self.n // SPAN))
        size = np.array([len(v[0]) for v in vectors], np.int64)
        self.own_off = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        self.own_term = np.concatenate([v[0] for v in vectors]) if vectors else np.zeros(0, np.int64)
        self.own_weight = np.concatenate([v[1] for v in vectors]) if vectors else np.zeros(0)
        example = np.repeat(np.arange(len(vectors)), size)
        order = np.lexsort((example, self.own_term))
        self.term_off = np.searchsorted(self.own_term[order], np.arange(n_terms + 1))
        self.example, self.weight = example[order], self.own_weight[order]
        self._table = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_table": None}  # each worker makes its own table

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """The row of each of the ``COMMON`` most frequent terms (-1 for others), and their weights in all examples."""
        if self._table is None:
            common = np.argsort(-np.diff(self.term_off), kind="stable")[:COMMON]
            row, weights = np.full(self.n_terms, -1), np.zeros((len(common), self.blocks * SPAN), np.float32)
            row[common] = np.arange(len(common))
            for r, t in enumerate(common):
                a, z = self.term_off[t], self.term_off[t + 1]
                weights[r, self.example[a:z]] = self.weight[a:z]
            self._table = row, weights
        return self._table

    def _cosines(self, query: tuple[np.ndarray, np.ndarray], at: np.ndarray) -> np.ndarray:
        """Cosines with the examples ``at`` in double precision."""
        full = np.zeros(self.n_terms)
        full[query[0]] = query[1]
        off = self.own_off[at]
        size = self.own_off[at + 1] - off
        start = np.cumsum(size) - size
        entry = np.repeat(off - start, size) + np.arange(size.sum())
        return np.add.reduceat(full[self.own_term[entry]] * self.own_weight[entry], start) if len(at) else np.zeros(0)

    def nearest_all(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: np.ndarray | None = None):
        """For each query the positions and cosines of the k nearest examples, equal cosines in the order of the index.

        Cosines in single precision, by a matrix product for common terms and by postings for others, only
        choose examples: the k-th largest of the block maxima is a lower bound of the k-th cosine, and
        whatever comes within ``SLACK`` of it is computed again in double precision, so the neighbours are exact.
        """
        row, weights = self.table()
        for first in range(0, len(queries), BATCH):
            part = queries[first : first + BATCH]
            common = np.zeros((len(part), len(weights)), np.float32)
            for i, (t, w) in enumerate(part):
                there = row[t] >= 0
                common[i, row[t][there]] = w[there]
            scores = common @ weights
            for i, query in enumerate(part):
                score = scores[i]
                rare = row[query[0]] < 0
                for t, w in zip(query[0][rare], query[1][rare]):
                    a, z = self.term_off[t], self.term_off[t + 1]
                    score[self.example[a:z]] += np.float32(w) * self.weight[a:z]
                if without is not None and without[first + i] >= 0:
                    score[without[first + i]] = 0.0
                top = score.reshape(self.blocks, SPAN).max(axis=1)
                least = np.partition(top, self.blocks - k)[self.blocks - k] - SLACK if self.blocks >= k else 0.0
                at = np.flatnonzero((score >= least) & (score > 0) if least > 0 else score > 0)
                cosine = self._cosines(query, at)
                order = np.lexsort((at, -cosine))[:k]
                yield at[order], cosine[order]

    def nearest(self, query: tuple[np.ndarray, np.ndarray], k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        return next(self.nearest_all([query], k, np.array([without])))

    def vote(self, at: np.ndarray, cosine: np.ndarray) -> float:
        """Share of toxic weight among neighbours: nearer ones and rarer classes count more."""
        w = self.share[at] / (1.05 - np.minimum(cosine, 1.0))
        return float((w * self.label[at]).sum() / w.sum())


def examples(docs: DataFrame, labels: DataFrame, most: int) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, text and label of the examples, and how many labelled rows each class has."""
    known = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label")).where(~held_out())
    known = stash(known, "toxic-labels")
    sizes = {r.label: r.n for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = (F.xxhash64("doc_id"), "doc_id")
    chosen = known.where("label = 1").orderBy(*order).limit(most).unionByName(known.where("label = 0").orderBy(*order).limit(most))
    chosen = stash(chosen, "toxic-chosen")
    # at most 2 * most rows of 12 bytes
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), sizes


def choose_terms(rows: DataFrame, terms: int, chi2: float) -> np.ndarray:
    """Hashes of the words whose presence depends on the class, over distinct example texts."""

    def run(batches):
        for batch in batches:
            for part in tk.slices(batch, most=1 << 20):
                hashes, off = term_hashes(part.column(0))
                text = np.repeat(np.arange(part.num_rows), np.diff(off))
                order = np.lexsort((hashes, text))
                hashes, text = hashes[order], text[order]
                once = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])])[: len(hashes)]
                yield pa.RecordBatch.from_arrays([pa.array(tk.signed(hashes[once])), pa.array(np.asarray(part.column(1))[text[once]].astype(np.int32))], ["term", "label"])

    distinct = stash(rows.groupBy("text").agg(F.max("label").alias("label")), "toxic-texts")
    n1, n0 = distinct.agg(F.sum("label"), F.sum(1 - F.col("label"))).first()
    if not n1 or not n0:
        return np.zeros(0, np.uint64)
    counts = distinct.select("text", "label").mapInArrow(run, "term long, label int").groupBy("term").agg(F.sum("label").cast("double").alias("a"), F.sum(1 - F.col("label")).cast("double").alias("b"))
    n, c, d = float(n1 + n0), F.lit(float(n1)) - F.col("a"), F.lit(float(n0)) - F.col("b")
    a, b = F.col("a"), F.col("b")
    stat = F.lit(n) * (a * d - b * c) ** 2 / ((a + b) * (c + d) * float(n1) * float(n0))
    found = counts.where((a >= 3) & (a * float(n0) > b * float(n1)) & ((c + d) > 0)).withColumn("stat", stat).where(F.col("stat") >= chi2)
    found = found.orderBy(F.desc("stat"), "term").limit(terms).select("term").collect()
    return np.sort(np.array([r.term for r in found], np.int64).view(np.uint64))


def document_frequencies(docs: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, float]:
    """Over all documents: how many have each term, and how many there are."""
    space = Vocabulary(terms, np.ones(len(terms)))

    def run(batches):
        total = np.zeros(len(terms) + 1)
        for batch in batches:
            for part in tk.slices(batch):
                hashes, off = term_hashes(part.column(0))
                at = space.at(hashes)
                text = np.repeat(np.arange(part.num_rows), np.diff(off))[at >= 0]
                once = np.unique(text * (len(terms) + 1) + at[at >= 0]) % (len(terms) + 1)
                total += np.bincount(once, minlength=len(terms) + 1)
                total[-1] += part.num_rows
        return total

    total = partition_sums(docs.select("text"), run, (len(terms) + 1,))
    return total[:-1], float(total[-1])


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, k: int = 15, most: int = 10_000, terms: int = 2048, chi2: float = 30.0) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence (nearest examples with cosine and label) of every document."""
    rows, sizes = examples(docs, labels, most)
    rows = stash(rows, "toxic-examples")
    chosen = choose_terms(rows.select("text", "label"), terms, chi2)
    counts, n_docs = document_frequencies(docs, chosen)
    space = Vocabulary(chosen, np.log((n_docs + 1.0) / (counts + 1.0)) + 1.0)

    def vectors(batches):
        for batch in batches:
            for part in tk.slices(batch):
                v = space.vectors(part.column(1))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array([x.astype(np.int64).tobytes() for x, _ in v], pa.binary()), pa.array([y.tobytes() for _, y in v], pa.binary())], ["doc_id", "label", "term", "weight"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = rows.select("doc_id", "text", "label").mapInArrow(vectors, f"doc_id {kind}, label int, term binary, weight binary").orderBy("doc_id", "label", "term", "weight").collect()
    vecs = [(np.frombuffer(r.term, np.int64), np.frombuffer(r.weight)) for r in found]
    label = np.array([r.label for r in found], float)
    per_class = {c: max(1, int((label == c).sum())) for c in (0, 1)}
    share = np.array([sizes.get(int(c), 0) / per_class[int(c)] for c in label])
    some = np.array([len(v[0]) > 0 for v in vecs], bool)
    at = np.flatnonzero(some)
    index = Index([vecs[i] for i in at], np.array([found[i].doc_id for i in at]), label[at], share[at], len(chosen))
    none = share[~some]
    prior = float((share * label).sum() / share.sum()) if len(share) else 0.0
    silent = float((none * label[~some]).sum() / none.sum()) if len(none) else prior
    votes = np.array([index.vote(*near) if len(near[0]) else silent for near in index.nearest_all([vecs[i] for i in at], k, np.arange(len(at)))])
    if len(at):
        order = np.argsort(votes, kind="stable")
        knots, level = isotonic(votes[order], share[at][order], (share * label)[at][order])
    else:
        knots, level = np.zeros(1), np.full(1, prior)

    def run(batches):
        known: dict[bytes, tuple] = {}
        nothing = (silent, [], [], [])

        def judged(vectors):
            if len(known) >= REMEMBERED:
                known.clear()
            keys = [t.tobytes() + w.tobytes() for t, w in vectors]
            new = {key: v for key, v in zip(keys, vectors) if len(v[0]) and key not in known}
            for key, (near, c) in zip(new, index.nearest_all(list(new.values()), k)):
                known[key] = (
                    (float(np.interp(index.vote(near, c), knots, level)), list(index.ids[near[:3]]), list(c[:3]), list(index.label[near[:3]].astype(int))) if len(near) else nothing
                )
            return [known.get(key, nothing) for key in keys]

        for batch in batches:
            for part in tk.slices(batch):
                score, ids, cos, lab = zip(*judged(space.vectors(part.column(1))))
                score = np.clip(np.array(score, float), 0.0, 1.0)
                kinds = (part.schema.field(0).type, pa.float64(), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))] + [pa.array(x, pa.list_(t)) for x, t in zip((ids, cos, lab), kinds)],
                    ["doc_id", "score", "predicted", "near_ids", "near_cosines", "near_labels"],
                )

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int, near_ids array<{kind}>, near_cosines array<double>, near_labels array<int>")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted", "near_ids", "near_cosines", "near_labels")
