"""Secret scan: candidate strings, and a random forest that removes false positives.

A candidate is a run of at least ``SHORTEST`` characters of ``A-Z a-z 0-9 + / _ -`` with a digit.
Features are its length, character classes and transitions between them, how much of it frequent
words of all documents cover, the path-like surroundings, and the neighbouring words. The forest is
trained on labelled findings (doc_id, start, label); ``seed_findings`` labels the candidates whose
form or assignment leaves no doubt and leaves the others open.

Defined cases: null and empty texts have no candidates; candidates of repeated rows are each
returned; without findings of both classes the probability is the share of secrets among the
findings (0 without any); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .store import held_out, stash

SHORTEST = 16
#: Bytes before and after a candidate that count as its surroundings.
NEAR = 48
#: Frequent words of the dictionary, and the shortest one that counts.
DICTIONARY, WORD = 8192, 3

ALPHABET = np.zeros(256, bool)
ALPHABET[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")] = True
DIGITS = np.zeros(256, bool)
DIGITS[48:58] = True
LETTERS = np.ones(256, bool)
LETTERS[65:91] = LETTERS[97:123] = False

# Words that name secrets, and prefixes of issued keys.
NAMES = re.compile(rb"(?i)(token|secret|passw|pwd|passphrase|api.?key|access.?key|private.?key|auth|bearer|credential)")
ISSUED = re.compile(rb"(AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk_live_[0-9A-Za-z]{24}|xox[bp]-[0-9A-Za-z-]{20,}")
ASSIGNED = re.compile(rb"""(?i)(token|secret|passw\w*|pwd|\w*key)\s*[=:]\s*["']?$""")
HARMLESS = re.compile(rb"(?i)example|sample|dummy|placeholder|test|xxxx")

FEATURES = (
    "length", "entropy", "digits", "uppers", "lowers", "marks", "hex", "transitions", "distinct", "longest_run",
    "dictionary", "slashes", "at_sign", "dots", "assigned", "quoted", "named", "named_far", "issued", "number_before", "letters_before", "letters_after",
)


def dictionary(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of the most frequent words of letters over all documents."""

    def run(batches):
        for batch in batches:
            word, n = [], []
            for part in tk.slices(batch):
                words = tk.split(part.column(0), LETTERS, lower=True)
                hashes = tk.word_hashes(words)[words.end - words.start >= WORD]
                x, times = np.unique(hashes, return_counts=True)
                word.append(x)
                n.append(times)
            if word:
                x, back = np.unique(np.concatenate(word), return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(tk.signed(x)), pa.array(np.bincount(back, np.concatenate(n)).astype(np.int64))], ["word", "n"])

    counts = docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "word").limit(DICTIONARY).collect()
    return np.sort(np.array([r.word for r in top], np.int64).view(np.uint64))


def covered(value: bytes, words: np.ndarray) -> float:
    """Share of the bytes inside dictionary words, longest words first at each place."""
    text, done, i = value.lower(), 0, 0
    n = len(text)
    if not len(words) or n < WORD:
        return 0.0
    data, longest = np.frombuffer(text, np.uint8), np.zeros(n, np.int64)
    for size in range(WORD, min(n, 12) + 1):
        start = np.arange(n - size + 1)
        hashes = tk.word_hashes(tk.Words(data, np.array([0, n]), start, start + size, np.array([0, len(start)])))
        at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
        longest[start[words[at] == hashes]] = size
    while i < n:
        done, i = (done + longest[i], i + longest[i]) if longest[i] else (done, i + 1)
    return done / n


def features(value: bytes, before: bytes, after: bytes, words: np.ndarray) -> list[float]:
    data = np.frombuffer(value, np.uint8)
    n = len(data)
    kind = np.select([DIGITS[data], (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)], [0, 1, 2], 3)
    p = np.unique(data, return_counts=True)[1] / n
    edge = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1], [True]]))
    left, right = before.rsplit(None, 1)[-1] if before.split() else b"", after.split(None, 1)[0] if after.split() else b""
    words_before = before.split()
    around = left * (not before[-1:].isspace()) + right * (not after[:1].isspace())
    return [
        float(n), float(-(p * np.log2(p)).sum()), *[float((kind == k).mean()) for k in range(4)],
        float(re.fullmatch(rb"[0-9a-fA-F]+", value) is not None), (len(edge) - 2) / n, len(p) / n, float(np.diff(edge).max()),
        covered(value, words), float(value.count(b"/") + around.count(b"/")), float(b"@" in around), float(around.count(b".")),
        float(re.search(rb"[=:]\s*[\"']?$", before) is not None), float(before[-1:] in (b'"', b"'")),
        float(NAMES.search(b" ".join(words_before[-3:])) is not None), float(NAMES.search(before) is not None), float(ISSUED.match(value) is not None),
        float(bool(words_before) and DIGITS[np.frombuffer(words_before[-1], np.uint8)].mean() > 0.5), float(before[-1:].isalpha()), float(after[:1].isalpha()),
    ]


def seed_label(value: bytes, before: bytes) -> int | None:
    """1 for issued key forms and for mixed values assigned to a secret's name, 0 for plain numbers, placeholders and word-like strings; else open."""
    if HARMLESS.search(value) or not re.search(rb"[A-Za-z]", value):
        return 0
    if ISSUED.fullmatch(value) or (ASSIGNED.search(before) and re.search(rb"[0-9].*[A-Za-z]|[A-Za-z].*[0-9]", value)):
        return 1
    return 0 if not re.search(rb"[0-9].*[A-Za-z].*[0-9]", value) else None


def candidates(docs: DataFrame, words) -> DataFrame:
    """doc_id, start (characters), length, preview, features and the seed label of each candidate; ``words`` is a broadcast dictionary."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            at, start, length, preview, values, seeds = [], [], [], [], [], []
            for part_no, part in enumerate(tk.slices(batch)):
                runs = tk.split(part.column(1), ~ALPHABET)
                digits = np.concatenate([[0], np.cumsum(DIGITS[runs.data])])
                long = np.flatnonzero((runs.end - runs.start >= SHORTEST) & (digits[runs.end] > digits[runs.start]))
                text = np.searchsorted(runs.off, long, "right") - 1
                ids = part.column(0)
                for i, t in zip(long, text):
                    a, b, lo, hi = int(runs.start[i]), int(runs.end[i]), int(runs.text_off[t]), int(runs.text_off[t + 1])
                    value, before, after = (runs.data[x:y].tobytes() for x, y in ((a, b), (max(lo, a - NEAR), a), (b, min(hi, b + NEAR))))
                    at.append(ids[int(t)].as_py())
                    start.append(len(runs.data[lo:a].tobytes().decode("utf-8", "replace")))
                    length.append(b - a)
                    preview.append(value[:4].decode() + "***")
                    values.append(features(value, before, after, words.value))
                    seeds.append(seed_label(value, before))
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, batch.schema.field(0).type), pa.array(start, pa.int32()), pa.array(length, pa.int32()), pa.array(preview, pa.string()), pa.array(values, pa.list_(pa.float64())), pa.array(seeds, pa.int32())],
                ["doc_id", "start", "length", "preview", "features", "seed"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start int, length int, preview string, features array<double>, seed int")


def scan(docs: DataFrame, findings: DataFrame | None = None, threshold: float = 0.5, trees: int = 40, depth: int = 8, most: int = 20_000) -> DataFrame:
    """doc_id, start, length, preview, held_out, probability and is_secret of every candidate.

    ``findings`` (doc_id, start, label) are labelled candidates; without them the seed labels are
    used. The forest is fitted on at most ``most`` of them, the first ones by a hash, from documents
    outside the held-out fold.
    """
    spark = docs.sparkSession
    words = spark.sparkContext.broadcast(dictionary(docs))  # DICTIONARY hashes
    found = stash(candidates(docs, words), "secret-candidates")
    if findings is None:
        labelled = found.where("seed is not null").withColumn("label", F.col("seed").cast("double"))
    else:
        labelled = found.join(findings.where("label is not null").groupBy("doc_id", "start").agg(F.max("label").cast("double").alias("label")), ["doc_id", "start"])
    labelled = labelled.where(~held_out()).orderBy(F.xxhash64("doc_id", "start"), "doc_id", "start").limit(most)
    labelled = stash(labelled.select(array_to_vector("features").alias("vector"), "label"), "secret-findings")
    n, share, lo, hi = labelled.agg(F.count(F.lit(1)), F.avg("label"), F.min("label"), F.max("label")).first()
    out = found.select("doc_id", "start", "length", "preview", F.coalesce(held_out(), F.lit(False)).alias("held_out"), array_to_vector("features").alias("vector"))
    if not n or lo == hi:
        out = out.withColumn("probability", F.lit(float(share or 0.0)))
    else:
        forest = RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=trees, maxDepth=depth, seed=17, probabilityCol="votes", predictionCol="_class", rawPredictionCol="_raw").fit(labelled)
        out = forest.transform(out).withColumn("probability", vector_to_array("votes")[1])
    return out.select("doc_id", "start", "length", "preview", "held_out", "probability", (F.col("probability") >= threshold).alias("is_secret"))
