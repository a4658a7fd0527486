"""A hidden Markov language model: Baum-Welch training and exact sequence likelihood.

Words are counted over all training texts. The ``emit`` most frequent ones (by count, to about one
percent) are symbols of their own; all others belong to one of ``CLASSES`` symbols by their last two bytes, and inside a class a word
with count c has probability (c + 1) / (class tokens + class words + 1), the last 1 for the words
never seen. So the model gives every text a probability. Counts of about ``head`` most frequent words
travel in a table of fixed size; the counts of all rarer words are joined by word.

Training starts from a noisy unigram model. In each round every partition sums expected counts of
starts, transitions and emissions over whole texts, and the sums of all partitions make the next model.
The first ``shares`` rounds take a disjoint share of the training texts each, all texts together; the
last ``rounds`` take all of them. Scores come from the scaled forward recursion over whole texts.

Defined cases: a null or empty text is the end token alone; without training texts every base token
has probability 1 and the model is uniform over symbols; repeated rows are scored one by one; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .store import discard, held_out, partition_sums, stash

#: Symbols for words that have none of their own.
CLASSES = 64
#: About how many tokens are worked on at once; a longer text is taken alone.
WORK = 1 << 20
#: Distinct words a counting task holds before it passes them on.
HELD = 1 << 20


def word_classes(words: tk.Words) -> np.ndarray:
    last = words.data[words.end - 1].astype(np.int64)
    one = words.end - words.start > 1
    before = np.where(one, words.data[np.maximum(words.end - 2, 0)], 0).astype(np.int64)
    return (last * 31 + before * 7) % CLASSES


def count_words(texts: DataFrame) -> DataFrame:
    """word (hash), class and n over all texts."""

    def run(batches):
        parts, rows = [], 0

        def merged():
            word, cls, n = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(word, kind="stable")
            word, cls, n = word[order], cls[order], n[order]
            start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            return word[start], cls[start], np.add.reduceat(n, start)

        def out(x):
            return pa.RecordBatch.from_arrays([pa.array(tk.signed(x[0])), pa.array(x[1].astype(np.int32)), pa.array(x[2])], ["word", "class", "n"])

        for batch in batches:
            for part in tk.slices(batch):
                words = tk.split(part.column(0), lower=True)
                if not len(words.start):
                    continue
                word, first, n = np.unique(tk.word_hashes(words), return_index=True, return_counts=True)
                parts.append((word, word_classes(words)[first], n.astype(np.int64)))
                rows += len(word)
                if rows > 2 * HELD:
                    parts = [merged()]
                    rows = len(parts[0][0])
                    if rows > HELD:
                        yield out(parts[0])
                        parts, rows = [], 0
        if parts:
            yield out(merged())

    return texts.select("text").mapInArrow(run, "word long, class int, n long").groupBy("word", "class").agg(F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """Frequent words with their counts and symbols, and totals of everything else."""

    words: np.ndarray  # sorted hashes
    counts: np.ndarray
    symbols: np.ndarray  # own symbol, or -1 for a word of a class
    own: int
    end_count: int
    tokens: int
    distinct: int
    class_tokens: np.ndarray
    class_words: np.ndarray
    unigram: np.ndarray  # probability of each symbol, the last one is the end

    @property
    def log_total(self) -> float:
        return float(np.log10(self.tokens + self.distinct + 1))

    @property
    def log_class(self) -> np.ndarray:
        return np.log10(self.class_tokens + self.class_words + 1.0)


def lexicon(counts: DataFrame, texts: int, emit: int, head: int) -> Lexicon:
    # words by size class of their count, a few thousand classes: whole ones from the largest down, then the
    # next one's words below a bound of their hash
    size = F.floor(F.log2("n") * 64).cast("int")
    sizes = counts.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("w")).orderBy(F.desc("size")).collect()
    upto = np.concatenate([[0], np.cumsum([r.w for r in sizes], dtype=np.int64)])
    whole = int((upto[1:] <= head).sum())
    taken = size >= (sizes[whole - 1]["size"] if whole else 1 << 30)
    if whole < len(sizes):
        bound = int(0.9 * (head - int(upto[whole])) / sizes[whole].w * 2.0**64) - 2**63
        taken = taken | ((size == sizes[whole]["size"]) & (F.col("word") < bound))
    top = counts.where(taken).select("word", "n", size.alias("size")).toPandas().sort_values(["size", "word"], ascending=[False, True], ignore_index=True)
    totals = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    rest = counts
    own = min(emit, len(top))
    if own:
        last_size, last_word = int(top["size"].iloc[own - 1]), int(top["word"].iloc[own - 1])
        rest = counts.where((size < last_size) | ((size == last_size) & (F.col("word") > last_word)))
    class_tokens, class_words = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in rest.groupBy("class").agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("w")).collect():
        class_tokens[r["class"]], class_words[r["class"]] = r.t, r.w
    word, n = top["word"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(word)
    symbol = np.where(np.arange(len(top)) < own, np.arange(len(top)), -1)
    unigram = np.concatenate([n[:own], class_tokens, [texts]]) + 0.5
    return Lexicon(word[order], n[order], symbol[order], own, texts, int(totals[0] or 0) + texts, int(totals[1]) + (texts > 0), class_tokens, class_words, unigram / unigram.sum())


def encode(docs: DataFrame, shared) -> DataFrame:
    """A row a text: tokens, known tokens and log sums that the lexicon knows; symbols; words to be looked up.

    ``shared`` is the broadcast lexicon.
    """

    def run(batches):
        lex = shared.value
        for batch in batches:
            for part in tk.slices(batch):
                words = tk.split(part.column(2), lower=True)
                hashes, cls = tk.word_hashes(words), word_classes(words) if len(words.start) else np.zeros(0, np.int64)
                at = np.minimum(np.searchsorted(lex.words, hashes), max(len(lex.words) - 1, 0))
                known = lex.words[at] == hashes if len(lex.words) else np.zeros(len(hashes), bool)
                count = np.where(known, lex.counts[at], 0) if len(lex.words) else np.zeros(len(hashes), np.int64)
                symbol = np.where(known, lex.symbols[at], -1) if len(lex.words) else np.full(len(hashes), -1)
                rare = symbol < 0
                symbol = np.where(rare, lex.own + cls, symbol)
                seen = np.where(known, np.log10(count + 1.0), 0.0)
                inner = np.where(rare, seen - lex.log_class[cls], 0.0)
                total = lambda x: (t := np.concatenate([[0], np.cumsum(x)]))[words.off[1:]] - t[words.off[:-1]]
                n = words.count + 1
                base = total(seen) + np.log10(lex.end_count + 1.0) - n * lex.log_total
                all_symbols = np.insert(symbol, words.off[1:], lex.own + CLASSES).astype(np.uint16)
                off = np.concatenate([[0], np.cumsum(n)])
                away, away_off = hashes[~known], np.concatenate([[0], np.cumsum(~known)])[words.off]
                pack = lambda x, o: pa.array([x[a:b].tobytes() for a, b in zip(o[:-1], o[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n.astype(np.int64)), pa.array(total(known).astype(np.int64) + (lex.end_count > 0)), pa.array(base), pa.array(total(inner)), pack(all_symbols, off), pack(away, away_off)],
                    ["doc_id", "held_out", "n_tokens", "known", "base", "inner", "symbols", "away"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "held_out", "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, known long, base double, inner double, symbols binary, away binary")


def longest_first(seqs: list[np.ndarray]) -> np.ndarray:
    return np.argsort([-len(s) for s in seqs], kind="stable")


def packed(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all sequences by place, the longest sequence first; where each place begins; and how many sequences have it."""
    flat = [seqs[i] for i in longest_first(seqs)]
    size = np.array([len(s) for s in flat], np.int64)
    active = np.searchsorted(-size, -np.arange(size.max(initial=0)), "left")
    row = np.cumsum(active) - active
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    symbol = np.zeros(len(place), np.int64)
    if len(place):
        symbol[row[place] + np.repeat(np.arange(len(flat)), size)] = np.concatenate(flat)
    return symbol, row, active


@dataclass
class Hmm:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbols x states

    @staticmethod
    def noisy(unigram: np.ndarray, states: int, seed: int = 5) -> Hmm:
        rng = np.random.default_rng(seed)
        emit = unigram[:, None] * np.exp(rng.normal(0.0, 0.7, (len(unigram), states)))
        move = np.full((states, states), 0.2 / max(states - 1, 1)) + np.eye(states) * (0.8 - 0.2 / max(states - 1, 1))
        return Hmm(np.full(states, 1.0 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    def expected(self, seqs: list[np.ndarray]) -> np.ndarray:
        """Expected starts, transitions and emissions of the sequences, in one flat array."""
        k, m = len(self.start), len(self.emit)
        total = np.zeros(k + k * k + m * k)
        emit, move, start = self.emit.astype(np.float32), self.move.astype(np.float32), self.start.astype(np.float32)
        symbol, row, active = packed(seqs)
        if not len(active):
            return total
        alpha, scale = np.zeros((len(symbol), k), np.float32), np.ones(len(symbol), np.float32)
        for t, n in enumerate(active):
            at = slice(row[t], row[t] + n)
            a = (start if t == 0 else alpha[row[t - 1] : row[t - 1] + n] @ move) * emit[symbol[at]]
            scale[at] = a.sum(1)
            alpha[at] = a / scale[at, None]
        beta, moves = np.ones((active[0], k), np.float32), np.zeros((k, k))
        for t in range(len(active) - 2, -1, -1):
            n = active[t + 1]
            at, now = slice(row[t + 1], row[t + 1] + n), slice(row[t], row[t] + n)
            b = emit[symbol[at]] * beta[:n] / scale[at, None]
            moves += alpha[now].T @ b
            beta[:n] = b @ move.T
            alpha[now] *= beta[:n]
        total[:k] += alpha[: active[0]].sum(0, dtype=np.float64)
        total[k : k + k * k] += (moves * move).ravel()
        emitted = total[k + k * k :].reshape(m, k)
        for j in range(k):
            emitted[:, j] += np.bincount(symbol, alpha[:, j], m)
        return total

    def updated(self, total: np.ndarray, unigram: np.ndarray, weight: float = 20.0) -> Hmm:
        """The model of expected counts, with the unigram model as a prior of ``weight`` tokens a state."""
        k, m = len(self.start), len(self.emit)
        start, move, emit = total[:k] + 1.0, total[k : k + k * k].reshape(k, k) + 0.1, total[k + k * k :].reshape(m, k) + weight * unigram[:, None]
        return Hmm(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    def log10(self, seqs: list[np.ndarray]) -> np.ndarray:
        """log10 of each sequence's probability, by the scaled forward recursion in double precision."""
        symbol, row, active = packed(seqs)
        alpha, logs = np.tile(self.start, (len(seqs), 1)), np.zeros(len(seqs))
        for t, n in enumerate(active):
            a = (alpha[:n] if t == 0 else alpha[:n] @ self.move) * self.emit[symbol[row[t] : row[t] + n]]
            s = a.sum(1)
            logs[:n] += np.log10(s)
            alpha[:n] = a / s[:, None]
        out = np.zeros(len(seqs))
        out[longest_first(seqs)] = logs
        return out


def _sequences(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), np.uint16).astype(np.int64) for x in column]


def train(encoded: DataFrame, lex: Lexicon, states: int, rounds: int, shares: int) -> Hmm:
    """Baum-Welch: a round on each of ``shares`` disjoint parts of the texts, which together hold all of them, then ``rounds`` on all."""
    spark = encoded.sparkSession
    model = Hmm.noisy(lex.unigram, states)
    size = states + states * states + len(lex.unigram) * states
    share = F.pmod(F.xxhash64("doc_id", "symbols"), F.lit(max(shares, 1)))
    for texts in [encoded.where(share == i) for i in range(shares)] + [encoded] * rounds:
        now = spark.sparkContext.broadcast(model)  # states x symbols, a fixed size

        def run(batches, now=now):
            total = np.zeros(size)
            for batch in batches:
                for part in tk.slices(batch, "symbols", 2 * WORK):
                    total += now.value.expected(_sequences(part.column(0)))
            return total

        total = partition_sums(texts.select("symbols"), run, (size,))
        if total.any():  # a share of a small table may be empty
            model = model.updated(total, lex.unigram)
        now.destroy()
    return model


def score(docs: DataFrame, states: int = 8, rounds: int = 3, emit: int = 32_000, head: int = 262_144, shares: int = 8) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.coalesce(held_out(by=7, rest=2), F.lit(False)).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    counts = stash(count_words(texts.where("not held_out")), "hmm-counts")
    lex = lexicon(counts, texts.where("not held_out").count(), emit, head)
    shared = spark.sparkContext.broadcast(lex)  # about ``head`` words
    encoded = stash(encode(texts, shared).withColumn("row", F.monotonically_increasing_id()), "hmm-encoded")
    shared.destroy()
    model = spark.sparkContext.broadcast(train(encoded.where("not held_out"), lex, states, rounds, shares))

    def forward(batches):
        for batch in batches:
            for part in tk.slices(batch, "symbols", 2 * WORK):
                logs = model.value.log10(_sequences(part.column(part.num_columns - 1)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(logs)], [*part.schema.names[:-1], "forward"])

    def away(batches):
        for batch in batches:
            for part in tk.slices(batch, "away"):
                # a word once a text, however often the text has it
                words = [np.unique(np.frombuffer(x.as_py(), np.int64), return_counts=True) for x in part.column(1)]
                row = np.repeat(np.asarray(part.column(0)), [len(w) for w, _ in words])
                yield pa.RecordBatch.from_arrays([pa.array(row), *(pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*words))], ["row", "word", "times"])

    looked_up = encoded.select("row", "away").where(F.length("away") > 0).mapInArrow(away, "row long, word long, times long").join(counts.select("word", "n"), "word")
    looked_up = stash(looked_up.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more"), F.sum("times").alias("found")), "hmm-away")
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = ("row", "doc_id", "held_out", "n_tokens", "known", "base", "inner")
    scored = encoded.select(*columns, "symbols").mapInArrow(
        forward, f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, inner double, forward double"
    )
    scored = stash(scored, "hmm-scored")
    discard(counts, encoded)
    model.destroy()
    return scored.join(looked_up, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(lex.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("forward") + F.col("inner") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )
