"""Substring dedup by compaction of a de Bruijn graph of token k-mers.

An edge of the graph is a k-mer of words; only edges that occur twice or more matter. They are found
in two steps. Every k-mer window is assigned to its minimiser, the anchor with the least hash among
its ``ANCHOR``-word runs: equal windows have equal minimisers, so a window can only repeat if its
minimiser does, and only one in several word positions is a minimiser. Windows with a repeated
minimiser become edges, with a hash of the word before and the word after.

An edge continues into the next one without a branch if all its occurrences have the same next word
and all occurrences of the next edge have the same word before. Joining the edge table back to the
occurrences breaks each document's runs of repeated edges at branches: what remains between breaks
is a maximal nonbranching path, each of whose occurrences runs through all of it, and one row
stands for it. Then the words of every occurrence are read at its source coordinates, and occurrences
are of one path only if the 128-bit digests of all their words agree: edges whose 64-bit hashes collide
break paths at most, and remove no word. The first occurrence of a path by source coordinates stays;
the words of all others are removed.

Texts with the same words (by SHA-256) are one class: all rows but the first are repeats as a whole if
they have k words, and only one text of each class enters the graph. Classes are numbered in the order
of their first rows, and these numbers are the source coordinates.

An edge or path may hold a third of all occurrences. Those with more than one in ``HOT`` of all rows,
fewer than ``HOT`` by that, are joined by broadcast, the others by key.

Defined cases: null and empty texts have no words; texts shorter than k words lose none; rows are in
the order of doc_id, null ids last, and rows with one doc_id in the order of their texts; ids may be of
any type that can be ordered; equal rows keep their words once; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tokens as tk
from .store import discard, small, stash

#: Words of an anchor.
ANCHOR = 8
#: A key with more than this part of all rows is joined by broadcast: there are fewer than ``HOT`` of them.
HOT = 2000


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _met(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with ``table``, which has a row a key and its number of rows ``n``; both are stashes."""
    total = rows.count()
    hot = F.col("n") * HOT > total
    common = F.broadcast(table.where(hot).drop("n"))  # fewer than HOT rows, since their n add up to at most the total
    rest = rows.join(common.select(key), key, "left_anti").join(table.where(~hot).drop("n"), key)
    return rows.join(common, key).unionByName(rest)


def minimisers(grams: np.ndarray, k: int) -> np.ndarray:
    """For each window of k words of one text, the position of its least anchor (the leftmost of equals).

    ``grams`` are the anchor hashes of the text, one for each of its first n - ANCHOR + 1 words.
    """
    span = k - ANCHOR + 1
    if len(grams) < span:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, span)
    return np.argmin(view, axis=1) + np.arange(len(view))


def _summary(docs: DataFrame) -> DataFrame:
    """doc_id, hash of the text, key of the word sequence, number of words, and the hash of all words joined."""

    def run(batches):
        for batch in batches:
            for part in tk.slices(batch):
                words = tk.split(part.column(1))
                keys = tk.text_keys(tk.word_hashes(words), words.off)
                sha = [_sha((t.as_py() or "").encode().split()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(tk.signed(keys)), pa.array(words.count.astype(np.int64)), pa.array(sha, pa.string())], ["doc_id", "tag", "key", "n_words", "sha"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("tag")).mapInArrow(run, f"doc_id {kind}, tag long, key long, n_words long, sha string")


def _classes(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """sha, key, doc (number in the order of first rows), row of the first one, and its rep_id and rep_tag."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tag", "row"))
    classes = rows.groupBy("sha").agg(least.alias("least"), F.max("n_words").alias("n_words"), F.max("key").alias("key"))
    classes = stash(classes.select("sha", "key", "n_words", "least.*"), "span-firsts")
    tied = stash(classes.groupBy("no_id", "doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("tied_id")), "span-tied")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("tag")).join(small(tied), F.col("doc_id").eqNullSafe(F.col("tied_id")), "left_semi")
    shas = rows.select("sha", F.col("doc_id").alias("of_id"), F.col("tag").alias("of_tag")).distinct()
    texts = texts.join(shas, (F.col("tag") == F.col("of_tag")) & F.col("doc_id").eqNullSafe(F.col("of_id")))
    # the text of a class's first row, only where an id alone doesn't tell the order
    ordering = texts.groupBy("sha").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text")).alias("t")).select("sha", "t.text")
    ordered = classes.join(ordering, "sha", "left").orderBy("no_id", "doc_id", "text", "sha")
    return stash(ordered.select("sha", "key", F.monotonically_increasing_id().alias("doc"), "row", F.col("doc_id").alias("rep_id"), F.col("tag").alias("rep_tag")), "span-classes")


def _of_classes(docs: DataFrame, wanted: DataFrame, once: bool) -> DataFrame:
    """The text of each class in ``wanted``, which has doc, rep_id and rep_tag; ``once`` if no row of ``docs`` is repeated."""
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("tag"))
    texts = texts.join(wanted, (F.col("tag") == F.col("rep_tag")) & F.col("doc_id").eqNullSafe(F.col("rep_id"))).drop("doc_id", "tag")
    return texts if once else texts.dropDuplicates(["doc"])


def _anchors(docs: DataFrame, k: int) -> DataFrame:
    """Minimisers of all texts: hash, key of the text, position, and what deals the row to a task.

    Equal texts give equal rows. Of an anchor at several places of a batch, one goes on to meet those of
    other batches; the rest are known to repeat and are dealt evenly.
    """

    def run(batches):
        for batch in batches:
            out = []
            for part in tk.slices(batch):
                words = tk.split(part.column(0))
                hashes = tk.word_hashes(words)
                keys = tk.signed(tk.text_keys(hashes, words.off))
                grams = tk.window_hashes(hashes, ANCHOR)
                _, once = np.unique(keys, return_index=True)
                for i in once:
                    a, b = words.off[i], words.off[i + 1]
                    if b - a >= k:
                        at = minimisers(grams[a : b - ANCHOR + 1], k)
                        at = at[np.concatenate([[True], at[1:] != at[:-1]])]
                        out.append((tk.signed(grams)[a + at], np.full(len(at), keys[i]), at.astype(np.int32)))
            if out:
                anchor, key, pos = (np.concatenate(x) for x in zip(*out))
                order = np.lexsort((pos, key, anchor))
                anchor, key, pos = anchor[order], key[order], pos[order]
                new = np.concatenate([[True], anchor[1:] != anchor[:-1]])
                place = new.copy()
                place[1:] |= (key[1:] != key[:-1]) | (pos[1:] != pos[:-1])
                anchor, key, pos, new = anchor[place], key[place], pos[place], new[place]
                size = np.diff(np.append(np.flatnonzero(new), len(new)))
                several = np.repeat(size > 1, size)
                deal = np.where(new, anchor, tk.signed(tk.mix((key + pos).view(np.uint64))))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (deal, anchor, key, pos, several)], ["deal", "anchor", "key", "pos", "sure"])

    return docs.select("text").mapInArrow(run, "deal long, anchor long, key long, pos int, sure boolean")


def _repeated(anchors: DataFrame) -> DataFrame:
    """key and pos of the anchors that occur at two places or more; a place may come more than once.

    A sorted stream shows each row its neighbours; one row is carried over, however long a run is.
    """

    def run(batches):
        held, given = None, False
        for batch in batches:
            anchor, key, pos, sure = (np.asarray(batch.column(j)) for j in range(4))
            if held is not None:
                anchor, key, pos, sure = (np.concatenate([[x], y]) for x, y in zip(held, (anchor, key, pos, sure)))
            if not len(anchor):
                continue
            same = anchor[1:] == anchor[:-1]
            apart = same & ((key[1:] != key[:-1]) | (pos[1:] != pos[:-1]))
            # a run of one place only, however often, is no repeat; in a run of several every row is
            run_no = np.cumsum(np.concatenate([[0], ~same]))
            several = np.bincount(run_no[1:], apart, run_no[-1] + 1) > 0
            show = several[run_no] | sure
            if given:
                show[run_no == 0] = True
            fresh = show.copy()
            if held is not None and given:
                fresh[0] = False
            yield pa.RecordBatch.from_arrays([pa.array(key[fresh]), pa.array(pos[fresh].astype(np.int32))], ["key", "pos"])
            held, given = (anchor[-1], key[-1], pos[-1], sure[-1]), bool(show[-1])

    width = int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = anchors.repartition(width, "deal").sortWithinPartitions("anchor", "key", "pos", F.desc("sure"))
    return dealt.select("anchor", "key", "pos", "sure").mapInArrow(run, "key long, pos int")


def _edges(texts: DataFrame, k: int) -> DataFrame:
    """Windows whose minimiser repeats: edge, doc, pos, and hashes of the words around.

    ``texts`` has text, key, doc and places (of repeated anchors). A word that isn't there (start or
    end of the text) hashes to 0.
    """

    def run(batches):
        for batch in batches:
            for part in tk.slices(batch):
                words = tk.split(part.column(0))
                hashes = tk.word_hashes(words)
                right = tk.signed(tk.text_keys(hashes, words.off)) == np.asarray(part.column(1))
                grams, windows = tk.window_hashes(hashes, ANCHOR), tk.signed(tk.window_hashes(hashes, k))
                near = (hashes >> np.uint64(33)).astype(np.int64) + 1  # 31 bits, never 0
                doc, out = np.asarray(part.column(2)), []
                for i in np.flatnonzero(right):
                    a, b = words.off[i], words.off[i + 1]
                    if b - a < k:
                        continue
                    of = minimisers(grams[a : b - ANCHOR + 1], k)
                    marked, places = np.zeros(b - a, bool), np.asarray(part.column(3)[i].values)
                    marked[places[places < b - a]] = True  # texts may share a key
                    at = np.flatnonzero(marked[of])
                    before = np.where(at > 0, near[np.maximum(a + at - 1, 0)], 0)
                    after = np.where(a + at + k < b, near[np.minimum(a + at + k, len(near) - 1)], 0)
                    out.append((windows[a + at], np.full(len(at), doc[i]), at.astype(np.int32), (before << 32) | after))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["edge", "doc", "pos", "around"])

    return texts.select("text", "key", "doc", "places").mapInArrow(run, "edge long, doc long, pos int, around long")


def paths(edges: DataFrame) -> DataFrame:
    """Occurrences of maximal nonbranching paths of repeated edges: doc, pos and number of edges."""
    before, after = F.shiftright("around", 32), F.col("around").bitwiseAND(0xFFFFFFFF)
    table = edges.groupBy("edge").agg(
        F.count(F.lit(1)).alias("n"), F.min(before).alias("b0"), F.max(before).alias("b1"), F.min(after).alias("a0"), F.max(after).alias("a1")
    )
    table = table.where("n > 1").select("edge", "n", ((F.col("b0") == F.col("b1")) & (F.col("b0") > 0)).alias("one_in"), ((F.col("a0") == F.col("a1")) & (F.col("a0") > 0)).alias("one_out"))
    table = stash(table, "span-table")
    again = stash(_met(edges.select("edge", "doc", "pos"), table, "edge").drop("edge"), "span-repeated")
    along = W.partitionBy("doc").orderBy("pos")
    goes_on = (F.lag("pos").over(along) == F.col("pos") - 1) & F.lag("one_out").over(along) & F.col("one_in")
    found = again.withColumn("starts", F.when(goes_on, 0).otherwise(1)).withColumn("nth", F.sum("starts").over(along))
    out = stash(found.groupBy("doc", "nth").agg(F.min("pos").alias("pos"), F.count(F.lit(1)).cast("int").alias("edges")).drop("nth"), "span-paths")
    discard(table, again)
    return out


def _read(texts: DataFrame, k: int) -> DataFrame:
    """path (digest of all its words), doc, pos and n_words of each occurrence in ``texts``, which has text, doc and runs."""

    def run(batches):
        for batch in batches:
            for part in tk.slices(batch):
                out = []
                for text, doc, runs in zip(part.column(0), np.asarray(part.column(1)), part.column(2)):
                    words = text.as_py().encode().split()
                    for pos, edges in zip(*(runs.values.field(j).to_pylist() for j in (0, 1))):
                        n = edges + k - 1
                        out.append((hashlib.blake2b(b" ".join(words[pos : pos + n]), digest_size=16).digest(), doc, pos, n))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.int32(), pa.int32()))], ["path", "doc", "pos", "n_words"])

    return texts.select("text", "doc", "runs").mapInArrow(run, "path binary, doc long, pos int, n_words int")


def repeats(docs: DataFrame, k: int = 20) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """Summaries of all rows, classes of equal word sequences, and the spans of each class that repeat an earlier place.

    Rows have doc_id, key, n_words, sha and row; classes sha, key, doc, row (of the first one), rep_id and
    rep_tag; spans doc, pos, n_words, from_doc and from_pos. Last, whether no row of ``docs`` is repeated.
    """
    rows = stash(_summary(docs).withColumn("row", F.monotonically_increasing_id()), "span-rows")
    classes = _classes(docs, rows)
    repeated = stash(_repeated(_anchors(docs, k)), "span-anchors")
    places = repeated.groupBy("key").agg(F.collect_set("pos").alias("places"))  # places of one text
    once = not rows.groupBy("doc_id", "tag").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    edges = stash(_edges(_of_classes(docs, classes.join(places, "key"), once), k), "span-edges")
    runs = paths(edges)
    of_doc = runs.groupBy("doc").agg(F.collect_list(F.struct("pos", "edges")).alias("runs"))  # occurrences in one text
    found = stash(_read(_of_classes(docs, classes.join(of_doc, "doc"), once), k), "span-read")
    first = found.groupBy("path").agg(F.min(F.struct("doc", "pos")).alias("source"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = stash(first, "span-sources")
    again = _met(found, first, "path").where((F.col("doc") != F.col("source.doc")) | (F.col("pos") != F.col("source.pos")))
    spans = stash(again.select("doc", "pos", "n_words", F.col("source.doc").alias("from_doc"), F.col("source.pos").alias("from_pos")), "span-spans")
    discard(repeated, edges, runs, found, first)
    return rows, classes, spans, once


def dedup(docs: DataFrame, k: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document."""
    rows, classes, spans, once = repeats(docs, k)
    cuts = spans.groupBy("doc").agg(F.collect_list(F.struct("pos", "n_words")).alias("cuts"))  # spans of one text

    def run(batches):
        for batch in batches:
            for part in tk.slices(batch):
                words = tk.split(part.column(0))
                removed, sha = [], []
                for i, (text, n) in enumerate(zip(part.column(0), words.count)):
                    spans = part.column(2)[i].values
                    pos, length = (np.asarray(spans.field(j)) for j in (0, 1))
                    change = np.zeros(n + 1, np.int64)
                    np.add.at(change, pos, 1)
                    np.add.at(change, pos + length, -1)
                    gone = np.cumsum(change[:-1]) > 0
                    removed.append(int(gone.sum()))
                    sha.append(_sha([w for w, g in zip((text.as_py() or "").encode().split(), gone) if not g]))
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], ["doc", "n_removed", "cut_sha"])

    cut = _of_classes(docs, classes.join(cuts, "doc"), once).select("text", "doc", "cuts").mapInArrow(run, "doc long, n_removed long, cut_sha string")
    of_class = classes.select("sha", "doc", F.col("row").alias("first_row")).join(cut, "doc", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    whole = (F.col("row") != F.col("first_row")) & (F.col("n_words") >= k)
    return rows.join(of_class, "sha").select(
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).when(F.col("row") != F.col("first_row"), F.lit(0)).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(nothing)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
    )
