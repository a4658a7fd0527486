"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Texts with the same words are one class. A class's distinct word n-grams (64-bit hashes) are ordered
rare first; two sets can only reach the similarity if they share an n-gram of their prefixes. The
prefix postings meet by n-gram, each list in the order of set sizes. From each list come, first, only
the pairs of a row with the first one of its length class and with the one before it; the order is
the same in every list, so neighbours repeat from list to list and a row has few different pairs.
These are verified once each on whole sets, and linked.

Lists that then still hold several components are compared in pairs of blocks of about ``LIST`` rows:
rows outside the list's largest component against all of it. In a pair of blocks, rows of different
components pass the length and positional filters and the suffix filter, a histogram of the whole set
over fixed hash ranges that bounds the overlap, and each pair of rows counts only in the list of its
first common n-gram. Rows that some pair is left for meet again with their whole sets, in the same
blocks: there each pair is verified, and only links that join components are given out. No link
between components is lost, and no list is expanded into its pairs.

The order uses a table of ``SKETCH`` counters that covers all texts; any order gives the same
links, a better one fewer candidates.

Defined cases: a text with fewer than n words has its whole sequence as one n-gram; without words
or text the set is empty and the document is its own component; ids may be of any type that can be
ordered, null ones come last; repeated rows are each returned; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .components import components
from .store import discard, gather, small, stash

#: Counters of the frequency table (a power of two), and the right shift of a hash to its counter.
SKETCH = 1 << 22
SHIFT = np.uint64(64 - 22)
#: Cells of the histogram that bounds the overlap of two sets from above, each counting up to 255.
CELLS = 128
#: Rows, and n-grams in all, of a block of a list.
LIST, WEIGHT = 2048, 1 << 20
#: First n-grams of a row that are compared to tell whether a pair has met in an earlier list.
HEADS = 16
#: Pairs of one row that are verified by one key of a join.
HEAVY = 2048


def sets(column: pa.Array, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The key of each text's word sequence and its sorted distinct n-gram hashes."""
    words = tk.split(column, lower=True)
    hashes = tk.word_hashes(words)
    keys = tk.text_keys(hashes, words.off)
    grams = tk.window_hashes(hashes, n)
    out = []
    for i, (a, b) in enumerate(zip(words.off[:-1], words.off[1:])):
        if b - a >= n:
            s = np.sort(grams[a : b - n + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        else:
            out.append(keys[i : i + 1] if b > a else keys[:0])
    return keys, out


def _cells(grams: list[np.ndarray]) -> pa.Array:
    """The histogram of each set over the last bits of its hashes."""
    return pa.array([np.minimum(np.bincount((g & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS), 255).astype(np.uint8).tobytes() for g in grams], pa.binary())


def _scan(docs: DataFrame, n: int) -> DataFrame:
    """A row a document (hash of the text, key, set size), and a row a partition with its counters (doc_id null, counts set)."""

    def run(batches):
        counts = np.zeros(SKETCH, np.uint8)
        names = ["doc_id", "tag", "key", "n", "cells", "counts"]
        schema = None
        for batch in batches:
            for part in tk.slices(batch):
                keys, grams = sets(part.column(1), n)
                at = (np.concatenate(grams) >> SHIFT).astype(np.int64) if grams else np.zeros(0, np.int64)
                at, times = np.unique(at, return_counts=True)
                counts[at] = np.minimum(counts[at].astype(np.int64) + times, 255)
                size = pa.array(np.array([len(g) for g in grams], np.int64))
                out = pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(tk.signed(keys)), size, _cells(grams), pa.nulls(len(size), pa.binary())], names)
                schema = out.schema
                yield out
        if schema is not None:
            packed = zlib.compress(counts.tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, schema.field(0).type), *(pa.nulls(1, pa.int64()) for _ in range(3)), pa.nulls(1, pa.binary()), pa.array([packed], pa.binary())], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("tag")).mapInArrow(run, f"doc_id {kind}, tag long, key long, n long, cells binary, counts binary")


def _rarity(counts: DataFrame) -> np.ndarray:
    """The counters of all partitions added up, as classes that double every second step."""

    def add(payloads):
        total = np.zeros(SKETCH, np.uint32)
        for raw in payloads:
            part = np.frombuffer(zlib.decompress(raw), np.uint8)
            part = part.astype(np.uint32) if len(part) == SKETCH else part.view(np.uint32)
            total += np.minimum(part, ~total)  # counters stay at their limit
        return zlib.compress(total.tobytes(), 1)

    def first(batches):
        raw = [x.as_py() for batch in batches for x in batch.column(0)]
        return add(raw) if raw else None

    found = gather(counts, first, add, left=1)  # one sum, or none of an empty table
    total = np.frombuffer(zlib.decompress(found.pop(), bufsize=4 * SKETCH), np.uint32) if found else np.zeros(SKETCH, np.uint32)
    out = np.zeros(SKETCH, np.uint8)
    for at in range(0, SKETCH, 1 << 16):
        out[at : at + (1 << 16)] = np.floor(2 * np.log2(total[at : at + (1 << 16)] + 1.0))
    return out


def _postings(docs: DataFrame, rarity, n: int, percent: int) -> DataFrame:
    """gram, key and meta (set size and position) of each n-gram of each text's prefix."""

    def run(batches):
        rare = np.frombuffer(rarity.value, np.uint8)
        for batch in batches:
            for part in tk.slices(batch):
                keys, grams = sets(part.column(0), n)
                out, own, meta = [], [], []
                _, once = np.unique(keys, return_index=True)
                for i in once:
                    s = grams[i]
                    if not len(s):
                        continue
                    most = len(s) - (percent * len(s) + 99) // 100 + 1
                    rank = rare[(s >> SHIFT).astype(np.int64)]
                    out.append(s[np.lexsort((s, rank))[:most]])
                    own.append(np.full(most, keys[i]))
                    meta.append((np.int64(len(s)) << np.int64(32)) + np.arange(most, dtype=np.int64))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(tk.signed(np.concatenate(out))), pa.array(tk.signed(np.concatenate(own))), pa.array(np.concatenate(meta))], ["gram", "key", "meta"])

    return docs.select("text").mapInArrow(run, "gram long, key long, meta long")


def _shared(postings: DataFrame, percent: int) -> DataFrame:
    """Postings of n-grams in two classes or more, each with the first of its length class and the one before it.

    Works on a stream sorted by n-gram and set size: one row is carried over, however long a list is.
    """
    ratio = np.log(100.0 / percent)
    names = ["gram", "key", "meta", "lead_key", "lead_meta", "prev_key", "prev_meta"]

    def run(batches):
        held = None  # the last row so far (gram, key, meta) with its leader, and whether it was given out
        for batch in batches:
            gram, key, meta = (np.asarray(batch.column(j)) for j in range(3))
            if held is not None:
                gram, key, meta = (np.concatenate([[x], y]) for x, y in zip(held[:3], (gram, key, meta)))
            if not len(gram):
                continue
            keep = np.concatenate([[True], (gram[1:] != gram[:-1]) | (key[1:] != key[:-1])])
            gram, key, meta = gram[keep], key[keep], meta[keep]
            size = meta >> 32
            band = np.floor(np.log(size) / ratio).astype(np.int64)
            new = np.concatenate([[True], gram[1:] != gram[:-1]])
            lead = np.maximum.accumulate(np.where(new | np.concatenate([[True], band[1:] != band[:-1]]), np.arange(len(gram)), 0))
            lead_key, lead_meta = key[lead], meta[lead]
            prev_key, prev_meta = np.roll(key, 1), np.roll(meta, 1)
            given = np.zeros(len(gram), bool)
            if held is not None:  # what the carried row knows of its own list
                at = (gram == held[0]) & (band == np.floor(np.log(held[2] >> 32) / ratio))
                at &= lead == 0
                lead_key, lead_meta = np.where(at, held[3], lead_key), np.where(at, held[4], lead_meta)
                given[0] = held[5]
            with_next = np.concatenate([~new[1:], [False]])
            show = (~new | with_next) & ~given
            first = new.copy()
            if held is not None and held[5]:
                first[0] = False
            at = np.flatnonzero(show)
            if len(at):
                none = first[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram[at]), pa.array(key[at]), pa.array(meta[at]), pa.array(lead_key[at]), pa.array(lead_meta[at]), pa.array(prev_key[at], mask=none), pa.array(prev_meta[at], mask=none)], names
                )
            held = (gram[-1], key[-1], meta[-1], lead_key[-1], lead_meta[-1], bool(show[-1] or given[-1]))

    width = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = postings.repartition(width, "gram").sortWithinPartitions("gram", F.shiftright("meta", 32), "key")
    return dealt.mapInArrow(run, "gram long, key long, meta long, lead_key long, lead_meta long, prev_key long, prev_meta long")


def _possible(a: str, b: str, percent: int):
    """Length and positional filter on the metas of two postings of one n-gram."""
    n1, n2 = (F.shiftright(x, 32) for x in (a, b))
    left = F.least(n1 - F.col(a).bitwiseAND(0xFFFFFFFF), n2 - F.col(b).bitwiseAND(0xFFFFFFFF))
    return (F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent) & (left * (100 + percent) >= (n1 + n2) * percent)


def _blocks(placed: DataFrame) -> DataFrame:
    """Lists (gram) of several components: the largest one, and the blocks of its rows and of all others."""
    parts = placed.groupBy("gram", "component").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.shiftright("meta", 32)).alias("grams"))
    lists = parts.groupBy("gram").agg(F.max(F.struct("rows", "grams", "component")).alias("top"), F.sum("rows").alias("rows"), F.sum("grams").alias("grams"), F.count(F.lit(1)).alias("n"))
    blocks = lambda rows, grams: F.ceil(F.greatest(rows / F.lit(LIST), grams / F.lit(WEIGHT))).cast("int")
    few = blocks(F.col("rows") - F.col("top.rows"), F.col("grams") - F.col("top.grams"))
    return lists.where("n > 1").select("gram", F.col("top.component").alias("main"), few.alias("few"), blocks(F.col("top.rows"), F.col("top.grams")).alias("many"))


def _open_pairs(block, key, meta, component, cells, heads, b1, b2, percent: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of blocks ``b1`` and ``b2`` that pass all filters and meet in no earlier list."""
    left, right = (np.flatnonzero(block == b) for b in (b1, b2))
    size, place = meta >> 32, meta & 0xFFFFFFFF
    rest, found = size - place, []
    early = heads["place"] < place[:, None]  # places beyond the last one are never early
    for at in range(0, len(left), 256):
        i, j = left[at : at + 256, None], right[None, :]
        near = (component[i] != component[j]) & (np.minimum(size[i], size[j]) * 100 >= np.maximum(size[i], size[j]) * percent)
        near &= np.minimum(rest[i], rest[j]) * (100 + percent) >= (size[i] + size[j]) * percent
        if b1 == b2:
            near &= i < j
        x, y = np.nonzero(near)
        x, y = left[at + x], right[y]
        for to in range(0, len(x), 1 << 14):
            p, q = x[to : to + (1 << 14)], y[to : to + (1 << 14)]
            apart = (np.maximum(cells[p], cells[q]) - np.minimum(cells[p], cells[q])).sum(axis=1, dtype=np.int64)
            total = size[p] + size[q]
            good = (100 + percent) * (total - apart) >= 2 * percent * total
            p, q = p[good], q[good]
            met = ((heads["gram"][p][:, :, None] == heads["gram"][q][:, None, :]) & early[p][:, :, None] & early[q][:, None, :]).any(axis=(1, 2))
            found.append((p[~met], q[~met]))
    return found


NARROW = ["gram", "b1", "b2", "block", "key", "meta", "component", "cells", "heads"]
NARROW_KIND = "gram long, b1 int, b2 int, block int, key long, meta long, component long, cells binary, heads binary"
HEAD = np.dtype([("place", np.int64), ("gram", np.int64)])


def _grouped(batches, work):
    """Runs ``work`` on the rows of each pair of blocks (gram, b1, b2) of a sorted stream, and yields what it gives."""
    held = None
    for batch in batches:
        now = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if not now.num_rows:
            continue
        gram, b1, b2 = (np.asarray(now.column(j)) for j in range(3))
        edge = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (b1[1:] != b1[:-1]) | (b2[1:] != b2[:-1])]))
        for a, z in zip(edge[:-1], edge[1:]):
            yield from work(now.slice(a, z - a))
        held = now.slice(edge[-1])
    if held is not None:
        yield from work(held)
    tk.release()


def _columns(rows: pa.Table) -> tuple:
    block, key, meta, component = (np.asarray(rows.column(j)) for j in range(3, 7))
    cells = np.frombuffer(b"".join(x.as_py() for x in rows.column(7)), np.uint8).reshape(-1, CELLS)
    heads = np.frombuffer(b"".join(x.as_py() for x in rows.column(8)), HEAD).reshape(-1, HEADS)
    return block, key, meta, component, cells, heads, rows.column(1)[0].as_py(), rows.column(2)[0].as_py()


def _heads(entries: DataFrame) -> DataFrame:
    """The first ``HEADS`` n-grams of each row, with their places, of the lists that are compared."""

    def run(batches):
        for batch in batches:
            out = np.zeros((batch.num_rows, HEADS), HEAD)
            out["place"] = np.iinfo(np.int64).max
            for i, x in enumerate(batch.column(1)):
                place, gram = (np.asarray(x.values.field(j)) for j in (0, 1))
                out["place"][i, : len(place)], out["gram"][i, : len(gram)] = place, gram
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in out], pa.binary())], ["key", "heads"])

    place = F.col("meta").bitwiseAND(0xFFFFFFFF)
    first = entries.groupBy("key").agg(F.slice(F.array_sort(F.collect_list(F.struct(place.alias("place"), "gram"))), 1, HEADS).alias("first"))  # n-grams of one prefix
    return first.mapInArrow(run, "key long, heads binary")


def _between(docs: DataFrame, placed: DataFrame, members: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (k1, k2) that join components, from rows (gram, key, meta, component) of lists that hold several."""
    entries = stash(placed.join(_blocks(placed), "gram"), "jaccard-open")
    info = _heads(entries).join(members.select("key", "cells"), "key")
    alone = F.col("component") != F.col("main")
    own = F.when(alone, F.pmod(F.xxhash64("key"), F.col("few"))).otherwise(F.col("few") + F.pmod(F.xxhash64("key"), F.col("many"))).cast("int")
    spread = entries.join(info, "key").withColumn("block", own)
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(alone, F.col("few") + F.col("many") - 1).otherwise(F.col("few") - 1))))
    spread = spread.withColumn("b1", F.least("block", "other")).withColumn("b2", F.greatest("block", "other"))
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deal = lambda df, names: df.select(*names).repartition(width, "gram", "b1", "b2").sortWithinPartitions("gram", "b1", "b2")

    def survivors(rows):
        pairs = _open_pairs(*_columns(rows), percent)
        at = np.unique(np.concatenate([x for pair in pairs for x in pair] or [np.zeros(0, np.int64)]))
        if len(at):
            yield from rows.take(pa.array(at)).combine_chunks().to_batches()

    def verified(rows):
        block, key, meta, component, cells, heads, b1, b2 = _columns(rows)
        sets_of = [np.frombuffer(x.as_py(), np.uint64) for x in rows.column(9)]
        root: dict[int, int] = {}

        def of(c):
            while c in root:
                c = root[c]
            return c

        k1, k2 = [], []
        for p, q in _open_pairs(block, key, meta, component, cells, heads, b1, b2, percent):
            for x in np.unique(p):
                mine, others = sets_of[x], [y for y in q[p == x] if of(component[y]) != of(component[x])]
                if not others:
                    continue
                size = np.array([len(sets_of[y]) for y in others])
                every = np.concatenate([sets_of[y] for y in others])
                at = np.minimum(np.searchsorted(mine, every), len(mine) - 1)
                shared = np.add.reduceat(mine[at] == every, np.cumsum(size) - size, dtype=np.int64)
                for y in np.array(others)[100 * shared >= percent * (len(mine) + size - shared)]:
                    a, b = of(component[x]), of(component[y])
                    if a != b:
                        root[a] = b
                        k1.append(key[x])
                        k2.append(key[y])
        if k1:
            yield pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64())], ["k1", "k2"])

    left = stash(deal(spread, NARROW).mapInArrow(lambda batches: _grouped(batches, survivors), NARROW_KIND), "jaccard-left")
    whole = _whole_sets(docs, left.select("key").distinct(), members, n)
    links = deal(left.join(whole, "key"), [*NARROW, "grams"]).mapInArrow(lambda batches: _grouped(batches, verified), "k1 long, k2 long")
    links = stash(links, "jaccard-joining")
    discard(entries, left, whole)
    return links


def _whole_sets(docs: DataFrame, needed: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """key and sorted n-grams of the needed classes, computed from one text of each."""
    wanted = needed.join(members.select("key", "rep", "rep_tag"), "key")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("tag"))
    texts = texts.join(wanted, (F.col("tag") == F.col("rep_tag")) & F.col("doc_id").eqNullSafe(F.col("rep")))

    def whole(batches):
        for batch in batches:
            for part in tk.slices(batch):
                keys, grams = sets(part.column(0), n)
                right = tk.signed(keys) == np.asarray(part.column(1))
                own = [g.tobytes() for g, r in zip(grams, right) if r]
                yield pa.RecordBatch.from_arrays([part.column(1).filter(pa.array(right)), pa.array(own, pa.binary())], ["key", "grams"])

    return stash(texts.select("text", "key").mapInArrow(whole, "key long, grams binary").dropDuplicates(["key"]), "jaccard-sets")


def _verify(docs: DataFrame, pairs: DataFrame, members: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (k1, k2) whose whole sets reach the similarity; each pair is looked at once.

    Many rows may be paired with one k1: its set goes to as many keys of the join as that takes.
    """
    loads = pairs.groupBy("k1").agg(F.ceil(F.count(F.lit(1)) / HEAVY).cast("int").alias("salts"))
    loads = stash(loads, "jaccard-loads")
    whole = _whole_sets(docs, loads.select(F.col("k1").alias("key")).union(pairs.select(F.col("k2").alias("key"))).distinct(), members, n)
    left = whole.join(loads.withColumnRenamed("k1", "key"), "key").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    salted = pairs.join(small(loads.where("salts > 1")), "k1", "left").select("k1", "k2", F.coalesce(F.pmod(F.xxhash64("k2"), F.col("salts")), F.lit(0)).cast("int").alias("salt"))

    def check(batches):
        for batch in batches:
            good = []
            for g1, g2 in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(g1.as_py(), np.uint64), np.frombuffer(g2.as_py(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                shared = np.count_nonzero(both[1:] == both[:-1])
                good.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(j).filter(pa.array(good, pa.bool_())) for j in (0, 1)], ["k1", "k2"])
        tk.release()

    joined = salted.join(left.select(F.col("key").alias("k1"), "salt", F.col("grams").alias("g1")), ["k1", "salt"])
    joined = joined.join(whole.select(F.col("key").alias("k2"), F.col("grams").alias("g2")), "k2").select("k1", "k2", "g1", "g2")
    links = stash(joined.mapInArrow(check, "k1 long, k2 long"), "jaccard-links")
    discard(loads, whole)
    return links


def link(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every document; sets link from ``percent`` % Jaccard similarity."""
    spark = docs.sparkSession
    scanned = stash(_scan(docs, n), "jaccard-scan")
    rows = scanned.where("counts is null").select("doc_id", "key", "n")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tag"))
    members = scanned.where("counts is null and n > 0").groupBy("key").agg(least.alias("least"), F.first("cells").alias("cells"))
    # ``node`` numbers the classes in the order of their documents
    members = members.select("key", F.col("least.doc_id").alias("rep"), F.col("least.tag").alias("rep_tag"), "cells", "least.no_id").orderBy("no_id", "rep", "key")
    members = stash(members.select("key", "rep", "rep_tag", "cells", F.monotonically_increasing_id().alias("node")), "jaccard-classes")
    rarity = spark.sparkContext.broadcast(_rarity(scanned.where("counts is not null").select("counts")).tobytes())  # SKETCH bytes
    shared = stash(_shared(_postings(docs, rarity, n, percent), percent), "jaccard-shared")
    rarity.destroy()
    leads = shared.where(_possible("meta", "lead_meta", percent)).select(F.col("lead_key").alias("k1"), F.col("key").alias("k2"))
    chain = shared.where("prev_key is not null").where(_possible("meta", "prev_meta", percent)).select(F.col("prev_key").alias("k1"), F.col("key").alias("k2"))
    first = stash(leads.union(chain).where("k1 <> k2").distinct(), "jaccard-pairs")
    links = _verify(docs, first, members, n, percent)
    found = components(links.select(F.col("k1").alias("a"), F.col("k2").alias("b")), "jaccard-components")
    placed = shared.select("gram", "key", "meta").join(found.withColumnRenamed("node", "key"), "key", "left")
    placed = stash(placed.select("gram", "key", "meta", F.coalesce("component", "key").alias("component")), "jaccard-placed")
    discard(shared, first)
    more = _between(docs, placed, members, n, percent)
    discard(placed)
    numbers = lambda k, name: members.select(F.col("key").alias(k), F.col("node").alias(name))
    groups = components(links.unionByName(more).join(numbers("k1", "a"), "k1").join(numbers("k2", "b"), "k2").select("a", "b"), "jaccard-groups")
    placed = members.select("key", "node", "rep").join(groups, "node", "left")
    heads = members.select(F.col("node").alias("component"), F.col("rep").alias("head"))
    named = placed.join(heads, "component", "left").select("key", F.coalesce("component", "node").alias("component"), F.when(F.col("component").isNull(), F.col("rep")).otherwise(F.col("head")).alias("head"))
    return rows.join(named, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("head")).otherwise(F.col("doc_id")).alias("component_id")
    )
