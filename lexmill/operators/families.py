"""Word families by sliding edit distance, their lemmas, and the fuzzy stop-word filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import scores
from lexmill.operators.rounds import settled


#: Lengths of the shorter word up to which one edit is allowed; beyond, two.
ONE_EDIT = 5
#: From this length on, words are cut into three pieces, one of which two edits leave whole.
PIECES = 12


def _keys(x: str) -> str:
    """SQL for an array of hashes that any two strings of equal length within the allowed edits share at least one of.

    Up to ``ONE_EDIT`` letters one substitution is allowed: the string with one letter masked. Up to ``PIECES`` two edits
    are two substitutions, the string with two letters masked, or an insertion and a deletion, the string without one
    letter; strings that share such a key are within two edits. Beyond, pieces with their place: what lies between an
    insertion and a deletion is moved by one place.
    """
    n, mask = f"length({x})", "PLACING chr(1) FROM"  # chr(1) is no letter of a word
    once = f"transform(sequence(1, {n}), i -> xxhash64({n}, overlay({x} {mask} i)))"
    twice = f"flatten(transform(sequence(1, {n} - 1), i -> transform(sequence(i + 1, {n}), j -> xxhash64({n}, overlay(overlay({x} {mask} i) {mask} j)))))"
    without = f"transform(sequence(1, {n}), i -> xxhash64({n}, -1, concat(substring({x}, 1, i - 1), substring({x}, i + 1))))"
    return f"case when {n} <= {ONE_EDIT} then {once} when {n} < {PIECES} then concat({twice}, {without}) else {{pieces}} end"


def _pieces(x: str, shifts: str) -> str:
    n = f"length({x})"
    return f"""flatten(transform(sequence(0, 2), k -> transform({shifts}, d ->
        xxhash64({n}, k, substring({x}, {n} * k div 3 + 1 + d, {n} * (k + 1) div 3 - {n} * k div 3)))))"""


def related(words: DataFrame, *keys: str) -> DataFrame:
    """w1, w2 and distance of all pairs of words of a group at a distance of at most 1 (w1 < w2), over a vocabulary of any size.

    The distance compares the shorter word with each stretch of its length in the longer one, so every word offers its
    distinct stretches, and words meet stretches that share a key of ``_keys``: what is left is a small
    part of all pairs and is compared once by ``levenshtein``. Words of one letter are at a distance of 1 from each
    other, and words of two letters from none.
    """
    own = words.select(*keys, "word").where("length(word) >= 3").distinct()
    sizes = own.select(*keys, "word", F.explode(F.expr("sequence(greatest(3, length(word) - 4, cast(ceil(length(word) / 2) as int)), length(word))")).alias("n"))
    cut = sizes.select(*keys, "word", F.explode(F.expr("array_distinct(transform(sequence(1, length(word) - n + 1), i -> substring(word, i, n)))")).alias("part"))
    parts = cut.select(*keys, "part").distinct()
    short = own.select(*keys, F.col("word").alias("s"), F.explode(F.expr("array_distinct(" + _keys("word").format(pieces=_pieces("word", "array(0)")) + ")")).alias("key"))
    long_ = parts.select(*keys, "part", F.explode(F.expr("array_distinct(" + _keys("part").format(pieces=_pieces("part", "array(-1, 0, 1)")) + ")")).alias("key"))
    met = short.join(long_, [*keys, "key"]).where("length(s) = length(part)").select(*keys, "s", "part").distinct()
    lev = met.withColumn("edits", F.expr("levenshtein(s, part)")).withColumn("unit", F.expr("least(8, length(s)) / 3.0D")).where("edits <= unit")
    pairs = lev.join(cut, [*keys, "part"]).where("word <> s").select(*keys, F.least("s", "word").alias("w1"), F.greatest("s", "word").alias("w2"), (F.col("edits") / F.col("unit")).alias("distance"))
    letters = words.select(*keys, F.col("word").alias("w1"), F.length("word").alias("size")).where("size = 1").distinct()
    single = letters.join(letters.withColumnRenamed("w1", "w2"), [*keys, "size"]).where("w1 < w2").select(*keys, "w1", "w2", F.lit(1.0).alias("distance"))
    return pairs.groupBy(*keys, "w1", "w2").agg(F.min("distance").alias("distance")).unionByName(single)


def neighbours(words: DataFrame, *keys: str) -> DataFrame:
    """Of each word with a related one: keys, word, n_related, the least distance, and the first word at it.

    The pairs are those of ``related``, but none becomes a row: words of one length, as the shorter ones, and words that
    are up to four letters longer are cut into blocks by hash, and every pair of blocks is one task's work, so a pair is
    found in one task only. ``_near_counts`` counts there, and each word of a pair of blocks becomes one row of numbers:
    words are numbered in their order, and the least distance and the first word at it are one number.
    """
    every = settled(words.select(*keys, "word").distinct().orderBy("word").withColumn("id", F.monotonically_increasing_id()))
    own = every.where("length(word) >= 3")
    span = F.expr("explode(sequence(greatest(3, length(word) - 4, cast(ceil(length(word) / 2) as int)), length(word)))").alias("size")
    of_size = own.groupBy(*keys, F.length("word").alias("size")).agg(F.expr(f"ceil(count(*) / {2 * WORDS})").alias("here"))
    blocks = own.select(*keys, span).groupBy(*keys, "size").agg(F.expr(f"ceil(count(*) / {WORDS})").alias("there")).join(of_size, [*keys, "size"])
    blocks = settled(blocks)
    block = "pmod(xxhash64(word), {})"
    short = own.withColumn("size", F.length("word")).join(blocks, [*keys, "size"]).select(
        *keys, "size", F.expr(block.format("here")).alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("there") - 1)).alias("b"), F.lit(False).alias("longer"), "id", "word")
    long_ = own.select(*keys, "id", "word", span).join(blocks, [*keys, "size"]).select(
        *keys, "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("here") - 1)).alias("a"), F.expr(block.format("there")).alias("b"), F.lit(True).alias("longer"), "id", "word")
    tasks = blocks.agg(F.sum(F.col("here") * F.col("there"))).first()[0] or 1
    tasks = max(words.sparkSession.sparkContext.defaultParallelism, min(4 * tasks, TASKS))
    at = [*keys, "size", "a", "b"]

    def run(key, rows):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        size, out = key[-3].as_py(), []
        sides = [rows.filter(x).sort_by("id") for x in (pc.invert(rows["longer"]), rows["longer"])]
        ids = [x["id"].to_numpy() for x in sides]
        for mine, others, (n, edits, other) in zip(ids, ids[::-1], _near_counts(*(x["word"].to_pylist() for x in sides))):
            found = np.flatnonzero(n)
            out.append((mine[found], n[found], (edits[found] * PARTS * 3 // min(8, size) << ID) | others[other[found]]))
        return pa.table(dict(zip(("id", "n", "near"), map(np.concatenate, zip(*out)))))

    found = short.unionByName(long_).repartition(tasks, *at).groupBy(*at).applyInArrow(run, "id long, n long, near long")
    found = found.groupBy("id").agg(F.sum("n").alias("n_related"), F.min("near").alias("near"))
    found = found.join(own, "id").withColumn("other", F.expr(f"near & ((1L << {ID}) - 1)")).withColumn("distance", F.expr(f"(near >> {ID}) / {PARTS}.0D"))
    found = found.join(own.select(F.col("id").alias("other"), F.col("word").alias("nearest")), "other").select(*keys, "word", "n_related", "distance", "nearest")
    letters = every.select(*keys, "word").where("length(word) = 1")
    other = letters.withColumnRenamed("word", "nearest")
    single = (letters.join(other, list(keys)) if keys else letters.crossJoin(other)).where("word <> nearest")
    single = single.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n_related"), F.lit(1.0).alias("distance"), F.min("nearest").alias("nearest"))
    return found.unionByName(single)


#: Words of a block of ``neighbours`` (twice as many of the shorter ones), pairs that are held at a time, and the most partitions its pairs of blocks are dealt to.
WORDS, PAIRS, TASKS = 1 << 17, 1 << 22, 1 << 12
#: Distances are whole numbers of this part of 1, whatever the length of the shorter word; bits of a word's number.
PARTS, ID = 840, 50
#: Up to this length any two letters of a word are masked; pairs of longer words are found by pieces.
MASKED = 16


def _near_counts(short: list[str], longer: list[str]):
    """For the words of both lists: how many of the other list are related, the least edits, and the first word with them.

    ``short`` holds words of one length, ``longer`` words of this length or up to four letters more; both are distinct
    and sorted. Of a pair of equal length only the one with the smaller word in ``short`` counts, for both its words.
    A word meets stretches with the same letters but for those masked (up to two), or the same ones without one
    letter; keys are whole codes of the letters if 64 bits hold them. If not, or if the words are so long that they meet by
    pieces, keys are hashes and the pairs are compared.
    """
    from itertools import combinations

    import numpy as np

    none = tuple((np.zeros(len(w), np.int64),) * 3 for w in (short, longer))
    if not short or not longer:
        return none
    size = len(short[0])
    allowed = 1 if size <= ONE_EDIT else 2
    sizes = np.array([len(w) for w in longer])
    chars = [np.array(short, f"U{size}").view(np.uint32).reshape(-1, size)]
    owner = []
    for width in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == width)
        rows = np.array([longer[i] for i in at.tolist()], f"U{width}").view(np.uint32).reshape(-1, width)
        chars += [rows[:, i : i + size] for i in range(width - size + 1)]
        owner += [at] * (width - size + 1)
    owner = np.concatenate(owner).astype(np.int32)
    letters = np.unique(np.concatenate([np.unique(x) for x in chars]))
    mine, theirs = np.searchsorted(letters, chars[0]), np.searchsorted(letters, np.concatenate(chars[1:]))
    bits = max(1, (len(letters) - 1).bit_length())
    exact = size <= MASKED and size * bits <= 64
    if exact:
        value = np.arange(len(letters), dtype=np.uint64) << np.arange(0, size * bits, bits, dtype=np.uint64)[:, None]
    else:
        value = np.random.default_rng(7).integers(0, 2**64, (size, len(letters)), dtype=np.uint64)

    starts, counts, edits, owners, held = [], [], [], [], 0

    def meet(asked, kept, at, cost):
        """Note where the stretches of each word's key are: the keys of ``kept`` in order, one list of ``asked`` a letter or more."""
        nonlocal held
        order = np.argsort(kept)
        kept = kept[order]
        for keys in asked:
            turn = np.argsort(keys)
            first, last = (np.searchsorted(kept, keys[turn], side) for side in ("left", "right"))
            lo, n = np.empty(len(keys), np.int32), np.empty(len(keys), np.int32)
            lo[turn], n[turn] = first + held, last - first
            starts.append(lo)
            counts.append(n)
            edits.append(cost)
        owners.append(at[order])
        held += len(order)

    def coded(rows, first, last, shift=0):
        """The letters from ``first`` to before ``last``, as if they stood ``shift`` places further on."""
        out = np.zeros(len(rows), np.uint64)
        for i in range(first, last):
            out += value[i + shift][rows[:, i]]
        return out

    if size <= MASKED:
        whole = [coded(x, 0, size) for x in (mine, theirs)]
        for cost in range(allowed + 1):
            for places in combinations(range(size), cost):
                a, b = (w - sum((value[i][x[:, i]] for i in places), np.uint64(0)) for w, x in zip(whole, (mine, theirs)))
                meet([a], b, owner, cost)
        if allowed == 2:
            a, b = ([coded(x, 0, i) + coded(x, i + 1, size, -1) for i in range(size)] for x in (mine, theirs))
            meet(a, np.concatenate(b), np.tile(owner, size), 2)
    else:
        for k in range(3):
            first, last = size * k // 3, size * (k + 1) // 3
            shifts = [d for d in (-1, 0, 1) if first + d >= 0 and last + d <= size]
            b = [coded(theirs, first + d, last + d, -first - d) for d in shifts]
            meet([coded(mine, first, last, -first)], np.concatenate(b), np.tile(owner, len(shifts)), 0)
    del mine, theirs, chars
    starts, counts, owners, edits = np.array(starts), np.array(counts), np.concatenate(owners), np.array(edits)

    # of words of equal length: how many of ``short`` come before
    before = np.where(sizes == size, np.searchsorted(np.array(short), np.array(longer)), len(short))
    shift, far = len(longer).bit_length(), np.int64(2) << 60
    n_short, best_short = np.zeros(len(short), np.int64), np.full(len(short), far)
    n_long, best_long = np.zeros(len(longer), np.int64), np.full(len(longer), far)
    up = len(short).bit_length()
    total = np.cumsum(counts.sum(axis=0, dtype=np.int64))
    if not exact:
        words, lengths = short + longer, np.concatenate([np.full(len(short), size), sizes])
    begin = 0
    while begin < len(short):
        done = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, done + PAIRS, "right")))
        n = counts[:, begin:end].ravel()
        cells = np.flatnonzero(n)
        n = n[cells]
        kind, who = cells // (end - begin), cells % (end - begin) + begin
        at = np.repeat(starts[:, begin:end].ravel()[cells] - (np.cumsum(n, dtype=np.int64) - n), n)
        at += np.arange(len(at))
        to = owners[at]
        keep = np.repeat(who, n) < before[to]
        pairs = np.sort((np.repeat(who << (shift + 2) | edits[kind], n) + (to.astype(np.int64) << 2))[keep])
        pairs = pairs[np.flatnonzero(np.diff(pairs >> 2, prepend=-1))]
        a, b, cost = pairs >> (shift + 2), (pairs >> 2) & ((1 << shift) - 1), pairs & 3
        if not exact and len(pairs):
            found = [_compared(words, lengths, a[k : k + PART], b[k : k + PART] + len(short), size, allowed) for k in range(0, len(a), PART)]
            a, b, _ = (np.concatenate(x) for x in zip(*found))
            cost = np.rint(np.concatenate([x[2] for x in found]) * (min(8, size) / 3.0)).astype(np.int64)
            b = b - len(short)
        begin = end
        if not len(a):
            continue
        first = np.flatnonzero(np.diff(a, prepend=-1))
        n_short[a[first]] = np.diff(first, append=len(a))
        best_short[a[first]] = np.minimum.reduceat(cost << shift | b, first)
        n_long += np.bincount(b, minlength=len(longer))
        np.minimum.at(best_long, b, cost << up | a)
    return (n_short, best_short >> shift, best_short & ((1 << shift) - 1)), (n_long, best_long >> up, best_long & ((1 << up) - 1))


#: Pairs that are compared letter by letter at a time.
PART = 1 << 17


def fuzzy_stop_free(words: DataFrame, stopwords: DataFrame, band: int = 2, limit: float = 0.7) -> DataFrame:
    """Words without a stop word of a similar length at a distance below ``limit``."""
    near = stopwords.select(F.col("word").alias("stop"), F.explode(F.sequence(F.length("word") - band, F.length("word") + band)).alias("size"))
    hit = words.withColumn("size", F.length("word")).join(near, "size").where(scores.word_distance("word", "stop") < limit).select("word").distinct()
    return words.join(hit, "word", "left_anti")


#: Cells of a block of pairs.
BLOCK = 1 << 21
#: Up to this length words are compared by bits; words of a stretch of columns; numbers of 64 bits of a block of bits.
BITS, COLUMNS, CELLS = 24, 1 << 15, 1 << 14


def near_words(words: list[str]):
    """Positions a, b (a before b) and distances of the pairs of ``words`` that ``related`` would give, for the words of some texts.

    ``words`` are distinct and rising in length. Words of up to ``BITS`` letters are compared 64 pairs at a time
    (``_near_bits``). Longer ones are compared in blocks: an edit takes at most one letter and two
    neighbouring letters from a word, so a pair that lacks more of them goes by its bits. What is left is compared letter
    by letter: strings of equal length are within two edits if two letters differ, or if what lies between the first
    and the last difference is moved by one place.
    """
    import numpy as np

    n = np.array([len(w) for w in words], np.int64)
    out = []
    one = np.flatnonzero(n == 1)
    a, b = np.triu_indices(len(one), 1)
    out.append((one[a], one[b], np.ones(len(a))))
    if top := int(np.searchsorted(n, BITS + 4, "right")):
        out += _near_bits(words[:top], n[:top])
    if (low := int(np.searchsorted(n, BITS, "right"))) < len(n):
        out += [(a + low, b + low, d) for a, b, d in _near_blocks(words[low:], n[low:])]
    return tuple(np.concatenate(x) for x in zip(*out))


def _near_bits(words: list[str], n):
    """Blocks of pairs, the shorter word with 3 to ``BITS`` letters: one bit a word that may be the longer one.

    For each place and letter a row of bits says which words have it there. A row of the shorter word's letters then
    tells, 64 words at a time, how many places of a stretch differ (none, at most one, at most two), and whether the stretch
    is equal up to a place, moved by one from there to another place, and equal after it.
    """
    import numpy as np

    codes = np.array(words, f"U{BITS + 4}").view(np.uint32).reshape(len(words), -1)
    if codes.max() < 1 << 16:
        known = np.bincount(codes.ravel()) > 0
        known[0] = True
        codes = (np.cumsum(known) - 1)[codes]
    else:
        codes = np.unique(np.append(codes.ravel(), 0), return_inverse=True)[1][:-1].reshape(codes.shape)
    kinds = int(codes.max()) + 1
    columns = max(64, min(COLUMNS, (1 << 26) // (kinds * (BITS + 4)) // 64 * 64))
    sizes = [int(x) for x in np.unique(n) if 3 <= x <= BITS]
    begins = np.searchsorted(n, np.arange(BITS + 6))
    out = []
    for first in range(0, len(words), columns):
        last = min(first + columns, len(words))
        here = codes[first:last]
        has = np.zeros((int(n[last - 1]), kinds, -(-(last - first) // 64) * 64), bool)
        at, place = np.nonzero(here)
        has[place, here[at, place], at] = True
        has = np.packbits(has, axis=-1, bitorder="little").view(np.uint64)
        for size in sizes:
            lo, hi = max(first, int(begins[size])), min(last, int(begins[min(size + 4, 2 * size) + 1]))
            if lo >= hi:
                continue
            allowed, w0, w1 = 1 if size <= ONE_EDIT else 2, (lo - first) // 64, -(-(hi - first) // 64)
            mine = codes[begins[size] : min(begins[size + 1], hi), :size].T
            step = max(1, CELLS // (w1 - w0))
            for k in range(0, mine.shape[1], step):
                planes = [np.zeros((mine[0, k : k + step].size, w1 - w0), np.uint64) for _ in range(3)]
                for shift in range(5):
                    start = max(lo, int(begins[size + shift]))
                    if start >= hi:
                        break
                    valid = np.zeros((w1 - w0) * 64, bool)
                    valid[start - first - 64 * w0 : hi - first - 64 * w0] = True
                    u = (start - first) // 64 - w0
                    found = _edits(has[shift : shift + size, :, w0 + u : w1], mine[:, k : k + step], np.packbits(valid, bitorder="little").view(np.uint64)[u:], allowed)
                    for x, y in zip(planes, found):
                        x[:, u:] |= y
                cells = np.flatnonzero(planes[allowed])
                held = [np.unpackbits(x.ravel()[cells].view(np.uint8), bitorder="little") for x in planes[: allowed + 1]]
                bits = np.flatnonzero(held[allowed])
                edits = allowed - sum((x[bits] for x in held[:allowed]), np.zeros(len(bits), np.int64))
                a, b = np.divmod(cells, w1 - w0)
                a, b = a[bits >> 6] + (int(begins[size]) + k), (b[bits >> 6] + w0) * 64 + (bits & 63) + first
                keep = a < b
                out.append((a[keep], b[keep], edits[keep] / (min(8, size) / 3.0)))
    return out


def _edits(has, mine, valid, allowed: int):
    """Bits of at most none, one and two edits between words (``mine``: a row of letters a place) and stretches (``has``: bits by place and letter)."""
    import numpy as np

    size = len(mine)
    none = one = two = np.broadcast_to(valid, (mine.shape[1], len(valid)))
    if allowed == 1:
        for p in range(size):
            same = has[p][mine[p]]
            none, one = none & same, one & same | none
        return none, one
    ahead = behind = done = np.zeros_like(none)
    for p in range(size):
        same = has[p][mine[p]]
        done = done & same | ahead | behind
        if p < size - 1:
            ahead, behind = (ahead | none) & has[p][mine[p + 1]], (behind | none) & has[p + 1][mine[p]]
        none, one, two = none & same, one & same | none, two & same | one
    return none, one, two | done


def _near_blocks(words: list[str], n):
    """Blocks of pairs of words that are longer than ``BITS`` letters."""
    import numpy as np

    out = []
    letters, couples = np.zeros(len(words), np.uint64), np.zeros(len(words), np.uint64)
    for i, w in enumerate(words):
        x, y = 0, 0
        for c in w:
            x |= 1 << (ord(c) & 63)
        for c, d in zip(w, w[1:]):
            y |= 1 << ((ord(c) * 31 + ord(d) * 17) & 63)
        letters[i], couples[i] = x, y
    for size in np.unique(n):
        rows = np.flatnonzero(n == size)
        end = int(np.searchsorted(n, size + 4, "right"))
        step = max(1, BLOCK // max(1, end - rows[0]))
        for at in range(0, len(rows), step):
            first = int(rows[at])
            here, there = slice(first, int(rows[min(at + step, len(rows)) - 1]) + 1), slice(first, end)
            a, b = np.nonzero(np.bitwise_count(letters[here, None] & ~letters[None, there]) <= 2)
            a, b = a[a < b] + first, b[a < b] + first
            close = np.bitwise_count(couples[a] & ~couples[b]) <= 4
            a, b = a[close], b[close]
            for k in range(0, len(a), (part := max(1, BLOCK // int(size)))):
                out.append(_compared(words, n, a[k : k + part], b[k : k + part], int(size), 2))
    return out


def _compared(words: list[str], n, a, b, size: int, allowed: int):
    """Of the pairs those within ``allowed`` edits: all of a's words have ``size`` letters, b's up to four more."""
    import numpy as np

    def codes(at, width):
        own, back = np.unique(at, return_inverse=True)
        return np.array([words[i] for i in own], f"U{width}").view(np.uint32).reshape(len(own), width)[back] if len(own) else np.zeros((0, width), np.uint32)

    s, longer = codes(a, size), codes(b, size + 4)
    edits = np.full(len(a), 9)
    for shift in range(5):
        at = np.flatnonzero(n[b] >= size + shift)
        if not len(at):
            break
        x, y = s[at], longer[at, shift : shift + size]
        same = x == y
        found = (~same).sum(axis=1)
        if allowed == 2 and (rest := np.flatnonzero(found > 2)).size:
            x, y, same = x[rest], y[rest], same[rest]
            lo, hi = same.argmin(axis=1), size - 1 - same[:, ::-1].argmin(axis=1)
            between = (np.arange(size - 1) >= lo[:, None]) & (np.arange(size - 1) < hi[:, None])
            moved = ~((x[:, 1:] != y[:, :-1]) & between).any(axis=1) | ~((x[:, :-1] != y[:, 1:]) & between).any(axis=1)
            found[rest[moved]] = 2
        edits[at] = np.minimum(edits[at], found)
    near = edits <= allowed
    return a[near], b[near], edits[near] / (min(8, size) / 3.0)


#: Words of the texts whose near words are found together.
TOGETHER = 1 << 12


def families(words: DataFrame, group: str = "group") -> DataFrame:
    """Greedy families of the words of a group in their order (columns group, ord, word; a group's words are distinct).

    A word may join a family if it is within distance 1 of every member; it takes the family of the
    least mean distance, or at once the first one in which it meets a member at distance 0 before one that is too far.
    Else it starts one. A group, a text's words, is one row; ``near_words`` finds the near ones among the words of a few
    texts at once, and the walk of a text then only looks at its own.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            lists = batch.column("words")
            sizes, values, found = pc.list_value_length(lists).to_numpy(zero_copy_only=False), lists.flatten(), []
            ends, at = np.cumsum(sizes), 0
            while at < len(sizes):
                begin = int(ends[at] - sizes[at])
                to = max(at + 1, int(np.searchsorted(ends, begin + TOGETHER, "right")))
                coded = values.slice(begin, int(ends[to - 1]) - begin).dictionary_encode()
                known = coded.dictionary.to_pylist()
                order = sorted(range(len(known)), key=lambda i: len(known[i]))
                rank = np.empty(len(known), np.int64)
                rank[order] = np.arange(len(known))
                near = near_words([known[i] for i in order])
                own = rank[coded.indices.to_numpy()]
                for i in range(at, to):
                    found += _walk(own[int(ends[i] - sizes[i]) - begin : int(ends[i]) - begin], *near)
                at = to
            groups = batch.column("group").take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            yield pa.RecordBatch.from_arrays([groups, pa.array(found, pa.int64()), values], names=[group, "family", "word"])

    kind = words.schema[group].dataType.simpleString()
    placed = words.groupBy(F.col(group).alias("group")).agg(F.sort_array(F.collect_list(F.struct("ord", "word"))).alias("x"))
    return placed.select("group", F.col("x")["word"].alias("words")).mapInArrow(run, f"{group} {kind}, family long, word string")


def _walk(words, a, b, distances):
    """The family of each of a text's words (numbers, in their order), given the near pairs of numbers and their distances."""
    import numpy as np

    place = np.full(max(int(words.max(initial=-1)), int(b.max(initial=-1))) + 1, -1)
    place[words] = np.arange(len(words))
    x, y = place[a], place[b]
    mine = np.flatnonzero((x >= 0) & (y >= 0))
    x, y = x[mine], y[mine]
    early, late = np.minimum(x, y), np.maximum(x, y)
    order = np.argsort(late * len(words) + early)
    starts = np.searchsorted(late[order], np.arange(len(words) + 1)).tolist()
    none = distances[mine[order]] == 0
    same = np.searchsorted(late[order][none], np.arange(len(words) + 1)).tolist()
    equal, early, distances = early[order][none].tolist(), early[order].tolist(), distances[mine[order]].tolist()
    home, turn, members = [], [], []  # of words: the family and how many came to it before; of families: their words
    for i in range(len(words)):
        near, at = early[starts[i] : starts[i + 1]], None
        if not near:
            home.append(len(members))
            turn.append(0)
            members.append([i])
            continue
        met = {}
        for q in near:
            met[home[q]] = met.get(home[q], 0) + 1
        whole = [f for f, n in met.items() if n == len(members[f])]
        # a member at distance 0 counts if all before it are near
        zero = [home[q] for q in equal[same[i] : same[i + 1]] if met[home[q]] == len(members[home[q]]) or set(members[home[q]][: turn[q]]) <= set(near)]
        if zero:
            at = min(zero)
        elif len(whole) == 1:
            at = whole[0]
        elif whole:
            total = dict.fromkeys(whole, 0.0)
            for q, d in zip(near, distances[starts[i] : starts[i + 1]]):
                if home[q] in total:
                    total[home[q]] += d
            at = min(whole, key=lambda f: (total[f] / met[f], f))
        if at is None:
            at = len(members)
            members.append([])
        home.append(at)
        turn.append(len(members[at]))
        members[at].append(i)
    return home


def family_lemmas(members: DataFrame, morph: DataFrame, *keys: str) -> DataFrame:
    """The lemma with the highest summed score over noun hypotheses (animate ones count 0.7); sums equal to nine digits are ties, by lemma."""
    nouns = members.join(morph.where("pos = 'NOUN'"), "word").withColumn("s", F.col("score") * F.when(F.col("animacy") == "anim", 0.7).otherwise(1.0))
    sums = nouns.groupBy(*keys, "lemma").agg(F.sum("s").alias("s"))
    best = sums.groupBy(*keys).agg(F.min_by("lemma", F.struct(-F.round("s", 9), F.col("lemma"))).alias("lemma"))
    return members.select(*keys).distinct().join(best, list(keys), "left")
