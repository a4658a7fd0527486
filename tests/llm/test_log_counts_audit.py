"""The transaction log, prefix token counts and the audit of filter orders against plain models."""

import random
import re
import zlib
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from lexmill.llm import interactions, prefixes, translog

SCHEMA = "doc_id long, text string, lang string, source string, key long, mask int, label int, n long, epoch long, crc string"
LABELS = "doc_id long, quality int, toxic int, text string"


def docs_frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 1, 2, 3, 4, 5, "x") for i, t, lang, s in rows], SCHEMA)


def labels_frame(spark, rows):
    return spark.createDataFrame([(*r, "other") for r in rows], LABELS)


# --- transaction log ---------------------------------------------------------------------------------


def model_log(rows, toxic, per_epoch):
    """A store, and for each source a buffer and a stack of offsets; commits in the order of the log."""
    store, buffers, stacks, out, commits = {}, {}, {}, [], 0

    def state(epoch):
        out.append(("state", epoch, len(store), sum(zlib.crc32(f"{k}:{v}".encode()) for k, v in store.items())))

    for i, text, _, source in rows:
        h = zlib.crc32(str(i).encode())
        r, key = h % 41, h // 100 % 3000
        buffer, stack = buffers.setdefault(source, []), stacks.setdefault(source, [])
        if r > 6:
            buffer.append((i, key, None if i in toxic else text))
        elif r in (3, 4):
            stack.append(len(buffer))
        elif r in (5, 6):
            start = stack[-1] if stack else 0
            out += [("rollback", d, i, k) for d, k, _ in buffer[start:]]
            del buffer[start:]
        else:
            if r == 2:
                out += [("abort", d, i, k) for d, k, _ in buffer]
            else:
                for _, k, v in buffer:
                    if v is None:
                        store.pop(k, None)
                    else:
                        store[k] = v
                commits += 1
                if commits % per_epoch == 0:
                    state(commits // per_epoch)
            buffer.clear()
            stack.clear()
    out += [("abort", d, None, k) for b in buffers.values() for d, k, _ in b]
    if commits % per_epoch:
        state(commits // per_epoch + 1)
    return Counter(out)


def got_log(frame):
    return Counter((r.kind, r.id, r.n, r.value) for r in frame.select("kind", "id", "n", "value").collect())


def change_ids(n, key=None):
    found, i = [], 10_000_000
    while len(found) < n:
        h = zlib.crc32(str(i).encode())
        if h % 41 > 6 and (key is None or h // 100 % 3000 < key):
            found.append(i)
        i += 1
    return found


@pytest.mark.parametrize("seed", range(3))
def test_log_against_a_store(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(rng.choice([900, 1500])):
        source = rng.choice([None, "a", "a", "a", "b", ""])
        rows.append((i - 20, rng.choice([None, "", f"t{rng.randrange(40)}", "å" * 5]), "en", source))
    toxic = {i for i, *_ in rows if rng.random() < 0.1}
    marks = [(i, 0, 1) for i in toxic] + [(i, 1, None) for i, *_ in rows[:50]] + [(i, None, 0) for i in list(toxic)[:5]] + [(None, 1, 1), (10**12, 0, 1)]
    shuffled = [*rows, (None, "no id", "en", "a")]
    rng.shuffle(shuffled)
    got = translog.reassemble(docs_frame(spark, shuffled).repartition(5), labels_frame(spark, marks), per_epoch=rng.choice([1, 3, 16]) if seed else 4)
    per_epoch = 4 if seed == 0 else None
    states = [k for k in got_log(got) if k[0] == "state"]
    if per_epoch is None:  # the number of states tells the epoch size that was drawn
        commits = sum(zlib.crc32(str(i).encode()) % 41 < 2 for i, *_ in rows)
        per_epoch = next(p for p in (1, 3, 16) if -(-commits // p) == len(states))
    assert got_log(got) == model_log(rows, toxic, per_epoch)


def test_log_of_few_keys_and_long_transactions(spark):
    """Writes of few keys in many epochs: values come back from chunks of epochs long before; one source, no end for long."""
    rng = random.Random(9)
    changes = iter(change_ids(600, key=40))
    ends = [i for i in range(20_000_000, 20_100_000) if zlib.crc32(str(i).encode()) % 41 < 2]
    rows = []
    for c, end in zip(range(60), ends, strict=False):
        rows += [(next(changes) - 10_000_000, f"v{rng.randrange(9)}", "en", "s") for _ in range(3)]
        rows.append((end, None, "en", "s"))
    at = {r[0]: k for k, r in enumerate(rows)}  # ids are hashed, so the log's order is that of the ids
    rows.sort(key=lambda r: r[0])
    assert len(at) == len(rows)
    assert got_log(translog.reassemble(docs_frame(spark, rows), labels_frame(spark, []), per_epoch=2)) == model_log(rows, set(), 2)
    open_ = [(i, "x", "en", None) for i in change_ids(300)]
    assert got_log(translog.reassemble(docs_frame(spark, open_), labels_frame(spark, []))) == model_log(open_, set(), 16)


def test_log_defined_cases(spark):
    empty = translog.reassemble(docs_frame(spark, []), labels_frame(spark, []))
    assert empty.collect() == [] and empty.columns == ["kind", "id", "n", "value"]
    commit = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 41 < 2)
    change = next(i for i in range(commit) if zlib.crc32(str(i).encode()) % 41 > 6)
    rows = [(change, "b", "en", "s"), (change, "a", "en", "s"), (change, "a", "en", "s"), (commit, None, "en", "s"), (commit, None, "en", "s")]
    key = zlib.crc32(str(change).encode()) // 100 % 3000
    values = [zlib.crc32(f"{key}:{t}".encode()) for t in "ab"]
    got = got_log(translog.reassemble(docs_frame(spark, rows), labels_frame(spark, []), per_epoch=1))
    assert sorted(got) in ([("state", 1, 1, v), ("state", 2, 1, v)] for v in values)  # one of them is last, by digest
    assert got == got_log(translog.reassemble(docs_frame(spark, rows[::-1]), labels_frame(spark, []), per_epoch=1))


def test_machine_of_one_source():
    m = translog.Source()
    m.buffer += ["a", "b"]
    assert m.step(translog.IS_SAVEPOINT, 1, 0) == []
    m.buffer.append("c")
    assert m.step(translog.IS_ROLLBACK, 2, 0) == ["c"] and m.step(translog.IS_ROLLBACK, 3, 0) == []  # the savepoint is still there
    assert m.step(translog.IS_COMMIT, 4, 0) == ["a", "b"] and m.savepoints == []
    m.buffer.append("d")
    assert m.step(translog.IS_ROLLBACK, 5, 1) == ["d"]
    assert m.first == (translog.IS_SAVEPOINT, 1, 0) and m.end == (translog.IS_COMMIT, 4, 0)


# --- prefix counts -----------------------------------------------------------------------------------

tokenizers = pytest.importorskip("public_tokenizers")
spm = pytest.importorskip("sentencepiece")
TEXTS = [
    None, "", " ", "  ", "a", "the cat", "Hello  world\n\n\tof   things", "<s> </s><unk> <0x41> <pad>", "▁▁ x▁y", "naïve ﬁ Å é日本語のテキスト", "😀😀 emoji 👩‍👩‍👧", "\x00\x01 nul", "aaaaaaaaaaaaaaaaaaaaaaaa",
    "x" * 500, " " * 70, ("     " * 3 + "indented code = 1;\n") * 9, "1234567890 3.14159", "word " * 3000, "ab" * 40 + " " + "tion" * 30, "ÀÉÎõü straße", "a b\rc", "е́ кириллица текст",
]


@pytest.fixture(scope="module")
def library():
    return spm.SentencePieceProcessor(model_file=tokenizers.path("piece_bpe_32k.model"))


def test_every_prefix_as_the_library_counts_it(library):
    counter = prefixes.Counter(prefixes.vocabulary(tokenizers.path("piece_bpe_32k.model")))
    rng = random.Random(2)
    pool = " the of ing and tion  ▁▁ er in é日\n<s>0123\tABC-.,'"
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 90))) for _ in range(300)]
    for text, n in zip(texts, counter.of(texts), strict=True):
        assert len(n) == len(text) + 1
        places = range(len(text) + 1) if len(text) < 120 else [0, len(text), *rng.sample(range(len(text)), 30)]
        assert [int(n[i]) for i in places] == [len(library.encode(text[:i])) for i in places], text[:60]


def test_counts_do_not_depend_on_what_is_kept(library, monkeypatch):
    monkeypatch.setattr(prefixes, "KEPT_CHARS", 50)
    monkeypatch.setattr(prefixes, "KEPT_PAIRS", 20)
    counter = prefixes.Counter(prefixes.vocabulary(tokenizers.path("piece_bpe_32k.model")))
    for text in ["some longer words here", "other words, again and again", "x" * 200, ""]:
        assert [int(n[-1]) for n in counter.of([text])] == [len(library.encode(text))]


def test_count_and_answers_from_stored_prefixes(spark, library):
    path = tokenizers.path("piece_bpe_32k.model")
    docs = docs_frame(spark, [(i if i != 3 else None, t, "en", "s") for i, t in enumerate(TEXTS)] + [(1, "", "en", "s")])
    got = Counter(map(tuple, prefixes.count(docs, path, limit=50).collect()))
    assert all(len(r) == 5 for r in got)
    want = Counter()
    for i, t in [*enumerate(TEXTS), (1, "")]:
        t = t or ""
        n = [len(library.encode(t[:k])) for k in range(len(t) + 1)] if len(t) < 700 else None
        total = len(library.encode(t))
        want[(i if i != 3 else None, len(t.encode()), total, total > 50, max(k for k, x in enumerate(n) if x <= 50) if n else 5 * 50 - 1)] += 1
    got_short = Counter({k: v for k, v in got.items() if k[1] < 2000})
    assert got_short == Counter({k: v for k, v in want.items() if k[1] < 2000}) and len(got) == len(want)
    held = prefixes.prefixes(docs.where("doc_id = 5 or doc_id = 6"), path)
    rows = held.select("doc_id", prefixes.tokens_of("counts", 4).alias("four"), prefixes.tokens_of("counts", 10**6).alias("all"), prefixes.longest_within("counts", 1).alias("one"), prefixes.windows_within("counts", 2).alias("parts"))
    for r in rows.collect():
        t = TEXTS[r.doc_id]
        n = [len(library.encode(t[:k])) for k in range(len(t) + 1)]
        assert (r.four, r.all, r.one, r.parts) == (n[4], n[-1], max(k for k, x in enumerate(n) if x <= 1), -(-n[-1] // 2))
    assert prefixes.count(docs.limit(0), path).collect() == []


def test_other_models_are_refused(tmp_path):
    with pytest.raises(Exception):
        prefixes.vocabulary(str(tmp_path / "none.model"))


# --- audit of filter orders --------------------------------------------------------------------------


def model_audit(rows, marks):
    good = {i for i, q, _ in marks if q == 1 and i is not None}
    toxic = {i for i, _, t in marks if t == 1 and i is not None}
    by_text = {}
    for i, t, _, _ in rows:
        by_text.setdefault(t or "", []).append(i)
    docs = []
    for i, t, lang, _ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        ids = [x for x in by_text[t] if x is not None]
        tests = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), bool(ids) and (i is None or min(ids) < i)]
        docs.append((lang or "", {k for k, failed in zip("ABCDE", tests, strict=True) if failed}, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, k in enumerate(order, 1):
                gone = [d for d in left if k in d[1]]
                kept = [d for d in left if k not in d[1]]
                out[part, "".join(order), step] = [len(kept), len(gone), sum(k in d[1] for d in mine) - len(gone), sum(d[1] == {k} for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                shapley[part, k] += len(gone)
                left = kept
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_against_all_orders(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [(None, "same", "en", "s"), (1, "same", None, "s"), (1, "same", "", "s"), (0, None, "en", "s"), (7, "", "fr", "s"), (None, "", "en", "s"), (None, "nobody", "en", "s"), (None, "nobody", "fr", "s")]
    for i in range(10, 150):
        words = rng.choices(vocabulary if rng.random() < 0.6 else vocabulary[:20], k=rng.choice([5, 199, 200, 230]))
        text = rng.choice([" ", "\n", "\x0b\t", " "]).join(words)
        text += rng.choice(["", " #", " |", "A" * rng.randrange(60)])
        rows.append((rng.choice([i, i, i - 1]), text, rng.choice(["en", "fr", None]), "s"))
    rows += [(rng.randrange(300), rng.choice(rows)[1], rng.choice(["en", "de"]), "s") for _ in range(60)] + [rows[9], rows[9]]
    marks = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 300, 2)] + [(1, 1, 0), (1, 0, 1), (None, 1, 1)]
    got = interactions.audit(docs_frame(spark, rows).repartition(7), labels_frame(spark, marks))
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    found = {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in got.collect()}
    assert found == model_audit(rows, marks)
    assert {f for f, t in got.dtypes} == {"part", "filter_order", "step", *names} and got.count() == len(found)
    assert dict(got.dtypes)["step"] == "int"


def test_audit_of_no_documents(spark):
    assert interactions.audit(docs_frame(spark, []), labels_frame(spark, [])).collect() == []


def test_the_same_id_with_many_texts_is_counted_once_each(spark):
    rows = [(5, f"text {i}", "en", "s") for i in range(50)]
    kept = interactions.audit(docs_frame(spark, rows), labels_frame(spark, [(5, 1, 1)])).where("filter_order = 'EABCD' and step = 1").select("kept", F.lit(1)).collect()
    assert kept == [(50, 1)]
