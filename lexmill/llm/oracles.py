"""DuckDB SQL of the queries that SQL can express: plain, quadratic where need be, for small tables."""

from __future__ import annotations

from . import mixing, neardup, sharding

WORDS = "regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD = f"""
    WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(text=LOWER)} AS w FROM documents),
    grams AS MATERIALIZED (
      SELECT DISTINCT doc_id, g FROM (
        SELECT doc_id, unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) AS g FROM w WHERE len(w) >= 4
        UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 3)),
    sizes AS MATERIALIZED (SELECT w.doc_id, count(g.g) AS n FROM w LEFT JOIN grams g ON g.doc_id = w.doc_id GROUP BY w.doc_id),
    shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
    links AS MATERIALIZED (SELECT a, b FROM shared s JOIN sizes x ON x.doc_id = s.a JOIN sizes y ON y.doc_id = s.b WHERE 100 * i >= 85 * (x.n + y.n - i)),
    reach(v, c) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.v)
    SELECT s.doc_id, s.n::BIGINT AS n_shingles, min(r.c)::BIGINT AS component_id FROM sizes s JOIN reach r ON r.v = s.doc_id GROUP BY s.doc_id, s.n"""

SPANS = f"""
    WITH w AS MATERIALIZED (SELECT doc_id, {WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
    windows AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS p, unnest(list_transform(range(1, len(w) - 18), lambda i: array_to_string(w[i:i + 19], ' '))) AS g FROM w WHERE len(w) >= 20),
    again AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS nth FROM windows) WHERE nth > 1),
    gone AS MATERIALIZED (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, unnest(range(p, p + 20)) AS i FROM again)),
    tokens AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM w),
    kept AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY t.i) AS text FROM tokens t ANTI JOIN gone g ON g.doc_id = t.doc_id AND g.i = t.i GROUP BY t.doc_id),
    counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
    SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
    FROM w LEFT JOIN counts c ON c.doc_id = w.doc_id LEFT JOIN kept k ON k.doc_id = w.doc_id"""

#: DuckDB has no crc32: the reflected polynomial, bit by bit for the table of 256 and byte by byte for the text.
CRC_OF = """(SELECT xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)
    FROM (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t))"""
CRC = CRC_OF.format(text="coalesce(text, '')")

SHARDS = f"""SELECT doc_id, size, text_crc32, 'rows' AS law, shard, slot, NULL::INT AS grown_shard FROM ({sharding.shard_sql().replace("{docs}", "documents").replace("{crc}", CRC)})"""

#: One CTE a rule of the log; the store after an epoch is the last write of each key up to it.
LOG = f"""
    WITH hashed AS MATERIALIZED (SELECT doc_id, source, text, {CRC_OF.format(text="doc_id::VARCHAR")} AS h FROM documents WHERE doc_id IS NOT NULL),
    log AS (SELECT doc_id AS id, source, h % 41 AS r, (h // 100) % 3000 AS key, text FROM hashed),
    marked AS (SELECT *, r < 2 AS is_commit, r < 3 AS is_end, r IN (3, 4) AS is_save, r IN (5, 6) AS is_back FROM log),
    txns AS (SELECT *, coalesce(sum(is_end::INT) OVER (PARTITION BY source ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS txn FROM marked),
    parts AS (SELECT *, sum(is_save::INT) OVER (PARTITION BY source, txn ORDER BY id) AS part FROM txns),
    fates AS MATERIALIZED (
      SELECT id, r, key, text,
        min(CASE WHEN is_back THEN id END) OVER (PARTITION BY source, txn, part ORDER BY id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS back,
        min(CASE WHEN is_end THEN id END) OVER (PARTITION BY source, txn) AS ender,
        bool_or(is_commit) OVER (PARTITION BY source, txn) AS done FROM parts),
    commits AS MATERIALIZED (SELECT id AS ender, (row_number() OVER (ORDER BY id) - 1) // 16 + 1 AS epoch FROM marked WHERE is_commit),
    writes AS MATERIALIZED (
      SELECT c.epoch, f.ender, f.id, f.key, CASE WHEN f.text IS NULL OR EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = f.id AND l.toxic = 1) THEN NULL ELSE f.text END AS text
      FROM fates f JOIN commits c ON c.ender = f.ender WHERE f.r > 6 AND f.back IS NULL),
    latest AS (SELECT epoch, key, max_by({{'text': text}}, (ender, id)) AS v FROM writes GROUP BY epoch, key),
    valued AS MATERIALIZED (SELECT epoch, key, v.text IS NOT NULL AS there, {CRC_OF.format(text="key::VARCHAR || ':' || v.text")} AS crc FROM latest),
    epochs AS (SELECT DISTINCT epoch FROM commits),
    stores AS (SELECT e.epoch, v.key, max_by(v.there, v.epoch) AS there, max_by(CASE WHEN v.there THEN v.crc ELSE 0 END, v.epoch) AS crc FROM epochs e LEFT JOIN valued v ON v.epoch <= e.epoch GROUP BY e.epoch, v.key)
    SELECT 'state' AS kind, epoch::BIGINT AS id, count(*) FILTER (WHERE there)::BIGINT AS n, coalesce(sum(crc) FILTER (WHERE there), 0)::BIGINT AS value FROM stores GROUP BY epoch
    UNION ALL
    SELECT CASE WHEN back IS NOT NULL THEN 'rollback' ELSE 'abort' END, id, coalesce(back, ender), key::BIGINT FROM fates WHERE r > 6 AND (back IS NOT NULL OR NOT coalesce(done, false))"""

INTERACTIONS = f"""
    WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, {WORDS.format(text="text")} AS w, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
    marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
    f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        {{'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w), 'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
         'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(w.doc_id > first, first IS NOT NULL)}} AS x
      FROM w LEFT JOIN marks m ON m.doc_id = w.doc_id),
    fails AS (SELECT part, good, toxic, list_filter(['A', 'B', 'C', 'D', 'E'], lambda k: CASE k WHEN 'A' THEN x.A WHEN 'B' THEN x.B WHEN 'C' THEN x.C WHEN 'D' THEN x.D ELSE x.E END) AS fs FROM f),
    cells AS MATERIALIZED (SELECT part, fs, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM fails GROUP BY part, fs),
    l(k) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
    orders AS (SELECT a.k || b.k || c.k || d.k || e.k AS o FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
    steps AS (SELECT o, unnest(range(1, 6)) AS step FROM orders),
    named AS (SELECT o, step, o[step] AS k, string_split(o[1:step - 1], '') AS before FROM steps),
    long AS (SELECT part, o, step, k, fs, n, good, toxic, list_contains(fs, k) AS own, list_has_any(fs, before) AS gone FROM cells, named),
    figures AS (
      SELECT part, o, step, k, coalesce(sum(n) FILTER (WHERE NOT gone AND NOT own), 0) AS kept, coalesce(sum(n) FILTER (WHERE NOT gone AND own), 0) AS removed,
        coalesce(sum(n) FILTER (WHERE gone AND own), 0) AS redundant, coalesce(sum(n) FILTER (WHERE fs = [k]), 0) AS unique_fails,
        coalesce(sum(good) FILTER (WHERE NOT gone AND own), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE NOT gone AND own), 0) AS toxic_lost
      FROM long GROUP BY part, o, step, k)
    SELECT part, o AS filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
      good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley FROM figures"""

SQL = {
    "op3_mixing": mixing.schedule_sql().replace("{docs}", "documents"),
    "op4_neardup": neardup.LINK_SQL.replace("{vectors}", "embeddings").replace("{cosine}", "0.95"),
    "op5_jaccard": JACCARD,
    "op7_spans": SPANS,
    "op9_sharding": SHARDS,
    "op11_translog": LOG,
    "op13_interactions": INTERACTIONS,
}
