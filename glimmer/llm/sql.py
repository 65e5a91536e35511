"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

SPACE = r"[\x20\x09-\x0D]"

OP4 = r"""
WITH folded AS (
  SELECT 'd' AS side, doc_id::VARCHAR AS id, doc_id, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 'b', item_id::VARCHAR, NULL, coalesce(text, '') FROM benchmark
), split AS (
  SELECT side, id, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM folded
), items AS (
  SELECT id AS item, unnest(list_transform(range(1, greatest(2, len(w) - 8)), lambda i: array_to_string(w[i:i + 9], ' '))) AS win, least(10, len(w)) AS size
  FROM split WHERE side = 'b' AND len(w) > 0
), sizes AS (SELECT DISTINCT size FROM items
), wins AS (
  SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS i, unnest(list_transform(range(1, len(w) - size + 2), lambda j: array_to_string(w[j:j + size - 1], ' '))) AS win
  FROM split, sizes WHERE side = 'd' AND len(w) >= size
), hits AS (SELECT DISTINCT doc_id, i, wins.size, item FROM wins JOIN items USING (win, size)
), words AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM (SELECT DISTINCT doc_id, i, size FROM hits)) GROUP BY doc_id
), found AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT s.doc_id, len(s.w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(found.n, 0)::BIGINT AS n_items,
  sha256(coalesce(found.s, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM split s LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id) WHERE s.side = 'd'
"""

OP6 = rf"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS text FROM documents
), split AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM base
), tri AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) AS t FROM split
), again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS n FROM tri) WHERE n > 1
), repeats AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS k FROM again) GROUP BY doc_id
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines) AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_worded,
    coalesce(list_max(map_values(list_histogram(w))), 0) AS n_common,
    len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*\x{{2022}}]'))) AS n_bullets,
    len(list_filter(lines, lambda x: regexp_matches(x, '([.][.][.]|\x{{2026}})[\x20\x09-\x0D]*$'))) AS n_cut
  FROM split LEFT JOIN repeats USING (doc_id)
), f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_common <= 0.3 * n_words AND n_bullets <= 0.9 * greatest(1, n_lines) AND n_cut <= 0.3 * greatest(1, n_lines) AND n_dup_lines <= 0.5 * greatest(1, n_lines) AND n_worded >= 0.7 * n_words
    AND n_symbols <= 0.1 * greatest(1, n_words) AND word_chars BETWEEN 2 * n_words AND 15 * n_words AS kept
FROM f
"""

OP8_LINES = r"""
lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), firsts AS (SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k
), marked AS (SELECT keyed.*, coalesce(doc_id <> first, false) AS gone FROM keyed LEFT JOIN firsts USING (k)
), rebuilt AS (
  SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text FROM marked GROUP BY doc_id
)"""

OP8 = f"WITH {OP8_LINES} SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM rebuilt"

OP10 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p
), f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""

#: Repeated windows of 50 bytes, as pairs of hexadecimal digits.
OP5 = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS win FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM b)
), g AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) < doc_id AS again FROM w
), o AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM g WHERE again
), r AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o
), s AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS z FROM r GROUP BY doc_id, run
), k AS (SELECT doc_id, run, z, lead(a) OVER (PARTITION BY doc_id ORDER BY run) AS following, a FROM s
), t AS (
  SELECT b.doc_id, sum(z - a) AS n_removed, count(*) AS n_spans,
    substr(any_value(h), 1, 2 * min(a)) || string_agg(CASE WHEN following IS NULL THEN substr(h, 2 * z + 1) ELSE substr(h, 2 * z + 1, 2 * (following - z)) END, '' ORDER BY run) AS kept
  FROM k JOIN b USING (doc_id) GROUP BY b.doc_id
)
SELECT b.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM b LEFT JOIN t USING (doc_id)
"""


CRC32 = """
crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384))) AS t)
"""


def crc32(ascii_text: str) -> str:
    """The CRC-32 of a text of ASCII characters, where crc_table is in reach."""
    codes = f"list_transform(string_split({ascii_text}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295)"


def counted(value: str) -> str:
    return f"coalesce(strlen({value})::VARCHAR || ':' || {value}, '-')"


OP11 = f"""
WITH RECURSIVE {CRC32}, base AS (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS grp, {counted("doc_id::VARCHAR")} || {counted("source")} || {counted("lang")} AS front, {counted("text")} AS rear,
    n_chars, {crc32("coalesce(doc_id::VARCHAR, '')")} % 7 = 0 AND doc_id IS NOT NULL AS hit FROM documents, crc_table
), leaves AS (
  SELECT doc_id, grp, sha256(front || {counted("n_chars::VARCHAR")} || rear) AS leaf, sha256(front || {counted("(n_chars + CASE WHEN hit THEN 1 ELSE 0 END)::VARCHAR")} || rear) AS other FROM base
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS LAST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM leaves
), nodes AS (
  SELECT grp, 0 AS level, pos, n, leaf AS h FROM numbered
  UNION ALL SELECT grp, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY grp, level, pos // 2, n
), tops AS (SELECT grp, level AS height, h, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
), upper AS (
  SELECT 0 AS level, pos, n, h FROM tops
  UNION ALL SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM upper WHERE n > 1 GROUP BY level, pos // 2, n
), root AS (SELECT h FROM upper WHERE n = 1
), places AS (SELECT m.*, t.height, t.h AS subroot, t.pos AS top_at, (SELECT max(level) FROM upper) AS more FROM numbered m JOIN tops t USING (grp)
), steps AS (
  SELECT p.doc_id, p.leaf, p.grp, p.pos AS own, s.level, (p.pos >> s.level) & 1 AS side, x.h FROM places p, range(64) s(level) LEFT JOIN nodes x ON x.grp = p.grp AND x.level = s.level AND x.pos = xor(p.pos >> s.level, 1) WHERE s.level < p.height
  UNION ALL
  SELECT p.doc_id, p.leaf, p.grp, p.pos, p.height + s.level, (p.top_at >> s.level) & 1, x.h FROM places p, range(64) s(level) LEFT JOIN upper x ON x.level = s.level AND x.pos = xor(p.top_at >> s.level, 1) WHERE s.level < p.more
), proofs AS (
  SELECT grp, own AS pos, sha256(coalesce(string_agg(h, '' ORDER BY level), '')) AS proof_sha256 FROM steps GROUP BY grp, own
), folds AS (
  SELECT grp, pos, 0 AS level, other AS h FROM numbered
  UNION ALL SELECT f.grp, f.pos, f.level + 1, sha256(CASE WHEN s.side = 1 THEN coalesce(s.h, '') || f.h ELSE f.h || coalesce(s.h, '') END) FROM folds f JOIN steps s ON s.grp = f.grp AND s.own = f.pos AND s.level = f.level
), ends AS (SELECT grp, pos, arg_max(h, level) AS folded_root FROM folds GROUP BY grp, pos)
SELECT p.doc_id, p.leaf, p.subroot, root.h AS root, coalesce(q.proof_sha256, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = root.h AS verified
FROM places p JOIN ends e USING (grp, pos) LEFT JOIN proofs q USING (grp, pos), root
"""


OP12 = f"""
WITH RECURSIVE {CRC32}, keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS fault FROM conversations, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE fault WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM keyed WHERE fault <> 0
), placed AS (
  SELECT *, coalesce('=' || conv_id::VARCHAR, '') AS c, role[1:1] AS initial, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(strlen(role)::VARCHAR || ':' || role || text), copy) AS k,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen
  FROM damaged
), turns AS (
  SELECT *, said = '' AS blank, said <> '' AND seen AS duplicate, said <> '' AND NOT seen AND right(said, 1) NOT IN ('.', '!', '?') AS truncated,
    lag(initial) OVER (PARTITION BY c ORDER BY k) AS before FROM placed
), told AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(k) AS n FROM turns GROUP BY c
), says AS (FROM (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)) AS v(initial, q, nxt)
), paths AS (
  SELECT c, 0::BIGINT AS k, 0 AS q, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS lines FROM told
  UNION ALL
  SELECT c, k, q, best.cost, best.audit, best.lines FROM (
    SELECT c, k, q, min({{'cost': cost, 'audit': audit, 'lines': lines}}) AS best FROM (
      WITH opened AS (
        SELECT c, k, q, cost, audit, lines FROM paths
        UNION ALL SELECT c, k, s.nxt, cost + 5, audit || 'I', list_append(lines, CASE s.initial WHEN 'u' THEN 'user:' ELSE 'assistant:' END) FROM paths JOIN says s USING (q) WHERE s.initial <> 's'
      )
      SELECT o.c, t.k, o.q, o.cost + 2 AS cost, o.audit || 'D' AS audit, o.lines FROM opened o JOIN turns t ON t.c = o.c AND t.k = o.k + 1
      UNION ALL SELECT o.c, t.k, s.nxt, o.cost + CASE WHEN t.truncated THEN 5 ELSE 0 END, o.audit || 'K', list_append(o.lines, t.role || ':' || t.text)
      FROM opened o JOIN turns t ON t.c = o.c AND t.k = o.k + 1 AND NOT t.blank AND NOT t.duplicate JOIN says s ON s.q = o.q AND s.initial = t.initial
      UNION ALL SELECT o.c, t.k, s.nxt, o.cost + 1 + CASE WHEN t.truncated THEN 5 ELSE 0 END, o.audit || 'R', list_append(o.lines, CASE s.initial WHEN 'u' THEN 'user:' ELSE 'assistant:' END || t.text)
      FROM opened o JOIN turns t ON t.c = o.c AND t.k = o.k + 1 AND NOT t.blank AND NOT t.duplicate JOIN says s ON s.q = o.q AND s.initial <> 's'
    ) GROUP BY c, k, q)
), ends AS (
  SELECT p.c, p.q, p.cost, p.audit, p.lines FROM paths p JOIN told USING (c) WHERE p.k = told.n
), closed AS (
  SELECT c, min({{'cost': cost, 'audit': audit, 'lines': lines}}) AS best FROM (
    SELECT * FROM ends WHERE q IN (0, 3)
    UNION ALL SELECT c, 3, cost + 5, audit || 'I', list_append(lines, 'assistant:') FROM ends WHERE q = 2
  ) GROUP BY c
), every AS (SELECT DISTINCT conv_id, coalesce('=' || conv_id::VARCHAR, '') AS c FROM conversations)
SELECT e.conv_id, coalesce(t.gaps, 0)::BIGINT AS gaps, coalesce(t.blank, 0) AS blank, coalesce(t.duplicate, 0) AS duplicate, coalesce(t.truncated, 0) AS truncated, coalesce(t.illegal, 0) AS illegal,
  coalesce(x.best.cost, 0) AS cost, coalesce(x.best.audit, '') AS audit, sha256(coalesce(array_to_string(x.best.lines, chr(10)), '')) AS repaired_sha256
FROM every e LEFT JOIN told t USING (c) LEFT JOIN closed x USING (c)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_decontaminate": OP4, "op5_suffix_dedup": OP5, "op6_quality": OP6, "op8_line_dedup": OP8, "op10_warc": OP10, "op11_merkle": OP11, "op12_turns": OP12}
