"""SQL of the queries that DuckDB can express."""

from __future__ import annotations

from quillmesh.llm.decontaminate import WINDOW as ITEM_WINDOW
from quillmesh.llm.phrases import WINDOW as PHRASE_WINDOW
from quillmesh.llm.suffixes import WINDOW as PASSAGE_WINDOW

_WORD = r"'[^\x20\x09-\x0D]+'"
_WORDS = f"regexp_extract_all(coalesce(text, ''), {_WORD})"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PLAIN_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def repeated_windows(n: int) -> str:
    return f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, i, sha256(array_to_string(w[i:i+{n - 1}], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM d)),
f AS (SELECT h, min(doc_id) AS first FROM g GROUP BY h HAVING count(DISTINCT doc_id) > 1),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + {n})) AS k FROM g JOIN f USING (h) WHERE doc_id > first),
x AS (SELECT doc_id, list(k) AS gone FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda v, k: NOT list_contains(gone, k)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id)"""


DECONTAMINATE = f"""WITH d AS (SELECT doc_id, {_PLAIN_WORDS} AS w FROM documents), b AS (SELECT item_id, {_PLAIN_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
k AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i+n-1], ' ') AS key FROM (SELECT item_id, w, least({ITEM_WINDOW}, len(w)) AS n, unnest(range(1, greatest(1, len(w) - {ITEM_WINDOW - 1}) + 1)) AS i FROM b WHERE len(w) > 0)),
g AS (SELECT doc_id, n, i, array_to_string(w[i:i+n-1], ' ') AS key FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM k))),
h AS (SELECT doc_id, i, g.n, item_id FROM g JOIN k ON g.n = k.n AND g.key = k.key),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(its.n, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)"""

QUALITY = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
f AS (SELECT doc_id, h FROM g GROUP BY doc_id, h HAVING count(*) > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT g.doc_id, unnest(range(i, i + 5)) AS p FROM g JOIN f ON g.doc_id = f.doc_id AND g.h = f.h) GROUP BY doc_id),
c AS (SELECT d.doc_id, text, w, l, len(w) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS stutter FROM d LEFT JOIN r ON d.doc_id = r.doc_id),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
NOT base_failed AND NOT (n_symbols > 0.05 * word_chars OR n_dup_lines > 0.5 * len(l) OR length(regexp_replace(text, '[^!]', '', 'g')) > 0.3 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR stutter > 0.2 * n_words
OR (n_words >= 50 AND len(list_distinct(w)) < 0.1 * n_words) OR length(regexp_replace(text, '[^\\p{{Nd}}]', '', 'g')) > 0.5 * word_chars OR length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g')) > 0.5 * length(regexp_replace(text, '[^\\p{{L}}]', '', 'g'))) AS kept FROM v"""

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
WARC = f"""WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes,
array_to_string(list_transform(range(32), lambda i: substr('{_LETTERS}', 1 + CAST((CAST('0x' || substr(h, 5 * CAST(i // 4 AS INT) + 1, 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT), 1)), '') AS payload_digest,
CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first OR page_id IS NULL THEN first END AS refers_to FROM f"""

#: CRC-32 of a short text: the table of bytes, and an expression over it.
_CRC_TABLE = """crc_table AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([CAST(i AS BIGINT)], range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i)))"""


def crc32(text: str) -> str:
    return f"xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split({text}, ''), lambda ch: CAST(ord(ch) AS BIGINT))), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)))"


TRIE = f"""WITH {_CRC_TABLE},
turns AS (SELECT conv_id, octet_length(encode(text)) AS bytes, told, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, told) AS pos
  FROM (SELECT conv_id, turn, role, text, sha256(octet_length(encode(role)) || ':' || role || text) AS told FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL))),
convs AS (SELECT conv_id, conv_id - conv_id % 5 AS base, CASE WHEN conv_id % 5 = 0 THEN 0 ELSE {crc32('CAST(conv_id AS VARCHAR)')} % 9 END AS h FROM (SELECT DISTINCT conv_id FROM turns), crc_table),
begun AS (SELECT c.*, coalesce(n, 0) AS n FROM convs c LEFT JOIN (SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id) b ON b.conv_id = base),
made AS (SELECT c.conv_id, t.pos AS d, told, bytes FROM begun c JOIN turns t ON t.conv_id = base AND pos <= h WHERE c.conv_id <> base
  UNION ALL SELECT c.conv_id, least(h, n) + pos - h, told, bytes FROM begun c JOIN turns t ON t.conv_id = c.conv_id AND pos > h),
seq AS (SELECT c.conv_id, coalesce(l, []) AS l, coalesce(b, []) AS b FROM convs c LEFT JOIN (SELECT conv_id, list(told ORDER BY d) AS l, list(bytes ORDER BY d) AS b FROM made GROUP BY conv_id) m USING (conv_id)),
path AS (SELECT conv_id, d, sha256(array_to_string(l[1:d], ',')) AS node, sha256(array_to_string(l[1:d-1], ',')) AS above, CASE WHEN d > 0 THEN b[d] ELSE 0 END AS bytes, d = len(l) AS ends
  FROM (SELECT conv_id, l, b, unnest(range(0, len(l) + 1)) AS d FROM seq)),
nodes AS (SELECT node, d, any_value(above) AS above, any_value(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n, coalesce(string_agg(CASE WHEN ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '') AS ids FROM path GROUP BY node, d),
kids AS (SELECT above, d - 1 AS d, count(*) AS k FROM nodes WHERE d > 0 GROUP BY above, d),
own AS (SELECT n.*, coalesce(k, 0) AS k FROM nodes n LEFT JOIN kids ON kids.above = n.node AND kids.d = n.d),
sums AS (SELECT p.node, p.d, sum(CASE WHEN k = 0 THEN 1 ELSE 0 END) AS leaves, sum((n - 1) * o.bytes) AS saved FROM own o JOIN path p ON p.conv_id = o.conv_id AND p.d <= o.d GROUP BY p.node, p.d)
SELECT o.conv_id, o.d AS depth, CASE WHEN o.d > 0 THEN a.conv_id END AS parent_conv_id, o.n AS n_convs, o.k AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(o.ids) AS ends_sha256
FROM own o JOIN sums USING (node, d) LEFT JOIN nodes a ON a.node = o.above AND a.d = o.d - 1"""


def _step(q: str, want: str, wanted: str, keeps: str) -> str:
    """The best of deleting, keeping and renaming the row before state q; `want`: the state after it, `wanted`: the role."""
    more = "CASE WHEN cut THEN 3 ELSE 0 END"
    take = lambda cost, letter, then, line: f"{{'c': {cost} + {then}.c, 'a': '{letter}' || {then}.a, 'l': list_concat([{line}], {then}.l)}}"
    keep = "".join(f" WHEN {test} THEN {take(more, 'K', then, chr(39) + chr(39) + ' || role || ' + chr(39) + ':' + chr(39) + ' || text')}" for test, then in keeps and [k.split(">") for k in keeps.split(";")] or [])
    options = [f"{{'c': 4 + {q}.c, 'a': 'D' || {q}.a, 'l': {q}.l}}", f"CASE WHEN gone THEN NULL ELSE {take('3 + ' + more, 'R', want, chr(39) + wanted + ':' + chr(39) + ' || text')} END"]
    if keep:
        options.append(f"CASE WHEN gone THEN NULL{keep} END")
    return f"list_min([{', '.join(options)}])"


def _puts(s: str, a: str, u: str, state: str) -> str:
    """States of which rows may be put in before: a, u are those after an assistant's and a user's row."""
    put = lambda then, role: f"{{'c': 3 + {then}.c, 'a': 'I' || {then}.a, 'l': list_concat(['{role}:'], {then}.l)}}"
    return {"a": f"list_min([{a}, {put(u, 'user')}])", "u": f"list_min([{u}, {put(a, 'assistant')}])"}.get(state) or f"list_min([{s}, {put(u, 'user')}])"


_NEVER = "{'c': CAST(1000000000 AS BIGINT), 'a': '', 'l': CAST([] AS VARCHAR[])}"
_DONE = "{'c': CAST(0 AS BIGINT), 'a': '', 'l': CAST([] AS VARCHAR[])}"
#: States: n before any row, s after a system's, u after a user's, a after an assistant's.
REPAIR = f"""WITH RECURSIVE {_CRC_TABLE},
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS k FROM conversations, crc_table),
damaged AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM keyed WHERE k <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\\z') AS open FROM placed),
rows_ AS (SELECT *, blank OR again AS gone, open AND NOT blank AND NOT again AS cut, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substr(role, 1, 1) AS pair FROM seen),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (cut) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS m FROM rows_ GROUP BY conv_id),
walk AS (SELECT conv_id, m AS i, {_puts(_DONE, _DONE, _NEVER, 'n')} AS n, {_NEVER} AS s, {_puts(_DONE, _DONE, _NEVER, 'u')} AS u, {_DONE} AS a FROM facts
UNION ALL SELECT conv_id, i - 1, {_puts('n', 'a', 'u', 'n')}, {_puts('s', 'a', 'u', 's')}, {_puts('s', 'a', 'u', 'u')}, {_puts('s', 'a', 'u', 'a')} FROM (
  SELECT w.conv_id, w.i, {_step('w.n', 'w.u', 'user', "substr(role, 1, 1) = 's'>w.s;substr(role, 1, 1) = 'u'>w.u")} AS n, {_step('w.s', 'w.u', 'user', "substr(role, 1, 1) = 'u'>w.u")} AS s,
  {_step('w.u', 'w.a', 'assistant', "substr(role, 1, 1) = 'a'>w.a")} AS u, {_step('w.a', 'w.u', 'user', "substr(role, 1, 1) = 'u'>w.u")} AS a
  FROM walk w JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i WHERE w.i > 0))
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(w.n.c, 0) AS cost, coalesce(w.n.a, '') AS audit, sha256(coalesce(array_to_string(w.n.l, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN walk w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = 0"""

ORACLE_SQL = {
    "op2_suffixes": repeated_windows(PASSAGE_WINDOW),
    "op4_quality": QUALITY,
    "op9_phrases": repeated_windows(PHRASE_WINDOW),
    "op10_decontaminate": DECONTAMINATE,
    "op11_warc": WARC,
    "op12_repair": REPAIR,
    "op13_trie": TRIE,
}
