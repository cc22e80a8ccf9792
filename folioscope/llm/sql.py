"""DuckDB SQL of those queries of this package that SQL can express."""

from __future__ import annotations

from folioscope.llm import decontaminate, lines, repair

SQL: dict[str, str] = {}

SQL["op6_winnowed_lines"] = f"""
WITH split AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
    FROM documents
), normal AS (
    SELECT doc_id, i, line, trim(regexp_replace(line, '[\\t\\x0B\\x0C\\r ]+', ' ', 'g')) AS words FROM split
), numbered AS (
    SELECT *, sum(CASE WHEN words <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM normal
), filled AS (
    SELECT doc_id, pos, words FROM numbered WHERE words <> ''
), runs AS (
    SELECT doc_id, pos, unnest(range(1, {lines.RUN} + 1)) AS n FROM filled
), windows AS (
    SELECT r.doc_id, r.pos, r.n, string_agg(f.words, chr(10) ORDER BY f.pos) AS lines,
           sum(len(string_split(f.words, ' '))) AS n_words, sum(strlen(f.words)) AS n_bytes
    FROM runs r JOIN filled f ON f.doc_id = r.doc_id AND f.pos >= r.pos AND f.pos < r.pos + r.n
    GROUP BY r.doc_id, r.pos, r.n HAVING count(*) = r.n
), ranked AS (
    SELECT doc_id, pos, n, row_number() OVER (PARTITION BY n, lines ORDER BY doc_id, pos) AS place
    FROM windows WHERE n = {lines.RUN} OR n_words >= {lines.WORDS} OR n_bytes >= {lines.BYTES}
), gone AS (
    SELECT DISTINCT doc_id, pos + shift AS pos FROM ranked, range({lines.RUN}) AS r(shift) WHERE place > 1 AND shift < n
), marked AS (
    SELECT n.*, g.pos IS NOT NULL AS goes FROM numbered n LEFT JOIN gone g ON n.doc_id = g.doc_id AND n.pos = g.pos
)
SELECT doc_id, CAST(sum(CASE WHEN words <> '' THEN 1 ELSE 0 END) AS BIGINT) AS n_lines,
       CAST(sum(CASE WHEN words <> '' AND goes THEN 1 ELSE 0 END) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT goes), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_WORDS = (
    "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    "'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
)
SQL["op3_benchmark_containment"] = f"""
WITH docs AS (
    SELECT doc_id, {_WORDS} AS words FROM documents
), items AS (
    SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS words FROM benchmark
), item_windows AS (
    SELECT DISTINCT item, size, array_to_string(words[s:s + size - 1], ' ') AS win
    FROM (
        SELECT item, words, least(len(words), {decontaminate.WINDOW}) AS size,
               unnest(range(1, len(words) - least(len(words), {decontaminate.WINDOW}) + 2)) AS s
        FROM items WHERE len(words) > 0
    )
), sizes AS (
    SELECT DISTINCT size FROM item_windows
), doc_windows AS (
    SELECT doc_id, size, s, array_to_string(words[s:s + size - 1], ' ') AS win
    FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS s FROM docs, sizes WHERE len(words) >= size)
), hits AS (
    SELECT d.doc_id, d.size, d.s, i.item FROM doc_windows d JOIN item_windows i ON d.size = i.size AND d.win = i.win
), hit_words AS (
    SELECT doc_id, count(DISTINCT pos) AS n_hit
    FROM (SELECT doc_id, unnest(range(s, s + size)) AS pos FROM hits) GROUP BY doc_id
), hit_items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""


def _crc32(text: str) -> str:
    """The CRC-32 of a text of ASCII characters: eight shifts per byte under the reversed polynomial."""
    return (
        f"xor(list_reduce(list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT)), "
        "lambda a, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: xor(x >> 1, 3988292384 * (x & 1)), xor(a, b)), "
        "4294967295), 4294967295)"
    )


SQL["op12_prefix_trie"] = f"""
WITH numbered AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
    FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
    SELECT conv_id, {_crc32("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM numbered GROUP BY conv_id
), rebuilt AS (
    SELECT i.conv_id, n.pos, n.role, n.text FROM ids i JOIN numbered n ON n.conv_id = i.conv_id - i.conv_id % 5 AND n.pos <= i.h
    UNION ALL
    SELECT i.conv_id, n.pos, n.role, n.text FROM ids i JOIN numbered n ON n.conv_id = i.conv_id AND n.pos > i.h
), turns AS (
    SELECT conv_id, row_number() OVER w AS depth, strlen(text) AS bytes,
           string_agg(sha256(strlen(role) || ':' || role || text), '') OVER w AS path
    FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), members AS (
    SELECT conv_id, depth, bytes, path FROM turns UNION ALL SELECT conv_id, 0, 0, '' FROM ids
), nodes AS (
    SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM members GROUP BY path, depth
), children AS (
    SELECT left(path, 64 * (depth - 1)) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), above AS (
    SELECT n.*, coalesce(n_children, 0) AS n_children, unnest(range(0, n.depth + 1)) AS d
    FROM nodes n LEFT JOIN children c ON n.path = c.path
), subtrees AS (
    SELECT left(path, 64 * d) AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves,
           sum((n_convs - 1) * bytes) AS saved_tokens, max(CASE WHEN d = depth THEN n_children END) AS n_children
    FROM above GROUP BY 1
), ends AS (
    SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
    FROM (SELECT conv_id, max(path) AS path FROM members GROUP BY conv_id) GROUP BY path
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, s.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
       CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n JOIN subtrees s USING (path) LEFT JOIN ends e USING (path)
LEFT JOIN nodes p ON n.depth > 0 AND p.path = left(n.path, 64 * (n.depth - 1))
"""


#: A path to a state: its cost in nine digits, then its initials; or none.
_NONE = "'900000000'"


def _more(path: str, initial: str, cost: str | int) -> str:
    return f"lpad(CAST(CAST({path}[1:9] AS BIGINT) + {cost} AS VARCHAR), 9, '0') || {path}[10:] || '{initial}'"


def _least(*paths: str) -> str:
    return f"least({', '.join(paths)})"


def _fits(paths: str, initial: str) -> list[str]:
    """A row kept or, if it isn't a system message, given a role, after each of the paths."""
    kept = [f"CASE WHEN goes OR initial <> '{initial}' THEN {_NONE} ELSE {_more(p, 'K', 'more')} END" for p in paths.split()]
    given = [f"CASE WHEN goes THEN {_NONE} ELSE {_more(p, 'R', f'more + {repair.REROLE}')} END" for p in paths.split()]
    return kept if initial == "s" else kept + given


_INSERTED = f"""{_least("u", *[_more(p, "I", repair.INSERT) for p in ("b", "s", "a")])} AS u1,
           {_least("a", _more("u1", "I", repair.INSERT))} AS a1"""
_SAME = "IS NOT DISTINCT FROM"

SQL["op11_auction_repair"] = f"""
WITH RECURSIVE kinds AS (
    SELECT *, {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind
    FROM conversations
), damaged AS (
    SELECT conv_id, turn, copy, CASE kind WHEN 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
           CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text
    FROM kinds, range(2) AS r(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)
), placed AS (
    SELECT *, row_number() OVER w AS pos, left(role, 1) AS initial, lead(left(role, 1)) OVER w AS next_initial,
           row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
           rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS stripped
    FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, copy)
), faulty AS (
    SELECT *, stripped = '' AS blank, stripped <> '' AND again AS duplicate,
           stripped <> '' AND NOT again AND right(stripped, 1) NOT IN ('.', '!', '?') AS truncated
    FROM placed
), counted AS (
    SELECT conv_id, max(pos) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           sum(CAST(blank AS INT)) AS blank, sum(CAST(duplicate AS INT)) AS duplicate, sum(CAST(truncated AS INT)) AS truncated,
           sum(CASE WHEN initial || next_initial NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END) AS illegal
    FROM faulty GROUP BY conv_id
), paths AS (
    SELECT conv_id, CAST(0 AS BIGINT) AS pos, '000000000' AS b, {_NONE} AS s, {_NONE} AS u, {_NONE} AS a
    FROM (SELECT DISTINCT conv_id FROM conversations)
    UNION ALL
    SELECT conv_id, pos, {_more("b", "D", repair.DELETE)},
           {_least(_more("s", "D", repair.DELETE), *_fits("b", "s"))},
           {_least(_more("u1", "D", repair.DELETE), *_fits("b s a1", "u"))},
           {_least(_more("a1", "D", repair.DELETE), *_fits("u1", "a"))}
    FROM (
        SELECT f.conv_id, f.pos, f.initial, f.blank OR f.duplicate AS goes,
               CASE WHEN f.truncated THEN {repair.TRUNCATED} ELSE 0 END AS more, p.b, p.s, {_INSERTED}
        FROM paths p JOIN faulty f ON f.conv_id {_SAME} p.conv_id AND f.pos = p.pos + 1
    )
), solved AS (
    SELECT p.conv_id, {_INSERTED}, least(b, a1) AS path, c.* EXCLUDE (conv_id)
    FROM paths p LEFT JOIN counted c ON c.conv_id {_SAME} p.conv_id WHERE p.pos = coalesce(c.n, 0)
), edits AS (
    SELECT conv_id, path[9 + j] AS edit, j, len(replace(path[10:9 + j], 'I', '')) AS pos
    FROM solved, unnest(range(1, len(path) - 8)) AS r(j)
), messages AS (
    SELECT e.conv_id, e.edit, f.role, CASE e.edit WHEN 'I' THEN '' ELSE f.text END AS text, f.initial,
           row_number() OVER (PARTITION BY e.conv_id ORDER BY j) AS place
    FROM edits e LEFT JOIN faulty f ON f.conv_id {_SAME} e.conv_id AND f.pos = e.pos WHERE e.edit <> 'D'
), lines AS (
    SELECT conv_id, place, CASE WHEN edit = 'K' THEN role WHEN (place + led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text AS line
    FROM (SELECT *, max(CASE WHEN place = 1 AND edit = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS led FROM messages)
), repaired AS (
    SELECT conv_id, string_agg(line, chr(10) ORDER BY place) AS lines FROM lines GROUP BY conv_id
)
SELECT s.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(path[1:9] AS BIGINT) AS cost, path[10:] AS audit,
       sha256(coalesce(lines, '')) AS repaired_sha256
FROM solved s LEFT JOIN repaired r ON r.conv_id {_SAME} s.conv_id
"""
