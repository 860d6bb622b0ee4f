"""The expected rows of ``made_pages`` in DuckDB SQL."""

from __future__ import annotations

from .pages_base import BLANK, CELLS, CHARS, SUMS, WORDS, words

EVEN = CHARS.replace("ci * 6.0::DOUBLE + CASE WHEN (doc_id * 31 + ln * 7 + ci) % 97 = 0 THEN 4 ELSE 0 END", "ci * 6.0::DOUBLE")
LINE = "(ln::BIGINT * 2147483648 + ci)"
#: Characters that are printable ASCII.
ASCII = EVEN + ", ascii AS (SELECT * FROM chars WHERE text BETWEEN ' ' AND '~' AND length(text) = 1)"
SEVERAL = """
l AS (SELECT o_custkey AS doc_id, o_orderkey, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page_number,
  row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS seq, (l_partkey % 90)::DOUBLE AS x0, (l_partkey % 90) + l_quantity AS x1
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_COUNTED = "SELECT doc_id, length(v[1]) + length(v[2]) + length(v[3]) + length(v[4]) AS s, r, v FROM lines"

PAGES = {
    # a word ends where the attribute changes too
    "t2_extra_attrs": "WITH " + words().replace("regexp_matches(text, '^", "ci // 7 % 2 AS font, regexp_matches(text, '^").replace("lag(x1) OVER l AS px1", "lag(x1) OVER l AS px1, lag(font) OVER l AS pf").replace("x0 < px0", "font <> pf OR x0 < px0").replace("ORDER BY x0, ci)", "ORDER BY ci)").replace("min(top) AS top", "min(font) AS font, min(top) AS top")
    + f" SELECT doc_id, {SUMS}, md5(string_agg(text, ' ' ORDER BY ln, w)) AS words, count(*) FILTER (font = 0) AS a FROM words GROUP BY doc_id",
    "t3_jitter": "WITH " + words(source=CHARS.replace("ln * 12.0::DOUBLE AS top, ln * 12.0::DOUBLE + 10 AS bottom", f"ln * 12.0::DOUBLE + CASE WHEN {LINE} % 5 = 0 THEN 2.5 ELSE 0 END AS top, ln * 12.0::DOUBLE + 10 + CASE WHEN {LINE} % 5 = 0 THEN 2.5 ELSE 0 END AS bottom")) + f" {WORDS}",
    "t5_rotated": f"WITH {words()} SELECT doc_id, count(*) AS n, sum(top) AS x0, sum(bottom) AS x1, sum(x0) AS top, sum(x1) AS bottom, md5(string_agg(text, ' ' ORDER BY ln, w)) AS words, 'ttb' AS direction FROM words GROUP BY doc_id",
    "t5_right_to_left": f"WITH {words(source=EVEN)} SELECT doc_id, {SUMS}, md5(string_agg(reverse(text), ' ' ORDER BY ln, w DESC)) AS words FROM words GROUP BY doc_id",
    "t5_keep_blanks": f"WITH {EVEN}, words AS (SELECT doc_id, ln, string_agg(text, '' ORDER BY ci) AS text, min(x0) AS x0, max(x1) AS x1, min(top) AS top, max(bottom) AS bottom FROM chars GROUP BY ALL) SELECT doc_id, {SUMS}, md5(string_agg(text, ' ' ORDER BY ln)) AS words FROM words GROUP BY doc_id",
    "t5_text_flow": "WITH " + words().replace("ORDER BY x0, ci", "ORDER BY ci") + f" {WORDS}",
    "t9_layout": f"""WITH {ASCII}, size AS (SELECT doc_id, floor(max(x1) / 6 + 0.5)::INT AS wide, floor(max(bottom) / 12 + 0.5)::INT AS high FROM ascii GROUP BY doc_id),
grid AS (SELECT doc_id, wide, high, unnest(range(high)) AS ln FROM size), shown AS (SELECT doc_id, ln, ci, text FROM ascii WHERE text <> ' '),
last AS (SELECT doc_id, max(ln) AS last FROM shown GROUP BY doc_id),
rows AS (SELECT g.doc_id, g.ln, string_agg(coalesce(s.text, ' '), '' ORDER BY c) AS t FROM (SELECT doc_id, ln, unnest(range(wide)) AS c FROM grid) g LEFT JOIN shown s ON s.doc_id = g.doc_id AND s.ln = g.ln AND s.ci = g.c GROUP BY ALL)
SELECT doc_id, md5(string_agg(t, chr(10) ORDER BY ln)) AS text FROM rows WHERE doc_id IN (SELECT doc_id FROM last) GROUP BY doc_id""",
    "t12_upwards": f"WITH {words(source=CHARS.replace('FROM cs))', 'FROM cs WHERE text BETWEEN chr(32) AND chr(126) AND length(text) = 1))'))}, l AS (SELECT doc_id, ln, reverse(string_agg(text, ' ' ORDER BY w)) AS t FROM words GROUP BY ALL) SELECT doc_id, md5(string_agg(t, chr(10) ORDER BY ln DESC)) AS text FROM l GROUP BY doc_id",
    "t14_ignoring_case": f"""WITH {words()}, t AS (SELECT doc_id, string_agg(text, ' ' ORDER BY ln, w) AS t FROM words GROUP BY doc_id),
m AS (SELECT doc_id, unnest(regexp_extract_all(t, '(?i)the')) AS m FROM t) SELECT doc_id, count(*) AS n, 6.0 * count(*) AS width, count(*) AS chars, count(*) FILTER (m[1] = 'T') AS upper FROM m GROUP BY doc_id""",
    "p10_limit": f"""WITH {words()}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ln, w) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM words)
SELECT doc_id, count(*) AS n, string_agg(text, ' ' ORDER BY i) AS words FROM o WHERE i >= 1 AND i < n - 1 AND (i - 1) % 3 = 0 AND (i - 1) // 3 < 4 GROUP BY doc_id""",
    "a12_far_copies": f"""WITH {EVEN}, every AS (SELECT doc_id, x0, x1, top, bottom FROM chars UNION ALL SELECT doc_id, x0 + 2.5, x1 + 2.5, top, bottom FROM chars WHERE {LINE} % 11 = 0
  UNION ALL SELECT doc_id, x0, x1, top, bottom FROM chars WHERE {LINE} % 13 = 0) SELECT doc_id, {SUMS} FROM every GROUP BY doc_id""",
    "p7_relative": f"""WITH {CHARS}, k AS (SELECT doc_id, greatest(x0, 30) AS x0, least(x1, 330) AS x1, greatest(top, 10) AS top, least(bottom, 68) AS bottom FROM chars
  WHERE least(x1, 330) >= greatest(x0, 30) AND least(bottom, 68) >= greatest(top, 10) AND least(bottom, 68) - greatest(top, 10) + least(x1, 330) - greatest(x0, 30) > 0)
SELECT doc_id, {SUMS}, sum(x1 - x0) AS width, sum(bottom - top) AS height FROM k GROUP BY doc_id""",
    # the first crop clips what the second one looks at
    "p7_crop_of_crop": f"""WITH {CHARS}, k AS (SELECT doc_id, greatest(x0, 25) AS x0, least(x1, 625) AS x1, greatest(top, 13) AS top, least(bottom, 161) AS bottom FROM chars
  WHERE least(x1, 625) >= greatest(x0, 25) AND least(bottom, 161) >= greatest(top, 13) AND least(bottom, 161) - greatest(top, 13) + least(x1, 625) - greatest(x0, 25) > 0)
SELECT doc_id, {SUMS} FROM k WHERE x0 >= 35 AND x1 <= 335 AND top >= 18 AND bottom <= 118 AND (x1 > x0 OR bottom > top) GROUP BY doc_id""",
    "e4_object_edges": f"""WITH {CELLS} SELECT doc_id, 'rect_edge' AS object_type, unnest(['h', 'v']) AS orientation, unnest([8 * n, 8 * n]) AS n, unnest([0, 2])::BIGINT AS first, unnest([n * 720.0, n * 960.0]) AS x0 FROM pages
UNION ALL SELECT doc_id, 'line', 'h', n, 16 * n, n * 60.0 FROM pages UNION ALL SELECT doc_id, 'own_edge', 'v', n, 17 * n, n * 120.0 FROM pages""",
    "a3_pages_apart": f"WITH {SEVERAL} SELECT doc_id, page_number, min(x0) AS x0, 10.0 AS top, max(x1) AS x1, max(seq) * 10.0 + 8 AS bottom FROM l GROUP BY doc_id, page_number",
    "a6_pages_apart": f"""WITH {SEVERAL}, r AS (SELECT *, max(x1) OVER (PARTITION BY o_orderkey ORDER BY x0, x1, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM l),
g AS (SELECT *, sum(CASE WHEN x0 > reach + 2 THEN 1 ELSE 0 END) OVER (PARTITION BY o_orderkey ORDER BY x0, x1, seq ROWS UNBOUNDED PRECEDING) AS k FROM r)
SELECT doc_id, page_number, min(x0) AS x0, max(x1) AS x1, max(x1) - min(x0) AS width FROM g GROUP BY doc_id, page_number, k""",
    "j1_near_the_tolerance": "SELECT o_custkey AS doc_id, count(*) AS n, sum(o_orderkey * 20)::DOUBLE AS y FROM orders WHERE o_orderkey % 3 < 2 GROUP BY o_custkey",
    "a9_many_tables": f"""WITH {CELLS} SELECT doc_id, unnest([0, 1])::BIGINT AS table_id, unnest([CASE WHEN n > 1 THEN 4 * n - 1 ELSE 4 END, 4])::BIGINT AS n, unnest([0.0, 500.0]) AS top,
  unnest([20.0 * n, 520.0]) AS bottom, unnest([360.0 * n - CASE WHEN n > 1 THEN 180 ELSE 0 END, 360.0]) AS x0 FROM pages""",
    "b4_missing_cells": f"""WITH {CELLS}, t AS (SELECT l.doc_id, r, n, v FROM lines l JOIN pages p ON p.doc_id = l.doc_id)
SELECT doc_id, 0::BIGINT AS table_id, string_agg(CASE WHEN n > 1 AND r = n - 1 THEN v[1] || '|' || v[2] || '|' || v[3] || '|<none>' ELSE array_to_string(v, '|') END, chr(10) ORDER BY r) AS rows FROM t GROUP BY doc_id
UNION ALL SELECT doc_id, 1, array_to_string(v, '|') FROM t WHERE r = 0""",
    "a10_largest_of_many": f"WITH {CELLS} SELECT doc_id, CASE WHEN n > 1 THEN 4 * n - 1 ELSE 4 END AS n, 0.0 AS top FROM pages",
    "b8_lines_strict": f"WITH {CELLS} SELECT doc_id, 2 * n AS n, 180.0 * n AS x1, 20.0 * n * (n + 1) AS bottom FROM pages",
    # lines of words have two edges each, 10 apart, and lie 20 apart
    "b9_text_rows": f"WITH {CELLS} SELECT doc_id, 2 * (2 * n - 1) AS n, 2 * (2 * n - 1) * 5 + 2 * 10.0 * (2 * n - 1) * (2 * n - 2) / 2 AS top, (120.0 + 184) * (2 * n - 1) AS x1 FROM pages",
    "b6_explicit": f"WITH {CELLS}, x AS (SELECT unnest([0.0, 100.0]) AS x0, unnest([100.0, 240.0]) AS x1), y AS (SELECT unnest([0.0, 20.0, 70.0]) AS top, unnest([20.0, 70.0, 140.0]) AS bottom) SELECT doc_id, x0, top, x1, bottom FROM pages, x, y",
    "a8_text_edges_v": f"WITH {CELLS} SELECT doc_id, unnest([2.0, 62.0, 122.0, 182.0, 202.0]) AS x0, 0.0 AS top, n * 20.0 AS bottom, n * 20.0 AS height FROM pages WHERE n >= 3",
    "j9_dense_pages": f"""WITH {CHARS}, b AS (SELECT doc_id, ln, x0 - 3 AS l, x0 + 3 AS r, top AS t, top + 5 AS u FROM chars WHERE {LINE} % 17 = 0)
SELECT doc_id, {SUMS} FROM chars c WHERE EXISTS (SELECT 1 FROM b WHERE b.doc_id = c.doc_id AND b.ln = c.ln AND least(c.x1, r) >= greatest(c.x0, l) AND least(c.bottom, u) - greatest(c.top, t) + least(c.x1, r) - greatest(c.x0, l) > 0) GROUP BY doc_id""",
    # every cell's text is a line and a box of its own
    "l3_boxes": f"""WITH {CELLS}, s AS (SELECT doc_id, sum(length(v[1]) + length(v[2]) + length(v[3]) + length(v[4]) + 4)::BIGINT AS chars, 4 * count(*) AS n, count(*) * (4 * 2 + 360.0) AS x0, sum(4 * (100000 - (20.0 * r + 5))) AS y1 FROM lines GROUP BY doc_id)
SELECT doc_id, unnest(['textlinehorizontal', 'textboxhorizontal']) AS object_type, n, chars, x0, y1 FROM s""",
    # a shifted character has a space before it; lines without a blank or missing one between them are a box; blank lines come last
    "l4_flow": f"""WITH {CHARS}, t AS (SELECT doc_id, ln, string_agg(CASE WHEN ci > 0 AND x0 > ci * 6 THEN ' ' || text ELSE text END, '' ORDER BY ci) || chr(10) AS t FROM chars GROUP BY ALL),
l AS (SELECT *, regexp_matches(t, '^{BLANK}*$') AS blank FROM t),
b AS (SELECT *, ln > coalesce(lag(ln) OVER (PARTITION BY doc_id ORDER BY ln), -9) + 1 AS opens FROM l WHERE NOT blank)
SELECT doc_id, 'textlinehorizontal' AS object_type, count(*) AS n, sum(length(t))::BIGINT AS chars, md5(string_agg(t, '' ORDER BY blank, ln)) AS text FROM l GROUP BY doc_id
UNION ALL SELECT doc_id, 'textboxhorizontal', count(*) FILTER (opens), sum(length(t))::BIGINT, md5(string_agg(t, '' ORDER BY ln)) FROM b GROUP BY doc_id""",
    "l4_without_flow": f"WITH {CELLS} SELECT doc_id, string_agg(array_to_string(v, chr(10) || chr(10)) || chr(10) || chr(10), '' ORDER BY r) || chr(12) AS text FROM lines GROUP BY doc_id",
    # characters 4 wide and 2 apart: a space between any two
    "l2_word_gaps": f"WITH {CELLS} SELECT doc_id, count(*) AS n, sum(2 * length(v[1]))::BIGINT AS chars FROM lines GROUP BY doc_id",
    "f1_clean": "SELECT l_orderkey AS doc_id, sum(round(round_even((l_partkey * 7 + l_linenumber * 37 - 500) / 128, 6) * 1000000)::BIGINT)::BIGINT AS x FROM lineitem GROUP BY l_orderkey",
    "f8_shorten": """SELECT c_custkey AS doc_id, CASE WHEN length(t) <= 21 THEN t ELSE t[1:8] || ' ... ' || t[-8:] END AS name, c_mktsegment[1:6] AS segment FROM (SELECT *, c_name || repeat('x', (c_custkey % 30)::INT) AS t FROM customer)""",
    "f12_keys": f"""WITH {SEVERAL} SELECT doc_id, sum(seq * 10.0) AS line_ttb, -sum(seq * 10.0 + 8) AS line_btt, sum(x0) AS line_ltr, -sum(x1) AS line_rtl,
  sum(seq * 10.0 + 8) AS char_ttb, -sum(seq * 10.0) AS char_btt, sum(x0) AS char_ltr, -sum(x0) AS char_rtl FROM l GROUP BY doc_id""",
}
