"""The catalogue's queries in DuckDB SQL."""

from __future__ import annotations

import re

from .made_sql import MADE
from .pages_base import CELLS, CHARS, SUMS, WORDS, words
from .pages_sql import PAGES

BOX = (60.0, 12.0, 600.0, 118.0)
_OVERLAP = "least(x1, 600) >= greatest(x0, 60) AND least(bottom, 118) >= greatest(top, 12) AND least(bottom, 118) - greatest(top, 12) + least(x1, 600) - greatest(x0, 60) > 0"
QUERIES = {
    "p2_crop": f"""WITH {CHARS}, k AS (SELECT doc_id, greatest(x0, 60) AS x0, least(x1, 600) AS x1, greatest(top, 12) AS top, least(bottom, 118) AS bottom, top AS was, bottom AS wasb FROM chars WHERE {_OVERLAP})
SELECT doc_id, {SUMS}, sum(x1 - x0) AS width, sum(bottom - top) AS height, sum(top) AS doctop, sum(100000 - wasb - (bottom - wasb)) AS y0, sum(100000 - was - (top - was)) AS y1 FROM k GROUP BY doc_id""",
    "p3_within": f"WITH {CHARS} SELECT doc_id, {SUMS} FROM chars WHERE x0 >= 60 AND x1 <= 600 AND top >= 12 AND bottom <= 118 GROUP BY doc_id",
    "p4_outside": f"WITH {CHARS} SELECT doc_id, {SUMS} FROM chars WHERE NOT ({_OVERLAP}) GROUP BY doc_id",
    "p10_slice": f"WITH {words()}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ln DESC, w DESC) AS back FROM words) SELECT doc_id, count(*) AS n, string_agg(text, ' ' ORDER BY ln, w) AS words FROM o WHERE back <= 5 GROUP BY doc_id",
    "t4_words": f"WITH {words()} {WORDS}",
    "t4_punct": f"WITH {words(punctuation=True)} {WORDS}",
    "t4_ratio": f"WITH {words('4.5')} {WORDS}",
    "t10_text": f"WITH {words()}, l AS (SELECT doc_id, ln, string_agg(text, ' ' ORDER BY w) AS t FROM words GROUP BY ALL) SELECT doc_id, string_agg(t, chr(10) ORDER BY ln) AS text FROM l GROUP BY doc_id",
    "t13_text_lines": f"WITH {words()} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ln) - 1 AS line_seq, string_agg(text, ' ' ORDER BY w) AS text, min(x0) AS x0, min(top) AS top, max(x1) AS x1, max(bottom) AS bottom FROM words GROUP BY doc_id, ln",
    "t14_search": f"WITH {words()} SELECT doc_id, sum((length(text) - length(replace(text, 'the', ''))) // 3)::BIGINT AS n FROM words GROUP BY doc_id HAVING sum((length(text) - length(replace(text, 'the', ''))) // 3) > 0",
    "a12_dedupe": f"WITH {CHARS} SELECT doc_id, {SUMS} FROM chars GROUP BY doc_id",
    "a13_bounding_box": f"WITH {CHARS} SELECT doc_id, min(x0) AS x0, min(top) AS top, max(x1) AS x1, max(bottom) AS bottom FROM chars GROUP BY doc_id",
    "a7_text_edges_h": f"WITH {words()} SELECT doc_id, 2 * count(DISTINCT ln) AS n, min(x0) AS x0, max(x1) AS x1, (SELECT sum(y) FROM (SELECT unnest([min(q.top), max(q.bottom)]) AS y FROM words q WHERE q.doc_id = w.doc_id GROUP BY q.ln)) AS top FROM words w GROUP BY doc_id",
    "a1_cluster": """WITH f AS (SELECT l_partkey, l_quantity AS x, CASE WHEN l_quantity > lag(l_quantity) OVER (PARTITION BY l_partkey ORDER BY l_quantity) + 2 THEN 1 ELSE 0 END AS new FROM lineitem),
g AS (SELECT *, sum(new) OVER (PARTITION BY l_partkey ORDER BY x RANGE UNBOUNDED PRECEDING) AS c FROM f) SELECT l_partkey AS doc_id, c::BIGINT AS cluster, count(*) AS n, min(x) AS low, max(x) AS high FROM g GROUP BY ALL""",
    "a4_snap": """WITH e AS (SELECT l_suppkey AS doc_id, (l_orderkey % 500)::DOUBLE AS x FROM lineitem),
f AS (SELECT *, CASE WHEN x > lag(x) OVER (PARTITION BY doc_id ORDER BY x) + 1 THEN 1 ELSE 0 END AS new FROM e),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY x RANGE UNBOUNDED PRECEDING) AS c FROM f),
m AS (SELECT doc_id, c, round(avg(x), 3) AS x0, count(*) AS n FROM g GROUP BY ALL) SELECT doc_id, x0, sum(n)::BIGINT AS n FROM m GROUP BY ALL""",
    "a5_join_edges": """WITH e AS (SELECT l_suppkey AS doc_id, l_linenumber::DOUBLE AS top, (l_orderkey % 5000)::DOUBLE AS x0, (l_orderkey % 5000)::DOUBLE + l_quantity::INT AS x1 FROM lineitem),
r AS (SELECT *, max(x1) OVER (PARTITION BY doc_id, top ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e),
g AS (SELECT *, sum(CASE WHEN x0 > reach + 3 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, top ORDER BY x0, x1 RANGE UNBOUNDED PRECEDING) AS k FROM r)
SELECT doc_id, top, min(x0) AS x0, max(x1) AS x1 FROM g GROUP BY doc_id, top, k""",
    "e1_rect_edges": f"WITH {CELLS} SELECT doc_id, (4 * 4 * n) AS n, (4 * n * 2 * 60.0)::DOUBLE AS width, (4 * n * 2 * 20.0)::DOUBLE AS height FROM pages",
    "p9_filter_edges": f"WITH {CELLS} SELECT doc_id, (2 * 4 * n) AS n FROM pages",
    "e2_curve_edges": """WITH o AS (SELECT o_orderkey AS doc_id, (1 + o_custkey % 100)::DOUBLE AS a, (1 + o_orderkey % 50)::DOUBLE AS b FROM orders)
SELECT doc_id, unnest([0, 1, 2]) AS part, unnest(['h', 'v', NULL]) AS orientation, unnest([0.0, a, 0.0]) AS x0, unnest([a, a, a]) AS x1, unnest([0.0, 0.0, 0.0]) AS top, unnest([0.0, b, b]) AS bottom FROM o""",
    "e3_line_edges": "SELECT o_orderkey AS doc_id, CASE WHEN o_custkey % 2 = 0 THEN 'h' ELSE 'v' END AS orientation, 'line' AS object_type FROM orders",
    "a6_merge_edges": f"""WITH {CELLS} SELECT doc_id, 'h' AS orientation, n + 1 AS n, 240.0 * (n + 1) AS length, 20.0 * n * (n + 1) / 2 AS at FROM pages
UNION ALL SELECT doc_id, 'v', 5, 20.0 * n * 5, 600.0 FROM pages""",
    "j1_intersections": f"WITH {CELLS} SELECT doc_id, 5 * (n + 1) AS n, 600.0 * (n + 1) AS x, 5 * 20.0 * n * (n + 1) / 2 AS y FROM pages",
    "j2_cells": f"WITH {CELLS}, c AS (SELECT unnest([0, 1, 2, 3]) AS c) SELECT doc_id, 0 AS table_id, c * 60.0 AS x0, r * 20.0 AS top, c * 60.0 + 60 AS x1, r * 20.0 + 20 AS bottom FROM lines, c",
    "j3_chars_in_cells": f"WITH {CELLS} SELECT doc_id, sum(length(v[1]) + length(v[2]) + length(v[3]) + length(v[4]))::BIGINT AS n FROM lines GROUP BY doc_id",
    "a10_largest_table": f"WITH {CELLS} SELECT doc_id, 4 * n AS n FROM pages",
    "a11_rows": f"WITH {CELLS} SELECT doc_id, r AS row, 4::BIGINT AS n, 0.0 AS x0, r * 20.0 AS top, 240.0 AS x1, r * 20.0 + 20 AS bottom FROM lines",
    "b3_extract_table": f"WITH {CELLS} SELECT doc_id, string_agg(array_to_string(v, '|'), chr(10) ORDER BY r) AS rows FROM lines GROUP BY doc_id",
    "a15_doctop": "WITH p AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page_number, (600 + o_orderkey % 300)::DOUBLE AS height FROM orders) SELECT doc_id, page_number, coalesce(sum(height) OVER (PARTITION BY doc_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS doctop_offset FROM p",
    "a16_mcid_text": f"WITH {CHARS}, m AS (SELECT doc_id, ln AS mcid, string_agg(text, '' ORDER BY ci) AS t FROM chars GROUP BY ALL), e AS (SELECT doc_id, unnest(range(max(mcid) + 1)) AS mcid FROM m GROUP BY doc_id) SELECT e.doc_id, e.mcid::INT AS mcid, coalesce('P: ' || t, '') AS text FROM e LEFT JOIN m ON m.doc_id = e.doc_id AND m.mcid = e.mcid",
    "a17_counts": f"WITH {CELLS} SELECT 'rect' AS object_type, (SELECT 4 * count(*) FROM lines) AS n UNION ALL SELECT 'char', (SELECT sum(length(v[1]) + length(v[2]) + length(v[3]) + length(v[4]))::BIGINT FROM lines)",
    "f7_alpha": """WITH RECURSIVE a AS (SELECT o_orderkey AS doc_id, o_orderkey AS rest, '' AS s FROM orders UNION ALL SELECT doc_id, (rest - 1) // 26, chr((97 + (rest - 1) % 26)::INT) || s FROM a WHERE rest > 0) SELECT doc_id, s AS alpha FROM a WHERE rest = 0""",
    "f6_roman": """SELECT o_orderkey AS doc_id, ['', 'm', 'mm', 'mmm'][k // 1000 + 1] || ['', 'c', 'cc', 'ccc', 'cd', 'd', 'dc', 'dcc', 'dccc', 'cm'][k // 100 % 10 + 1] || ['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'][k // 10 % 10 + 1] || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][k % 10 + 1] AS roman
FROM (SELECT o_orderkey, o_orderkey % 3999 + 1 AS k FROM orders)""",
    "p1_filter": f"WITH {CHARS} SELECT doc_id, {SUMS} FROM chars WHERE text BETWEEN 'A' AND 'Z' GROUP BY doc_id",
    "p11_resize": f"""WITH {CELLS}, m AS (SELECT doc_id, c * 60.0 + 7 AS x0, c * 60.0 + 72 AS x1, r * 20.0 + 1 AS top, r * 20.0 + 23 AS bottom FROM lines, (SELECT unnest([0, 1, 2, 3]) AS c))
SELECT doc_id, {SUMS}, sum(x1 - x0) AS width, sum(bottom - top) AS height, sum(top) AS doctop, sum(100000 - bottom) AS y0, sum(100000 - top) AS y1 FROM m GROUP BY doc_id""",
    "j9_outside_boxes": f"WITH {CELLS} SELECT doc_id, sum(length(v[1]) + length(v[2]) + length(v[3]) + length(v[4]))::BIGINT AS n FROM lines WHERE r > 0 GROUP BY doc_id",
    "t8_ligatures": f"WITH {words()} SELECT doc_id, count(*) AS n, md5(string_agg(replace(text, 'q', 'fi'), ' ' ORDER BY ln, w)) AS words FROM words GROUP BY doc_id",
    "t14_regex": f"WITH {words()}, d AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS m FROM words) SELECT doc_id, count(*) AS n, sum(length(m))::BIGINT AS digits FROM d GROUP BY doc_id",
    "a11_columns": f"""WITH {CELLS} SELECT doc_id, unnest([0, 1, 2, 3])::BIGINT AS "column", n, unnest([0.0, 60.0, 120.0, 180.0]) AS x0, 0.0 AS top, unnest([60.0, 120.0, 180.0, 240.0]) AS x1, n * 20.0 AS bottom FROM pages""",
    "s15_vectors": """SELECT s_suppkey AS doc_id, 'rect' AS object_type, true AS fill, false AS stroke, n AS x0, 280 - n AS top, n + 60 AS x1, 300 - n AS bottom, n AS y0, n + 20 AS y1 FROM (SELECT s_suppkey, s_nationkey::DOUBLE AS n FROM supplier)
UNION ALL SELECT s_suppkey, 'line', false, true, 10.0, 290.0, 90.0, 290.0, 10.0, 10.0 FROM supplier""",
    "s27_metadata": "SELECT s_suppkey AS doc_id, 3::BIGINT AS page_count, s_name AS title FROM supplier",
    "s28_labels": "SELECT s_suppkey AS doc_id, unnest([1, 2, 3])::BIGINT AS page_number, unnest(['i', 'ii', 'p-' || s_suppkey]) AS label, unnest([0.0, 300.0, 600.0]) AS doctop_offset FROM supplier",
    "s30_annotations": "SELECT s_suppkey AS doc_id, 'http://suppliers/' || s_suppkey AS uri, 10.0 AS x0, 260.0 AS top, 30.0 AS x1, 280.0 AS bottom FROM supplier",
    "s1_decode": """WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^\\x20-\\x7e\\x{a1}-\\x{ac}\\x{ae}-\\x{ff}\\n]', '?', 'g') AS t FROM documents)
SELECT doc_id, length(replace(t, chr(10), ''))::BIGINT AS n, 1 + ((length(t) - length(replace(t, chr(10), ''))) // 60) AS pages FROM t""",
}

QUERIES |= MADE | PAGES
#: Numbers such as 60.0 are meant as doubles, not decimals.
QUERIES = {k: re.sub(r"\b(\d+)\.0\b", r"\1e0", v) for k, v in QUERIES.items()}
