"""Parts of the SQL that the catalogue's queries share: the made characters, words and tables."""

from __future__ import annotations

CHARS = """
lns AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS ln FROM documents),
cs AS (SELECT doc_id, ln, unnest(string_split(line, '')) AS text, generate_subscripts(string_split(line, ''), 1) - 1 AS ci FROM lns WHERE line <> ''),
chars AS (SELECT doc_id, ln, ci, text, x0, x0 + 6.0 AS x1, ln * 12.0::DOUBLE AS top, ln * 12.0::DOUBLE + 10 AS bottom
  FROM (SELECT *, ci * 6.0::DOUBLE + CASE WHEN (doc_id * 31 + ln * 7 + ci) % 97 = 0 THEN 4 ELSE 0 END AS x0 FROM cs))"""
BLANK = "[\\t\\n\\x0B\\f\\r \\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"


def words(x_tolerance: str = "3", punctuation: bool = False, source: str = CHARS) -> str:
    """CTEs up to words(doc_id, ln, w, text, x0, x1, top, bottom)."""
    alone = "text IN ('!','\"','#','$','%','&','''','(',')','*','+',',','-','.','/',':',';','<','=','>','?','@','[','\\','\\\\',']','^','_','`','{','|','}','~')" if punctuation else "false"
    return f"""{source},
flags AS (SELECT *, regexp_matches(text, '^{BLANK}$') AS blank, {alone} AS alone FROM chars),
prevs AS (SELECT *, lag(blank) OVER l AS pb, lag(alone) OVER l AS pa, lag(x0) OVER l AS px0, lag(x1) OVER l AS px1 FROM flags WINDOW l AS (PARTITION BY doc_id, ln ORDER BY x0, ci)),
marks AS (SELECT *, CASE WHEN coalesce(pb, true) OR alone OR pa OR x0 < px0 OR x0 > px1 + {x_tolerance} THEN 1 ELSE 0 END AS new FROM prevs),
nums AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, ln ORDER BY x0, ci) AS w FROM marks),
words AS (SELECT doc_id, ln, w, string_agg(text, '' ORDER BY x0, ci) AS text, min(x0) AS x0, max(x1) AS x1, min(top) AS top, max(bottom) AS bottom FROM nums WHERE NOT blank GROUP BY ALL)"""


SUMS = "count(*) AS n, sum(x0) AS x0, sum(x1) AS x1, sum(top) AS top, sum(bottom) AS bottom"
WORDS = f"SELECT doc_id, {SUMS}, md5(string_agg(text, ' ' ORDER BY ln, w)) AS words FROM words GROUP BY doc_id"
CELLS = """
lines AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_suppkey) - 1 AS r,
  [l_partkey::VARCHAR, l_quantity::INT::VARCHAR, l_returnflag, l_linestatus] AS v FROM lineitem),
pages AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id)"""
