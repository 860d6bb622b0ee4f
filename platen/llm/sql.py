"""The same results in DuckDB SQL, for the operators that SQL can express."""

from __future__ import annotations

from . import quality
from .licences import GRANT, NAME_FORM, NAMED, RULES, TAG, known, names

_COMPONENTS = """reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
component AS (SELECT a AS node, least(a, min(b)) AS component FROM reach GROUP BY a)"""

OP1 = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
sound AS (
  SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
unit AS (SELECT vec_id, label, len(e) AS d, list_transform(e, lambda x: x / norm) AS e FROM sound WHERE norm > 0),
links AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM unit p JOIN unit q ON p.label = q.label AND p.d = q.d AND p.vec_id <> q.vec_id
  WHERE list_inner_product(p.e, q.e) >= 0.93),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a),
{_COMPONENTS}
SELECT v.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(component, v.vec_id) AS component_id,
  v.vec_id = coalesce(component, v.vec_id) AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN component c ON c.node = v.vec_id"""

OP3 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM w),
s AS (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM sets),
shared AS (SELECT p.doc_id AS a, q.doc_id AS b, p.n AS m, q.n AS n, count(*) AS common
  FROM s p JOIN s q ON p.h = q.h AND p.doc_id <> q.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * common >= 85 * (m + n - common)),
{_COMPONENTS}
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(component, doc_id) AS component_id, doc_id = coalesce(component, doc_id) AS kept
FROM sets LEFT JOIN component ON node = doc_id"""

_CUTOFFS = ", ".join(f"('{name}', {c}::DOUBLE)" for name, cutoffs in quality.SIGNALS.items() for c in cutoffs)
_RATE = quality.ALPHA / len(quality.SIGNALS)
OP8 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
grams AS (SELECT r, unnest(list_transform(range(1, len(w) - 3), lambda i: {{'i': i, 'g': array_to_string(w[i:i+4], ' ')}})) AS x FROM w WHERE len(w) > 4),
again AS (SELECT r, x.i AS i, count(*) OVER (PARTITION BY r, x.g) AS n FROM grams),
covered AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest([i, i + 1, i + 2, i + 3, i + 4]) AS k FROM again WHERE n > 1) GROUP BY r),
made AS (
  SELECT d.r, doc_id, stratum, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(lines) AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN w ON w.r = d.r LEFT JOIN covered ON covered.r = d.r),
base AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM made),
signals AS (
  SELECT r, doc_id, stratum, base_failed, unnest([{{'signal': 'symbols_per_word', 'v': n_symbols / greatest(n_words, 1)}},
    {{'signal': 'duplicate_lines', 'v': n_dup_lines / greatest(n_lines, 1)}}, {{'signal': 'repeated_words', 'v': n_repeat_words / greatest(n_words, 1)}},
    {{'signal': 'mean_word_length', 'v': word_chars / greatest(n_words, 1)}}]) AS s FROM base),
marked AS (SELECT doc_id, max(quality) = 1 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
cutoffs(signal, cutoff) AS (VALUES {_CUTOFFS}),
seen AS (
  SELECT stratum, signal, cutoff, count(*) FILTER (good) AS n, count(*) FILTER (good AND s.v > cutoff) AS k, count(*) FILTER (NOT good AND s.v > cutoff) AS bad
  FROM signals JOIN marked USING (doc_id) JOIN cutoffs ON cutoffs.signal = s.signal WHERE NOT base_failed GROUP BY ALL),
bound AS (
  SELECT *, n > 0 AND list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_RATE}) + (n - i) * ln(1 - {_RATE}))))
    <= {quality.DELTA} / ((SELECT count(DISTINCT stratum) FROM seen) * {len(quality.SIGNALS)}) AND k <= {_RATE} * n AS safe FROM seen),
chosen AS (
  SELECT stratum, signal, arg_max(cutoff, (bad - {quality.WEIGHT} * k, cutoff)) AS cutoff FROM bound
  WHERE safe AND bad > {quality.WEIGHT} * k GROUP BY stratum, signal),
rejected AS (SELECT DISTINCT r FROM signals JOIN chosen ON chosen.stratum = signals.stratum AND chosen.signal = s.signal AND s.v > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rejected.r IS NULL AS kept
FROM base LEFT JOIN rejected ON rejected.r = base.r"""

_KNOWN = ", ".join(f"('{s}', '{n}')" for s, n in known().items())
_RULES = ", ".join(f"({i}, '{n}', '{k}', '|{'|'.join(ids)}|')" for i, (n, k, ids) in enumerate(RULES))
_NAMES = ", ".join(f"('{n} ', '{i}')" for n, i in names())
_NAME = f"CASE WHEN starts_with(s, '{TAG}') THEN s ELSE regexp_extract(s, '{GRANT}', 1) END"
for _pattern, _new in NAME_FORM:
    _NAME = f"regexp_replace({_NAME}, '{_pattern}', '{_new.replace('@', chr(92))}', 'g')"
OP7 = f"""
WITH known(s, id) AS (VALUES {_KNOWN}), names(n, id) AS (VALUES {_NAMES}), rules(i, name, kind, ids) AS (VALUES {_RULES}),
plain AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')),
    '[.!?;]+([ \\t\\n\\r\\f]+|\\z)', chr(1) || chr(10), 'g'), '[\\n\\r]+', chr(2), 'g'), '[^a-z0-9\\x01\\x02]+', ' ', 'g') AS t FROM documents),
parts AS (
  SELECT r, 1 AS way, string_split_regex(t, ' ?[\\x01\\x02]+ ?') AS s FROM plain
  UNION ALL SELECT r, 2, string_split_regex(regexp_replace(t, '([^\\x01\\x02]) ?\\x02+ ?', '\\1 ', 'g'), '[ \\x02]*\\x01[ \\x01\\x02]*') FROM plain),
each AS (SELECT r, way, trim(unnest(s)) AS s, generate_subscripts(s, 1) AS k FROM parts),
granted AS (
  SELECT s, {_NAME} || ' ' AS name FROM (SELECT DISTINCT s FROM each)
  WHERE starts_with(s, '{TAG}') OR (contains(s, ' under ') OR contains(s, ' by ') OR starts_with(s, 'under ')) AND regexp_matches(s, '{NAMED}')),
named AS (SELECT s, arg_max(id, length(n)) AS id FROM granted JOIN names ON starts_with(name, n) GROUP BY s),
ids AS (
  SELECT r, way, list(coalesce(known.id, named.id) ORDER BY k) AS ids FROM each LEFT JOIN known ON known.s = each.s LEFT JOIN named ON named.s = each.s
  WHERE known.id IS NOT NULL OR named.id IS NOT NULL GROUP BY r, way),
pair AS (
  SELECT doc_id, p.r, coalesce(a.ids, []) AS a, coalesce(b.ids, []) AS b FROM plain p
  LEFT JOIN ids a ON a.r = p.r AND a.way = 1 LEFT JOIN ids b ON b.r = p.r AND b.way = 2),
held AS (
  SELECT r, i, name, kind FROM pair JOIN rules ON contains('|' || array_to_string(a, '|') || '|-|' || array_to_string(b, '|') || '|', rules.ids)),
found AS (
  SELECT r, string_agg(name, ',' ORDER BY i) AS licences, bool_or(kind = 'restricted') AS x, bool_or(kind = 'copyleft') AS y FROM held
  WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.r = held.r AND h.name IN (held.name || '-notice', held.name || '-text')) GROUP BY r)
SELECT doc_id, greatest(len(a), len(b))::BIGINT AS n_sentences,
  array_to_string(CASE WHEN len(b) > len(a) THEN b ELSE a END, ',') AS sentence_ids, coalesce(licences, '') AS licences,
  CASE WHEN f.r IS NULL THEN 'none' WHEN x THEN 'restricted' WHEN y THEN 'copyleft' ELSE 'permissive' END AS kind
FROM pair LEFT JOIN found f ON f.r = pair.r"""

_CONTROL = r"<s>|</s>|\[/?INST\]|\[SYS\]|\[BOT\]|\[TURN\]|\[ROLE\]|<</?SYS>>"
OP10 = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (
  SELECT *, length(regexp_replace(text, '(\\*)({_CONTROL})', '\1\1\\\2', 'g')) AS n,
    length(regexp_replace(role, '(\\*)({_CONTROL})', '\1\1\\\2', 'g')) AS role_n,
    role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS opens FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(n + CASE WHEN NOT opens THEN 8 ELSE 6 + CASE role WHEN 'user' THEN 7 WHEN 'system' THEN 6 WHEN 'assistant' THEN 6 ELSE 7 + role_n + 8 END END))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""

ORACLES = {"op1_itq_near_vectors": OP1, "op3_minhash_near_duplicates": OP3, "op7_licences": OP7, "op8_quality": OP8, "op10_chat": OP10}
