"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from docloom.llm import licenses, quality
from docloom.llm.chat import CLOSE, HEAD_END, NEXT, OPEN

WS = r"[\x20\x09-\x0D]+"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _spelled(x: str) -> str:
    cases = " ".join(f"WHEN '{old}' THEN '{new}'" for old, new in licenses.SPELLINGS.items())
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda w: CASE w {cases} ELSE w END), ' ')"


def _lines(x: str) -> str:
    plain = f"regexp_replace(lower({x}), '(?m)^[^\\p{{L}}\\p{{N}}\\n]*(?:copyright\\b|\\(c\\)|©|all rights reserved)[^\\n]*$', '', 'g')"
    return f"regexp_replace({plain}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"


def _squeezed(x: str) -> str:
    return f"trim(regexp_replace({x}, '[ \\n]+', ' ', 'g'))"


def _known(pairs) -> str:
    values = ", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in pairs)
    return f"SELECT sha256({_spelled(_squeezed(_lines('x')))}) AS digest, min(l) AS license FROM (VALUES {values}) AS v(l, x) GROUP BY 1"


OP1 = f"""
WITH texts AS ({_known([*licenses.TEXTS.items(), *licenses.NOTICES, *licenses.titled()])}), notes AS ({_known(licenses.NOTICES)}),
docs AS (SELECT doc_id, {_lines("text")} AS lines FROM documents),
named AS (SELECT DISTINCT d.doc_id, n.license FROM (SELECT doc_id, unnest(string_split(lines, chr(10))) AS line FROM docs) d JOIN notes n ON n.digest = sha256({_spelled("trim(d.line)")})),
listed AS (SELECT doc_id, count(*) AS n, string_agg(license, ',' ORDER BY license) AS notices FROM named GROUP BY doc_id),
digests AS (SELECT doc_id, sha256({_spelled(_squeezed("lines"))}) AS digest FROM docs)
SELECT d.doc_id, t.license, coalesce(l.n, 0) AS n_notices, coalesce(l.notices, '') AS notices, d.digest
FROM digests d LEFT JOIN texts t ON t.digest = d.digest LEFT JOIN listed l ON l.doc_id = d.doc_id
"""

OP4 = """
WITH rules(rule, host, path, verdict) AS (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
p AS (SELECT page_id, coalesce(lower(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)), '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, row_number() OVER () AS r FROM pages),
best AS (SELECT p.r, arg_max(q.rule, length(q.rule)) AS rule, arg_max(q.verdict, length(q.rule)) AS verdict FROM p JOIN rules q ON (p.host = q.host OR ends_with(p.host, '.' || q.host)) AND starts_with(p.path, q.path) GROUP BY p.r)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict FROM p LEFT JOIN best b USING (r)
"""

OP6 = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS doc, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
rows_ AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS rows_ FROM d),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, sum(n) AS n FROM (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS n FROM rep) GROUP BY doc_id),
lines AS (SELECT d.doc_id, d.source, d.doc, trim(regexp_replace(lower(x), '{WS}', ' ', 'g')) AS line FROM d JOIN (SELECT doc_id, unnest(rows_) AS x FROM rows_) r ON r.doc_id = d.doc_id),
over_ AS (SELECT source, line, min(doc) AS first FROM lines GROUP BY source, line HAVING count(DISTINCT doc) > {quality.MAX_DOCS}),
gone AS (SELECT l.doc_id, sum(len(string_split(l.line, ' '))) AS n FROM lines l JOIN over_ o ON o.line = l.line AND o.source IS NOT DISTINCT FROM l.source AND o.first <> l.doc GROUP BY l.doc_id),
c AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
  len(r.rows_) - len(list_distinct(r.rows_)) AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS removed_words
  FROM d JOIN rows_ r USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < {quality.MIN_WORDS} OR n_repeat_words * 100 > n_words * {quality.MAX_REPEAT_PERCENT}) AS base_failed, removed_words,
  NOT (n_words < {quality.MIN_WORDS} OR n_repeat_words * 100 > n_words * {quality.MAX_REPEAT_PERCENT}) AND removed_words <= n_words * {quality.MAX_REMOVED} AS kept FROM c
"""

ESCAPED = "regexp_replace(coalesce({}, ''), '([<\\[])(\\\\*)(/?(?:s>|INST\\]|TURN\\]))', '\\1\\\\\\2\\3', 'g')"
OP7 = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
s AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS NOT DISTINCT FROM role AS same FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length({ESCAPED.format("text")}) + CASE WHEN same THEN {len(NEXT)} ELSE length({ESCAPED.format("role")}) + {len(OPEN) + len(HEAD_END) + len(CLOSE)} END)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""

OP9 = """
WITH RECURSIVE w AS (SELECT doc_id, md5(text) AS t, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
u AS (SELECT t, min(doc_id) AS d, any_value(w) AS w FROM w WHERE len(w) > 0 GROUP BY t),
g AS (SELECT d, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT d, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM u)),
c AS (SELECT d, g, count(*) AS c FROM g GROUP BY d, g),
n AS (SELECT d, sum(c) AS n FROM c GROUP BY d),
p AS (SELECT x.d AS a, y.d AS b, sum(least(x.c, y.c)) AS s FROM c x JOIN c y ON x.g = y.g AND x.d < y.d GROUP BY x.d, y.d),
e AS (SELECT a, b FROM p JOIN n na ON na.d = a JOIN n nb ON nb.d = b WHERE s * 5 >= (na.n + nb.n - s) * 4),
both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT d, d FROM u),
reach AS (SELECT a, b FROM both_ UNION SELECT r.a, x.b FROM reach r JOIN both_ x ON x.a = r.b),
class AS (SELECT a AS d, min(b) AS m FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(k.m, w.doc_id) AS class_id, count(*) OVER (PARTITION BY w.doc_id, w.t) AS copies
FROM w LEFT JOIN u ON u.t = w.t AND len(w.w) > 0 LEFT JOIN class k ON k.d = u.d
"""

ORACLE_SQL = {"op1_license_scan": OP1, "op4_url_filter": OP4, "op6_quality_rules": OP6, "op7_chat_format": OP7, "op9_minhash_dedup": OP9}
