"""DuckDB SQL for the queries of the subpackage that SQL can express."""

from __future__ import annotations

from .registry import URL_RULES

_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

OP10 = rf"""
WITH rules(rh, rp, rv) AS (VALUES {_RULES}),
u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*'), '') AS path FROM u),
hits AS (SELECT page_id, rh || rp AS rule, rv, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC, length(rh) DESC, rv DESC) AS nth
         FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT p.page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM p LEFT JOIN hits ON hits.page_id = p.page_id AND nth = 1
"""

_SPACE = r"[\x20\x09-\x0D]+"

OP2 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '{_SPACE}'), lambda x: x <> '') AS words FROM d),
tri AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS t FROM w, unnest(range(1, greatest(len(words) - 1, 1))) AS r(i)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, t) AS n FROM tri) WHERE n > 1),
cover AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, unnest([0, 1, 2]) AS x(k) GROUP BY doc_id),
raw AS (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d),
ln AS (SELECT doc_id, host, text, line, list_filter(regexp_split_to_array(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACE}'), lambda x: x <> '') AS ws FROM raw),
full_lines AS (SELECT *, array_to_string(ws, ' ') AS norm FROM ln WHERE len(ws) > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM full_lines GROUP BY doc_id),
above AS (SELECT host, norm, min(doc_id) AS first FROM full_lines GROUP BY host, norm HAVING count(DISTINCT text) > 10),
lost AS (SELECT doc_id, sum(len(ws))::BIGINT AS words, count(DISTINCT norm) AS lines FROM full_lines JOIN above USING (host, norm) WHERE doc_id <> first GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w.words)::BIGINT AS n_words, coalesce(list_sum(list_transform(w.words, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(w.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
             coalesce(cover.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.words, 0)::BIGINT AS removed_words, coalesce(lost.lines, 0)::BIGINT AS removed_lines
      FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN cover USING (doc_id) LEFT JOIN lost USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words - removed_words >= 0.5 * n_words AS kept, removed_words, removed_lines FROM f
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_frequency": OP2, "op10_url_rules": OP10}
