"""DuckDB SQL for the results of this subpackage's queries, where SQL can express them."""

from __future__ import annotations

OP2 = r"""
WITH sized AS (
  SELECT doc_id, text, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, CAST([3, 1, 2][1 + CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS INT)] AS DOUBLE) AS weight,
    source_size * CAST(2 AS DOUBLE) AS bound, CAST(sum(source_size) OVER () AS BIGINT) * CAST(1.5 AS DOUBLE) AS total
  FROM sources
), levels AS (
  SELECT *, (total - coalesce(sum(bound) OVER (ORDER BY bound / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY bound / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), shared AS (
  SELECT level FROM levels WHERE bound >= level * weight ORDER BY bound / weight, source ASC NULLS LAST LIMIT 1
), targets AS (
  SELECT source, source_size, least(bound, coalesce((SELECT level FROM shared) * weight, bound)) AS target FROM levels
), rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, coalesce(t.target / nullif(t.source_size, 0), 0) AS rate,
    CAST(CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(s.doc_id AS VARCHAR), '\N') || ':' || coalesce(md5(s.text), '\N')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496 AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken,
  CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM rated
"""

CHAT = r"""
WITH told AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), headed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
    '<|im_start|>' || replace(replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), '\', '\\'), chr(10), '\n') || chr(10) AS head,
    regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS body
  FROM told
), written AS (
  SELECT *, head || body || '<|im_end|>' || chr(10) AS turn_text FROM headed
), before AS (
  SELECT *, coalesce(string_agg(turn_text, '') OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') || head AS context FROM written
)
"""

OP9 = CHAT + r"""
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(CAST(sum(CASE WHEN role = 'assistant' THEN len(text) ELSE 0 END) AS BIGINT), 0) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(len(turn_text)) AS BIGINT) AS formatted_chars,
  count(*) FILTER (role = 'assistant') AS n_examples,
  CAST(coalesce(sum(len(context)) FILTER (role = 'assistant'), 0) AS BIGINT) AS context_chars,
  sha256(coalesce(string_agg(sha256(context), ',' ORDER BY k) FILTER (role = 'assistant'), '')) AS contexts_sha256
FROM before GROUP BY conv_id
"""

CHAT_EXAMPLES = CHAT + "SELECT conv_id, context, body AS target FROM before WHERE role = 'assistant'"

OP1 = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS gram
  FROM (SELECT item, w, unnest(range(1, CAST(greatest(len(w) - 9, 1) AS BIGINT) + 1)) AS i FROM items WHERE len(w) > 0)
), grams AS (
  SELECT row, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS gram
  FROM (SELECT row, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), found AS (
  SELECT g.row, g.i, g.n, w.item FROM grams g JOIN windows w USING (n, gram)
), hits AS (
  SELECT row, count(DISTINCT spot) AS n_hit FROM (SELECT row, unnest(range(i, i + n)) AS spot FROM (SELECT DISTINCT row, i, n FROM found)) GROUP BY row
), whose AS (
  SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item FROM found) GROUP BY row
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (row) LEFT JOIN whose USING (row)
"""

OP5 = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT row, w, unnest(range(1, CAST(len(w) - 6 AS BIGINT))) AS i FROM d WHERE len(w) > 8
), again AS (
  SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, array_to_string(list_slice(w, i, i + 7), ' ')) AS n FROM starts) WHERE n > 1
), repeats AS (
  SELECT row, count(DISTINCT spot) AS n FROM (SELECT row, unnest(range(i, i + 8)) AS spot FROM again) GROUP BY row
), measured AS (
  SELECT row, doc_id, source, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
    len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS n_lines, n_lines - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words
  FROM d LEFT JOIN repeats r USING (row)
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    base_failed OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 30 * n_lines AS any_failed
  FROM measured
), domains AS (
  SELECT source, count(*) AS n, count(*) FILTER (any_failed) AS failed FROM judged GROUP BY source
), moments AS (
  SELECT avg(CAST(failed AS DOUBLE) / n) AS m, var_pop(CAST(failed AS DOUBLE) / n) AS v FROM domains
), prior AS (
  SELECT m, CASE WHEN v > 0 AND v < m * (1 - m) THEN m * (1 - m) / v - 1 ELSE 1 END AS k FROM moments
), verdicts AS (
  SELECT source, (failed + m * k) / (n + k) <= 0.7 AS good FROM domains CROSS JOIN prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed, any_failed, NOT base_failed AND good AS kept
FROM judged j JOIN verdicts v ON j.source IS NOT DISTINCT FROM v.source
"""

OP6 = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents
), chunks AS (
  SELECT row, n, k, substr(h, 800 * k + 1, 1598) AS chunk FROM (SELECT row, h, n, unnest(range(0, n // 400)) AS k FROM d WHERE n >= 400)
), windows AS MATERIALIZED (
  SELECT row, 400 * k + j + 1 AS i, md5_number(substr(chunk, 2 * j + 1, 800)) AS g FROM (SELECT row, n, k, chunk, unnest(range(0, 400)) AS j FROM chunks) WHERE 400 * k + j <= n - 400
), starts AS (
  SELECT row, i FROM windows WHERE g IN (SELECT g FROM windows GROUP BY g HAVING count(*) > 1)
), runs AS (
  SELECT row, i, sum(new) OVER (PARTITION BY row ORDER BY i) AS run
  FROM (SELECT row, i, CASE WHEN i - lag(i) OVER (PARTITION BY row ORDER BY i) <= 400 THEN 0 ELSE 1 END AS new FROM starts)
), spans AS (
  SELECT row, run, min(i) AS a, max(i) + 400 AS b FROM runs GROUP BY row, run
), pieces AS (
  SELECT row, run, a, b, coalesce(lag(b) OVER (PARTITION BY row ORDER BY run), 1) AS prior FROM spans
), cut AS (
  SELECT d.row, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans,
    string_agg(substr(h, 2 * prior - 1, 2 * (a - prior)), '' ORDER BY run) || substr(any_value(h), 2 * max(b) - 1) AS kept
  FROM d JOIN pieces USING (row) GROUP BY d.row
)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN cut USING (row)
"""

OP3 = r"""
WITH RECURSIVE rules (of, starts, told) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), rest AS (
  SELECT row_number() OVER () AS row, page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), located AS (
  SELECT row, page_id, html, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM rest
), fits AS (
  SELECT row, arg_min(struct_pack(rule := of || starts, told := told), (-length(of || starts), of || starts)) AS r
  FROM located JOIN rules ON (host = of OR ends_with(host, '.' || of)) AND starts_with(path, starts) GROUP BY row
), ruled AS (
  SELECT row, page_id, html, host, path, r.rule AS rule, r.told AS told FROM located LEFT JOIN fits USING (row)
), seeds AS (
  SELECT host, avg(CASE WHEN told = 'allow' THEN 1 ELSE 0 END) AS trust, avg(CASE WHEN told = 'block' THEN 1 ELSE 0 END) AS distrust FROM ruled WHERE host <> '' GROUP BY host
), hrefs AS (
  SELECT host AS src, unnest(regexp_extract_all(html, '\b[hH][rR][eE][fF][ \t\n\x0B\f\r]*=[ \t\n\x0B\f\r]*["'']?((?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^"'' \t\n\x0B\f\r>]+)', 1)) AS url FROM ruled
), links AS (
  SELECT src, dst, count(*) AS links
  FROM (SELECT src, translate(regexp_extract(substr(url, strpos(url, '//') + 2), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM hrefs)
  WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst
), shares AS (
  SELECT src, dst, links / sum(links) OVER (PARTITION BY src) * CAST(0.85 AS DOUBLE) AS given, links / sum(links) OVER (PARTITION BY dst) * CAST(0.85 AS DOUBLE) AS had FROM links
), flows AS (
  SELECT 'trust' AS kind, src AS come, dst AS go, given AS share FROM shares
  UNION ALL SELECT 'distrust', dst, src, had FROM shares
  UNION ALL SELECT 'suspicion', dst, src, given FROM shares
), started AS (
  SELECT kind, host, score * (CAST(1 AS DOUBLE) - CAST(0.85 AS DOUBLE)) AS score
  FROM (SELECT 'trust' AS kind, host, trust AS score FROM seeds UNION ALL SELECT 'distrust', host, distrust FROM seeds UNION ALL SELECT 'suspicion', host, distrust FROM seeds)
  WHERE score > 0
), passed AS (
  SELECT kind, host, score, 0 AS k FROM started
  UNION ALL SELECT f.kind, f.go, sum(p.score * f.share), p.k + 1 FROM passed p JOIN flows f ON p.kind = f.kind AND p.host = f.come WHERE p.k < 12 GROUP BY f.kind, f.go, p.k
), standing AS (
  SELECT host, round(coalesce(sum(score) FILTER (kind = 'trust'), 0), 9) AS trust, round(coalesce(sum(score) FILTER (kind = 'distrust'), 0), 9) AS distrust,
    round(coalesce(sum(score) FILTER (kind = 'suspicion'), 0), 9) AS suspicion
  FROM passed GROUP BY host
)
SELECT page_id, host, path, rule, coalesce(told, CASE WHEN greatest(distrust, suspicion) >= 0.075 AND greatest(distrust, suspicion) > trust THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust
FROM ruled LEFT JOIN standing USING (host)
"""


def _any_case(word: str) -> str:
    """A pattern for a word of letters in either case; letters beyond A-Z that fold to them don't match, as in Spark."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


def _matches(pattern: str, kind: str, group: int = 0, where: str = "true") -> str:
    """Matches of a pattern with offsets: the lengths of matches and of the texts between them, summed up."""
    quoted = pattern.replace("'", "''")
    return f"""
  SELECT row, {kind} AS kind, CAST(stop - len(hit) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM (
    SELECT row, hit, part, sum(len(gap) + len(hit)) OVER (PARTITION BY row ORDER BY i) AS stop FROM (
      SELECT row, unnest(regexp_extract_all(text, '{quoted}')) AS hit, unnest(regexp_extract_all(text, '{quoted}', {group})) AS part,
        unnest(string_split_regex(text, '{quoted}')) AS gap, unnest(range(1, CAST(len(text) AS BIGINT) + 2)) AS i
      FROM d WHERE regexp_matches(text, '{quoted}'))
    WHERE hit IS NOT NULL)
  WHERE {where}"""


_ASSIGN = "(" + "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_ACCOUNT = "(?:" + "|".join(map(_any_case, ("client_?id", "user_?name", "user", "login", "account", "key_?id"))) + r""")["']?\x20*[:=]\x20*["']?[a-zA-Z0-9_.@-]{3,}"""
_ADDRESS = r"""(?:https?|ftps?|sftp|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|redis|mongodb|amqps?|s3)://[^ \t\n\x0B\f\r"'<>]+"""
#: A mixed token begins a run of its characters and ``=`` and ends before the first ``=``.
_TOKENS = _matches("[A-Za-z0-9+/_=-]+", "4").replace("AS BIGINT) AS stop FROM", "AS BIGINT) AS run_stop, regexp_extract(hit, '^[A-Za-z0-9+/_-]*') AS token FROM")

OP10 = f"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents
), parts AS ({_matches(_ASSIGN, "CASE WHEN len(part) >= 8 THEN 0 ELSE 4 END", 2, "len(part) >= 4")}
  UNION {_matches("AKIA[A-Z0-9]{12,}", "1")}
  UNION {_matches("[0-9a-f]{32,}", "2")}
  UNION {_matches(_ACCOUNT, "3")}
  UNION {_matches(_ADDRESS, "5")}
  UNION SELECT row, kind, start, start + len(token) FROM ({_TOKENS})
  WHERE len(token) >= 20 AND regexp_matches(token, '[0-9]') AND regexp_matches(token, '[A-Z]') AND regexp_matches(token, '[a-z]')
), near AS (
  SELECT w.row, w.kind, w.start, w.stop, bool_or(o.kind IN (1, 3)) AS by_id, bool_or(o.kind IN (0, 2, 4)) AS by_key
  FROM parts w JOIN parts o ON w.row = o.row AND o.start <= w.stop + 240 AND o.stop >= w.start - 240 AND (o.kind, o.start, o.stop) <> (w.kind, w.start, w.stop)
  WHERE w.kind >= 3 GROUP BY w.row, w.kind, w.start, w.stop
), spans AS (
  SELECT row, kind, start, stop FROM parts WHERE kind < 3
  UNION ALL SELECT row, kind, start, stop FROM near WHERE CASE kind WHEN 3 THEN by_key WHEN 4 THEN by_id ELSE by_id AND by_key END
), named AS (
  SELECT *, ['assign', 'access', 'hex', 'linked_id', 'linked_secret', 'linked_endpoint'][kind + 1] || ':' || start || ':' || stop AS name FROM spans
), gathered AS (
  SELECT row, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(name, ',' ORDER BY start, kind, stop) FILTER (kind < 3) AS base, string_agg(name, ',' ORDER BY start, kind, stop) AS spans
  FROM named GROUP BY row
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN gathered USING (row)
"""

_WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP12 = f"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_LOWERED}, '{_WORDS}') AS words FROM documents
), own AS (SELECT row, doc_id, words, len(words) AS n FROM d WHERE len(words) > 0
), totals AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_words FROM own
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWERED}, '{_WORDS}')) AS term FROM benchmark
), posted AS (
  SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, n, unnest(words) AS term FROM own) WHERE term IN (SELECT term FROM asked) GROUP BY row, doc_id, n, term
), weights AS (
  SELECT term, floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM posted, totals GROUP BY term, n_docs
), scored AS (
  SELECT item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_words))))::BIGINT AS score
  FROM asked JOIN posted USING (term) JOIN weights USING (term), totals GROUP BY item_id, row, doc_id
)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0
) WHERE rank <= 10
"""

OP13 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
), told AS (SELECT p.*, CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to FROM p LEFT JOIN firsts USING (payload_digest))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM told
"""

ORACLE_SQL: dict[str, str] = {"op1_decontaminate": OP1, "op2_mix": OP2, "op3_urls": OP3, "op5_quality": OP5, "op6_repeats": OP6, "op9_chat": OP9, "op10_secrets": OP10, "op12_ranked": OP12, "op13_warc": OP13, "chat_examples": CHAT_EXAMPLES}
