"""DuckDB SQL for the results of the registered queries, put together from common table expressions."""

from __future__ import annotations

from lodestar.functions.text import COVERAGE_STOPWORDS, FEEDBACK_STOPWORDS
from lodestar.operators.english import STEP2, STEP3, STEP4, STOPWORDS
from lodestar.operators.ltr import FEATURES
from lodestar.operators.metrics import METRICS, MODES


def _r(x: str, digits: int = 4) -> str:
    scale = f"CAST({10**digits} AS DOUBLE)"
    return f"(floor(({x}) * {scale} + CAST(0.5 AS DOUBLE)) / {scale})"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _tokens(x: str) -> str:
    return f"list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda t: t <> '')"


def _significant(x: str, words: list[str] = FEEDBACK_STOPWORDS) -> str:
    return f"list_filter({_tokens(x)}, lambda t: len(t) > 2 AND NOT list_contains({_list(words)}, t))"


def _bigrams(x: str, joint: str = " ") -> str:
    return f"list_transform(range(1, CAST(len({x}) AS BIGINT)), lambda i: ({x})[i] || '{joint}' || ({x})[i + 1])"


DOCS = """docs AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, split_part(coalesce(text, ''), chr(10), 1) AS title,
    substr(coalesce(text, ''), len(split_part(coalesce(text, ''), chr(10), 1)) + 2) AS abstract, coalesce(text, '') AS text FROM documents
), queries AS (
  SELECT CAST(item_id AS VARCHAR) AS query_id, text AS query FROM benchmark
)"""

QRELS = """qrels AS (
  SELECT q.query_id, d.id, CASE WHEN l.toxic = 1 THEN -1 WHEN l.quality = 1 THEN 3 WHEN l.quality IS NULL THEN 2 ELSE 1 END AS grade
  FROM queries q JOIN docs d ON contains(d.text, q.query) LEFT JOIN labels l ON CAST(l.doc_id AS VARCHAR) = d.id
)"""

FIELDS = {"title": 3, "abstract": 2, "text": 1}


def _index(queries: str = "queries", tag: str = "", fields: dict[str, float] = FIELDS, k1: float = 1.2, tokens=_tokens) -> str:
    """Scores of terms (query_id, id, field, term, qtf, score) of a query table, as score{tag}."""
    return f"""tok{tag} AS MATERIALIZED (
  {" UNION ALL ".join(f"SELECT id, '{f}' AS field, {tokens(f)} AS w FROM docs" for f in fields)}
), stat{tag} AS (
  SELECT field, count(*) AS n_docs, avg(CAST(len(w) AS DOUBLE)) AS avg_len FROM tok{tag} WHERE len(w) > 0 GROUP BY field
), ask{tag} AS (
  SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({tokens("query")}) AS term FROM {queries}) GROUP BY ALL
), post{tag} AS MATERIALIZED (
  SELECT field, term, id, dl, count(*) AS tf FROM (SELECT id, field, len(w) AS dl, unnest(w) AS term FROM tok{tag}) WHERE term IN (SELECT term FROM ask{tag}) GROUP BY ALL
), df{tag} AS (
  SELECT field, term, count(*) AS df FROM post{tag} GROUP BY ALL
), term{tag} AS MATERIALIZED (
  SELECT a.query_id, p.id, p.field, p.term, a.qtf,
    ln(1 + (s.n_docs - d.df + CAST(0.5 AS DOUBLE)) / (d.df + CAST(0.5 AS DOUBLE))) * (p.tf / (p.tf + CAST({k1} AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * p.dl / s.avg_len))) AS score
  FROM post{tag} p JOIN df{tag} d USING (field, term) JOIN stat{tag} s USING (field) JOIN ask{tag} a USING (term)
), wide{tag} AS (
  SELECT query_id, id, {", ".join(f"coalesce(sum(CASE WHEN field = '{f}' THEN score * qtf END), 0) AS {f}, sum(CASE WHEN field = '{f}' THEN qtf END) AS n_{f}" for f in fields)} FROM term{tag} GROUP BY ALL
)"""


def _top(source: str, score: str, k: int, keep: str = "") -> str:
    return f"SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id{keep} ORDER BY score DESC, id) AS rank{keep} FROM (SELECT query_id, id, {score} AS score{keep} FROM {source})) WHERE rank <= {k}"


SUM = _r("3 * title + 2 * abstract + 1 * text", 6)
BEST = _r("greatest(3 * title, 2 * abstract, 1 * text)", 6)
POOL = f"""best50 AS MATERIALIZED ({_top("wide", SUM, 50)}), pool AS MATERIALIZED (
  SELECT b.query_id, q.query, b.id, b.score, b.rank, d.title, d.abstract FROM best50 b JOIN docs d USING (id) JOIN queries q USING (query_id)
)"""
BASELINE = f"run AS MATERIALIZED ({_top('wide', BEST, 10)})"


def _with(*parts: str) -> str:
    return ("WITH RECURSIVE " if any("walk(" in p for p in parts) else "WITH ") + ", ".join(parts) + " "


COMMON = (DOCS, _index())
RANKED = "SELECT query_id, id, rank, score FROM "


def _coverage(asked: str, title: str = "t", body: str = "a") -> str:
    wanted = f"list_distinct({asked})"
    hit = lambda x: f"len(list_intersect({wanted}, {x}))"
    return f"(CASE WHEN len({wanted}) = 0 THEN 0 ELSE CAST(3 * {hit(title)} + 2 * {hit(body)} + {hit(f'list_concat({title}, {body})')} AS DOUBLE) / len({wanted}) END)"


def _phrase(asked: str) -> str:
    wanted = f"list_distinct({_bigrams(asked)})"
    hit = lambda x: f"len(list_intersect({wanted}, {_bigrams(x)}))"
    return f"(CASE WHEN len({wanted}) = 0 THEN 0 ELSE CAST(3 * {hit('t')} + 2 * {hit('a')} AS DOUBLE) / len({wanted}) END)"


def _share(score: str) -> str:
    return f"{score} / greatest(max({score}) OVER (PARTITION BY query_id), 1)"


def _own(words: list[str], source: str = "pool", more: str = "") -> str:
    return f"(SELECT *, {_significant('query', words)} AS asked, {_significant('title', words)} AS t, {_significant('abstract', words)} AS a FROM {source}{more})"


COVERAGE = f"""cov AS MATERIALIZED (
  SELECT query_id, id, original_rank, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, original_rank) AS rank FROM (
    SELECT query_id, id, rank AS original_rank, {_r(f"{_share('score')} + CAST(0.08 AS DOUBLE) * {_coverage('asked')}")} AS rerank_score FROM {_own(COVERAGE_STOPWORDS)})
)"""
TERMS = f"""fbt AS MATERIALIZED (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, term) AS place FROM (
    SELECT query_id, term, {_r("sum(CAST(1 AS DOUBLE) / rank)", 9)} AS weight FROM (
      SELECT query_id, rank, query, unnest({_significant("title || ' ' || title || ' ' || abstract")}) AS term FROM pool WHERE rank <= 4)
    WHERE NOT list_contains({_significant("query")}, term) GROUP BY query_id, term)) WHERE place <= 8
), fb AS (SELECT query_id, list(term ORDER BY place) AS expansion FROM fbt GROUP BY query_id)"""
EXPANDED = "pool LEFT JOIN (SELECT query_id, expansion FROM fb) USING (query_id)"


def _feedback_score(phrase: str) -> str:
    e = "coalesce(expansion, CAST([] AS VARCHAR[]))"
    return _r(f"{_share('score')} + CAST(0.06 AS DOUBLE) * {_coverage('asked')} + CAST(0.14 AS DOUBLE) * {_coverage(e)} + {phrase} * {_phrase('asked')}")


PRF = f"""prf AS MATERIALIZED (
  SELECT query_id, id, original_rank, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, original_rank) AS rank FROM (
    SELECT query_id, id, rank AS original_rank, {_feedback_score("CAST(0.01 AS DOUBLE)")} AS rerank_score FROM {_own(FEEDBACK_STOPWORDS, EXPANDED)})
)"""
RERANKED = "SELECT query_id, id, original_rank, rerank_score, rank FROM "


def _gain(mode: str, g: str = "grade") -> str:
    by = {"binary": "1", "linear": g, "cranfield-reversed": f"pow(CAST(2 AS DOUBLE), 5 - {g}) - 1", "graded": f"pow(CAST(2 AS DOUBLE), {g}) - 1"}[mode]
    return f"(CASE WHEN {g} > 0 THEN CAST({by} AS DOUBLE) ELSE 0 END)"


def _scored(run: str, name: str = "scored", mode: str = "graded", keys: str = "") -> str:
    """Metrics per query of a table (keys, query_id, id, rank); ``keys`` as ``, a, b``."""
    names = [k for k in keys.replace(",", " ").split()]
    every = "queries" + (f" CROSS JOIN (SELECT DISTINCT {', '.join(names)} FROM {run})" if names else "")
    return f"""{name}_judged AS (SELECT *, {_gain(mode)} AS gain FROM qrels WHERE grade > 0), {name}_ideal AS (
  SELECT query_id, count(*) AS relevant_count, sum(CASE WHEN place <= 10 AND gain > 0 THEN gain / log2(place + 1) END) AS ideal
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, id) AS place FROM {name}_judged) GROUP BY query_id
), {name}_top AS (
  SELECT r.query_id, r.id, r.rank{''.join(f', r.{n}' for n in names)}, CASE WHEN j.id IS NULL THEN 0 ELSE 1 END AS hit, coalesce(j.gain, 0) AS gain,
    sum(CASE WHEN j.id IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY r.query_id{''.join(f', r.{n}' for n in names)} ORDER BY r.rank ROWS UNBOUNDED PRECEDING) AS so_far
  FROM {run} r LEFT JOIN {name}_judged j ON j.query_id = r.query_id AND j.id = r.id WHERE r.rank <= 10
), {name}_sum AS (
  SELECT query_id{keys}, count(*) AS returned, sum(hit) AS hits, sum(CASE WHEN hit = 1 THEN CAST(so_far AS DOUBLE) / rank END) AS precisions,
    min(CASE WHEN hit = 1 THEN rank END) AS first_rank, sum(CASE WHEN gain > 0 THEN gain / log2(rank + 1) END) AS dcg FROM {name}_top GROUP BY query_id{keys}
), {name} AS MATERIALIZED (
  SELECT query_id{keys}, {_r("coalesce(CAST(hits AS DOUBLE) / returned, 0)")} AS precision_at_k, {_r("coalesce(CAST(hits AS DOUBLE) / relevant_count, 0)")} AS recall_at_k,
    {_r("coalesce(precisions / relevant_count, 0)")} AS average_precision, {_r("coalesce(CAST(1 AS DOUBLE) / first_rank, 0)")} AS reciprocal_rank,
    {_r("coalesce(dcg / nullif(ideal, 0), 0)")} AS ndcg_at_k, coalesce(relevant_count, 0) AS relevant_count, CAST(coalesce(hits, 0) AS BIGINT) AS hits, first_rank
  FROM {every} LEFT JOIN {name}_sum USING (query_id{keys}) LEFT JOIN {name}_ideal USING (query_id)
)"""


def _mean(m: str, to: str) -> str:
    return f"floor(sum(CAST(round({m} * 10000) AS BIGINT)) / count(*) + CAST(0.5 AS DOUBLE)) / CAST(10000 AS DOUBLE) AS {to}"


MEANS = ", ".join(["count(*) AS query_count", *[_mean(m, {"average_precision": "map", "reciprocal_rank": "mrr"}.get(m, m)) for m in METRICS]])


def _classified(source: str, name: str) -> str:
    return f"""{name} AS (SELECT *, CASE WHEN hits = 0 THEN 'zero_relevant_at_k' WHEN first_rank > 3 THEN 'late_first_relevant'
  WHEN relevant_count >= 10 AND recall_at_k < 0.35 THEN 'broad_need_low_recall' WHEN precision_at_k < 0.2 THEN 'lexical_noise_low_precision'
  WHEN ndcg_at_k < 0.25 THEN 'graded_ranking_loss' WHEN recall_at_k < 0.5 THEN 'partial_recall' ELSE 'passing_or_minor' END AS behavior_group FROM {source})"""


TWO_RUNS = (*COMMON, QRELS, BASELINE, POOL, COVERAGE, "cand AS (SELECT * FROM cov WHERE rank <= 10)", _scored("run", "base_s"), _scored("cand", "cand_s"), _classified("base_s", "base_c"), _classified("cand_s", "cand_c"))


def _hash(source: str, key: str, text: str, name: str) -> str:
    """Sparse local-hash embeddings (key, component, value)."""
    fnv = "list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(feature, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"
    words = f"list_filter({_tokens(text)}, lambda t: len(t) > 1)"
    return f"""{name}_f AS (
  SELECT {key}, feature, sum(weight) AS weight FROM (
    SELECT {key}, 'tok:' || unnest(w) AS feature, CAST(1 AS DOUBLE) AS weight FROM (SELECT {key}, {words} AS w FROM {source})
    UNION ALL SELECT {key}, 'bi:' || unnest({_bigrams("w", ":")}), 0.5 FROM (SELECT {key}, {words} AS w FROM {source})) GROUP BY ALL
), {name}_h AS (SELECT feature, {fnv} AS h FROM (SELECT DISTINCT feature FROM {name}_f)), {name} AS MATERIALIZED (
  SELECT {key}, component, value FROM (SELECT {key}, component, {_r(f"weight / CASE WHEN norm = 0 THEN 1 ELSE norm END", 6)} AS value FROM (
    SELECT *, sqrt(sum(weight * weight) OVER (PARTITION BY {key})) AS norm FROM (
      SELECT {key}, h % 384 AS component, sum(CASE WHEN h % 2 = 1 THEN weight ELSE -weight END) AS weight FROM {name}_f JOIN {name}_h USING (feature) GROUP BY ALL))) WHERE value <> 0
)"""


HASHED = _hash("docs", "id", "text", "dvec") + ", " + _hash("queries", "query_id", "query", "qvec")
NEAR = f"""dots AS MATERIALIZED (
  SELECT q.query_id, d.id, coalesce({_r("s.score", 6)}, 0) AS score FROM (SELECT query_id FROM queries) q CROSS JOIN (SELECT id FROM docs) d
  LEFT JOIN (SELECT query_id, id, sum(q.value * d.value) AS score FROM qvec q JOIN dvec d USING (component) GROUP BY ALL) s ON s.query_id = q.query_id AND s.id = d.id
), near AS MATERIALIZED ({_top("dots", "score", 50)})"""


def _scaled(source: str) -> str:
    return f"(SELECT query_id, id, (score - min(score) OVER w) / CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE max(score) OVER w - min(score) OVER w END AS scaled FROM {source} WINDOW w AS (PARTITION BY query_id))"


FUSED = f"""lin AS (
  SELECT coalesce(l.query_id, n.query_id) AS query_id, coalesce(l.id, n.id) AS id, coalesce(l.scaled, 0) AS a, coalesce(n.scaled, 0) AS b
  FROM {_scaled("pool")} l FULL JOIN {_scaled("near")} n ON l.query_id = n.query_id AND l.id = n.id
), sides AS (SELECT query_id, id, rank, 0 AS side FROM pool UNION ALL SELECT query_id, id, rank, 1 FROM near)"""


def _share_of(asked: str, words: str) -> str:
    return f"(CASE WHEN len(list_distinct({asked})) = 0 THEN 0 ELSE CAST(len(list_intersect(list_distinct({asked}), {words})) AS DOUBLE) / len(list_distinct({asked})) END)"


_E = "coalesce(expansion, CAST([] AS VARCHAR[]))"
_AB = "list_concat(t, a)"
FEATURE_ROWS = f"""feat0 AS (
  SELECT *, (score - min(score) OVER w) / CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE max(score) OVER w - min(score) OVER w END AS lex, count(*) OVER w AS n,
    {_share_of("asked", _AB)} AS c_any, {_share_of(_E, _AB)} AS c_fb, {_share_of(_bigrams("asked"), f"list_concat({_bigrams('t')}, {_bigrams('a')})")} AS c_ph
  FROM {_own(FEEDBACK_STOPWORDS, EXPANDED)} WINDOW w AS (PARTITION BY query_id)
), feat1 AS (
  SELECT f.*, d.score AS v, row_number() OVER (PARTITION BY f.query_id ORDER BY d.score DESC, f.id) AS vr, coalesce(g.grade, 0) AS grade
  FROM feat0 f JOIN dots d ON d.query_id = f.query_id AND d.id = f.id LEFT JOIN qrels g ON g.query_id = f.query_id AND g.id = f.id
), feats AS MATERIALIZED (
  SELECT query_id, id, CAST(greatest(grade, 0) AS BIGINT) AS label, rank AS original_rank, {_r("lex", 6)} AS "lexicalScore", {_r("CAST(1 AS DOUBLE) / rank", 6)} AS "rankReciprocal",
    {_r("CAST(n - rank + 1 AS DOUBLE) / n", 6)} AS "rankPercentile", {_r(_share_of("asked", "t"), 6)} AS "titleCoverage", {_r(_share_of("asked", "a"), 6)} AS "abstractCoverage",
    {_r("c_any", 6)} AS "anyCoverage", {_r("c_ph", 6)} AS "phraseCoverage", {_r("c_fb", 6)} AS "feedbackCoverage",
    {_r("lex + CAST(0.06 AS DOUBLE) * c_any + CAST(0.14 AS DOUBLE) * c_fb + CAST(0.01 AS DOUBLE) * c_ph", 6)} AS "prfScore",
    {_r("(v - min(v) OVER w) / CASE WHEN max(v) OVER w = min(v) OVER w THEN 1 ELSE max(v) OVER w - min(v) OVER w END", 6)} AS "vectorScore",
    {_r("CAST(1 AS DOUBLE) / vr", 6)} AS "vectorRankReciprocal", {_r("least(CAST(len(t) AS DOUBLE) / 24, 1)", 6)} AS "titleLength", {_r("least(CAST(len(a) AS DOUBLE) / 180, 1)", 6)} AS "abstractLength"
  FROM feat1 WINDOW w AS (PARTITION BY query_id)
)"""
DOMAINS = f"dom AS (SELECT query_id, CASE WHEN len({_tokens('query')}) < 30 THEN 'short' WHEN len({_tokens('query')}) < 45 THEN 'medium' ELSE 'long' END AS dataset FROM queries)"
VECTORS = """vecs AS (SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings), vq AS (
  SELECT CAST(vec_id AS VARCHAR) AS query_id, CAST(embedding AS DOUBLE[]) AS q, label FROM embeddings WHERE vec_id % 100 = 0)"""
VSCORES = _r("list_dot_product(q, e)", 6)
LTR = {"lexicalScore": 1.0, "anyCoverage": 0.25, "feedbackCoverage": 0.1, "phraseCoverage": 0.05, "vectorScore": 0.2}
FOLD = "CASE WHEN len(regexp_replace({0}, '[^0-9]', '', 'g')) > 0 AND CAST(regexp_replace({0}, '[^0-9]', '', 'g') AS BIGINT) > 0 THEN (CAST(regexp_replace({0}, '[^0-9]', '', 'g') AS BIGINT) - 1) % 5 ELSE list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split({0}, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (h * 31 + c) & 4294967295) % 5 END"

NEEDED = "need AS (SELECT query_id, greatest(CAST(floor(sum(qtf) * CAST(0.7 AS DOUBLE)) AS BIGINT), 1) AS needed FROM ask GROUP BY query_id)"
ENOUGH = f"ok AS (SELECT query_id, id, {_r('greatest(CASE WHEN n_title >= needed THEN 3 * title END, CASE WHEN n_abstract >= needed THEN 2 * abstract END, CASE WHEN n_text >= needed THEN 1 * text END)', 6)} AS score FROM wide JOIN need USING (query_id))"
_NORM = "(CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * dl / avg_len)"
_STANDS = "list_transform(range(1, len(offs) + 1), lambda c: spots[c][seat[c]] - offs[c])"
_FIRST = "list_min(list_transform(range(1, len(offs) + 1), lambda c: {{'p': {stands}[c], 'c': c}})).c"
_NEXT = "list_min(list_transform(list_filter(range(1, len(offs) + 1), lambda c: c <> {k}), lambda c: {stands}[c]))"
_HIT = "CASE WHEN spread <= 3 THEN CAST(1 AS DOUBLE) / (1 + spread) ELSE 0 END"
#: Cursors over the positions of a query's words (``held``), a step of one cursor (m; k is the one that is behind) a row of ``walk``.
PHRASES = f"""want AS (
  SELECT query_id, unnest(w) AS term, unnest(range(len(w))) AS place FROM (SELECT query_id, {_tokens("query")} AS w FROM queries)
), want_n AS (
  SELECT query_id, count(*) AS asked FROM want GROUP BY query_id
), pos AS MATERIALIZED (
  SELECT * FROM (SELECT id, field, len(w) AS dl, unnest(w) AS term, unnest(range(len(w))) AS pos FROM tok) WHERE term IN (SELECT term FROM want)
), idf AS (
  SELECT field, term, ln(1 + (n_docs - df + CAST(0.5 AS DOUBLE)) / (df + CAST(0.5 AS DOUBLE))) AS idf FROM df JOIN stat USING (field)
), spot AS (
  SELECT field, id, dl, term, list(pos ORDER BY pos) AS spots FROM pos GROUP BY ALL
), met AS (
  SELECT query_id, field, id, dl, count(*) AS found FROM want JOIN spot USING (term) GROUP BY ALL
), whole AS (
  SELECT query_id, field, id, dl FROM met JOIN want_n USING (query_id) WHERE found = asked
), held AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY query_id, field, id) AS n, * FROM (
    SELECT query_id, field, id, w.dl, list(place ORDER BY place) AS offs, list(term ORDER BY place) AS words, list(spots ORDER BY place) AS spots, sum(idf) AS idf
    FROM whole w JOIN want USING (query_id) JOIN spot USING (field, id, term) JOIN idf USING (field, term) GROUP BY ALL)
), begun AS (
  SELECT * FROM (SELECT *, list_transform(range(1, len(words) + 1), lambda c: len(list_filter(range(1, c + 1), lambda d: words[d] = words[c]))) AS seat FROM held WHERE len(words) > 1)
  WHERE len(list_filter(range(1, len(words) + 1), lambda c: seat[c] > len(spots[c]))) = 0
), walk(n, seat, k, m, nxt, spread, fin, freq, going) AS (
  SELECT n, seat, k, k, {_NEXT.format(k="k", stands="st")}, list_max(st) - st[k], list_max(st), CAST(0 AS DOUBLE), true
  FROM (SELECT *, {_FIRST.format(stands="st")} AS k FROM (SELECT *, {_STANDS} AS st FROM begun))
  UNION ALL
  SELECT n, seat, CASE WHEN turn THEN k2 ELSE k END, CASE WHEN NOT going THEN m WHEN rival IS NOT NULL THEN greatest(m, rival) WHEN turn THEN k2 ELSE k END,
    CASE WHEN turn THEN {_NEXT.format(k="k2", stands="st")} ELSE nxt END,
    CASE WHEN turn THEN fin - st[k2] WHEN going AND rival IS NULL THEN least(spread, fin - st[k]) ELSE spread END, fin, CASE WHEN turn OR NOT going THEN freq + {_HIT} ELSE freq END, going
  FROM (SELECT *, going AND rival IS NULL AND st[k] > nxt AS turn, {_FIRST.format(stands="st")} AS k2
    FROM (SELECT n, seat, k, m, nxt, spread, freq, offs, st, seat[m] <= len(spots[m]) AS going, greatest(fin, st[m]) AS fin, list_filter(range(1, len(offs) + 1), lambda c: c <> m AND words[c] = words[m] AND spots[c][seat[c]] = spots[m][seat[m]])[1] AS rival
      FROM (SELECT *, {_STANDS} AS st
        FROM (SELECT w.n, list_transform(w.seat, lambda v, c: v + CAST(c = w.m AS INT)) AS seat, k, m, nxt, spread, fin, freq, offs, words, spots FROM walk w JOIN held h ON h.n = w.n WHERE w.going))))
), often AS (
  SELECT query_id, field, id, dl, idf, freq FROM held JOIN walk USING (n) WHERE NOT going AND freq > 0
  UNION ALL SELECT query_id, field, id, dl, idf, CAST(len(spots[1]) AS DOUBLE) FROM held WHERE len(words) = 1
), phrases AS MATERIALIZED (
  SELECT query_id, id, {_r(f"max(CASE field WHEN 'title' THEN 8 WHEN 'abstract' THEN 5 ELSE 2 END * idf * freq / (freq + CAST(1.2 AS DOUBLE) * {_NORM}))", 6)} AS score FROM often JOIN stat USING (field) GROUP BY ALL
)"""
CROSS = f"""widest AS (
  SELECT term, max(df) AS df FROM df GROUP BY term
), best_of AS (
  SELECT term, id, max(CASE field WHEN 'title' THEN 3 WHEN 'abstract' THEN 2 ELSE 1 END * ln(1 + (n_docs - least(df, n_docs) + CAST(0.5 AS DOUBLE)) / (least(df, n_docs) + CAST(0.5 AS DOUBLE))) * (tf / (tf + CAST(1.2 AS DOUBLE) * {_NORM}))) AS score
  FROM post JOIN widest USING (term) JOIN stat USING (field) GROUP BY ALL
), crossed AS MATERIALIZED (
  SELECT query_id, id, {_r("score", 6)} AS score FROM (SELECT query_id, id, sum(score * qtf) AS score, count(*) AS found FROM best_of JOIN ask USING (term) GROUP BY ALL)
  JOIN (SELECT query_id, count(*) AS asked FROM ask GROUP BY query_id) USING (query_id) WHERE found = asked
)"""


# Words by Unicode's boundaries in scripts with spaces between words, and Porter's stems, a step a table.
_LETTERS, _DIGITS = r"[\p{L}\p{Nl}\p{M}\p{Cf}]+", r"[\p{Nd}\p{M}\p{Cf}]+"
_WORD = rf"(?:{_LETTERS}(?:[:·.''‘’]{_LETTERS})*|{_DIGITS}(?:[,;.''‘’]{_DIGITS})*|_+)+"


def _english(x: str) -> str:
    written = f"list_filter(regexp_extract_all({x}, '{_WORD}'), lambda t: regexp_matches(t, '[\\p{{L}}\\p{{Nd}}]'))"
    return f"list_filter(list_transform({written}, lambda t: regexp_replace(lower(t), '[''’]s$', '')), lambda t: t <> '' AND NOT list_contains({_list(STOPWORDS)}, t))"


def _shape(x: str) -> str:
    return f"list_reduce(list_prepend('', list_filter(string_split({x}, ''), lambda c: c <> '')), lambda s, c: s || CASE WHEN contains('aeiou', c) OR (c = 'y' AND right(s, 1) = 'c') THEN 'v' ELSE 'c' END)"


def _measure(x: str) -> str:
    return f"len(regexp_extract_all({_shape(x)}, 'v+c+'))"


def _short(x: str) -> str:
    return f"({_shape(x)} LIKE '%cvc' AND right({x}, 1) NOT IN ('w', 'x', 'y'))"


def _less(x: str, n: int) -> str:
    return f"left({x}, len({x}) - {n})"


def _suffix_step(name: str, source: str, rules: str) -> str:
    """Of the suffixes a word ends with, the longest decides: it is replaced if something measurable is left."""
    pairs = sorted((r.split(":") for r in rules.split()), key=lambda r: -len(r[0]))
    told = "[" + ", ".join(f"{{'a': '{a}', 'b': '{b}'}}" for a, b in pairs) + "]"
    return f"""{name} AS (SELECT word, CASE WHEN r IS NOT NULL AND {_measure("left(w, len(w) - len(r.a))")} > 0 THEN left(w, len(w) - len(r.a)) || r.b ELSE w END AS w
  FROM (SELECT word, w, list_filter({told}, lambda s: ends_with(w, s.a))[1] AS r FROM {source}))"""


_FOURTH = _list(sorted(STEP4.split(), key=lambda x: -len(x)))
STEMS = ",\n".join([
    f"said AS MATERIALIZED (SELECT 'd' AS kind, id, unnest(['title', 'abstract', 'text']) AS field, unnest([{_english('title')}, {_english('abstract')}, {_english('text')}]) AS ws FROM docs0 UNION ALL SELECT 'q', query_id, 'query', {_english('query')} FROM queries0)",
    "each AS MATERIALIZED (SELECT kind, id, field, unnest(ws) AS word, generate_subscripts(ws, 1) AS spot FROM said)",
    f"s0 AS (SELECT DISTINCT word, CASE WHEN word LIKE '%sses' OR word LIKE '%ies' THEN {_less('word', 2)} WHEN word LIKE '%s' AND word NOT LIKE '%ss' THEN {_less('word', 1)} ELSE word END AS w FROM each)",
    f"""s1 AS (SELECT word, w, CASE WHEN w LIKE '%eed' THEN NULL WHEN w LIKE '%ed' AND contains({_shape(_less('w', 2))}, 'v') THEN {_less('w', 2)} WHEN w LIKE '%ing' AND contains({_shape(_less('w', 3))}, 'v') THEN {_less('w', 3)} END AS x FROM s0)""",
    f"""s2 AS (SELECT word, CASE WHEN w LIKE '%eed' THEN CASE WHEN {_measure(_less('w', 3))} > 0 THEN {_less('w', 1)} ELSE w END WHEN x IS NULL THEN w
  WHEN x LIKE '%at' OR x LIKE '%bl' OR x LIKE '%iz' THEN x || 'e'
  WHEN len(x) > 1 AND right(x, 1) = left(right(x, 2), 1) AND right({_shape('x')}, 1) = 'c' AND right(x, 1) NOT IN ('l', 's', 'z') THEN {_less('x', 1)}
  WHEN {_measure('x')} = 1 AND {_short('x')} THEN x || 'e' ELSE x END AS w FROM s1)""",
    f"s3 AS (SELECT word, CASE WHEN w LIKE '%y' AND contains({_shape(_less('w', 1))}, 'v') THEN {_less('w', 1)} || 'i' ELSE w END AS w FROM s2)",
    _suffix_step("s4", "s3", STEP2),
    _suffix_step("s5", "s4", STEP3),
    f"s6 AS (SELECT word, w, list_filter({_FOURTH}, lambda s: ends_with(w, s))[1] AS suffix FROM s5)",
    f"s7 AS (SELECT word, CASE WHEN suffix IS NOT NULL AND {_measure('left(w, len(w) - len(suffix))')} > 1 AND (suffix <> 'ion' OR right(left(w, len(w) - 3), 1) IN ('s', 't')) THEN left(w, len(w) - len(suffix)) ELSE w END AS w FROM s6)",
    f"s8 AS (SELECT word, CASE WHEN w LIKE '%e' AND ({_measure(_less('w', 1))} > 1 OR ({_measure(_less('w', 1))} = 1 AND NOT {_short(_less('w', 1))})) THEN {_less('w', 1)} ELSE w END AS w FROM s7)",
    f"stems AS MATERIALIZED (SELECT word, CASE WHEN len(word) < 3 THEN word WHEN w LIKE '%ll' AND {_measure('w')} > 1 THEN {_less('w', 1)} ELSE w END AS stem FROM s8)",
    "texts AS MATERIALIZED (SELECT kind, id, field, string_agg(stem, ' ' ORDER BY spot) AS t FROM each JOIN stems USING (word) GROUP BY ALL)",
    "docs AS (SELECT id, " + ", ".join(f"max(CASE WHEN field = '{f}' THEN t END) AS {f}" for f in FIELDS) + " FROM texts WHERE kind = 'd' GROUP BY id)",
    "queries AS (SELECT id AS query_id, t AS query FROM texts WHERE kind = 'q')",
])
ENGLISH = (DOCS.replace("docs AS", "docs0 AS").replace("queries AS", "queries0 AS"), STEMS, _index(tokens=lambda x: f"list_filter(string_split(coalesce({x}, ''), ' '), lambda t: t <> '')"), BASELINE)


def _clean(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"


def _lines(*parts: str) -> str:
    return f"concat_ws(chr(10), {', '.join(parts)})"


ORACLE_SQL: dict[str, str] = {
    "fixture_term_search": _with(*COMMON, f"s AS ({_top('wide2', 'score', 10)})".replace("wide2", "(SELECT query_id, id, CAST(sum(CASE field WHEN 'title' THEN 3 WHEN 'abstract' THEN 2 ELSE 1 END * tf * qtf) AS BIGINT) AS score FROM post JOIN ask USING (term) GROUP BY ALL)")) + RANKED + "s",
    "mapped_hits": _with(*COMMON, BASELINE) + "SELECT r.query_id, r.id, r.rank, r.score, d.title, md5(d.abstract) AS abstract, coalesce(nullif(s.source, ''), 'driver-tables') AS source FROM run r JOIN docs d USING (id) JOIN documents s ON CAST(s.doc_id AS VARCHAR) = r.id",
    "lexical_cases": _with(*COMMON, BASELINE) + "SELECT q.query_id, count(r.id) AS n, coalesce(string_agg(r.id, ',' ORDER BY r.rank), '') AS ids FROM (SELECT query_id FROM queries UNION ALL SELECT 'none') q LEFT JOIN run r ON r.query_id = q.query_id AND r.rank <= 5 GROUP BY q.query_id",
    "bm25_english": _with(*ENGLISH) + RANKED + "run",
    "english_bm25": _with(*ENGLISH) + RANKED + "run",
    "english_stem": _with(*ENGLISH[:2]) + "SELECT word, stem FROM stems WHERE word IN (SELECT word FROM each WHERE field = 'text')",
    "english_words": _with(DOCS) + f"SELECT id, len(w) AS n_words, md5(coalesce(list_aggregate(w, 'string_agg', ' '), '')) AS words_md5 FROM (SELECT id, {_english('text')} AS w FROM docs)",
    "bm25_best_fields": _with(*COMMON, BASELINE) + RANKED + "run",
    "bm25_field_sum": _with(*COMMON) + RANKED + f"({_top('wide', SUM, 10)})",
    "bm25_tie_breaker": _with(DOCS, _index(fields={"title": 1, "text": 1})) + RANKED + f"({_top('wide', _r('greatest(title, text) + CAST(0.5 AS DOUBLE) * (title + text - greatest(title, text))', 6), 10)})",
    "bm25_paper_profile": _with(DOCS, _index(k1=1.5)) + RANKED + f"({_top('wide', SUM, 10)})",
    "msm_filter": _with(*COMMON, NEEDED, ENOUGH) + RANKED + f"({_top('(SELECT * FROM ok WHERE score IS NOT NULL)', 'score', 10)})",
    "phrase_search": _with(*COMMON, PHRASES) + RANKED + f"({_top('phrases', 'score', 10)})",
    "cross_fields_search": _with(*COMMON, CROSS) + RANKED + f"({_top('crossed', 'score', 10)})",
    "query_rescue": _with(*COMMON, NEEDED, ENOUGH, PHRASES, CROSS, f"must AS (SELECT query_id, id, {BEST} AS score FROM wide)") + RANKED + f"({_top('(SELECT m.query_id, m.id, m.score AS m, p.score AS p, c.score AS c, o.score AS o FROM must m LEFT JOIN phrases p ON p.query_id = m.query_id AND p.id = m.id LEFT JOIN crossed c ON c.query_id = m.query_id AND c.id = m.id LEFT JOIN ok o ON o.query_id = m.query_id AND o.id = m.id)', _r('m + coalesce(p * 3, 0) + coalesce(c * 2, 0) + coalesce(o * CAST(1.5 AS DOUBLE), 0)', 6), 10)})",
    "total_hits": _with(*COMMON) + "SELECT query_id, count(*) AS total_hits FROM wide GROUP BY query_id",
    "coverage_rerank": _with(*COMMON, POOL, COVERAGE) + RERANKED + "cov",
    "prf_feedback_terms": _with(*COMMON, POOL, TERMS) + "SELECT query_id, term, weight, place FROM fbt",
    "prf_rerank": _with(*COMMON, POOL, TERMS, PRF) + RERANKED + "prf",
    "prf_expand_merge": _with(
        *COMMON, POOL, TERMS, "more AS (SELECT query_id, string_agg(term, ' ') AS query FROM fbt GROUP BY query_id)", _index("more", "2"),
        f"again AS ({_top('(SELECT query_id, id, sum(s) AS score FROM (SELECT query_id, id, 3 * title + 2 * abstract + 1 * text AS s FROM wide UNION ALL SELECT query_id, id, CAST(1.4 AS DOUBLE) * title + CAST(1.1 AS DOUBLE) * abstract + CAST(0.4 AS DOUBLE) * text FROM wide2) GROUP BY ALL)', _r('score', 6), 80)})",
        "merged AS (SELECT coalesce(o.query_id, e.query_id) AS query_id, coalesce(o.id, e.id) AS id, coalesce(o.score, 0) AS original_score, coalesce(e.score, 0) AS expanded_score, o.rank AS original_rank, e.rank AS expanded_rank FROM best50 o FULL JOIN again e ON o.query_id = e.query_id AND o.id = e.id)",
        f"sc AS (SELECT query_id, id, original_score, expanded_score, original_rank, expanded_rank, {_r(f'CAST(0.62 AS DOUBLE) * ({_share('original_score')}) + CAST(0.38 AS DOUBLE) * ({_share('expanded_score')}) + CAST(0.06 AS DOUBLE) * {_coverage('asked')} + CAST(0.14 AS DOUBLE) * {_coverage(_E)}')} AS rerank_score FROM {_own(FEEDBACK_STOPWORDS, 'merged JOIN docs USING (id) JOIN queries USING (query_id) LEFT JOIN fb USING (query_id)')})",
    ) + "SELECT query_id, id, original_score, expanded_score, coalesce(original_rank, 0) AS original_rank, coalesce(expanded_rank, 0) AS expanded_rank, concat_ws('+', CASE WHEN original_rank IS NOT NULL THEN 'original' END, CASE WHEN expanded_rank IS NOT NULL THEN 'expanded' END) AS sources, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, sc.original_rank ASC NULLS LAST, sc.expanded_rank ASC NULLS LAST) AS rank FROM sc",
    "prf_grid": _with(
        *COMMON, QRELS, POOL, TERMS,
        f"grid AS (SELECT phrase_weight, query_id, id, row_number() OVER (PARTITION BY phrase_weight, query_id ORDER BY rerank_score DESC, original_rank) AS rank FROM (SELECT phrase_weight, query_id, id, original_rank, {_r('fixed + phrase_weight * phrase')} AS rerank_score FROM (SELECT query_id, id, rank AS original_rank, {_share('score')} + CAST(0.06 AS DOUBLE) * {_coverage('asked')} + CAST(0.14 AS DOUBLE) * {_coverage(_E)} AS fixed, {_phrase('asked')} AS phrase FROM {_own(FEEDBACK_STOPWORDS, EXPANDED)}) CROSS JOIN (SELECT CAST(unnest([0, 0.01, 0.02, 0.04, 0.06]) AS DOUBLE) AS phrase_weight)))",
        _scored("grid", keys=", phrase_weight"),
    ) + f"SELECT phrase_weight, {MEANS} FROM scored GROUP BY phrase_weight",
    "embedding_cache": _with(DOCS, _hash("docs", "id", "text", "dvec")) + "SELECT id, component, value FROM dvec",
    "embedding_runs": """WITH d AS (SELECT coalesce(text, '') AS t, coalesce(lang = 'en', false) AS e FROM documents), n AS (
      SELECT count(*) AS a, count(*) FILTER (e) AS ae, count(DISTINCT t) AS m, count(DISTINCT t) FILTER (e) AS me FROM d)
      SELECT 1 AS run, ae AS asked, me AS made, me AS held FROM n UNION ALL SELECT 2, a, m - me, m FROM n UNION ALL SELECT 3, a, 0, m FROM n""",
    "local_hash_embedding": _with(DOCS, _hash("docs", "id", "text", "dvec")) + "SELECT id, component, value FROM dvec",
    "knn_exact": _with(VECTORS) + RANKED + f"({_top('(SELECT query_id, id, q, e FROM vq CROSS JOIN vecs)', VSCORES, 10)})",
    "knn_bounded": _with(VECTORS) + RANKED + f"({_top('(SELECT query_id, id, q, e FROM vq CROSS JOIN vecs)', VSCORES, 10)})",
    "knn_ignore_identical": _with(VECTORS) + RANKED + f"({_top('(SELECT query_id, id, q, e FROM vq CROSS JOIN vecs WHERE id <> query_id)', VSCORES, 10)})",
    "knn_label_metrics": _with(VECTORS, "queries AS (SELECT query_id FROM vq)", "qrels AS (SELECT query_id, id, 1 AS grade FROM vq JOIN vecs USING (label) WHERE id <> query_id)", f"run AS ({_top('(SELECT query_id, id, q, e FROM vq CROSS JOIN vecs WHERE id <> query_id)', VSCORES, 10)})", _scored("run", mode="binary")) + f"SELECT {MEANS} FROM scored",
    "minmax_scores": _with(*COMMON, POOL) + f"SELECT query_id, id, {_r('scaled', 6)} AS scaled FROM {_scaled('pool')}",
    "blend_linear": _with(*COMMON, POOL, HASHED, NEAR, FUSED) + RANKED + f"({_top('lin', _r('CAST(0.5 AS DOUBLE) * a + CAST(0.5 AS DOUBLE) * b', 6), 50)})",
    "rrf": _with(*COMMON, POOL, HASHED, NEAR, FUSED) + RANKED + f"({_top('(SELECT query_id, id, sum(CAST(1 AS DOUBLE) / (60 + rank)) AS s FROM sides GROUP BY ALL)', _r('s', 9), 50)})",
    "hybrid_sweep": _with(
        *COMMON, QRELS, POOL, HASHED, NEAR, FUSED, "ws AS (SELECT k, k / CAST(10 AS DOUBLE) AS w, 1 - k / CAST(10 AS DOUBLE) AS u FROM range(1, 10) t(k))",
        f"runs AS (SELECT variant, query_id, id, row_number() OVER (PARTITION BY variant, query_id ORDER BY score DESC, id) AS rank FROM (SELECT 'linear-0.' || k AS variant, query_id, id, {_r('u * a + w * b', 6)} AS score FROM lin CROSS JOIN ws UNION ALL SELECT 'rrf-0.' || k, query_id, id, {_r('sum((CASE WHEN side = 0 THEN u ELSE w END) / (60 + rank))', 9)} FROM sides CROSS JOIN ws GROUP BY ALL) UNION ALL SELECT 'lexical', query_id, id, rank FROM pool UNION ALL SELECT 'vector', query_id, id, rank FROM near)",
        _scored("runs", keys=", variant"),
    ) + f"SELECT variant, {MEANS} FROM scored GROUP BY variant",
    "metrics_aggregate": _with(*COMMON, QRELS, BASELINE, _scored("run")) + f"SELECT {MEANS} FROM scored",
    "failure_groups": _with(*COMMON, QRELS, BASELINE, _scored("run"), _classified("scored", "c")) + "SELECT behavior_group, count(*) AS query_count, " + ", ".join(f"{_r(f'sum(CAST(round({m} * 10000) AS BIGINT)) / CAST(10000 AS DOUBLE) / count(*)')} AS average_{m}" for m in METRICS) + f", {_r('sum(relevant_count) / count(*)')} AS average_relevant_count, {_r('sum(hits) / count(*)')} AS average_relevant_hits_at_k, CASE behavior_group WHEN 'zero_relevant_at_k' THEN 'No relevant result in top K' WHEN 'late_first_relevant' THEN 'Relevant result ranked too late' WHEN 'broad_need_low_recall' THEN 'Broad information need with low recall' WHEN 'lexical_noise_low_precision' THEN 'Lexical noise dominates' WHEN 'graded_ranking_loss' THEN 'Relevant results found but weak graded ranking' WHEN 'partial_recall' THEN 'Partial recall' ELSE 'Passing or minor issue' END AS label FROM c GROUP BY behavior_group",
    "failure_examples": _with(*COMMON, QRELS, BASELINE, _scored("run"), _classified("scored", "c")) + "SELECT behavior_group, place, query_id, ndcg_at_k FROM (SELECT *, row_number() OVER (PARTITION BY behavior_group ORDER BY ndcg_at_k, query_id) AS place FROM c) WHERE place <= 5",
    "missing_relevant": _with(*COMMON, QRELS, BASELINE) + "SELECT query_id, place, id, CAST(grade AS BIGINT) AS grade FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, id) AS place FROM qrels q WHERE grade > 0 AND NOT EXISTS (SELECT 1 FROM run r WHERE r.query_id = q.query_id AND r.id = q.id)) WHERE place <= 12",
    "metric_deltas": _with(*TWO_RUNS, f"b AS (SELECT {MEANS} FROM base_s)", f"c AS (SELECT {MEANS} FROM cand_s)") + " UNION ALL ".join(f"SELECT '{m}' AS metric, b.{m} AS baseline, c.{m} AS candidate, {_r(f'c.{m} - b.{m}')} AS delta FROM b, c" for m in ("precision_at_k", "recall_at_k", "map", "mrr", "ndcg_at_k")),
    "group_deltas": _with(*TWO_RUNS) + "SELECT behavior_group, CAST(sum(b) AS BIGINT) AS baseline_count, CAST(sum(c) AS BIGINT) AS candidate_count, CAST(sum(c) - sum(b) AS BIGINT) AS delta FROM (SELECT behavior_group, 1 AS b, 0 AS c FROM base_c UNION ALL SELECT behavior_group, 0, 1 FROM cand_c) GROUP BY behavior_group",
    "query_deltas": _with(*TWO_RUNS) + "SELECT *, CASE WHEN ndcg_delta > 0 THEN 'improved' WHEN ndcg_delta < 0 THEN 'worsened' ELSE 'unchanged' END AS change FROM (SELECT query_id, b.behavior_group AS baseline_group, c.behavior_group AS candidate_group, " + ", ".join(f"{_r(f'c.{m} - b.{m}')} AS {d}" for m, d in (("ndcg_at_k", "ndcg_delta"), ("average_precision", "average_precision_delta"), ("reciprocal_rank", "reciprocal_rank_delta"), ("recall_at_k", "recall_delta"))) + " FROM base_c b JOIN cand_c c USING (query_id))",
    "decision": _with(*TWO_RUNS, f"b AS (SELECT {MEANS} FROM base_s)", f"c AS (SELECT {MEANS} FROM cand_s)") + "SELECT CASE WHEN " + " AND ".join(f"c.{m} > b.{m}" for m in ("map", "ndcg_at_k", "recall_at_k", "mrr")) + " THEN 'candidate_improved_core_metrics' WHEN " + " AND ".join(f"c.{m} < b.{m}" for m in ("map", "ndcg_at_k", "recall_at_k", "mrr")) + " THEN 'candidate_regressed_core_metrics' ELSE 'candidate_mixed_metrics' END AS decision FROM b, c",
    "technique_classification": _with(
        *COMMON, QRELS, POOL, COVERAGE, TERMS, PRF, DOMAINS, "runs AS (SELECT 'field-sum' AS technique, query_id, id, rank FROM pool UNION ALL SELECT 'coverage-rerank', query_id, id, rank FROM cov UNION ALL SELECT 'prf-rerank', query_id, id, rank FROM prf)",
        _scored("runs", mode="linear", keys=", technique"), f"by_set AS (SELECT technique, dataset, {_mean('ndcg_at_k', 'measured')} FROM scored JOIN dom USING (query_id) GROUP BY ALL)",
        f"rel AS (SELECT t.technique, t.dataset, {_r('(t.measured - b.measured) / b.measured')} AS delta FROM by_set t JOIN by_set b ON b.technique = 'field-sum' AND b.dataset = t.dataset WHERE t.technique <> 'field-sum' AND b.measured <> 0)",
        "agg AS (SELECT technique, count(*) AS evaluated, count(*) FILTER (delta > 0) AS improved, least(min(delta), 0) AS worst, coalesce(string_agg(CASE WHEN delta > 0 THEN dataset END, ',' ORDER BY dataset), '') AS improved_on FROM rel GROUP BY technique)",
    ) + f"SELECT technique, CASE WHEN improved / evaluated >= 0.7 AND worst >= -0.05 THEN 'universal' WHEN improved >= 2 THEN 'domain-conditional' ELSE 'dormant' END AS scope, evaluated, improved, {_r('improved / evaluated', 3)} AS improve_rate, {_r('worst', 3)} AS worst_relative_regression, improved_on FROM agg",
    "portfolio": _with(
        *COMMON, QRELS, POOL, COVERAGE, TERMS, PRF, DOMAINS, "runs AS (SELECT 'field-sum' AS technique, query_id, id, rank FROM pool UNION ALL SELECT 'coverage-rerank', query_id, id, rank FROM cov UNION ALL SELECT 'prf-rerank', query_id, id, rank FROM prf)",
        _scored("runs", mode="linear", keys=", technique"), f"by_set AS (SELECT technique, dataset, {_mean('ndcg_at_k', 'measured')} FROM scored JOIN dom USING (query_id) GROUP BY ALL)",
        f"rel AS (SELECT t.technique, t.dataset, {_r('(t.measured - b.measured) / b.measured')} AS delta FROM by_set t JOIN by_set b ON b.technique = 'field-sum' AND b.dataset = t.dataset WHERE t.technique <> 'field-sum' AND b.measured <> 0)",
        "agg AS (SELECT technique, count(*) AS evaluated, count(*) FILTER (delta > 0) AS improved, least(min(delta), 0) AS worst FROM rel GROUP BY technique)",
    ) + f"SELECT t.technique, t.dataset, b.measured AS baseline, t.measured, CASE WHEN b.measured <> 0 THEN {_r('(t.measured - b.measured) / b.measured')} END AS relative, CASE WHEN improved / evaluated >= 0.7 AND worst >= -0.05 THEN 'universal' WHEN improved >= 2 THEN 'domain-conditional' ELSE 'dormant' END AS scope FROM by_set t JOIN by_set b ON b.technique = 'field-sum' AND b.dataset = t.dataset LEFT JOIN agg a ON a.technique = t.technique WHERE t.technique <> 'field-sum'",
    "mean_of_parts": _with(*COMMON, QRELS, BASELINE, DOMAINS, _scored("run", mode="linear"), f"by_set AS (SELECT dataset, count(*) AS query_count, {_mean('ndcg_at_k', 'ndcg_at_k')} FROM scored JOIN dom USING (query_id) GROUP BY dataset)") + f"SELECT 'all' AS dataset, count(*) AS parts, CAST(sum(query_count) AS BIGINT) AS query_count, {_mean('ndcg_at_k', 'ndcg_at_k')} FROM by_set",
    "failure_shares": _with(*COMMON, QRELS, BASELINE, DOMAINS, _scored("run"), _classified("scored", "c")) + f"SELECT *, {_r('CAST(query_count AS DOUBLE) / sum(query_count) OVER (PARTITION BY dataset)')} AS share FROM (SELECT dataset, behavior_group, count(*) AS query_count FROM c JOIN dom USING (query_id) GROUP BY ALL)",
    "collection_pool": _with(DOCS, _index(fields={"title": 3, "text": 2})) + RANKED + f"({_top('wide', _r('3 * title + 2 * text', 6), 50)})",
    "filtered_search": _with(*COMMON) + RANKED + f"({_top("(SELECT w.* FROM wide w JOIN documents d ON CAST(d.doc_id AS VARCHAR) = w.id WHERE d.lang = 'fr')", BEST, 10)})",
    "index_life": """WITH d AS (SELECT doc_id % 2 = 0 AS even, doc_id % 3 = 0 AS third, lang IS NOT DISTINCT FROM 'de' AS de FROM documents
      ), s AS (
        SELECT unnest([0, 1, 2, 3, 4, 5, 6])::INT AS step, unnest(['create', 'load', 'load', 'again', 'replace', 'remove', 'merge']) AS name, unnest([0, 1, 2, 2, 3, 3, 1])::INT AS segments, unnest([0, 0, 0, 0, 1, 2, 0])::INT AS tombstones
      ), n AS (SELECT step, name, segments, tombstones, (SELECT count(*) FILTER (CASE step WHEN 0 THEN false WHEN 1 THEN even WHEN 5 THEN NOT de WHEN 6 THEN NOT de ELSE true END) FROM d) AS n_docs FROM s)
      SELECT step, name, n_docs, n_docs AS n_stored, segments, tombstones FROM n""",
    "index_after_changes": _with(DOCS.replace("FROM documents", "FROM documents WHERE lang IS DISTINCT FROM 'de'"), *COMMON[1:], BASELINE) + "SELECT version, query_id, id, rank, score FROM run, (SELECT unnest(['remove', 'merge']) AS version)",
    "streamed_index": _with(*COMMON, BASELINE) + RANKED + "run",
    "baseline_matrix": _with(*COMMON, QRELS, BASELINE, DOMAINS, _scored("run", mode="linear"), f"by_set AS (SELECT dataset, count(*) AS query_count, {_mean('ndcg_at_k', 'ndcg_at_k')} FROM scored JOIN dom USING (query_id) GROUP BY dataset)") + f"SELECT dataset, CAST(1 AS BIGINT) AS tier, 'measured' AS status, query_count, ndcg_at_k, CAST(0.43 AS DOUBLE) AS published, {_r('ndcg_at_k - CAST(0.43 AS DOUBLE)')} AS delta, {_r(_r('ndcg_at_k - CAST(0.43 AS DOUBLE)') + ' / CAST(0.43 AS DOUBLE)')} AS relative_delta FROM by_set",
    "ltr_features": _with(*COMMON, QRELS, POOL, TERMS, HASHED, NEAR, FEATURE_ROWS) + "SELECT * FROM feats",
    "ltr_linear_score": _with(*COMMON, QRELS, POOL, TERMS, HASHED, NEAR, FEATURE_ROWS, "sc AS (SELECT query_id, id, original_rank, " + _r(" + ".join(f'"{f}" * CAST({LTR.get(f, 0.0)} AS DOUBLE)' for f in FEATURES), 6) + " AS ltr_score FROM feats)") + "SELECT query_id, id, ltr_score, row_number() OVER (PARTITION BY query_id ORDER BY ltr_score DESC, original_rank, id) AS rank FROM sc",
    "fold_assignment": _with(DOCS) + f"SELECT id, {FOLD.format('id')} AS fold, {FOLD.format('masked')} AS hash_fold FROM (SELECT id, regexp_replace(id, '[0-9]', 'x', 'g') AS masked FROM docs)",
    "pool_recall": _with(*COMMON, QRELS, POOL, "r AS (SELECT q.query_id, count(*) AS relevant, count(p.id) AS hits FROM qrels q LEFT JOIN pool p ON p.query_id = q.query_id AND p.id = q.id WHERE grade > 0 GROUP BY q.query_id)", "s AS (SELECT CAST(sum(relevant) AS BIGINT) AS relevant_count, CAST(sum(hits) AS BIGINT) AS relevant_in_pool, count(*) AS queries_with_relevant, count(*) FILTER (hits > 0) AS queries_with_relevant_in_pool FROM r)") + f"SELECT *, {_r('CAST(relevant_in_pool AS DOUBLE) / greatest(relevant_count, 1)', 6)} AS recall, {_r('CAST(queries_with_relevant_in_pool AS DOUBLE) / greatest(queries_with_relevant, 1)', 6)} AS query_coverage FROM s",
    "oracle_rank": _with(*COMMON, QRELS, POOL) + "SELECT query_id, id, label, original_rank, row_number() OVER (PARTITION BY query_id ORDER BY label DESC, original_rank) AS rank FROM (SELECT p.query_id, p.id, CAST(greatest(coalesce(g.grade, 0), 0) AS BIGINT) AS label, p.rank AS original_rank FROM pool p LEFT JOIN qrels g ON g.query_id = p.query_id AND g.id = p.id)",
    "normalize_query": r"""WITH n AS (SELECT conv_id, turn, ' ' || text AS x, regexp_replace(' ' || text, '^\s+|\s+$', '', 'g') AS y FROM conversations)
SELECT conv_id, turn, md5(regexp_replace(y, '\s+', ' ', 'g')) AS normalized_md5, CASE WHEN x = y AND y = regexp_replace(y, '\s+', ' ', 'g') THEN 'none' ELSE concat_ws('; ', CASE WHEN x <> y THEN 'trimmed leading/trailing whitespace' END, CASE WHEN y <> regexp_replace(y, '\s+', ' ', 'g') THEN 'collapsed repeated internal whitespace' END) END AS transformations FROM n""",
    "stopword_tokens": _with(DOCS) + f"SELECT id, array_to_string({_significant('title', COVERAGE_STOPWORDS)}, ' ') AS tokens, len({_significant('text')}) AS n_text_tokens FROM docs",
    "bigrams": _with(DOCS) + f"SELECT bigram, count(*) AS n, count(DISTINCT id) AS n_docs FROM (SELECT id, unnest({_bigrams('w')}) AS bigram FROM (SELECT id, {_significant('text', COVERAGE_STOPWORDS)} AS w FROM docs)) GROUP BY bigram",
    "dataset_profile_counts": _with(DOCS, QRELS) + "SELECT 'documents' AS part, count(*) AS n FROM docs UNION ALL SELECT 'queries', count(*) FROM queries UNION ALL SELECT 'qrels', count(*) FROM qrels UNION ALL SELECT 'judged_queries', count(DISTINCT query_id) FROM qrels",
    "knn_ivf_recall": _with(VECTORS) + f"SELECT count(DISTINCT query_id) AS queries, count(*) AS wanted, true AS nine_in_ten FROM ({_top('(SELECT query_id, id, q, e FROM vq CROSS JOIN vecs)', VSCORES, 10)})",
    "bm25_ignore_identical": _with(DOCS, _index(fields={"title": 1, "text": 1})) + RANKED + f"({_top('(SELECT * FROM wide WHERE id <> query_id)', _r('greatest(title, text) + CAST(0.5 AS DOUBLE) * (title + text - greatest(title, text))', 6), 10)})",
    "published_delta": _with(*COMMON, QRELS, BASELINE, DOMAINS, _scored("run", mode="linear"), f"by_set AS (SELECT dataset, {_mean('ndcg_at_k', 'ndcg_at_k')} FROM scored JOIN dom USING (query_id) GROUP BY dataset)") + f"SELECT dataset, ndcg_at_k, {_r('ndcg_at_k - CAST(0.43 AS DOUBLE)')} AS delta, {_r(_r('ndcg_at_k - CAST(0.43 AS DOUBLE)') + ' / CAST(0.43 AS DOUBLE)')} AS relative_delta FROM by_set",
    "simpler_preferred": _with(
        *COMMON, QRELS, POOL, COVERAGE, TERMS, PRF, DOMAINS, "runs AS (SELECT 'coverage-rerank' AS technique, query_id, id, rank FROM cov UNION ALL SELECT 'prf-rerank', query_id, id, rank FROM prf)",
        _scored("runs", mode="linear", keys=", technique"), f"by_set AS (SELECT technique, dataset, {_mean('ndcg_at_k', 'measured')} FROM scored JOIN dom USING (query_id) GROUP BY ALL)",
        "won AS (SELECT count(*) AS evaluated, count(*) FILTER (a.measured > b.measured) AS won FROM by_set a JOIN by_set b USING (dataset) WHERE a.technique = 'prf-rerank' AND b.technique = 'coverage-rerank')",
    ) + "SELECT evaluated, won, coalesce(won / nullif(evaluated, 0), 0) >= 0.7 AS preferred FROM won",
    "weights_metrics": _with(*COMMON, QRELS, POOL, TERMS, HASHED, NEAR, FEATURE_ROWS, "sc AS (SELECT query_id, id, original_rank, " + _r(" + ".join(f'"{f}" * CAST({LTR.get(f, 0.0)} AS DOUBLE)' for f in FEATURES), 6) + " AS ltr_score FROM feats)", "run AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY ltr_score DESC, original_rank, id) AS rank FROM sc)", _scored("run")) + f"SELECT {MEANS} FROM scored",
    "tagged_collection": _with(DOCS, f"r AS (SELECT id, {_clean('title')} AS t, {_clean('abstract')} AS a, {_clean('source')} AS s, {_clean('lang')} AS l FROM docs JOIN documents ON CAST(doc_id AS VARCHAR) = id)", "n AS (SELECT *, CASE WHEN t = '' THEN 'Cranfield document ' || id ELSE t END AS title FROM r)")
    + f"SELECT id, 'driver-tables' AS dataset, title, md5(a) AS abstract_md5, md5({_clean("concat_ws(' ', title, s, l, a)")}) AS text_md5, 'documents' AS source FROM n",
    "tagged_queries": f"SELECT CAST(row_number() OVER (ORDER BY item_id) AS VARCHAR) AS query_id, {_clean('text')} AS query FROM benchmark",
    "qrels_lines": _with(DOCS, QRELS) + "SELECT query_id, count(g.id) AS judged, coalesce(string_agg(g.id || ':' || g.grade, ',' ORDER BY g.id || ':' || g.grade), '') AS judgements FROM queries LEFT JOIN qrels g USING (query_id) GROUP BY query_id",
    "jsonl_corpus": _with(DOCS) + "SELECT id, title, md5(text) AS text_md5 FROM docs",
    "judged_queries": _with(DOCS, QRELS, "n AS (SELECT query_id, count(*) AS n, CAST(sum(grade) AS BIGINT) AS grades FROM qrels GROUP BY query_id)") + "SELECT 'q' || query_id AS query_id, row_number() OVER (ORDER BY CAST(query_id AS BIGINT)) AS place, query, n, grades FROM n JOIN queries USING (query_id)",
    "archive_members": _with(DOCS) + "SELECT id || '.txt' AS name, CASE WHEN len(id) % 2 = 0 THEN 'zip' ELSE 'tar' END AS kind, md5(text) AS content_md5 FROM docs",
    "bulk_payload": _with(DOCS) + f"SELECT 'action' AS kind, id, md5('driver-tables') AS content_md5 FROM docs UNION ALL SELECT 'document', id, md5({_lines('title', 'text')}) FROM docs",
    "embedding_input": _with(DOCS, QRELS) + "SELECT 'document' AS kind, id, md5(CASE WHEN title <> '' THEN title || chr(10) ELSE '' END || abstract) AS text_md5 FROM docs UNION ALL SELECT 'query', query_id, md5(query) FROM queries WHERE query_id IN (SELECT query_id FROM qrels)",
    "resumed_work": "SELECT CAST(doc_id AS VARCHAR) AS id, length(coalesce(text, '')) AS n_chars FROM documents WHERE lang IS DISTINCT FROM 'en'",
    "text_forms": _with(DOCS) + f"SELECT id, md5({_clean('text')}) AS cleaned_md5, md5('passage: ' || {_lines("nullif(title, '')", "nullif(abstract, '')", "nullif(text, '')")}) AS whole_md5, md5({_lines("nullif(title, '')", "nullif(abstract, '')")}) AS short_md5, md5(abstract) AS body_md5, md5(concat_ws(' ', title, title, abstract)) AS feedback_md5 FROM docs",
    "event_arrivals": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
} | {f"metrics_{m.replace('-', '_')}": _with(*COMMON, QRELS, BASELINE, _scored("run", mode=m)) + f"SELECT query_id, {', '.join(METRICS)} FROM scored" for m in MODES}
