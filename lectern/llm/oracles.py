"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from lectern.llm import secret_scan

SQL: dict[str, str] = {}

SQL["op1_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) = 1 AS kept,
       text_sha256
FROM d
"""


def _either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


def _secrets() -> str:
    """The rules of the scan, matched by DuckDB's own engine.  Matches and the gaps between
    them give the positions.  Letters of either case are written out (ASCII only)."""
    keyword = _either_case("password|passwd|secret|token|api_?key")
    parts = []
    for r, rule in enumerate(secret_scan.RULES):
        words = "(?i:password|passwd|secret|token|api_?key)"
        pattern = rule.pattern.replace(words, keyword).replace("'", "''")
        pattern = "[0-9a-f]{32,}" if rule.kind == "hex" else pattern
        parts.append(f"""
  SELECT r, {r} AS rule, '{rule.kind}' AS kind, {rule.base} AS base, {rule.least} AS least,
         unnest(regexp_extract_all(text, '{pattern}')) AS w,
         unnest(regexp_extract_all(text, '{pattern}', {rule.group})) AS g,
         unnest(list_slice(string_split_regex(text, '{pattern}'), 1, len(regexp_extract_all(text, '{pattern}')))) AS gap,
         unnest(range(len(regexp_extract_all(text, '{pattern}')))) AS nth
  FROM d""")
    said = "kind || ':' || (e - length(w))::VARCHAR || ':' || e::VARCHAR"
    counts = "".join(f", count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secret_scan.RULES if r.base)
    shown = "".join(f", coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secret_scan.RULES if r.base)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(parts)}),
s AS (SELECT *, sum(length(gap) + length(w)) OVER (PARTITION BY r, rule ORDER BY nth)::BIGINT AS e FROM m),
a AS (
  SELECT r{counts},
         string_agg({said}, ',' ORDER BY e - length(w), rule) FILTER (base) AS base_said,
         string_agg({said}, ',' ORDER BY e - length(w), rule) AS spans
  FROM s WHERE length(g) >= least GROUP BY r)
SELECT doc_id{shown}, sha256(coalesce(base_said, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (r)
"""


SQL["op3_secret_scan"] = _secrets()

SQL["op4_exact_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, x.vec_id,
         list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v x ON q.vec_id % 100 = 0 AND x.vec_id != q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

SQL["op13_source_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
                                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term, count(*) AS c FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
l AS (SELECT lang, count(*) AS v, sum(c) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, count(*) AS c FROM w JOIN k USING (lang, term) GROUP BY ALL),
gn AS (SELECT g.lang, g.source, coalesce(sum(c.c), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (
  SELECT gn.lang, gn.source, k.term, coalesce(c.c, 0) AS c,
         1 + 1000000000::HUGEINT * (coalesce(c.c, 0) + 1) // (gn.n + l.v)::HUGEINT AS p
  FROM gn JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term),
q AS (SELECT k.lang, k.term, 1 + 1000000000::HUGEINT * (k.c + 1) // (l.n + l.v)::HUGEINT AS q FROM k JOIN l USING (lang)),
f AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source != b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (
  SELECT p.lang, p.source, 'term' AS part, p.term AS item, ((p.p - q.q) * (p.p - q.q) // q.q)::BIGINT AS value
  FROM p JOIN q USING (lang, term) WHERE p.c > 0 AND p.p > q.q),
r AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200
"""

# The true neighbours: what the search finds, too, on tables no larger than its sample.
SQL["op11_nearest_neighbours"] = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (
  SELECT q.vec_id AS query_id, x.vec_id,
         sqrt(list_reduce(list_transform(list_zip(q.v, x.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, b: a + b)) AS score
  FROM v q JOIN v x ON q.vec_id % 100 = 0 AND x.vec_id != q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
