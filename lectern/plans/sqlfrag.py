"""DuckDB SQL fragments mirroring the Column expressions in ``lectern.functions``.

Used only to write oracle SQL; they are independent formulations of the same
rules (regex classes, stop-word list, numeric-token rule), not translations of
the Spark plans.
"""

from __future__ import annotations

from lectern.functions.text import default_stopwords


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(sql_str(v) for v in values) + "]"


STOPWORDS = sql_list(default_stopwords())


def norm(x: str) -> str:
    return rf"regexp_replace(coalesce({x}, ''), '[^\p{{L}}\p{{N}}]+', ' ', 'g')"


def words(x: str) -> str:
    return f"list_filter(string_split(lower({norm(x)}), ' '), lambda t: t <> '')"


def clean(x: str) -> str:
    return (f"list_filter({words(x)}, lambda t: NOT list_contains({STOPWORDS}, t) "
            rf"AND NOT regexp_full_match(t, '\p{{N}}+'))")


def vec(x: str) -> str:
    return f"list_filter({clean(x)}, lambda t: length(t) >= 2)"


PAPERS = ("(SELECT source AS dataset, doc_id AS paper_key, split_part(text, chr(10), 1) AS title, "
          "text AS abstract, lang AS topic, n_chars FROM documents)")


def tf_scores(query_text: str, field: str = "abstract", zero_as_zero: bool = False) -> str:
    """SELECT dataset, paper_key, score over every paper (score NULL for an empty vector)."""
    zero = "0.0" if zero_as_zero else "CASE WHEN n_tok > 0 THEN 0.0 END"
    return f"""
    WITH p AS (SELECT * FROM {PAPERS}),
    q AS (SELECT unnest({vec(sql_str(query_text))}) AS term),
    qc AS (SELECT term, count(*) AS qn FROM q GROUP BY term),
    qs AS (SELECT coalesce(sum(qn * qn), 0) AS qss FROM qc),
    t AS (SELECT dataset, paper_key, unnest({vec(field)}) AS term FROM p),
    c AS (SELECT dataset, paper_key, term, count(*) AS n FROM t GROUP BY ALL),
    d AS (SELECT c.dataset, c.paper_key, sum(c.n * c.n) AS ss, sum(c.n) AS n_tok,
                 sum(c.n * coalesce(qc.qn, 0)) AS dot
          FROM c LEFT JOIN qc ON c.term = qc.term GROUP BY ALL),
    s AS (SELECT p.dataset, p.paper_key,
                 CASE WHEN coalesce(d.dot, 0) > 0 AND qs.qss > 0
                      THEN d.dot::DOUBLE / sqrt(d.ss::DOUBLE * qs.qss::DOUBLE)
                      ELSE {('0.0' if zero_as_zero else 'CASE WHEN coalesce(d.n_tok, 0) > 0 AND qs.qss > 0 THEN 0.0 END')} END AS score
          FROM p LEFT JOIN d ON p.dataset = d.dataset AND p.paper_key = d.paper_key CROSS JOIN qs)
    SELECT dataset, paper_key, score FROM s"""


def round_score(x: str) -> str:
    return f"round(CAST(CAST({x} AS FLOAT) AS DOUBLE), 4)"
