"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from quarryleaf.llm import secrets


def _secrets_sql() -> str:
    """Spans of each kind by what lies between matches, running sums for their
    places, and an existence test for linking."""
    parts = []
    for k, kind in enumerate(secrets.KINDS):
        pattern, group, least, _ = secrets.PATTERNS[kind]
        whole = f"(?s)(.*?)({pattern})".replace("'", "''")
        all_of = lambda g, whole=whole: f"regexp_extract_all(coalesce(text, ''), '{whole}', {g})"
        ok = "regexp_matches(c, '[A-Z]') AND regexp_matches(c, '[a-z]') AND regexp_matches(c, '[0-9]')" if kind == "secret" else f"length(c) >= {least}"
        parts.append(f"SELECT doc_id, {k} AS kind, n, length(g) AS gap, length(m) AS len, {ok} AS ok FROM (SELECT doc_id, unnest(range(len(gs))) AS n, unnest(gs) AS g, unnest(ms) AS m, unnest(cs) AS c FROM (SELECT doc_id, {all_of(1)} AS gs, {all_of(2)} AS ms, {all_of(group)} AS cs FROM documents))")
    near = " OR ".join(f"abs(a.{x} - b.{y}) <= {secrets.SCOPE}" for x in ("s", "e") for y in ("s", "e"))
    name = f"['{"', '".join(secrets.KINDS)}'][kind + 1]"
    written = f"string_agg({name} || ':' || s || ':' || e, ',' ORDER BY s, kind)"
    return f"""WITH f AS ({" UNION ALL ".join(parts)}),
p AS (SELECT doc_id, kind, kind IN (0, 2, 4) AS secret, e - len AS s, e FROM (SELECT *, sum(gap + len) OVER (PARTITION BY doc_id, kind ORDER BY n)::BIGINT AS e FROM f) WHERE ok),
k AS (SELECT * FROM p a WHERE kind < 3 OR EXISTS (SELECT 1 FROM p b WHERE b.doc_id = a.doc_id AND a.secret <> b.secret AND ({near}))),
g AS (SELECT doc_id, count_if(kind = 0)::BIGINT AS n_assign, count_if(kind = 1)::BIGINT AS n_access, count_if(kind = 2)::BIGINT AS n_hex, {written} FILTER (kind < 3) AS base, {written} AS spans FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN g USING (doc_id)"""


ORACLES: dict[str, str] = {"op7_secrets": _secrets_sql()}
