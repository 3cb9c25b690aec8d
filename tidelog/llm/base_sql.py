"""DuckDB SQL of what SQL can say of three operators: base spans of personal data and secrets, and payloads of media.

The SQL is held against queries that return these columns alone (``queries.py``); the patterns are the plain ones.
"""

# The base patterns.
_PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR TRY_CAST('0' || ltrim(p, '0') AS BIGINT) > 255)) = 0"),
    (
        "card",
        r"[0-9](?:[\x20-]?[0-9])+",
        """length(x) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length(x) + 1), lambda i: CASE WHEN (length(x) - i) % 2 = 0 THEN CAST(substr(x, i, 1) AS INT)
        WHEN CAST(substr(x, i, 1) AS INT) > 4 THEN 2 * CAST(substr(x, i, 1) AS INT) - 9 ELSE 2 * CAST(substr(x, i, 1) AS INT) END)) % 10 = 0""",
    ),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(x) BETWEEN 8 AND 15"),
)
_SECRETS = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", "length(g) >= 6"),
    ("access", r"AKIA[A-Z0-9]+", "length(m) >= 20"),
    ("hex", r"[0-9a-f]+", "length(m) >= 24"),
)


def _spans(kinds: tuple, order: str) -> str:
    """Counts and digest of all matches: pieces between matches and the matches before give a match its place."""
    parts = []
    for k, (kind, pattern, valid) in enumerate(kinds):
        group = f"regexp_extract_all(t, '{pattern}', 1)" if kind == "assign" else f"regexp_extract_all(t, '{pattern}')"
        parts.append(f"""
  SELECT r, {k} AS k, '{kind}' AS kind, e - length(m) AS s, e FROM (
    SELECT r, m, g, regexp_replace(m, '[^0-9]', '', 'g') AS x, sum(length(p) + length(m)) OVER (PARTITION BY r ORDER BY i) AS e FROM (
      SELECT r, unnest(ms) AS m, unnest(gs) AS g, unnest(list_slice(ps, 1, len(ms))) AS p, unnest(range(1, len(ms) + 1)) AS i FROM (
        SELECT r, regexp_extract_all(t, '{pattern}') AS ms, {group} AS gs, string_split_regex(t, '{pattern}') AS ps FROM d) WHERE len(ms) > 0))
  WHERE {valid}""")
    counts = ", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind, *_ in kinds)
    names = ", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind, *_ in kinds)
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(parts)}),
c AS (SELECT r, {counts}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY {order}) AS spans FROM found GROUP BY r)
SELECT doc_id, {names}, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN c USING (r)"""


PII_BASE = _spans(_PII, "k, s")
SECRETS_BASE = _spans(_SECRETS, "s, k")
MEDIA_PAYLOADS = """WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
p AS (SELECT doc_id, b, octet_length(b) AS n, CASE WHEN octet_length(b) = 0 THEN 64 ELSE (octet_length(b) + 63) // 64 * 64 END AS whole FROM d)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(whole AS BIGINT) AS payload_bytes, sha256(b || repeat('\\x00'::BLOB, whole - n)) AS payload_sha256 FROM p"""
