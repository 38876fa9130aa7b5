"""SQL counterparts (DuckDB) of those operators that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op2_exact_dedup"] = r"""
WITH d AS (
    SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
    FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""

ORACLES["op5_line_dedup"] = r"""
WITH split AS (
    SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents
), lines AS (
    SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM split
), clean AS (
    SELECT doc_id, pos, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS x
    FROM lines
), seq AS (
    SELECT doc_id, pos, x, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) >= 20 AS long,
           row_number() OVER w AS i, lead(x) OVER w AS x1, lead(x, 2) OVER w AS x2,
           lead(len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) >= 20) OVER w AS long1
    FROM clean WHERE x <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), runs AS (
    SELECT doc_id, i, 1 AS n, x AS g FROM seq WHERE long
    UNION ALL SELECT doc_id, i, 2, x || chr(10) || x1 FROM seq WHERE x1 IS NOT NULL AND (long OR long1)
    UNION ALL SELECT doc_id, i, 3, x || chr(10) || x1 || chr(10) || x2 FROM seq WHERE x2 IS NOT NULL
), later AS (
    SELECT doc_id, i, n FROM runs
    QUALIFY row_number() OVER (PARTITION BY n, g ORDER BY doc_id, i) > 1
), gone AS (
    SELECT DISTINCT s.doc_id, s.pos
    FROM (SELECT doc_id, unnest(range(i, i + n)) AS i FROM later) l JOIN seq s ON s.doc_id = l.doc_id AND s.i = l.i
)
SELECT l.doc_id, coalesce(string_agg(line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '') AS text,
       count(g.pos) AS removed
FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos
GROUP BY l.doc_id
"""

ORACLES["op10_source_mixing"] = r"""
WITH sizes AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
    FROM documents
), sources AS (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
    FROM sizes GROUP BY source
), weighed AS (
    SELECT *, [5, 2, 1][(rank % 3 + 1)::INTEGER] AS weight, [-0.5, 0.0, 0.5][(rank % 3 + 1)::INTEGER]::DOUBLE AS ramp,
           3 * source_size AS most, sum(source_size) OVER ()::BIGINT AS total
    FROM sources
), stops AS (
    SELECT *, sum(most) OVER w::BIGINT AS stopped, (sum(weight) OVER () - sum(weight) OVER w)::BIGINT AS left_weight
    FROM weighed WINDOW w AS (ORDER BY most / weight::DOUBLE ROWS UNBOUNDED PRECEDING)
), shares AS (
    SELECT total / (SELECT sum(weight) FROM weighed)::DOUBLE AS share FROM weighed
    UNION ALL
    SELECT (total - stopped) / left_weight::DOUBLE FROM stops WHERE left_weight > 0
), settled AS (
    SELECT max(share) AS share FROM shares
), targets AS (
    SELECT w.*, least(weight * share, most::DOUBLE) AS target FROM weighed w, settled
), ordered AS (
    SELECT s.doc_id, s.size, t.source_size, t.target, t.ramp, round(t.target)::BIGINT AS demand,
           coalesce(sum(s.size) OVER (
               PARTITION BY t.rank ORDER BY md5(s.doc_id::VARCHAR), s.doc_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
    FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), taken AS (
    SELECT *, demand // source_size AS rounds,
           greatest(0, least(size, demand - demand // source_size * source_size - before)) AS extra
    FROM ordered
)
SELECT doc_id, size, source_size, target, (rounds * size + extra)::BIGINT AS taken,
       CASE WHEN size > 0 AND rounds * size + extra > 0 THEN
           round(2 * (before / demand::DOUBLE) / ((1 - ramp) + sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * (before / demand::DOUBLE))), 6)
       END AS first_time
FROM taken
"""

_RULES = [
    ("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 3, 12),
    ("access", r"AKIA[A-Z0-9]+", 2, 18),
    ("hex", r"[0-9a-f]+", 2, 16),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 2, 1),
    ("github", r"gh[opsur]_[A-Za-z0-9]{36,}", 2, 1),
]


def _secret_sql() -> str:
    """Every rule's gaps and matches as lists; positions are running sums of their lengths."""
    parts = []
    for order, (kind, pattern, group, least) in enumerate(_RULES):
        piece = rf"([\s\S]*?)({pattern})"
        parts.append(rf"""
            SELECT doc_id, {order} AS ord, '{kind}' AS kind, e - match AS s, e FROM (
                SELECT doc_id, match, kept, sum(whole) OVER (PARTITION BY doc_id ORDER BY idx) AS e FROM (
                    SELECT doc_id, length(unnest(regexp_extract_all(text, '{piece}', 0))) AS whole,
                           length(unnest(regexp_extract_all(text, '{piece}', 2))) AS match,
                           length(unnest(regexp_extract_all(text, '{piece}', {group}))) AS kept,
                           unnest(range(len(regexp_extract_all(text, '{piece}', 0)))) AS idx
                    FROM d WHERE regexp_matches(text, '{pattern}')
                )
            ) WHERE kept >= {least}""")
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({' UNION ALL '.join(parts)}),
per_doc AS (
    SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
           count(*) FILTER (WHERE kind = 'hex') AS n_hex,
           string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) FILTER (WHERE ord < 3) AS base,
           string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) AS spans
    FROM found GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(d.text) AS blob
FROM d LEFT JOIN per_doc USING (doc_id)
"""


ORACLES["op1_secret_scan"] = _secret_sql()

ORACLES["op12_filter_audit"] = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), told AS (
    SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY doc_id
), words AS (
    SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d
), fails AS (
    SELECT words.doc_id, part, (len(w) < 200)::INTEGER AS a, (100 * len(list_distinct(w)) < 50 * len(w))::INTEGER AS b,
           (100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text))::INTEGER AS c,
           regexp_matches(text, '[#$%&*|]')::INTEGER AS d,
           (words.doc_id > min(words.doc_id) OVER (PARTITION BY text))::INTEGER AS e
    FROM words
), marked AS (
    SELECT part, [a, b, c, d, e] AS f, a + b + c + d + e AS failed,
           coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
    FROM fails LEFT JOIN told USING (doc_id)
), letters AS (SELECT unnest([1, 2, 3, 4, 5]) AS k), orders AS (
    SELECT [v.k, w.k, x.k, y.k, z.k] AS o
    FROM letters v, letters w, letters x, letters y, letters z
    WHERE len(list_distinct([v.k, w.k, x.k, y.k, z.k])) = 5
), steps AS (
    SELECT part, o, step, o[step] AS k, f[o[step]] AS fails, failed, good, toxic,
           list_sum(list_transform(o[1:step - 1], lambda p: f[p])) AS before
    FROM marked, orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), counted AS (
    SELECT part, o, step, k,
           count(*) FILTER (WHERE coalesce(before, 0) = 0 AND fails = 0) AS kept,
           count(*) FILTER (WHERE coalesce(before, 0) = 0 AND fails = 1) AS removed,
           count(*) FILTER (WHERE before > 0 AND fails = 1) AS redundant,
           count(*) FILTER (WHERE fails = 1 AND failed = 1) AS unique_fails,
           count(*) FILTER (WHERE coalesce(before, 0) = 0 AND fails = 1 AND good = 1) AS good_lost,
           count(*) FILTER (WHERE coalesce(before, 0) = 0 AND fails = 1 AND toxic = 1) AS toxic_lost
    FROM steps GROUP BY part, o, step, k
)
SELECT part, array_to_string(list_transform(o, lambda p: 'ABCDE'[p]), '') AS filter_order, step::INTEGER AS step,
       kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, k)::BIGINT AS shapley
FROM counted
"""

ORACLES["op13_lexical_search"] = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
    FROM documents WHERE text IS NOT NULL
), sized AS (SELECT *, len(w)::BIGINT AS n FROM d WHERE len(w) > 0
), totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS occurrences FROM sized
), postings AS (
    SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM sized) GROUP BY ALL
), wanted AS (
    SELECT item_id, term, count(*) AS repeats FROM (
        SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
    ) GROUP BY ALL
), weights AS (
    SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
    FROM postings, totals GROUP BY term, docs
), scored AS (
    SELECT item_id, doc_id,
           sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // occurrences))))::BIGINT AS score
    FROM wanted JOIN postings USING (term) JOIN weights USING (term), totals GROUP BY item_id, doc_id
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""
