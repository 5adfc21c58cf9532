"""SQL of the operators that need more than a few lines of it; parameters are stated here on their own, not taken from the operators."""

from __future__ import annotations

#: Fixed values of the secret patterns, for an engine without look-around; letters in either case are written out.
_NAMES = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = rf"""({_NAMES})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def clusters(k: int = 40, rounds: int = 5) -> str:
    """Rounds written out one after the other; a floored mean is a division of whole numbers with a non-negative remainder."""
    assign = "SELECT v.vec_id, v.r, arg_min(c.n, (list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, c.n)) AS n FROM v, c{i} c GROUP BY ALL"
    steps = []
    for i in range(rounds):
        steps.append(f"a{i} AS MATERIALIZED ({assign.format(i=i)})")
        steps.append(
            f"s{i} AS (SELECT n, j, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS m FROM (SELECT a.n, unnest(v.q) AS x, unnest(range(64)) AS j FROM a{i} a JOIN v ON v.r = a.r) GROUP BY n, j)"
        )
        steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c.n, coalesce(m.q, c.q) AS q FROM c{i} c LEFT JOIN (SELECT n, list(m::BIGINT ORDER BY j) AS q FROM s{i} GROUP BY n) m ON m.n = c.n)")
    return f"""
        WITH v AS MATERIALIZED (
          SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
          WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        c0 AS MATERIALIZED (
          SELECT row_number() OVER (ORDER BY h, q) - 1 AS n, q FROM (SELECT sha256('2:' || coalesce(vec_id::VARCHAR, '')) AS h, q FROM v ORDER BY h, q LIMIT {k})),
        {", ".join(steps)},
        e AS MATERIALIZED (SELECT a.vec_id, a.n, list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d, c.q
          FROM ({assign.format(i=rounds)}) a JOIN v ON v.r = a.r JOIN c{rounds} c ON c.n = a.n)
        SELECT vec_id, n::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY n))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
          sha256(array_to_string(q, ',')) AS centroid_sha256 FROM e
    """


def secrets() -> str:
    """Entropy counted anew for every window, instead of by what enters and leaves."""
    kinds = [("assign", _ASSIGN, 2, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16)]
    classes = [("entropy16", "[0-9A-Fa-f]+", "lower(w)", 32, 3.2), ("entropy64", "[A-Za-z0-9+/_=-]+", "w", 24, 4.0)]

    def listed(name: str, pattern: str, group: int, least: int, at: int) -> str:
        return f"""SELECT r, '{name}' AS kind, {at} AS ord, found, start, start + length(found) AS stop FROM (
            SELECT r, found, counted, sum(length(before) + length(found)) OVER (PARTITION BY r ORDER BY i) - length(found) AS start FROM (
              SELECT r, unnest(w) AS found, unnest(g) AS counted, unnest(b[1:len(w)]) AS before, unnest(range(len(w))) AS i FROM (
                SELECT r, regexp_extract_all(t, '{pattern}', 0) AS w, regexp_extract_all(t, '{pattern}', {group}) AS g, regexp_split_to_array(t, '{pattern}') AS b FROM d)))
          WHERE length(counted) >= {least}"""

    def hot(name: str, pattern: str, counted: str, window: int, bits: float, at: int) -> str:
        return f"""SELECT r, '{name}' AS kind, {at} AS ord, start + min(i) AS start, start + max(i) + {window} AS stop FROM (
            SELECT *, count(*) FILTER (new) OVER (PARTITION BY r, start ORDER BY i) AS island FROM (
              SELECT *, i > lag(i, 1, -1000000) OVER (PARTITION BY r, start ORDER BY i) + {window} AS new FROM (
                SELECT r, start, i FROM (
                  SELECT r, start, i, ch, count(*) AS c FROM (SELECT r, start, i, unnest(string_split(substr({counted}, i + 1, {window}), '')) AS ch FROM (
                    SELECT r, start, found AS w, unnest(range(length(found) - {window} + 1)) AS i FROM ({listed(name, pattern, 0, window, at)}) x WHERE NOT ({allowed})))
                  GROUP BY ALL)
                GROUP BY ALL HAVING sum(round(c * log2(c) * 1048576)) <= floor({window} * (log2({window}) - {bits}) * 1048576))))
          GROUP BY r, start, island"""

    allowed = r"""(NOT regexp_matches(found, '[0-9]') AND NOT regexp_matches(found, '[A-Z][A-Z]')) OR regexp_full_match(found, '[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}')
            OR regexp_matches(found, '^sha(1|256|384|512)[-_]') OR regexp_matches(lower(found), 'example|placeholder|changeme|dummy|sample') OR regexp_matches(found, '0123456789|abcdefghijkl|ABCDEFGHIJKL')"""
    base = " UNION ALL ".join(listed(*k, at=i) for i, k in enumerate(kinds))
    one, two = (hot(*c, at=3 + i) for i, c in enumerate(classes))
    return f"""
        WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
        b AS MATERIALIZED ({base}),
        h1 AS MATERIALIZED (SELECT * FROM ({one}) h WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.r = h.r AND b.start <= h.start AND h.stop <= b.stop)),
        h2 AS MATERIALIZED (SELECT * FROM ({two}) h WHERE NOT EXISTS (SELECT 1 FROM (SELECT r, start, stop FROM b UNION ALL SELECT r, start, stop FROM h1) b WHERE b.r = h.r AND b.start <= h.start AND h.stop <= b.stop)),
        s AS (SELECT r, kind, ord, start, stop FROM b UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2),
        g AS (SELECT r, count(*) FILTER (ord = 0) AS a, count(*) FILTER (ord = 1) AS c, count(*) FILTER (ord = 2) AS x, count(*) FILTER (ord = 3) AS e1, count(*) FILTER (ord = 4) AS e2,
            string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) FILTER (ord < 3) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) AS everything FROM s GROUP BY r)
        SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(x, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(everything, '') AS spans,
          coalesce(e1, 0) AS n_entropy16, coalesce(e2, 0) AS n_entropy64 FROM d LEFT JOIN g ON g.r = d.r
    """


def fill_in_middle() -> str:
    return r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
        k AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
            ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
        c AS (SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS i, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS j,
            CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM k),
        p AS (SELECT *, coalesce(array_to_string(w[1:i], ''), '') AS a, coalesce(array_to_string(w[i + 1:j], ''), '') AS m, coalesce(array_to_string(w[j + 1:], ''), '') AS z FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
          sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || m ELSE '<S>' || z || '<P>' || a || '<M>' || m END) AS output_sha256,
          sha256(t) AS restored_sha256 FROM p
    """
