"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

EMBEDDING_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
    SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
      AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS u, b.vec_id AS w FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach(u, w) AS (
    SELECT u, w FROM links
    UNION
    SELECT r.u, l.w FROM reach r JOIN links l ON r.w = l.u
)
SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, least(v.vec_id, coalesce(m.low, v.vec_id)) AS component_id,
       v.vec_id <= coalesce(m.low, v.vec_id) AS kept
FROM v
LEFT JOIN (SELECT u, count(*) AS n_links FROM links GROUP BY u) n ON n.u = v.vec_id
LEFT JOIN (SELECT u, min(w) AS low FROM reach GROUP BY u) m ON m.u = v.vec_id
"""

MIXING_SQL = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS key FROM documents
), s AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1 AS place FROM d GROUP BY source
), w AS (
    SELECT *, [5, 2, 1][1 + place % 3] AS weight, sum(source_size) OVER () AS total FROM s
), rounds(n, rest, shared) AS (
    SELECT 0, CAST(max(total) AS DOUBLE), CAST(sum(weight) AS DOUBLE) FROM w
    UNION ALL
    SELECT * FROM (
        SELECT r.n + 1, max(w.total) - sum(CASE WHEN w.source_size * 3 * r.shared <= w.weight * r.rest THEN w.source_size * 3 ELSE 0 END),
               CAST(sum(CASE WHEN w.source_size * 3 * r.shared <= w.weight * r.rest THEN 0 ELSE w.weight END) AS DOUBLE)
        FROM rounds r, w WHERE r.n < 60 AND r.shared > 0 GROUP BY r.n, r.rest, r.shared
    )
), share AS (
    SELECT rest, shared FROM rounds WHERE shared > 0 ORDER BY n DESC LIMIT 1
), t AS (
    SELECT w.*, CASE WHEN source_size * 3 * shared <= weight * rest THEN source_size * 3.0 ELSE weight * rest / shared END::DOUBLE AS target FROM w, share
), c AS (
    SELECT d.*, t.source_size, t.target, t.place, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size / 2 AS middle,
           CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS full_passes
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), r AS (
    SELECT *, full_passes + CASE WHEN middle < target - full_passes * source_size THEN 1 ELSE 0 END AS repeats,
           CASE WHEN target > 0 THEN least(1.0, middle / target) ELSE 0.0 END::DOUBLE AS share
    FROM c
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * repeats AS BIGINT) AS taken,
       CASE WHEN repeats > 0 THEN least(1.0, CASE place % 3 -- where the integral of the source's weight over time reaches the share
           WHEN 0 THEN share
           WHEN 1 THEN share * 2 / (0.5 + sqrt(0.25 + share * 2))
           ELSE share * 2 / (1.5 + sqrt(greatest(0.0, 2.25 - share * 2))) END) END AS position
FROM r
"""


#: Levels of the template tree in SQL; the operator goes as deep as the paths differ, the given tables' have fewer segments.
LEVELS = 5


def _differ(n1: str, b1: str, n2: str, b2: str) -> str:
    mean = f"(({b1} + {b2} + 1) / ({n1} + {n2} + 2))"
    return f"abs(({b1} + 1) / ({n1} + 2) - ({b2} + 1) / ({n2} + 2)) > 1.96 * sqrt({mean} * (1 - {mean}) * (1 / ({n1} + 1) + 1 / ({n2} + 1)))"


def _level(i: int, before: str) -> str:
    """One level of the template tree (see the operator): branches that do not stand apart become wildcards, and of the
    others neighbours in the order of their shares are merged where they do not differ."""
    return f"""
b{i} AS (SELECT tree, template, coalesce(seg[{i}], '') AS s, sum(labelled) AS n, sum(blocked) AS b FROM {before} GROUP BY ALL),
n{i} AS (
    SELECT *, sum(n) OVER (PARTITION BY tree, template) AS n_all, sum(b) OVER (PARTITION BY tree, template) AS b_all FROM b{i}
),
t{i} AS (SELECT *, s <> '' AND n > 0 AND {_differ("n", "b", "(n_all - n)", "(b_all - b)")} AS strong FROM n{i}),
l{i} AS (SELECT *, lag(n) OVER w AS n_last, lag(b) OVER w AS b_last FROM t{i} WHERE strong WINDOW w AS (PARTITION BY tree, template ORDER BY (b + 1) / (n + 2), n, b, s)),
c{i} AS (
    SELECT *, sum(CASE WHEN n_last IS NULL OR {_differ("n", "b", "n_last", "b_last")} THEN 1 ELSE 0 END)
        OVER (PARTITION BY tree, template ORDER BY (b + 1) / (n + 2), n, b, s ROWS UNBOUNDED PRECEDING) AS grp FROM l{i}
),
m{i} AS (
    SELECT tree, template, s, CASE WHEN count(*) OVER g = 1 THEN '/' || s ELSE '//' || min(s) OVER g END AS name FROM c{i} WINDOW g AS (PARTITION BY tree, template, grp)
),
k{i} AS (SELECT b.tree, b.template, b.s, CASE WHEN b.s = '' THEN '' ELSE coalesce(m.name, '/*') END AS step FROM b{i} b LEFT JOIN m{i} m USING (tree, template, s)),
g{i} AS (SELECT g.* REPLACE (g.template || k.step AS template) FROM {before} g JOIN k{i} k ON g.tree = k.tree AND g.template = k.template AND coalesce(g.seg[{i}], '') = k.s)"""


URL_SQL = f"""
WITH u AS (
    SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages
), rules(h, p, said) AS (
    VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), hosts AS (
    SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(said, length(h || p)) AS said
    FROM (SELECT DISTINCT host, path FROM u) JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL
), parsed AS (
    SELECT u.*, rule, said, list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''),
           lambda x: CASE WHEN regexp_matches(x, '^[0-9]+$|^[0-9a-fA-F]{{8,}}$|^.{{32,}}$|^[0-9].*[0-9]$') THEN '*' ELSE x END) AS seg
    FROM u LEFT JOIN hosts USING (host, path)
), paths AS (
    SELECT host, seg, count(said) AS labelled, count(*) FILTER (said = 'block') AS blocked FROM parsed GROUP BY ALL
), g0 AS (
    SELECT 'host:' || host AS tree, '' AS template, seg, CAST(labelled AS DOUBLE) AS labelled, CAST(blocked AS DOUBLE) AS blocked FROM paths
    UNION ALL
    SELECT '*', '', seg, sum(labelled)::DOUBLE, sum(blocked)::DOUBLE FROM paths GROUP BY ALL
),{",".join(_level(i, f"g{i - 1}") for i in range(1, LEVELS + 1))},
leaf AS (SELECT tree, seg, sum(labelled) OVER (PARTITION BY tree, template) AS n, sum(blocked) OVER (PARTITION BY tree, template) AS b FROM g{LEVELS}),
prior AS (SELECT coalesce((sum(blocked) + 1) / (sum(labelled) + 2), 0.5) AS prior FROM paths),
wide AS (SELECT seg, (b + 4.0 * prior) / (n + 4.0) AS p_wide FROM leaf, prior WHERE tree = '*'),
own AS (SELECT substr(tree, 6) AS host, seg, (b + 4.0 * p_wide) / (n + 4.0) AS p FROM leaf JOIN wide USING (seg) WHERE tree <> '*')
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN p > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM parsed JOIN own USING (host, seg)
"""

SUFFIX_SQL = """
WITH d AS (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), starts AS (
    SELECT doc_id, p, substr(h, CAST(2 * p + 1 AS BIGINT), 200) AS s FROM (SELECT doc_id, h, unnest(range(CAST(length(h) // 2 - 99 AS BIGINT))) AS p FROM d WHERE length(h) >= 200)
), again AS (
    SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS n FROM starts) WHERE n > 1
), runs AS (
    SELECT doc_id, min(p) AS a, max(p) + 100 AS z FROM (
        SELECT *, sum(CASE WHEN p <= before + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS run
        FROM (SELECT *, coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), -1000) AS before FROM again)
    ) GROUP BY doc_id, run
), pieces AS (
    SELECT doc_id, z AS a, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY a), 1000000000) AS z FROM runs
    UNION ALL
    SELECT doc_id, 0, min(a) FROM runs GROUP BY doc_id
), cleaned AS (
    SELECT doc_id, string_agg(substr(h, CAST(2 * a + 1 AS BIGINT), CAST(2 * (z - a) AS BIGINT)), '' ORDER BY a) AS k FROM pieces JOIN d USING (doc_id) GROUP BY doc_id
), n AS (
    SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id
)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN cleaned USING (doc_id) LEFT JOIN n USING (doc_id)
"""

SEARCH_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS row, doc_id,
           regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents WHERE text IS NOT NULL
), q AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
), total AS (
    SELECT count(*) AS n, CAST(sum(len(terms)) AS BIGINT) AS l FROM d WHERE len(terms) > 0
), p AS (
    SELECT row, doc_id, len, term, count(*) AS tf FROM (SELECT row, doc_id, len(terms) AS len, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL
), w AS (
    SELECT term, CAST(floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, total GROUP BY term, n
), s AS (
    SELECT item_id, row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len * n) // l)))) AS BIGINT) AS score
    FROM q JOIN p USING (term) JOIN w USING (term), total GROUP BY item_id, row, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 50
"""

FILL_SQL = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || doc_id) AS h FROM documents
), u AS (
    SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units,
           [CAST('0x' || substr(h, i, 8) AS BIGINT) FOR i IN [1, 9, 17, 25]] AS h FROM d
), c AS (
    SELECT *, len(units) AS n, least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS a, greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS b,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 100 THEN 'plain'
                WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u
), t AS (
    SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM t
"""
