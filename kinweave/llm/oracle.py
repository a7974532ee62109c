"""DuckDB SQL for the numbered queries that SQL can express."""

from __future__ import annotations

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

EXACT = r"""
    WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
    SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = min(doc_id) OVER w AS kept, text_sha256
    FROM d WINDOW w AS (PARTITION BY text_sha256)"""

SUBSTRING = f"""
    WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
    places AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35),
    win AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 34], ' ')) AS k FROM places),
    rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY k) AS c FROM win) WHERE c > 1),
    gone AS (SELECT DISTINCT doc_id, i + j AS p FROM rep CROSS JOIN range(35) t(j)),
    words AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM d),
    kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS s, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
    SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
    FROM d LEFT JOIN kept USING (doc_id)"""

JACCARD = rf"""
    WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
    g AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM d WHERE len(ws) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 80 * (x.n + y.n - n_both)),
    r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
    SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
    FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY 1) USING (doc_id)"""

SUFFIX = """
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    seg AS (SELECT doc_id, s, substr(h, 2 * s + 1, 498) AS x FROM (SELECT doc_id, h, unnest(range(0, (length(h) // 2)::BIGINT, 200)) AS s FROM d)),
    win AS (SELECT doc_id, s + i AS i, md5(substr(x, 2 * i + 1, 100)) AS k FROM (SELECT doc_id, s, x, unnest(range(0, least(200, length(x) // 2 - 49)::BIGINT)) AS i FROM seg WHERE length(x) >= 100)),
    hit AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY k) AS least_id FROM win) WHERE least_id < doc_id),
    gone AS (SELECT DISTINCT doc_id, i + j AS p FROM hit CROSS JOIN range(50) t(j)),
    runs AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (before IS NULL OR before < p - 1) AS n_spans FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM gone) GROUP BY 1),
    bytes AS (SELECT doc_id, s + i AS p, substr(x, 2 * i + 1, 2) AS b FROM (SELECT doc_id, s, x, unnest(range(0, least(200, length(x) // 2)::BIGINT)) AS i FROM seg SEMI JOIN runs USING (doc_id))),
    kept AS (SELECT doc_id, string_agg(b, '' ORDER BY p) AS s FROM bytes ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
    SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
           sha256(unhex(CASE WHEN n_removed IS NULL THEN h ELSE coalesce(s, '') END)) AS kept_sha256
    FROM d LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)"""

QUALITY = rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
    w3 AS (SELECT doc_id, i, w || ' ' || lead(w) OVER x || ' ' || lead(w, 2) OVER x AS k FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d) WINDOW x AS (PARTITION BY doc_id ORDER BY i)),
    tri AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM w3 WHERE k IS NOT NULL),
    rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM tri CROSS JOIN range(3) r(j) WHERE c > 1 GROUP BY 1),
    lns AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT s) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS s FROM d) WHERE regexp_matches(s, '[^\x20\x09-\x0D]') GROUP BY 1),
    m AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(lns.dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
        coalesce(lns.n, 0) AS n_lines, len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS letter_words
        FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN lns USING (doc_id)),
    b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT (base_failed OR 4 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 2 * letter_words < n_words OR (n_lines >= 4 AND 2 * n_dup_lines > n_lines)) AS kept
    FROM b"""

MIXING = r"""
    WITH d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
        strlen(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS n, strlen(regexp_replace(coalesce(text, ''), '[\x00-\x40\x5B-\x60\x7B-\x7F]', '', 'g')) AS m FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS z, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM d GROUP BY source),
    r AS (SELECT *, sum(z) OVER () AS t, coalesce(sum(3 * z) OVER o, 0) AS zs, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS ws FROM s
        WINDOW o AS (ORDER BY z / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    c AS (SELECT *, w * (t - zs) / ws > 3 * z AS stops FROM r),
    g AS (SELECT source, z, CASE WHEN stops THEN (3 * z)::DOUBLE ELSE (w * (t - coalesce(sum(3 * z) FILTER (stops) OVER (), 0)))::DOUBLE / (sum(w) FILTER (NOT stops) OVER ())::DOUBLE END AS target FROM c),
    k AS (SELECT *, -ln((('0x' || substr(md5('20#' || doc_id), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / CASE WHEN n > 0 THEN (n + 9 * m)::DOUBLE / (10 * n)::DOUBLE ELSE 0.1::DOUBLE END AS e FROM d),
    p AS (SELECT doc_id, size, z, target, floor(target + 0.5)::BIGINT AS words, coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY e, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
        FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source)
    SELECT doc_id, size, z AS source_size, target, CASE WHEN z = 0 THEN 0 ELSE words // z * size + greatest(0, least(size, words % z - before)) END::BIGINT AS taken FROM p"""

ORACLE_SQL = {"op13_source_mixing": MIXING, "op1_exact_dedup": EXACT, "op2_substring_dedup": SUBSTRING, "op5_ngram_jaccard_join": JACCARD, "op7_suffix_array_dedup": SUFFIX, "op10_quality_rules": QUALITY}
