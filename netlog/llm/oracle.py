"""SQL that gives the queries' results from the tables directly, for those that SQL can express."""

SQL = {
    "op4_systematic_mix": """
        WITH RECURSIVE d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
                   md5(coalesce(doc_id::VARCHAR, 'null')) AS key
            FROM documents
        ), s AS (
            SELECT source, sum(size)::BIGINT AS source_size,
                   [1, 2, 3][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
            FROM d GROUP BY source
        ), fill AS (  -- round by round: sources above their cap get it, the rest share what is left
            SELECT 0 AS round, source, source_size, w, false AS capped FROM s
            UNION ALL
            SELECT round + 1, source, source_size, w, capped OR 3 * source_size * open_w < w * rest
            FROM (
                SELECT *, sum(CASE WHEN capped THEN 0 ELSE w END) OVER () AS open_w,
                       sum(source_size) OVER () - sum(CASE WHEN capped THEN 3 * source_size ELSE 0 END) OVER () AS rest
                FROM fill
            ) WHERE round < (SELECT count(*) FROM s)
        ), last AS (
            SELECT *, sum(CASE WHEN capped THEN 0 ELSE w END) OVER () AS open_w,
                   sum(source_size) OVER () - sum(CASE WHEN capped THEN 3 * source_size ELSE 0 END) OVER () AS rest
            FROM fill WHERE round = (SELECT max(round) FROM fill)
        ), t AS (
            SELECT source, source_size,
                   CASE WHEN capped THEN (3 * source_size)::DOUBLE ELSE (w * rest)::DOUBLE / open_w::DOUBLE END AS target,
                   ('0x' || substr(md5('0/' || coalesce(source, chr(0) || 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
            FROM last
        ), k AS (
            SELECT d.doc_id, d.size, t.source_size, t.target, t.u,
                   CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS r,
                   row_number() OVER (
                       PARTITION BY d.source
                       ORDER BY length(bin(size)) * 64 + (size >> greatest(length(bin(size)) - 6, 0)), key, doc_id
                   )::DOUBLE AS k
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
        )
        SELECT doc_id, size::BIGINT AS size, source_size, target,
               (least(floor(r * k + u) - floor(r * (k - 1) + u), 3) * size)::BIGINT AS taken
        FROM k
    """,
    "op6_line_runs": """
        WITH l AS (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                   generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
            FROM documents WHERE text IS NOT NULL
        ), n AS (
            SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS following,
                   len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) >= 50 AS long
            FROM l
        ), r AS (  -- turn of the line, and of the pair that begins with it
            SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) > 1 AND long AS one,
                   following IS NOT NULL AND row_number() OVER (PARTITION BY line, following ORDER BY doc_id, pos) > 1 AS two
            FROM n
        ), g AS (
            SELECT *, one OR two OR coalesce(lag(two) OVER (PARTITION BY doc_id ORDER BY pos), false) AS gone FROM r
        ), s AS (
            SELECT *, pos - row_number() OVER (PARTITION BY doc_id, gone ORDER BY pos) AS run FROM g
        ), spans AS (
            SELECT doc_id, string_agg(a || '-' || b, ',' ORDER BY a) AS runs
            FROM (SELECT doc_id, min(pos) AS a, max(pos) AS b FROM s WHERE gone GROUP BY doc_id, run) GROUP BY doc_id
        ), k AS (
            SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_deleted,
                   coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept
            FROM s GROUP BY doc_id
        )
        SELECT d.doc_id, CASE WHEN text IS NULL THEN NULL ELSE n_lines END AS n_lines,
               coalesce(n_deleted, 0)::BIGINT AS n_deleted, coalesce(runs, '') AS runs, sha256(kept) AS kept_sha256
        FROM documents d LEFT JOIN k USING (doc_id) LEFT JOIN spans USING (doc_id)
    """,
    "op11_exact_refinement": """
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS n, translate(coalesce(text, ''), ' ' || chr(9) || chr(10) ||
                   chr(11) || chr(12) || chr(13), '') AS bare
            FROM documents
        ), r AS (
            SELECT *, row_number() OVER w AS turn, first_value(doc_id) OVER w AS keep_id FROM d
            WINDOW w AS (PARTITION BY bare ORDER BY n DESC, doc_id NULLS LAST)
        )
        SELECT doc_id, keep_id, count(*) OVER (PARTITION BY bare) AS group_size, turn = 1 AS kept,
               sha256(bare) AS text_sha256
        FROM r
    """,
    "op12_prefix_free_parsing": """
        WITH p AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents
        ), w AS (
            SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p
        ), g AS (
            SELECT lang, unnest(words) AS phrase, 1 AS k FROM w
            UNION ALL
            SELECT lang, unnest([words[i] || ' ' || words[i + 1] FOR i IN range(1, len(words))]), 2 FROM w
            UNION ALL
            SELECT lang, unnest([words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] FOR i IN range(1, len(words) - 1)]), 3
            FROM w
        ), f AS (
            SELECT lang, phrase, k, count(*) AS f FROM g GROUP BY ALL
        ), n AS (
            SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
        ), c AS (
            SELECT lang, phrase, k, f AS a, split_part(phrase, ' ', 1) AS w1, split_part(phrase, ' ', 2) AS w2,
                   split_part(phrase, ' ', 3) AS w3
            FROM f WHERE k > 1 AND f >= 10
        ), cuts AS (
            SELECT *, 1 AS cut, w1 AS head, CASE WHEN k = 2 THEN w2 ELSE w2 || ' ' || w3 END AS rest FROM c
            UNION ALL
            SELECT *, 2, w1 || ' ' || w2, w3 FROM c WHERE k = 3
        ), s AS (
            SELECT c.lang, c.phrase, c.k, c.a, c.cut, l.f AS l, r.f AS r,
                   (1000000::HUGEINT * c.a * c.a // (l.f::HUGEINT * r.f))::BIGINT AS score
            FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.head JOIN f r ON r.lang = c.lang AND r.phrase = c.rest
        ), b AS (
            SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
        ), t AS (
            SELECT lang, part, max(a) AS longer
            FROM (SELECT lang, unnest([w1 || ' ' || w2, w2 || ' ' || w3]) AS part, a FROM c WHERE k = 3) GROUP BY ALL
        )
        SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank,
               phrase, a, l, r, n, score
        FROM b JOIN n USING (lang) LEFT JOIN t ON b.k = 2 AND t.lang = b.lang AND t.part = b.phrase
        WHERE longer IS NULL OR 100 * longer < 50 * a
        QUALIFY rank <= 2000
    """,
}
