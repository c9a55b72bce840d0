"""DuckDB SQL with the same rows as the queries that SQL can express."""

DECONTAMINATION = r"""
WITH doc AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x{0}-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x{0}-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item_window AS (
    SELECT DISTINCT item_id, least(13, len(w)) AS n,
        array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS win
    FROM item, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS u(i) WHERE len(w) > 0
), size AS (SELECT DISTINCT n FROM item_window),
hit AS (
    SELECT d.doc_id, d.i, d.n, x.item_id FROM (
        SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
        FROM doc, size, unnest(range(1, len(w) - n + 2)) AS u(i)
    ) AS d JOIN item_window AS x USING (n, win)
), hit_word AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1
), hit_item AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY 1
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit_word USING (doc_id) LEFT JOIN hit_item USING (doc_id)
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE doc AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingle AS (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS s
    FROM doc, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i) WHERE len(w) > 0
), size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY 1),
common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
    FROM shingle AS a JOIN shingle AS b USING (s) WHERE a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (
    SELECT a, b FROM common AS c JOIN size AS x ON x.doc_id = a JOIN size AS y ON y.doc_id = b
    WHERE 100 * c.n >= 85 * (x.n + y.n - c.n)
), step AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (
    SELECT doc_id, doc_id AS other FROM doc
    UNION
    SELECT r.doc_id, s.b FROM reach AS r JOIN step AS s ON s.a = r.other
), component AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM doc JOIN component USING (doc_id) LEFT JOIN size USING (doc_id)
"""

SUBSTRINGS = r"""
WITH doc AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
    SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS win FROM doc, unnest(range(1, len(w) - 18)) AS u(i)
), later AS (
    SELECT doc_id, i FROM (
        SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS n FROM win
    ) WHERE n > 1
), removed AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (
    SELECT doc_id, unnest(range(i, i + 20)) AS p FROM later
) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
    sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE
        list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(gone, x[2])),
            lambda x: x[1]) END, ' ')) AS kept_sha256
FROM doc LEFT JOIN removed USING (doc_id)
"""

LINES = r"""
WITH doc AS (
    SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN [] ELSE string_split(text, chr(10)) END AS w FROM documents
), line AS (
    SELECT doc_id, i, w[i] AS s FROM doc, unnest(range(1, len(w) + 1)) AS u(i) WHERE regexp_matches(w[i], '[^\x20\x09-\x0D]')
), ranked AS (
    SELECT *, row_number() OVER (ORDER BY doc_id, i) AS place FROM line
), kind AS (SELECT s, min(place) AS place FROM ranked GROUP BY 1),
without AS (
    SELECT s, place, k, substr(s, 1, k - 1) || substr(s, k + 1) AS v FROM kind, unnest(range(1, length(s) + 1)) AS u(k)
    WHERE length(s) >= 16
), near AS (
    SELECT a.s FROM without AS a JOIN without AS b USING (v, k) WHERE b.place < a.place
    UNION SELECT a.s FROM without AS a JOIN kind AS u ON u.s = a.v WHERE u.place < a.place AND length(u.s) >= 16
    UNION SELECT u.s FROM without AS a JOIN kind AS u ON u.s = a.v WHERE a.place < u.place AND length(u.s) >= 16
), removed AS (
    SELECT doc_id, list(i) AS gone FROM ranked JOIN kind USING (s)
    WHERE ranked.place > kind.place OR s IN (SELECT s FROM near) GROUP BY 1
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
    sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE
        list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(gone, x[2])),
            lambda x: x[1]) END, chr(10))) AS kept_sha256
FROM doc LEFT JOIN removed USING (doc_id)
"""

COLLOCATIONS = r"""
WITH piece AS (
    SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (
        SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)
), total AS (SELECT lang, sum(len(w)) AS n FROM piece GROUP BY 1),
gram AS (
    SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase, count(*) AS f
    FROM piece, range(1, 6) AS t(m), unnest(range(1, len(w) - m + 2)) AS u(i) GROUP BY ALL HAVING count(*) >= 100
), cuts AS (
    SELECT lang, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS head,
        array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS rest
    FROM gram, unnest(range(1, m)) AS u(k) WHERE m > 1
), scored AS (
    SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, n, 1000::HUGEINT * a * n // (x.f::HUGEINT * y.f) AS score
    FROM cuts AS c JOIN gram AS x ON x.lang = c.lang AND x.phrase = head
    JOIN gram AS y ON y.lang = c.lang AND y.phrase = rest JOIN total AS t ON t.lang = c.lang
), lowest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), held AS (
    SELECT DISTINCT c.lang, c.phrase FROM gram AS c JOIN gram AS d ON c.lang = d.lang AND c.f = d.f AND c.m < d.m
    WHERE contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' ')
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r,
    CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM lowest ANTI JOIN held USING (lang, phrase) QUALIFY rank <= 2000
"""

RANKED = r"""
WITH doc AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x{0}-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), total AS (SELECT count(*) AS n_docs, sum(len(w)) AS n_terms FROM doc WHERE len(w) > 0),
posting AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM doc) GROUP BY ALL),
query AS (
    SELECT item_id, t, count(*) AS repeats FROM (
        SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x{0}-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark
    ) GROUP BY ALL
), weight AS (
    SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w
    FROM (SELECT t, count(*) AS df FROM posting GROUP BY 1), total
), scored AS (
    SELECT item_id, doc_id, CAST(sum(repeats * w * ((1000000000 * tf) //
        (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
    FROM query JOIN posting USING (t) JOIN weight USING (t), total GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""
