"""DuckDB SQL of the queries that SQL can express on whole tables."""

WORD = r"[^\x20\x09-\x0D]+"

OP10 = rf"""
WITH w AS (
  SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents
), m AS (
  SELECT doc_id, ws, len(ws) AS n_words,
         coalesce(list_sum([length(x) for x in ws]), 0)::BIGINT AS word_chars,
         length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls
  FROM w
), win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, n_words - 6)) AS i FROM m WHERE n_words >= 8)
), hit AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM win) WHERE c > 1
), rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM hit, range(0, 8) t(k) GROUP BY doc_id
), led AS (
  SELECT m.doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(ls)::BIGINT AS n_lines, len(list_distinct(ws))::BIGINT AS n_distinct_words,
         coalesce(list_max([length(x) for x in ws]), 0)::BIGINT AS longest_word,
         len(regexp_extract_all(array_to_string(ws, ' '), '[A-Za-z]|[^\x00-\xBF]'))::BIGINT AS n_letters
  FROM m LEFT JOIN rep USING (doc_id)
), bits AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END | CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    | CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END | CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 8 ELSE 0 END
    | CASE WHEN 2 * n_dup_lines > n_lines THEN 16 ELSE 0 END | CASE WHEN 2 * n_letters < word_chars THEN 32 ELSE 0 END
    | CASE WHEN longest_word > 200 THEN 64 ELSE 0 END | CASE WHEN 50 * n_distinct_words < n_words THEN 128 ELSE 0 END)::BIGINT AS failure_bits
  FROM led
)
SELECT *, (failure_bits & 3) <> 0 AS base_failed, (failure_bits & 255) = 0 AS kept FROM bits
"""

OP1 = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents
), win AS (
  SELECT doc_id, i, hash(array_to_string(ws[i:i + 34], ' ')) AS h, md5(array_to_string(ws[i:i + 34], ' ')) AS m
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)
), hit AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h, m) AS c FROM win) WHERE c > 1
), cut AS (
  SELECT doc_id, list_distinct(flatten(list(range(i, i + 35)))) AS gone FROM hit GROUP BY doc_id
), kept AS (
  SELECT d.doc_id, len(ws) AS n_words, coalesce(len(gone), 0) AS n_removed,
         CASE WHEN gone IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(gone, i)) END AS ks
  FROM d LEFT JOIN cut USING (doc_id)
)
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(array_to_string(ks, ' ')) AS kept_sha256 FROM kept
"""

OP8 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)]) END) AS sh FROM d
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))
), reach AS (
  SELECT a AS doc_id, a AS r FROM links UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.r = links.a
), c AS (
  SELECT doc_id, min(r) AS m FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c.m, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

ORACLES: dict[str, str] = {"op1_substring_dedup": OP1, "op8_jaccard_join": OP8, "op10_quality_rules": OP10}
