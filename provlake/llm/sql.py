"""SQL, for DuckDB, of the queries that SQL can express whole. It goes by definition, not by the operators' methods."""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACE_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

DECONTAMINATION = f"""
WITH bw AS (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, len(x) AS n, array_to_string(x, ' ') AS k FROM (SELECT item_id, w[i:i + 9] AS x FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM bw WHERE len(w) > 0))),
dw AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
dg AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, dg.n, item_id FROM dg JOIN win USING (k)),
pos AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY 1)
SELECT dw.doc_id, coalesce(len(w), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

QUALITY_RULES = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_SPACE_WORDS.format("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
rep AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 5)) AS p FROM r) GROUP BY 1),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
m AS (SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
  length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^!?#*$%&|<>=~^]', '', 'g')) AS n_marks
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN ln USING (doc_id)),
f AS (SELECT *, CAST(n_words < 10 AS INT) + 2 * CAST(100 * n_repeat_words > 20 * n_words AS INT) + 4 * CAST(10 * n_symbols > n_words AS INT) + 8 * CAST(n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines AS INT)
  + 16 * CAST(n_letters >= 40 AND 2 * n_upper > n_letters AS INT) + 32 * CAST(n_marks * 4 > n_words AND n_words >= 10 AS INT) + 64 * CAST(n_words >= 10 AND (word_chars < 2 * n_words OR word_chars > 25 * n_words) AS INT) AS fail_mask FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_mask & 3 <> 0 AS base_failed, fail_mask = 0 AS kept, n_lines, n_letters, n_upper, n_marks, CAST(fail_mask AS BIGINT) AS fail_mask FROM f
"""

SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS k FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d WHERE length(h) >= 100)),
f AS (SELECT k, min(doc_id) AS first FROM s GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, i FROM s JOIN f USING (k) WHERE first < doc_id),
run AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM hit)),
span AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM run GROUP BY doc_id, r),
gap AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS s, a AS e FROM span UNION ALL SELECT doc_id, max(b), 1000000000 FROM span GROUP BY 1),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * s + 1, 2 * (e - s)), '' ORDER BY s) AS h FROM gap JOIN d USING (doc_id) GROUP BY 1),
n AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM span GROUP BY 1)
SELECT d.doc_id, length(d.h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

NEAR_DUP = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPACE_WORDS.format(_LOWER)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, k FROM (SELECT doc_id, array_to_string(w[i:i + 3], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM d WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT DISTINCT a, a AS b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
comp AS (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)
"""

SQL = {
    "op3_benchmark_decontamination": DECONTAMINATION,
    "op4_quality_rules": QUALITY_RULES,
    "op5_suffix_array_dedup": SUFFIX_DEDUP,
    "op7_minhash_near_dedup": NEAR_DUP,
}
