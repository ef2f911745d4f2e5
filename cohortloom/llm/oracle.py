"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_OP3 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, list_filter(regexp_split_to_array(text, '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0b\f\r]')) AS ls, text
  FROM d
), g AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), h AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1
), r AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM h) GROUP BY rid
), m AS (
  SELECT d.rid, d.doc_id, d.source, len(ws)::BIGINT AS n_words,
         length(array_to_string(ws, ''))::BIGINT AS word_chars,
         length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(r.n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d JOIN w USING (rid) LEFT JOIN r USING (rid)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         (10 * n_symbols > word_chars)::INT + (5 * n_repeat_words > n_words)::INT
         + (30 * n_dup_lines > n_words)::INT
         + (word_chars < 2 * n_words OR word_chars > 20 * n_words)::INT AS n_rules
  FROM m
), hosts AS (
  SELECT source, count(*) AS n, sum((base_failed OR n_rules > 0)::INT) AS k FROM f GROUP BY source
), prior AS (
  SELECT sum(k) / sum(n) AS m, var_samp(k / n) AS v FROM hosts
), p AS (
  SELECT m, least(greatest(coalesce(m * (1 - m) / nullif(v, 0) - 1, 2.0), 2.0), 1000.0) AS weight FROM prior
), verdict AS (
  SELECT source, round((k + weight * m) / (n + weight), 9) AS host_rate FROM hosts, p
)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rate,
       NOT base_failed AND n_rules <= CASE WHEN host_rate > 0.5 THEN 0 ELSE 1 END AS kept
FROM f JOIN verdict ON f.source IS NOT DISTINCT FROM verdict.source
"""

_OP10 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ')
         ELSE array_to_string(ws[i:i + 4], ' ') END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)
), r AS (
  SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x
)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) c ON c.x = w.doc_id
"""

_OP2 = r"""
WITH w AS (
  SELECT doc_id, unnest(list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[ \t\n\x0b\f\r]+'), lambda x: x <> '')) AS t
  FROM documents
), tf AS (SELECT doc_id, t, count(*) AS n FROM w GROUP BY doc_id, t
), dl AS (SELECT doc_id, sum(n) AS len FROM tf GROUP BY doc_id
), st AS (SELECT count(*) AS nd, (SELECT sum(len) FROM dl) / count(*) AS avg_len FROM documents
), df AS (SELECT t, count(*) AS df FROM tf GROUP BY t
), s AS (
  SELECT q.doc_id AS query_id, d.doc_id,
         round(sum(q.n * ln(1 + (nd - df + 0.5) / (df + 0.5)) * d.n * 2.2
                   / (d.n + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score
  FROM tf q JOIN tf d USING (t) JOIN df USING (t) JOIN dl ON dl.doc_id = d.doc_id, st
  WHERE q.doc_id % 100 = 0 GROUP BY 1, 2
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 10
"""

_OP13 = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS ws FROM documents
), g AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS place FROM g) WHERE place > 1
), gone AS (
  SELECT DISTINCT doc_id, i + k AS p FROM later, range(20) AS t(k)
), marked AS (
  SELECT x.doc_id, x.p, x.word, gone.p IS NOT NULL AS goes
  FROM (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w) AS x
  LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.p = x.p
)
SELECT w.doc_id, len(any_value(w.ws))::BIGINT AS n_words, count(*) FILTER (WHERE goes)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT goes), '')) AS kept_sha256
FROM w LEFT JOIN marked ON marked.doc_id = w.doc_id GROUP BY w.doc_id
"""

SQL = {"op13_debruijn_dedup": _OP13, "op2_block_max_wand": _OP2, "op10_jaccard_join": _OP10, "op3_host_quality": _OP3}
