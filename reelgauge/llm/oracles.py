"""DuckDB SQL of the operators that SQL can express: the Jaccard join, the quality rules, the embedding groups and the collocations.

Each is the plain definition over whole tables: all pairs that share a shingle, all windows, all pairs of a label. Rows are told
apart by a number of their own; components are a recursive table of what each row reaches.
"""

from __future__ import annotations

from .quality_rules import STOP_WORDS

_WORD = r"[^\x20\x09-\x0D]+"

JACCARD_JOIN = rf"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS words FROM documents),
starts AS (SELECT rid, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS i FROM docs WHERE len(words) > 0),
shingles AS (SELECT DISTINCT rid, array_to_string(words[i:i + 3], ' ') AS shingle FROM starts),
sizes AS (SELECT rid, count(*) AS n FROM shingles GROUP BY rid),
named AS (SELECT s.rid, doc_id, shingle, n FROM shingles AS s JOIN sizes USING (rid) JOIN docs USING (rid) WHERE doc_id IS NOT NULL),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.rid, b.rid AS other, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS n_both
  FROM named AS a JOIN named AS b ON a.shingle = b.shingle AND a.rid <> b.rid AND a.n * 85 <= b.n * 100 AND b.n * 85 <= a.n * 100 GROUP BY ALL),
links AS (SELECT DISTINCT a, b FROM shared WHERE 100 * n_both >= 85 * (na + nb - n_both) AND a <> b),
reach AS (SELECT DISTINCT a AS node, a AS found FROM links UNION SELECT r.node, l.b FROM reach AS r JOIN links AS l ON l.a = r.found),
least AS (SELECT node, min(found) AS component FROM reach GROUP BY node)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component, doc_id) AS component_id
FROM docs LEFT JOIN sizes USING (rid) LEFT JOIN least ON node = doc_id
"""

QUALITY_RULES = rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents),
windows AS (SELECT rid, i, array_to_string(words[i:i + 7], ' ') AS w FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM docs WHERE len(words) >= 8) AS x),
twice AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, w) > 1),
gained AS (SELECT rid, least(8, coalesce(i - lag(i) OVER (PARTITION BY rid ORDER BY i), 8)) AS g FROM twice),
repeated AS (SELECT rid, CAST(sum(g) AS BIGINT) AS n FROM gained GROUP BY rid),
counted AS (
  SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda line: regexp_matches(line, '{_WORD}')) AS lines,
    coalesce(n, 0) AS n_repeat_words, len(list_filter(words, lambda w: w IN ({", ".join(f"'{w}'" for w in STOP_WORDS)}))) AS n_stop_words
  FROM docs LEFT JOIN repeated USING (rid)),
measured AS (
  SELECT doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_repeat_words,
    n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    CAST(word_chars AS DOUBLE) / nullif(n_words, 0) AS mean_word_chars, CAST(n_symbols AS DOUBLE) / nullif(n_words, 0) AS symbols_per_word,
    CAST(len(lines) - len(list_distinct(lines)) AS DOUBLE) / nullif(len(lines), 0) AS dup_line_share,
    CAST(n_stop_words AS DOUBLE) / nullif(n_words, 0) AS stop_word_share, CAST(n_repeat_words AS DOUBLE) / nullif(n_words, 0) AS repeat_word_share
  FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(mean_word_chars BETWEEN CAST(1.5 AS DOUBLE) AND CAST(15 AS DOUBLE), true)
    AND coalesce(symbols_per_word <= CAST(0.25 AS DOUBLE), true) AND coalesce(dup_line_share <= CAST(0.5 AS DOUBLE), true)
    AND coalesce(stop_word_share >= CAST(0.02 AS DOUBLE), true) AND coalesce(repeat_word_share <= CAST(0.3 AS DOUBLE), true) AS kept,
  mean_word_chars, symbols_per_word, dup_line_share, stop_word_share, repeat_word_share FROM measured
"""

EMBEDDING_DEDUP = """
WITH RECURSIVE vecs AS (SELECT row_number() OVER () AS rid, vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
usable AS MATERIALIZED (
  SELECT rid, vec_id, label, v FROM vecs
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.rid AS a, b.rid AS b, b.vec_id FROM usable AS a JOIN usable AS b ON a.label = b.label AND a.rid <> b.rid
  WHERE CASE WHEN len(a.v) = len(b.v) THEN list_cosine_similarity(a.v, b.v) >= CAST(0.93 AS DOUBLE) ELSE false END),
reach AS (SELECT DISTINCT a AS node, a AS found FROM links UNION SELECT r.node, l.b FROM reach AS r JOIN links AS l ON l.a = r.found),
least AS (SELECT node, min(vec_id) AS component FROM reach JOIN vecs ON rid = found GROUP BY node),
counted AS (SELECT a AS node, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(vec_id = coalesce(component, vec_id), true) AS kept
FROM vecs LEFT JOIN least ON least.node = rid LEFT JOIN counted ON counted.node = rid
"""

COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\x0C\r]')) AS piece FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM worded GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded WHERE len(w) > 0),
grams AS (SELECT lang, w[i:i + size - 1] AS words FROM starts JOIN (VALUES (1), (2), (3), (4), (5)) AS s(size) ON i + size - 1 <= len(w)),
counts AS (SELECT lang, words, len(words) AS size, CAST(count(*) AS HUGEINT) AS f FROM grams GROUP BY lang, words HAVING count(*) >= 100),
covered AS (
  SELECT DISTINCT s.lang, s.words FROM counts AS s JOIN counts AS b ON b.lang = s.lang AND b.size = s.size + 1 AND s.size > 1 AND 100 * b.f >= 100 * s.f
    AND (b.words[1:s.size] = s.words OR b.words[2:] = s.words)),
cuts AS (
  SELECT c.lang, c.words, c.f AS a, h.f AS l, t.f AS r, n, k, CAST(1000 AS HUGEINT) * c.f * n // (h.f * t.f) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM counts WHERE size > 1) AS c
  JOIN counts AS h ON h.lang = c.lang AND h.words = c.words[1:k] JOIN counts AS t ON t.lang = c.lang AND t.words = c.words[k + 1:] JOIN totals AS m ON m.lang = c.lang
  WHERE NOT EXISTS (SELECT 1 FROM covered AS x WHERE x.lang = c.lang AND x.words = c.words)),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(words, ' ')) AS rank, array_to_string(words, ' ') AS phrase, a, l, r, n, score FROM best)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""

ORACLE_SQL = {"op12_collocations": COLLOCATIONS, "op8_jaccard_join": JACCARD_JOIN, "op9_quality_rules": QUALITY_RULES, "op10_embedding_dedup": EMBEDDING_DEDUP}
