"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .bm25 import bm25_top
from .common import table
from .html_text import main_text
from .jaccard_join import jaccard_components
from .mixing import mix_report
from .packing import packed
from .pii import personal_data
from .quality_classifier import quality_scores
from .quality_rules import quality_verdicts
from .secrets import secrets
from .toxicity import toxicity


def op1_pii(spark, sf_dir):
    return personal_data(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark, sf_dir):
    return packed(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark, sf_dir):
    return main_text(table(spark, sf_dir, "pages"))


def op4_quality_rules(spark, sf_dir):
    return quality_verdicts(table(spark, sf_dir, "documents"))


def op5_source_mixing(spark, sf_dir):
    return mix_report(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_secret_scan(spark, sf_dir):
    return secrets(table(spark, sf_dir, "documents"))


def op8_ngram_jaccard_join(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"))


def op9_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_bm25_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return bm25_top(docs, docs.where("doc_id % 100 = 0"))


QUERIES = {"op10_bm25_search": op10_bm25_search, "op1_pii": op1_pii, "op2_best_fit_packing": op2_best_fit_packing, "op3_html_extraction": op3_html_extraction, "op4_quality_rules": op4_quality_rules, "op5_source_mixing": op5_source_mixing, "op6_quality_classifier": op6_quality_classifier, "op7_secret_scan": op7_secret_scan, "op9_toxicity": op9_toxicity, "op8_ngram_jaccard_join": op8_ngram_jaccard_join}

_RULE_SQL = """
WITH docs AS (SELECT doc_id, source, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
words AS (SELECT rid, doc_id, source, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM docs),
windows AS (
  SELECT rid, k, count(*) OVER (PARTITION BY rid, w[k], w[k + 1], w[k + 2]) AS times
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS k FROM words)),
repeated AS (
  SELECT rid, count(DISTINCT k + d) AS n FROM windows, (VALUES (0), (1), (2)) AS o(d) WHERE times > 1 GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM docs),
dups AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n
  FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
m AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words,
    length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(repeated.n, 0)::BIGINT AS n_repeat_words,
    coalesce(n_lines, 0)::BIGINT AS n_lines
  FROM words LEFT JOIN repeated USING (rid) LEFT JOIN dups USING (rid)),
f AS (
  SELECT *, (n_symbols > 0.5::DOUBLE * n_words)::INT AS f1, (n_dup_lines > 0.5::DOUBLE * n_lines)::INT AS f2,
    (n_repeat_words > 0.3::DOUBLE * n_words)::INT AS f3 FROM m),
long AS (
  SELECT source, r, count(*)::DOUBLE AS n, sum(f)::DOUBLE AS fails
  FROM (SELECT source, unnest([1, 2, 3]) AS r, unnest([f1, f2, f3]) AS f FROM f) GROUP BY ALL),
mean AS (SELECT r, sum(fails) / sum(n) AS mean, sum(n) AS docs FROM long GROUP BY r),
var AS (
  SELECT r, mean, sum(n * (fails / n - mean) ^ 2) / docs AS v
  FROM long JOIN mean USING (r) GROUP BY r, mean, docs),
prior AS (
  SELECT r, mean, CASE WHEN v <= 0 THEN 10000 ELSE greatest(1, least(10000, mean * (1 - mean) / v - 1)) END AS s FROM var),
shrunk AS (
  SELECT source, r, (fails + s * mean) / (n + s) > mean + 0.5::DOUBLE * sqrt(mean * (1 - mean) / (s + 1)) AS strict
  FROM long JOIN prior USING (r)),
rates AS (
  SELECT source, bool_or(strict) FILTER (r = 1) AS r1, bool_or(strict) FILTER (r = 2) AS r2, bool_or(strict) FILTER (r = 3) AS r3
  FROM shrunk GROUP BY source),
judged AS (
  SELECT m.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    concat_ws(',',
      CASE WHEN n_symbols > (CASE WHEN r1 THEN 0.25 ELSE 0.5 END)::DOUBLE * n_words THEN 'symbols' END,
      CASE WHEN n_dup_lines > (CASE WHEN r2 THEN 0.3 ELSE 0.5 END)::DOUBLE * n_lines THEN 'dup_lines' END,
      CASE WHEN n_repeat_words > (CASE WHEN r3 THEN 0.2 ELSE 0.3 END)::DOUBLE * n_words THEN 'repeats' END) AS failed_rules
  FROM m JOIN rates ON m.source IS NOT DISTINCT FROM rates.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed_rules,
  NOT base_failed AND failed_rules = '' AS kept
FROM judged
"""

_MIX_SQL = """
WITH d AS (
  SELECT *, ('0x' || substr(key, 1, 3))::INT AS place, row_number() OVER (PARTITION BY source, key) AS copy FROM (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
      md5('mix-2:' || coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(md5(text), 'null')) AS key
    FROM documents)),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [3.0::DOUBLE, 1.0, 2.0][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight
  FROM d GROUP BY source),
l AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total,
    coalesce(sum(2.0::DOUBLE * source_size) OVER b, 0) AS full_, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS open_
  FROM s WINDOW b AS (ORDER BY 2.0::DOUBLE * source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, coalesce(least(cap, max(CASE WHEN (total - full_) / open_ <= cap / weight THEN (total - full_) / open_ END) OVER () * weight), cap) AS target
  FROM l),
g AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END AS whole,
    target - CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END * source_size AS rest FROM t),
p AS (SELECT source, place, sum(size)::BIGINT AS words FROM d GROUP BY source, place),
u AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY place) AS upto FROM p),
c AS (
  SELECT u.source, place AS last_, rest - upto + words AS left_
  FROM u JOIN g ON u.source IS NOT DISTINCT FROM g.source WHERE upto - words <= rest AND rest < upto),
k AS (
  SELECT d.source, key, size, left_, sum(size) OVER (PARTITION BY d.source ORDER BY key, copy) - size AS before, d.doc_id, copy
  FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source AND place = last_),
x AS (
  SELECT source, key, copy FROM k WHERE CASE WHEN size = 0 THEN before <= left_ ELSE before + size / 2 <= left_ END)
SELECT doc_id, size, g.source_size, target,
  (size * least(2, whole + (place < coalesce(last_, 9999) OR place = last_ AND EXISTS (
    SELECT 1 FROM x WHERE x.source IS NOT DISTINCT FROM d.source AND x.key = d.key AND x.copy = d.copy))::INT))::BIGINT AS taken
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN c ON d.source IS NOT DISTINCT FROM c.source
"""

_JOIN_SQL = """
WITH RECURSIVE docs AS (
  SELECT doc_id, row_number() OVER () AS rid,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT rid, unnest(CASE
    WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM docs),
n AS (SELECT rid, count(*) AS n FROM shingles GROUP BY rid),
pairs AS (SELECT a.rid AS x, b.rid AS y, count(*) AS o FROM shingles a JOIN shingles b ON a.g = b.g AND a.rid < b.rid GROUP BY ALL),
links AS (
  SELECT x, y FROM pairs JOIN n AS p ON p.rid = x JOIN n AS q ON q.rid = y WHERE 100 * o >= 75 * (p.n + q.n - o)),
both_ AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(rid, other) AS (
  SELECT rid, rid FROM docs UNION SELECT r.rid, b.y FROM reach r JOIN both_ b ON b.x = r.other),
lowest AS (SELECT r.rid, min(d.doc_id) AS component_id FROM reach r JOIN docs d ON d.rid = r.other GROUP BY r.rid),
degree AS (SELECT x AS rid, count(*) AS n_links FROM both_ GROUP BY x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, coalesce(n_links, 0)::BIGINT AS n_links
FROM docs LEFT JOIN n USING (rid) JOIN lowest USING (rid) LEFT JOIN degree USING (rid)
"""

ORACLE_SQL: dict[str, str] = {"op8_ngram_jaccard_join": _JOIN_SQL, "op4_quality_rules": _RULE_SQL, "op5_source_mixing": _MIX_SQL}
