"""Query of the quality rules."""

from __future__ import annotations

from corpuslens.llm import quality as q
from corpuslens.llm.queries import query
from corpuslens.llm.staging import table

_COUNT = lambda characters: "length(t) - length(" + "replace(" * len(characters) + "t" + "".join(f", '{c}', '')" for c in characters) + ")"
_PART = lambda top, below, name: f"(1000000 * {top}) // (greatest({below}, 1) * {q.SCALES[name]})"
# P(Bin(n, p) <= k) by all terms
_TAIL = f"""CASE WHEN k >= n * {q.RISK} THEN 1.0 ELSE least(1.0, list_sum(list_transform(range(0, CAST(k AS BIGINT) + 1), lambda j: exp(lgamma(n + 1.0) - lgamma(j + 1.0)
  - lgamma(n - j + 1.0) + j * ln({q.RISK}) + (n - j) * ln(1 - {q.RISK}))))) END"""
ORACLE = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang AS stratum, coalesce(text, '') AS t FROM documents),
 a AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
   list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
 g AS (SELECT r, i, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM a)),
 c AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g),
 v AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM c WHERE n > 1) GROUP BY r),
 m AS (SELECT a.r, doc_id, stratum, t, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
   {_COUNT(q.SYMBOLS)} AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(v.n, 0) AS n_repeat_words,
   length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_capitals, {_COUNT('!?')} AS n_marks FROM a LEFT JOIN v ON a.r = v.r),
 b AS (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed, greatest({_PART('n_symbols', 'word_chars', 'symbols')},
   {_PART('n_dup_lines', 'n_lines', 'dup_lines')}, {_PART('n_repeat_words', 'n_words', 'repeats')}, {_PART('n_capitals', 'word_chars', 'capitals')},
   {_PART('n_marks', 'n_words', 'marks')}) AS badness FROM m),
 s AS (SELECT *, least(badness // {q.BIN}, {q.BINS}) AS step FROM b),
 y AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
 h AS (SELECT stratum, any_value(step) AS step, bool_or(quality = 1) AS good FROM s JOIN y USING (doc_id) WHERE NOT base_failed GROUP BY stratum, t),
 z AS (SELECT stratum, count_if(good) AS n, count_if(NOT good) AS n_bad FROM h GROUP BY stratum),
 k AS (SELECT z.stratum, cutoff, any_value(n) AS n, any_value(n_bad) AS n_bad, count_if(good AND step > cutoff) AS k, count_if(NOT good AND step > cutoff) AS k_bad
   FROM z CROSS JOIN (SELECT unnest(range(0, {q.BINS})) AS cutoff) JOIN h ON h.stratum IS NOT DISTINCT FROM z.stratum GROUP BY z.stratum, cutoff),
 p AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY round(k_bad / greatest(n_bad, 1) - k / greatest(n, 1), 9) DESC, cutoff DESC) AS rank
   FROM k WHERE {_TAIL} <= {q.DELTA} / (SELECT count(*) FROM z))
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND step <= coalesce(cutoff, {q.BINS}) AS kept,
   badness, CAST(coalesce(cutoff, {q.BINS}) AS INTEGER) AS cutoff FROM s LEFT JOIN (SELECT * FROM p WHERE rank = 1) o ON s.stratum IS NOT DISTINCT FROM o.stratum"""


@query("op3_quality_rules", ORACLE)
def op3(spark, sf):
    return q.quality_verdicts(spark, table(spark, sf, "documents"), table(spark, sf, "labels"))
