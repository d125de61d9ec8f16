"""Query of the importance resampling."""

from __future__ import annotations

from corpuslens.llm.importance import resample
from corpuslens.llm.queries import query
from corpuslens.llm.staging import table

_WORDS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
ORACLE = f"""WITH tab AS MATERIALIZED (SELECT list(c ORDER BY b) AS tab FROM (
   SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
   FROM range(256) t(b))),
 d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
 dw AS MATERIALIZED (SELECT r, unnest(w) AS word FROM d),
 bw AS MATERIALIZED (SELECT unnest({_WORDS}) AS word FROM benchmark),
 y AS (SELECT word, list_transform(range(1, CAST(octet_length(encode(word)) AS BIGINT) + 1),
   lambda i: CAST(concat('0x', substr(hex(encode(word)), 2 * i - 1, 2)) AS BIGINT)) AS bytes
   FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
 k AS MATERIALIZED (SELECT word, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes),
   lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])), 4294967295) % 10000 AS bucket FROM y CROSS JOIN tab),
 s AS (SELECT bucket, count(*) AS s FROM dw JOIN k USING (word) GROUP BY bucket),
 t AS (SELECT bucket, count(*) AS t FROM bw JOIN k USING (word) GROUP BY bucket),
 g AS (SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * ((SELECT count(*) FROM dw) + 10000)
   / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * ((SELECT count(*) FROM bw) + 10000)))) AS BIGINT) AS gain FROM s FULL JOIN t USING (bucket)),
 x AS (SELECT r, CAST(sum(gain) AS BIGINT) AS weight FROM dw JOIN k USING (word) JOIN g USING (bucket) GROUP BY r),
 e AS (SELECT doc_id, len(w) AS n, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
   (CAST(concat('0x', substr(sha256(concat('2024:', coalesce(CAST(doc_id AS VARCHAR), 'null'))), 1, 8)) AS BIGINT) + 0.5) / 4294967296.0))) AS BIGINT) AS score
   FROM d LEFT JOIN x USING (r)),
 f AS (SELECT *, CASE WHEN n >= 20 THEN row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id) END AS place,
   count(*) FILTER (WHERE n >= 20) OVER () AS apt FROM e)
 SELECT doc_id, n AS n_features, weight, score, CASE WHEN place <= 10 * apt // 100 THEN place END AS rank FROM f"""


@query("op13_importance_resampling", ORACLE)
def op13(spark, sf):
    rows = resample(spark, table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")
