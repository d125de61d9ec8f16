"""Query of the benchmark search."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.llm.decontamination import WINDOW, benchmark_hits, contaminated
from corpuslens.llm.queries import query
from corpuslens.llm.staging import table

_WORDS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
ORACLE = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
 b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_WORDS} AS w FROM benchmark),
 bw AS (SELECT DISTINCT item, least(len(w), {WINDOW}) AS l, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS win FROM (
   SELECT *, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
 dw AS (SELECT r, i, l, array_to_string(w[i:i + l - 1], ' ') AS win FROM (
   SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT l FROM bw))),
 hit AS (SELECT r, i, l, item FROM dw JOIN bw USING (l, win)),
 n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + l)) AS p FROM hit) GROUP BY r),
 t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
 SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
   coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
 FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)"""


@query("op7_decontamination", ORACLE)
def op7(spark, sf):
    hits = contaminated(benchmark_hits(spark, table(spark, sf, "documents"), table(spark, sf, "benchmark")))
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")
