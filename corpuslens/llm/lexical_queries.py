"""Query of the ranked search."""

from __future__ import annotations

from corpuslens.llm.lexical import build_index, search
from corpuslens.llm.queries import query
from corpuslens.llm.staging import table

_TERMS = ("unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))")
ORACLE = f"""WITH d AS (SELECT r, doc_id, {_TERMS} AS t FROM (SELECT row_number() OVER () AS r, * FROM documents)),
 n AS (SELECT r, doc_id, count(*) AS n FROM d GROUP BY r, doc_id),
 g AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS len FROM n),
 q AS (SELECT q, item_id, t, count(*) AS c FROM (SELECT q, item_id, {_TERMS} AS t FROM (
   SELECT row_number() OVER () AS q, * FROM benchmark)) GROUP BY q, item_id, t),
 tf AS (SELECT r, t, count(*) AS tf FROM d WHERE t IN (SELECT t FROM q) GROUP BY r, t),
 w AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w
   FROM (SELECT t, count(*) AS df FROM tf GROUP BY t) CROSS JOIN g),
 s AS (SELECT q, item_id, r, doc_id,
   CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * docs) // len))))) AS BIGINT) AS score
   FROM q JOIN tf USING (t) JOIN w USING (t) JOIN n USING (r) CROSS JOIN g GROUP BY q, item_id, r, doc_id)
 SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
   SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 20"""


@query("op11_ranked_search", ORACLE)
def op11(spark, sf):
    return search(spark, build_index(spark, table(spark, sf, "documents")), table(spark, sf, "benchmark"))
