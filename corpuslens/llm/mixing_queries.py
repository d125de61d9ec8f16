"""Query of the mix of sources."""

from __future__ import annotations

from corpuslens.llm.mixing import BLOCKS, FILLS, mixed
from corpuslens.llm.queries import query
from corpuslens.llm.staging import table

_fills = "".join(f""" m{i} AS (SELECT *, NOT fits AND words <= gap AND sum(CASE WHEN NOT fits AND words <= gap THEN words ELSE 0 END)
   OVER (PARTITION BY source ORDER BY block) <= gap AS more FROM f{i}),
 f{i + 1} AS (SELECT source, block, words, gap - sum(CASE WHEN more THEN words ELSE 0 END) OVER (PARTITION BY source) AS gap, fits OR more AS fits FROM m{i}),
""" for i in range(FILLS)).rstrip()
ORACLE = f"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
   CAST(concat('0x', substr(sha256(concat('2024:', coalesce(CAST(doc_id AS VARCHAR), 'null'), ':', md5(coalesce(text, '')))), 1, 15)) AS BIGINT) AS h
   FROM documents),
 s AS (SELECT source, size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
   FROM (SELECT source, CAST(sum(size) AS BIGINT) AS size FROM d GROUP BY source)),
 t AS (SELECT CAST(sum(size) AS BIGINT) AS total, sum(w) AS all_w FROM s),
 r AS (SELECT source, size, w, total, total - coalesce(sum(3 * size) OVER lower, 0) AS left_words, all_w - coalesce(sum(w) OVER lower, 0) AS left_w
   FROM s CROSS JOIN t WINDOW lower AS (ORDER BY CAST(3 * size AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 l AS (SELECT min(left_words) AS words, min(left_w) AS weight FROM (
   SELECT * FROM r WHERE 3 * size * left_w >= left_words * w QUALIFY left_w = max(left_w) OVER ())),
 g AS (SELECT source, r.size AS source_size, total, CASE WHEN 3 * r.size * l.weight < l.words * w THEN CAST(3 * r.size AS DOUBLE)
   ELSE w * CAST(l.words AS DOUBLE) / CAST(l.weight AS DOUBLE) END AS target FROM r CROSS JOIN l),
 p AS (SELECT *, least(3, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END) AS passes,
   greatest(1, CAST(ceil(source_size * {float(BLOCKS)} / greatest(total, 1)) AS BIGINT)) AS n FROM g),
 x AS (SELECT d.*, p.source_size, p.target, p.passes, p.target - p.passes * p.source_size AS rest, h % n AS block
   FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
 b AS (SELECT source, block, passes, rest, CAST(sum(size) AS BIGINT) AS words FROM x GROUP BY source, block, passes, rest),
 f0 AS (SELECT source, block, words, CASE WHEN passes < 3 THEN rest ELSE 0 END AS gap, false AS fits FROM b),
{_fills}
 e AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY NOT fits AND abs(words - gap) < gap DESC, abs(words - gap), block) = 1
   AND NOT fits AND abs(words - gap) < gap AS last FROM f{FILLS})
 SELECT doc_id, size, source_size, target, CAST(size * (x.passes + CASE WHEN fits OR last THEN 1 ELSE 0 END) AS BIGINT) AS taken
 FROM x JOIN e ON x.source IS NOT DISTINCT FROM e.source AND x.block = e.block"""


@query("op12_source_mix", ORACLE)
def op12(spark, sf):
    return mixed(spark, table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")
