"""Query of the url filter."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.llm.queries import query
from corpuslens.llm.staging import table
from corpuslens.llm.urlfilter import host_and_path, judge_urls

# --- fixed values: the rules of the contract
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]
# short pages with advertisements: their addresses, host and path, are the block list
LISTED = """html LIKE '%<div class="ad">%' AND length(html) < 1500"""

_REST = "CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
_FITS = lambda text: (lambda h, s: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{s}'))")(*text.split("/", 1))
_BY_LENGTH = sorted(RULES, key=lambda r: -len(r[1]))
ORACLE = f"""WITH r AS (SELECT page_id, html, coalesce({_REST}, '') AS rest FROM pages),
 h AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r)
 SELECT page_id, host, path,
   CASE {' '.join(f"WHEN {_FITS(text)} THEN '{text}'" for _, text in _BY_LENGTH)} END AS rule,
   CASE {' '.join(f"WHEN {_FITS(text)} THEN '{verdict}'" for verdict, text in _BY_LENGTH)}
     WHEN concat(host, path) IN (SELECT concat(host, path) FROM h WHERE {LISTED} AND concat(host, path) <> '') THEN 'block' ELSE 'allow' END AS verdict
 FROM h"""


def block_list(pages):
    """A column `key`, host and path, of the pages to block."""
    host, path = host_and_path(F.col("url"))
    return pages.filter(LISTED).select(F.concat(host, path).alias("key")).filter("key <> ''").distinct()


@query("op8_url_filter", ORACLE)
def op8(spark, sf):
    pages = table(spark, sf, "pages")
    return judge_urls(spark, pages, RULES, block_list(pages), key=F.concat("host", "path"))
