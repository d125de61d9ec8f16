"""Query of the page renderer."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.llm.htmltext import extract
from corpuslens.llm.queries import query
from corpuslens.llm.staging import table


@query("op10_html_text")
def op10(spark, sf):
    return extract(table(spark, sf, "pages")).select(
        "page_id", "text", F.length("text").alias("n_chars"), F.size(F.split("text", "\n")).alias("n_lines"))
