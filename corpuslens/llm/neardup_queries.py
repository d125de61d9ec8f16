"""Query of the near-duplicate classes."""

from __future__ import annotations

from corpuslens.llm.neardup import near_duplicates
from corpuslens.llm.queries import query
from corpuslens.llm.staging import table


@query("op5_near_duplicates")
def op5(spark, sf):
    return near_duplicates(spark, table(spark, sf, "documents"))
