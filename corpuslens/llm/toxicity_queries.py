"""Query of the toxicity scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.llm.queries import query
from corpuslens.llm.staging import held_out, table
from corpuslens.llm.toxicity import fit, toxicity_scores


@query("op4_toxicity")
def op4(spark, sf):
    documents = table(spark, sf, "documents")
    model = fit(spark, documents, table(spark, sf, "labels"))
    return toxicity_scores(documents, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
