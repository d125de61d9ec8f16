"""Query of the language identification."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.llm.language import fit, languages, letter_pieces
from corpuslens.llm.piece_queries import tokenizer_file
from corpuslens.llm.pieces import read_vocabulary
from corpuslens.llm.queries import query
from corpuslens.llm.staging import held_out, table


@query("op2_language")
def op2(spark, sf):
    documents = table(spark, sf, "documents")
    pieces = letter_pieces(list(read_vocabulary(tokenizer_file("piece_bpe_32k.model")).pieces))
    model = fit(spark, documents, pieces)
    return languages(documents, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
