"""Query of the token-id files."""

from __future__ import annotations

from corpuslens.llm.piece_queries import tokenizer_file
from corpuslens.llm.queries import query
from corpuslens.llm.staging import table
from corpuslens.llm.tokenids import read_ids, write_ids


@query("op9_token_ids")
def op9(spark, sf):
    with open(tokenizer_file("byte_bpe_50k.json"), encoding="utf-8") as file:
        spec = file.read()
    return read_ids(spark, write_ids(spark, table(spark, sf, "documents"), spec), ids=False)
