"""Query of the piece encoding."""

from __future__ import annotations

import os

from corpuslens.llm.pieces import encode_digests, read_vocabulary
from corpuslens.llm.queries import query
from corpuslens.llm.staging import table


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer file; TOKENIZER_DIR names another folder."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op6_sentencepiece")
def op6(spark, sf):
    return encode_digests(table(spark, sf, "documents"), read_vocabulary(tokenizer_file("piece_bpe_32k.model")))
