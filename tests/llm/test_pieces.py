"""Piece encoding and decoding against the library, on whole tables and on odd texts."""

import hashlib
import random

import pytest
import sentencepiece

from corpuslens.llm import pieces
from corpuslens.llm.piece_queries import op6, tokenizer_file

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(pieces.read_vocabulary(tokenizer_file("piece_bpe_32k.model")))


def odd_texts():
    draw = random.Random(3)
    alphabet = "  ▁\n\tabcdetThEin.,'-0129éßñü日本語🎉́\x00\x7f"
    yield from ["", " ", "  ", "a", " a", "a ", "<s></s><0x41>", "▁", "x" * 5000, " " * 3001, "ab" * 3000, "é" * 999,
                "\U0001f600\U0001f600 ", "thenthethethenthenthe" * 50]
    for n in range(600):
        yield "".join(draw.choice(alphabet) for _ in range(draw.randrange(0, 60)))
    for n in range(300):
        yield "".join(draw.choice(["the", "in", "er", " ", "  ", "tion", "qu", "a", "t", "h"]) for _ in range(40))


def test_odd_texts_equal_the_library(library, codec):
    for text in odd_texts():
        ids = library.encode(text, add_eos=True)
        assert codec.encode(text) == ids, repr(text)
        assert codec.decode(ids) == library.decode(ids), repr(text)
    assert codec.encode(None) == library.encode("", add_eos=True)


def test_decoding_any_ids_equals_the_library(library, codec):
    draw = random.Random(4)
    for _ in range(500):
        ids = [draw.choice([draw.randrange(3, 259), draw.randrange(259, 32000)]) for _ in range(draw.randrange(0, 12))]
        assert codec.decode(ids) == library.decode(ids), ids


def test_whole_table_equals_the_library(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = op6(spark, SF).collect()
    assert len(rows) == len(texts)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))


def test_nulls_repeats_and_empty_table(spark):
    vocabulary = pieces.read_vocabulary(tokenizer_file("piece_bpe_32k.model"))
    docs = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (None, "", "b"), (2, "a b", None)], "doc_id long, text string, ids string")
    rows = pieces.encode_documents(docs, vocabulary).collect()
    assert sorted((r.doc_id or 0, r.ids, r.decoded) for r in rows) == [(0, [2], ""), (1, [2], ""), (1, [2], ""), (2, [264, 287, 2], "a b")]
    assert pieces.encode_documents(docs.limit(0), vocabulary).count() == 0
