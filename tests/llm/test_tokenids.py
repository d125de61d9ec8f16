"""Token-id files: round trips, the library's ids on whole tables and odd texts, defined cases."""

import random
import zlib

import numpy as np
import pytest
import tokenizers

from corpuslens.llm import tokenids as t
from corpuslens.llm.piece_queries import tokenizer_file
from corpuslens.llm.tokenid_queries import op9

SF = "/root/testdata/sf0.01"
SPEC = open(tokenizer_file("byte_bpe_50k.json"), encoding="utf-8").read()


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_str(SPEC)


def test_number_round_trip():
    draw = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        for bits in (3, 8, 9, 16, 17, 24, 25, 32):
            x = draw.integers(0, 1 << bits, n, dtype=np.uint64).astype("<u4")
            control, data = t.encode_ranks(x)
            assert len(control) == -(-n // 4) and (t.decode_ranks(control, data, n) == x).all()
    ids = draw.zipf(1.3, 5000) % 50_000
    assert (t.decode_block(*t.encode_block(ids), len(ids)) == ids).all()
    # by hand: 1, 256, 65536 take 1, 2, 3 bytes
    assert t.encode_ranks(np.array([1, 256, 65536], np.uint32)) == (bytes([0b00100100]), bytes([1, 0, 1, 0, 0, 1]))


def odd_texts():
    draw = random.Random(1)
    yield from ["", " ", "\n", "\n\n a", "a  b", "it's we're I'll 'tis ''s don't'", "x" * 5000, " " * 500, "<|endoftext|>", "a<|endoftext|> b",
                "日本語 🎉", "²³ ½", "a b", "¿qué?", "x\x00y", "a\x1cb"]
    for _ in range(3000):
        yield "".join(draw.choice("  \n\t''''asdtmrevl.ABCéßñ0129,!?_-") for _ in range(draw.randrange(0, 40)))


def test_odd_texts_equal_the_library(library):
    texts = list(odd_texts())
    own = t.Tokenizer(SPEC)
    for _ in range(2):  # the second time from the table
        ids, n = own.texts(texts)
        for text, got in zip(texts, np.split(ids, np.cumsum(n)[:-1])):
            assert got.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("bits, words", [(6, 5_000), (t.TABLE_BITS, 3_000_000)])
def test_more_distinct_words_than_the_table_holds(library, monkeypatch, bits, words):
    monkeypatch.setattr(t, "TABLE_BITS", bits)
    own = t.Tokenizer(SPEC)
    text = " ".join(f"w{i:x}" for i in range(words))
    want = library.encode(text, add_special_tokens=False).ids
    for _ in range(2):
        ids, n = own.texts([text, "w1 w2"])
        assert n.tolist()[0] == len(want) and np.array_equal(ids[:len(want)], want)


def test_whole_table_equals_the_library(spark, library):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    rows = {r.doc_id: r for r in op9(spark, SF).collect()}
    assert len(rows) == len(docs)
    start = 0
    for doc, text in docs:
        ids = np.array(library.encode(text, add_special_tokens=False).ids + [0], "<u4")
        r = rows[doc]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_order_nulls_repeats_and_empty_table(spark, library):
    texts = [(5, "b b"), (None, "null id"), (2, None), (5, "b b"), (5, ""), (1, "last'll ¿"), (None, "")] + [(9, f"w{i}") for i in range(50)]
    docs = spark.createDataFrame([(t_, d, 1, 2) for d, t_ in texts], "text string, doc_id long, place int, shard int").repartition(3)
    folder = t.write_ids(spark, docs, SPEC, block_ids=7)
    rows = sorted(t.read_ids(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, None, 1, 2, 5, 5, 5] + [9] * 50
    at = 0
    for r in rows:
        assert (r.start, r.n_tokens) == (at, len(r.ids)) and r.ids[-1] == 0
        at += r.n_tokens
    want = sorted(tuple(library.encode(x or "", add_special_tokens=False).ids) for _, x in texts)
    assert sorted(tuple(r.ids[:-1]) for r in rows) == want
    assert t.read_ids(spark, t.write_ids(spark, docs.limit(0), SPEC)).count() == 0
