"""The pipeline against a plain version of every stage, and its stages on odd rows."""

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from corpuslens.llm import secrets, toxicity
from corpuslens.llm.piece_queries import tokenizer_file
from tests.llm.test_decontamination import slow_hits
from tests.llm.test_neardup import slow_classes
from tests.llm.test_secrets import plain

SF = "/root/testdata/sf0.01"


def redacted(text):
    out, at = "", 0
    for _, _, start, end in sorted(secrets.find_spans(text, secrets.RULES), key=lambda f: f[2:]):
        if start >= at:
            out += text[at:start] + "[secret]"
        at = max(at, end)
    return out + text[at:]


def test_run_equals_plain_stages(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()}
    model = toxicity.fit(spark, spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    scorer = toxicity.Scorer(model)
    docs = {i: t for i, t in docs.items() if scorer.score(t) < 0.5}
    ids = list(docs)
    docs = {ids[i]: docs[ids[i]] for i, c in enumerate(slow_classes(list(docs.values()))) if i == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {i for i, n, hit, _ in slow_hits(docs.items(), items) if hit and 20 * hit >= n}
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()}
    assert bad and set(got) == set(docs) - bad
    assert any(plain(docs[i]) for i in got)
    for i, ids in got.items():
        assert ids == library.encode(redacted(docs[i]), add_eos=True)


@pytest.fixture(scope="module")
def odd(spark):
    text = "one two three four five six seven"
    return spark.createDataFrame(
        [(1, text, "en", "s", 3, "x"), (1, text, "en", "s", 3, "x"), (1, "quite other words than those before", None, None, None, None),
         (None, text.upper(), None, None, 1, None), (None, None, None, None, None, None), (None, None, None, None, None, None), (2, "", "", "", 0, ""),
         (3, "secret=" + "a" * 20 + " end", "en", "s", 31, "y"), (4, "w " * 50_000, "en", "s", 9, "y")],
        "doc_id long, text string, lang string, source string, n_chars long, key string")


def test_stages_on_odd_rows(spark, odd):
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == odd.columns and docs.dtypes == odd.dtypes
        docs = spark.createDataFrame(docs.collect(), odd.schema)
    rows = sorted(((r.doc_id or 0, r.text or "", r.n_chars) for r in docs.collect()), key=str)
    # the copy with a null id has the smaller key; equal rows without words stay, as they are no copies
    assert rows == sorted([
        (0, "ONE TWO THREE FOUR FIVE SIX SEVEN", 1), (1, "quite other words than those before", None), (0, "", None), (0, "", None), (2, "", 0),
        (3, "[secret] end", 12), (4, "w " * 50_000, 9)], key=str)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == 7 and last.columns == ["doc_id", "ids", "n_tokens"]


def test_columns_of_any_name_are_kept(spark, odd):
    names = ["row", "own", "blob", "findings", "marked", "hash", "gone_id", "gone_hash", "class_id", "class_size", "h", "id", "_secret_id", "text_hash_of_row"]
    docs = odd.filter("doc_id IN (1, 3)")
    for n in names:
        docs = docs.withColumn(n, F.concat_ws("-", F.lit(n), F.col("doc_id").cast("string")))
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
    rows = docs.collect()
    assert len(rows) == 3 and all(r[n] == f"{n}-{r.doc_id}" for r in rows for n in names)


def test_empty_table(spark, odd):
    docs = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
