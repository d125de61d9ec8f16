"""Benchmark search against all windows compared one by one, and its defined cases."""

import random
import re

from corpuslens.llm.decontamination import Searcher, benchmark_hits, contaminated, normal_words


def slow_words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def slow_hits(docs, items, size=13):
    listed = []
    for item, passage in items:
        p = slow_words(passage)
        listed.append((item, {tuple(p[i:i + size]) for i in range(max(1, len(p) - size + 1)) if p}))
    lengths = {len(win) for _, wins in listed for win in wins}
    for doc, text in docs:
        w = slow_words(text)
        places = {}
        for n in lengths:
            for i in range(len(w) - n + 1):
                places.setdefault(tuple(w[i:i + n]), []).append(i)
        hit, found = set(), set()
        for item, wins in listed:
            for win in wins:
                for i in places.get(win, ()):
                    hit.update(range(i, i + len(win)))
                    found.add("null" if item is None else str(item))
        yield doc, len(w), len(hit), sorted(found)


def sample():
    draw = random.Random(5)
    word = lambda: draw.choice(["a", "b", "an", "the", "thé", "x9", "日本"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([20, 13, 14, 40, 3, 1, 0])] + [(None, "so Very, rare"), (3, "AN a AN b; an the")]
    docs = []
    for i in range(60):
        text = [word() for _ in range(draw.randrange(0, 120))]
        for _ in range(draw.randrange(0, 3)):
            at = draw.randrange(0, len(text) + 1)
            text[at:at] = draw.choice(items)[1].upper().split()
        docs.append((i, draw.choice([" ", "\n", " -- "]).join(text)))
    return docs + [(None, "so very rare"), (7, None), (7, ""), (8, "...")] * 2, items


def rows(hits):
    return sorted((str(r.doc_id), r.n_words, r.n_hit, r.items) for r in contaminated(hits).collect())


def test_equal_to_brute_force_in_one_block_and_in_many(spark):
    docs, items = sample()
    shape = "text string, items string, spans int, {} long"
    d = spark.createDataFrame([(t, "x", 1, i) for i, t in docs], shape.format("doc_id"))
    b = spark.createDataFrame([(t, "x", 1, i) for i, t in items], shape.format("item_id"))
    want = sorted((str(i), n, h, f) for i, n, h, f in slow_hits(docs, items))
    assert any(h for _, _, h, _ in want)
    assert rows(benchmark_hits(spark, d, b)) == want
    assert rows(benchmark_hits(spark, d, b, block_windows=20)) == want


def test_a_window_of_many_items_is_sent_once(spark, monkeypatch):
    """A third of the items hold one passage: it is a few windows, whatever their number."""
    from corpuslens.llm import decontamination

    sent = []
    real = decontamination._search
    monkeypatch.setattr(decontamination, "_search", lambda patterns: sent.append(len(patterns)) or real(patterns))
    items = [(i, "a b c d e f g h i j k l m n") for i in range(300)] + [(1000 + i, f"x{i} y") for i in range(20)]
    d = spark.createDataFrame([(1, "a b c d e f g h i j k l m n o"), (2, "x3 y x4 y")], "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert rows(benchmark_hits(spark, d, b)) == sorted((str(i), n, h, f) for i, n, h, f in slow_hits([(1, "a b c d e f g h i j k l m n o"), (2, "x3 y x4 y")], items))
    assert sent == [22]


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert rows(benchmark_hits(spark, d, b)) == [("1", 3, 0, [])]
    assert rows(benchmark_hits(spark, d.limit(0), d.selectExpr("doc_id AS item_id", "text"))) == []


def test_search_finds_every_position():
    draw = random.Random(1)
    for _ in range(200):
        text = bytes(draw.choice(b"ab ") for _ in range(draw.randrange(0, 300)))
        patterns = {bytes(draw.choice(b"ab ") for _ in range(draw.randrange(1, 40))) for _ in range(6)} | {text[5:25] or b"q"}
        want = sorted((i, p) for p in patterns for i in range(len(text)) if text.startswith(p, i))
        assert sorted(Searcher(patterns).find(text)) == want


def test_words_equal_the_pattern():
    draw = random.Random(2)
    for _ in range(200):
        text = "".join(chr(draw.choice([draw.randrange(0, 130), draw.randrange(0, 0xD7FF)])) for _ in range(80))
        assert [w.decode() for w in normal_words(text)] == slow_words(text)
