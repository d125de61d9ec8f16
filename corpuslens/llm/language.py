"""Language of a text by unigrams summed over all segmentations.

A word is the space mark and its lower-cased letters.  Every way to cut it into
pieces of a fixed public vocabulary counts: its probability in a language is the
sum over segmentations of the product of piece probabilities, which a forward
pass computes.  Letters that are no piece of the vocabulary are pieces of their
own class.  A text scores the sum of the logarithms over its words.  Passes keep
logarithms at each node, so that no word, however long or rare, underflows.

Piece probabilities come from expectation maximisation: the forward and a
backward pass give the expected count of each piece over all segmentations of
the training words, weighted by the words' counts in each language.  The words
are counted by Spark over about `TRAIN_DOCS` documents for each language at most
(a share of them by the hash of their id); the expected counts are partial sums per
batch, so that only pieces x languages numbers reach the driver.  Words of every
length count.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm.staging import held_out, written

# executors need not have this package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPACE = "▁"
TRAIN_DOCS = 1500    # for each language
ROUNDS = 3
SMOOTHING = 0.1      # added to every expected count
LONGEST = 48         # longer words are scored one by one
LETTERS = 100_000    # of the words in one pass of the fit
CACHED_WORDS = 250_000

_words = re.compile(r"[^\W\d_]+").findall


def words_of(text: str | None) -> list[str]:
    """Runs of letters.  The pattern also takes numerals that are no digits, which part words."""
    found = _words((text or "").lower())
    return [x for w in found for x in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


@dataclass
class Model:
    languages: list[str]
    pieces: list[str]        # number 0 stands for any letter that is no piece
    probability: np.ndarray  # pieces x languages


def letter_pieces(pieces: list[str]) -> list[str]:
    """Those of a vocabulary that can occur in a word: lower-case letters, perhaps after the space mark."""
    own = re.compile(f"{SPACE}?[^\\W\\d_]*").fullmatch
    return sorted({p for p in pieces if p and own(p) and p == p.lower()} | {SPACE})


class Lattice:
    """All pieces in words: flat arrays of matches, and the passes over them."""

    def __init__(self, pieces: list[str]):
        self.find = ahocorasick.Automaton()
        for i, p in enumerate(pieces, 1):
            self.find.add_word(p, i << 8 | len(p))
        self.find.make_automaton()
        self.single = {p for p in pieces if len(p) == 1}

    def matches(self, words: list[str]):
        """Node of each word's start, word lengths, and (start node, end node, end offset, piece) of each match.

        The nodes of a word of n letters are n + 2: before the space mark, after it, and after each letter.
        """
        text = SPACE + SPACE.join(words)
        length = np.fromiter(map(len, words), int, len(words)) + 1
        at = np.concatenate([[0], np.cumsum(length)])  # place of each word's mark in the text
        # (last letter, piece, length) in one number
        found = [last << 32 | piece for last, piece in self.find.iter(text)]
        if not self.single.issuperset(text):
            found += [k << 32 | 1 for k, c in enumerate(text) if c not in self.single]
        m = np.array(found, np.int64)
        last, piece, n = m >> 32, m >> 8 & 0xFFFFFF, m & 0xFF
        word = np.searchsorted(at, last, "right") - 1
        # a node is a place in the text plus the number of words before it
        offset = last + 1 - at[word]
        order = np.lexsort((word, offset))
        word, piece, n, offset = word[order], piece[order], n[order], offset[order]
        end = at[word] + word + offset
        return at[:-1] + np.arange(len(words)), length, end - n, end, offset, piece, word

    def forward(self, words: list[str], p: np.ndarray):
        """ln of the probability of all ways to each node, and the matches."""
        first, length, start, end, offset, piece, word = found = self.matches(words)
        logs, log_p = np.full((int(length.sum()) + len(words), p.shape[1]), -np.inf), np.log(p)
        logs[first] = 0.0
        for a, b in _runs(offset):
            # matches with one end stand together
            cuts = np.flatnonzero(np.diff(end[a:b], prepend=-1))
            x = logs[start[a:b]] + log_p[piece[a:b]]
            most = np.maximum.reduceat(x, cuts)
            x -= np.repeat(most, np.diff(cuts, append=b - a), 0)
            logs[end[a:b][cuts]] = most + np.log(np.add.reduceat(np.exp(x), cuts))
        return logs, found

    def log_words(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """ln of each word's probability, summed over its segmentations: words x languages."""
        out = np.empty((len(words), p.shape[1]))
        short = [i for i, w in enumerate(words) if len(w) <= LONGEST]
        if short:
            logs, (first, length, *_) = self.forward([words[i] for i in short], p)
            out[short] = logs[first + length]
        for i, w in enumerate(words):
            if len(w) > LONGEST:
                out[i] = self.log_long(w, p)
        return out

    def log_long(self, word: str, p: np.ndarray) -> np.ndarray:
        """The same for one word of any length: the last few nodes are kept, scaled to the largest."""
        text = SPACE + word
        ends: dict[int, list[tuple[int, int]]] = {}
        for last, piece in self.find.iter(text):
            ends.setdefault(last + 1, []).append((piece >> 8, piece & 0xFF))
        for k, c in enumerate(text):
            if c not in self.single:
                ends.setdefault(k + 1, []).append((0, 1))
        longest = max((n for e in ends.values() for _, n in e), default=1)
        recent = {0: np.ones(p.shape[1])}
        total = np.zeros(p.shape[1])
        for node in range(1, len(text) + 1):
            recent[node] = sum(recent[node - n] * p[i] for i, n in ends[node])
            recent.pop(node - longest, None)
            scale = recent[node]
            total += np.log(scale)
            recent = {k: v / scale for k, v in recent.items()}
        return total

    def expected(self, words: list[str], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected pieces of words, by their counts in each language: pieces x languages."""
        total = np.zeros((len(p), p.shape[1]))
        place = np.cumsum([len(w) + 1 for w in words]) // LETTERS
        for a, b in _runs(place):
            total += self._expected(words[a:b], counts[a:b], p)
        return total

    def _expected(self, words: list[str], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        logs, (first, length, start, end, offset, piece, word) = self.forward(words, p)
        # share of each match among the ways to its end, then among all segmentations: never above 1
        share = np.exp(logs[start] + np.log(p)[piece] - logs[end])
        passed = np.zeros_like(logs)
        passed[first + length] = 1.0
        for a, b in reversed(_runs(offset)):
            share[a:b] *= passed[end[a:b]]
            np.add.at(passed, start[a:b], share[a:b])
        share *= counts[word]
        return np.stack([np.bincount(piece, share[:, k], len(p)) for k in range(p.shape[1])], 1)


def _runs(ascending: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.flatnonzero(np.diff(ascending)) + 1
    edges = [0, *cuts.tolist(), len(ascending)]
    return list(zip(edges[:-1], edges[1:])) if len(ascending) else []


def _word_counts(sample: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, Counter] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                counts.setdefault(lang, Counter()).update(words_of(text.as_py()))
            for lang, c in counts.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(c), pa.string()), pa.array(c.keys(), pa.string()), pa.array(c.values(), pa.int64())],
                    ["lang", "word", "n"])

    return sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(spark: SparkSession, documents: DataFrame, pieces: list[str], most: int = TRAIN_DOCS) -> Model:
    """Model of the documents that are not held out and have a language and a text."""
    known = documents.select("doc_id", F.col("lang").cast("string").alias("lang"), "text").filter(
        "lang IS NOT NULL AND text IS NOT NULL").filter(~held_out(F.col("doc_id")))
    # a share of each language by the hash of the id: no language is gathered or sorted in one task
    ids = known.select("lang", "doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("h"))
    shares = ids.groupBy("lang").agg(F.least(F.lit(most) / F.count("*"), F.lit(1.0)).alias("share"))
    chosen = ids.join(shares, "lang").filter(F.col("h") < F.col("share") * (1 << 30)).select("lang", "doc_id")
    # written first, so that Spark knows its size and broadcasts it only if it is small
    chosen = written(spark, chosen, "language-sample")
    sample = known.join(chosen, ["lang", "doc_id"], "left_semi").select("lang", "text")
    words = written(spark, _word_counts(sample), "words")
    languages = sorted(r.lang for r in words.select("lang").distinct().collect())
    p = np.full((len(pieces) + 1, max(1, len(languages))), 1.0 / (len(pieces) + 1))
    column = {lang: i for i, lang in enumerate(languages)}
    for _ in range(ROUNDS if languages else 0):
        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattice = Lattice(pieces)
            for batch in batches:
                words = batch.column("word").to_pylist()
                counts = np.zeros((len(words), len(languages)))
                counts[np.arange(len(words)), [column[x] for x in batch.column("lang").to_pylist()]] = batch.column("n").to_numpy()
                found = lattice.expected(words, counts, p)
                piece, lang = np.nonzero(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(piece, pa.int32()), pa.array(lang, pa.int32()), pa.array(found[piece, lang])], ["piece", "lang", "n"])

        total = np.full_like(p, SMOOTHING)
        # at most pieces x languages rows
        for r in words.mapInArrow(expect, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).collect():
            total[r.piece, r.lang] += r.n
        p = total / total.sum(0)
    return Model(languages, pieces, p)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.lattice = model, Lattice(model.pieces)
        self.row: dict[str, int] = {}
        self.logs, self.uses = np.zeros((0, model.probability.shape[1])), np.zeros(0, int)

    def texts(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text: the best posterior under equal priors."""
        words = [words_of(t) for t in texts]
        new = sorted({w for x in words for w in x if w not in self.row})
        if len(self.row) + len(new) > CACHED_WORDS:
            self._forget()
            new = sorted({w for x in words for w in x if w not in self.row})
        for i in range(0, len(new), 20_000):
            part = new[i:i + 20_000]
            self.row.update(zip(part, range(len(self.row), len(self.row) + len(part))))
            self.logs = np.concatenate([self.logs, self.lattice.log_words(part, self.model.probability)])
            self.uses = np.concatenate([self.uses, np.zeros(len(part), int)])
        out = []
        for x in words:
            if not x or not self.model.languages:
                out.append(("und", 0.0))
                continue
            rows = np.fromiter(map(self.row.__getitem__, x), int, len(x))
            self.uses[rows] += 1
            total = self.logs[rows].sum(0)
            best = int(total.argmax())
            out.append((self.model.languages[best], float(1 / np.exp(total - total[best]).sum())))
        return out

    def _forget(self) -> None:
        """Keep the half of the cache that most texts used."""
        kept = np.argsort(-self.uses, kind="stable")[:CACHED_WORDS // 2]
        words = list(self.row)
        self.row = {words[i]: k for k, i in enumerate(kept)}
        self.logs, self.uses = self.logs[kept], np.zeros(len(kept), int)


def languages(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every document.

    Defined cases: a null text and a text without letters are `und` with score 0,
    and so is all if no language was learned; equal posteriors go to the first
    language by name; numerals like a half or a circled one are no letters; a text of
    any length is read whole; repeated rows each give a row; an empty table gives none;
    other columns are not read.
    """
    id_type = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                found = scorer.texts(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                    ["doc_id", "lang_pred", "score"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double")
