"""Near-duplicate texts: ProbMinHash signatures, banding, exact verification, classes.

A text is the weighted set of its shingles of five words (lower-cased, as in the
benchmark search; a shorter text is one shingle), with weight 1 + ln(count).  Two
texts are near duplicates if their probability Jaccard similarity

    J(x, y) = sum over i of 1 / sum over j of max(x_j / x_i, y_j / y_i)

is at least 0.8; without repeated shingles this is the Jaccard similarity.

1. Sketch (a map).  Every shingle is a Poisson process of arrivals, with its
   weight as rate, seeded by its hash; each arrival falls on one of 320 registers,
   which keep the earliest shingle.  Rounds of arrivals stop for a shingle as soon
   as its next one is later than all registers of its text.  Two texts agree in a
   register with probability J.  Texts with equal words get one 64-bit content id,
   so exact copies are one node from here on.
2. Bands.  32 bands of 5 of the registers: a pair at 0.8 misses all with probability
   3e-6.  In each band bucket every text is compared with two texts of it, those
   with the smallest and the largest id: a star, not all pairs.
3. Links are verified by J of the whole texts, and give components.
4. The rest.  Buckets that still hold several components are searched for pairs
   between components in blocks of about `BLOCK` texts, by numpy inside the
   tasks; only pairs that agree in so many registers as all but 4e-6 of the pairs
   at 0.8 do leave the task.  They are verified where their block's texts are sent
   once, not once for each pair, and join the links.  No bucket is cut.
5. Components are labels that spread along the links, written every round.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm.decontamination import normal_words
from corpuslens.llm.staging import written

# executors need not have this package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE = 5
SIMILARITY = 0.8
REGISTERS, BANDS, ROWS = 320, 32, 5
AGREEING = 224   # registers: 4.5 standard deviations below those expected at 0.8
BLOCK, BLOCK_WORDS = 512, 2_000_000   # texts, and their words together, in a block

_u = np.uint64
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], _u)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> _u(30))) * _u(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _u(27))) * _u(0x94D049BB133111EB)
    return x ^ (x >> _u(31))


def word_hashes(joined: bytes) -> np.ndarray:
    """64-bit hashes of words that are parted, started and ended by one space."""
    raw = np.frombuffer(joined + b"\0" * 8, np.uint8)
    spaces = np.flatnonzero(raw == 32)
    start, size = spaces[:-1] + 1, np.diff(spaces) - 1
    eight = np.lib.stride_tricks.sliding_window_view(raw, 8)
    out = mixed(size.astype(_u))
    left = np.arange(len(start))
    done = 0
    while len(left):
        rest = size[left] - done
        cut = (8 * np.maximum(8 - rest, 0)).astype(_u)
        part = eight[start[left] + done].copy().view("<u8").reshape(-1) & (_u(0xFFFFFFFFFFFFFFFF) >> cut)
        out[left] = mixed(out[left] * _u(0x9E3779B97F4A7C15) ^ part)
        left = left[rest > 8]
        done += 8
    return out


class Texts:
    """Words of some texts as hashes, one after the other, and what is made of them."""

    def __init__(self, texts: list[str | None]):
        words = [normal_words(t) for t in texts]
        self.n = np.fromiter(map(len, words), np.int64, len(words))
        self.first = np.cumsum(self.n) - self.n
        self.hashes = word_hashes(b" " + b"".join(b" ".join(w) + b" " for w in words if w)) if self.n.any() else np.zeros(0, _u)

    def content_ids(self) -> list[int | None]:
        """64 bits of each text's sequence of words; None without words."""
        place = np.arange(len(self.hashes)) - np.repeat(self.first, self.n)
        parts = mixed(self.hashes ^ mixed(place.astype(_u)))
        total = np.concatenate([[_u(0)], np.cumsum(parts, dtype=_u)])
        ids = mixed(total[self.first + self.n] - total[self.first] + self.n.astype(_u)).view(np.int64)
        return [int(i) if n else None for i, n in zip(ids, self.n)]

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingle hashes of one text, ascending, and their weights."""
        h = self.hashes[self.first[k]:self.first[k] + self.n[k]]
        if len(h) < SHINGLE:
            if not len(h):
                return np.zeros(0, _u), np.zeros(0)
            return mixed((h * _MULTIPLIERS[:len(h)]).sum(dtype=_u, keepdims=True) + _u(len(h))), np.ones(1)
        m = len(h) - SHINGLE + 1
        total = h[:m] * _MULTIPLIERS[0]
        for j in range(1, SHINGLE):
            total += h[j:j + m] * _MULTIPLIERS[j]
        found, count = np.unique(mixed(total), return_counts=True)
        return found, 1 + np.log(count)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """For each weighted set, the element that arrives first in every register."""
    n = np.fromiter((len(h) for h, _ in sets), np.int64, len(sets))
    element = np.concatenate([h for h, _ in sets]) if len(sets) else np.zeros(0, _u)
    rate = np.concatenate([w for _, w in sets]) if len(sets) else np.zeros(0)
    owner = np.repeat(np.arange(len(sets)), n)
    time = np.zeros(len(element))
    best, who = np.full(len(sets) * registers, np.inf), np.zeros(len(sets) * registers, _u)
    arrival = 0
    while len(element):
        arrival += 1
        bits = mixed(element + _u(arrival * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        time -= np.log(((bits >> _u(16)).astype(float) + 0.5) * 2.0 ** -48) / rate
        register = ((bits & _u(0xFFFF)) * _u(registers) >> _u(16)).astype(np.int64)
        cell = owner * registers + register
        early = np.flatnonzero(time < best[cell])
        at, when = cell[early], time[early]
        np.minimum.at(best, at, when)
        won = when == best[at]
        who[at[won]] = element[early[won]]
        # a later arrival of an element cannot matter once this one is after all registers of its text
        latest = best.reshape(-1, registers).max(1)
        on = np.flatnonzero(time < latest[owner])
        element, rate, owner, time = element[on], rate[on], owner[on], time[on]
    return who.reshape(-1, registers)


def similarity(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard of two weighted sets with ascending elements."""
    _, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    a, b = x[1][i], y[1][j]
    order = np.argsort(a / b, kind="stable")
    a, b = a[order], b[order]
    only_x, only_y = x[1].sum() - a.sum(), y[1].sum() - b.sum()
    # elements with a larger ratio count by x_j / x_i, those with a smaller one by y_j / y_i; equal ratios agree
    from_here = np.cumsum(a[::-1])[::-1]
    before = np.cumsum(b) - b
    return float((1 / ((from_here + only_x) / a + (before + only_y) / b)).sum())


_LONG, _LONGS = pa.int64(), pa.list_(pa.int64())
_PART = 500      # texts sketched at a time ...
_PART_CHARS = 1 << 21   # ... if they are not longer than this together


def _parts(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of a batch with their texts."""
    size, at, texts = 0, 0, []
    for i, value in enumerate(batch.column(column)):
        text = value.as_py()
        if texts and (len(texts) == _PART or size + len(text or "") > _PART_CHARS):
            yield batch.slice(at, i - at), texts
            size, at, texts = 0, i, []
        texts.append(text)
        size += len(text or "")
    if texts:
        yield batch.slice(at), texts


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    band = mixed(np.arange(BANDS, dtype=_u) + _u(1))
    for batch in batches:
        for part, texts in _parts(batch, "text"):
            t = Texts(texts)
            who = signatures([t.shingles(k) for k in range(len(texts))])
            keys = np.repeat(band[None, :], len(texts), 0)
            rows = who[:, :BANDS * ROWS].reshape(len(texts), BANDS, ROWS)
            for r in range(ROWS):
                keys = mixed(keys * _u(0x9E3779B97F4A7C15) ^ rows[:, :, r])
            low = (mixed(who) >> _u(56)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_hash"), pa.array(t.content_ids(), _LONG), pa.array(t.n, _LONG),
                 pa.array(list(keys.view(np.int64)), _LONGS), pa.array([s.tobytes() for s in low], pa.binary())],
                ["doc_id", "text_hash", "id", "n_words", "bands", "registers"])


def _own_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose text has the content id that is looked for."""
    for batch in batches:
        for part, texts in _parts(batch, "text"):
            ids = pa.array(Texts(texts).content_ids(), _LONG)
            keep = pa.array([a is not None and a == b for a, b in zip(ids.to_pylist(), part.column("id").to_pylist())])
            yield part.select(["id", "text"]).filter(keep)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        known: dict[int, tuple] = {}
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        good = []
        for i, pair in enumerate(zip(a, b)):
            sets = []
            for node, column in zip(pair, ("text_a", "text_b")):
                if node not in known:
                    if len(known) > 64:
                        known.clear()
                    known[node] = Texts([batch.column(column)[i].as_py()]).shingles(0)
                sets.append(known[node])
            if similarity(*sets) >= SIMILARITY - 1e-9:
                good.append(i)
        yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in good], _LONG), pa.array([b[i] for i in good], _LONG)], ["a", "b"])


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that agree in enough registers."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, REGISTERS) for c in ("registers_a", "registers_b"))
        yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(1) >= AGREEING))


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Likely pairs of different components inside (band, i, j) groups, which arrive one after the other.

    A pair of several common bands leaves in one of them, which its ids pick.
    Rows are (band, i, j, a, partners): one for each text with likely partners,
    at most a block of them, and one with null partners for each text that its
    cell has to see.
    """
    def rows():
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("band", "i", "j", "own", "id", "component", "registers", "bands")]
            yield from zip(*columns)

    out: list[tuple] = []

    def full() -> pa.RecordBatch:
        columns = zip(*out) if out else [()] * 5
        return pa.RecordBatch.from_arrays(
            [pa.array(c, kind) for c, kind in zip(columns, (_LONG, pa.int32(), pa.int32(), _LONG, _LONGS))], ["band", "i", "j", "a", "partners"])

    for (band, i, j), group in groupby(rows(), key=lambda r: r[:3]):
        group = list(group)
        left = [r for r in group if r[3] == i]
        right = [r for r in group if r[3] == j] if i != j else left
        ids = np.array([r[4] for r in right], np.int64)
        component = np.array([r[5] for r in right], np.int64)
        registers = np.frombuffer(b"".join(r[6] for r in right), np.uint8).reshape(-1, REGISTERS)
        bands = np.array([r[7] for r in right], np.int64)
        here = int(np.flatnonzero(bands[0] == band)[0])
        seen: set[int] = set()
        for k, r in enumerate(left):
            other = np.flatnonzero(component != r[5])
            if i == j:
                other = other[other > k]
            if len(other):
                agree = (registers[other] == np.frombuffer(r[6], np.uint8)).sum(1)
                other = other[agree >= AGREEING]
                common = bands[other] == np.array(r[7], np.int64)
                turn = (mixed((ids[other] ^ np.int64(r[4])).view(_u)) % common.sum(1).astype(_u)).astype(np.int64)
                picked = common[:, here] & (common[:, :here].sum(1) == turn)
                if picked.any():
                    partners = ids[other[picked]].tolist()
                    out.append((band, i, j, r[4], partners))
                    seen.update(partners, [r[4]])
        out += [(band, i, j, x, None) for x in seen]
        if len(out) >= 10_000:
            yield full()
            out = []
    yield full()


def _verify_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of partners, whose rows follow the texts of their (band, i, j) cell."""
    cell, texts, sets, held = None, {}, {}, 0
    for batch in batches:
        good: list[tuple[int, int]] = []
        columns = [batch.column(c).to_pylist() for c in ("band", "i", "j", "a", "partners")]
        for k, (band, i, j, a, partners) in enumerate(zip(*columns)):
            if cell != (band, i, j):
                cell, texts, sets, held = (band, i, j), {}, {}, 0
            if partners is None:
                texts[a] = batch.column("text")[k].as_py()
                continue
            own = Texts([texts[a]]).shingles(0)
            for b in partners:
                if b not in sets:
                    if held > BLOCK_WORDS:
                        sets, held = {}, 0
                    sets[b] = Texts([texts[b]]).shingles(0)
                    held += len(sets[b][0])
                if similarity(own, sets[b]) >= SIMILARITY - 1e-9:
                    good.append((a, b))
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in good], _LONG), pa.array([b for _, b in good], _LONG)], ["a", "b"])


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """id, component (its smallest id) of every node of links(a, b), by labels that spread and jump."""
    ways = written(spark, links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = written(spark, ways.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select(
        "id", F.least("id", "m").alias("label")), "labels")
    while True:
        near = ways.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        spread = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("new"))
        # the label's own label, as it was before this round
        jump = spread.join(labels.select(F.col("id").alias("new"), F.col("label").alias("far")), "new").select(
            "id", F.least("new", "far").alias("label"), (F.least("new", "far") != F.col("label")).alias("changed"))
        moved = written(spark, jump, "labels")
        labels = moved.select("id", "label")
        if not moved.filter("changed").limit(1).count():
            return labels.withColumnRenamed("label", "component")


def near_duplicates(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """doc_id, class_id (smallest doc_id of its class), class_size of every document.

    Defined cases: texts with equal words are copies; null texts and texts
    without words are alike to none and stand alone; a class whose ids are all
    null has the class_id null; repeated rows each give a row and count each in
    class_size; an empty table gives none; other columns are not read.  Content
    ids have 64 bits: among 10^9 different texts two are taken for copies with a
    probability of 3 percent.
    """
    id_type = documents.schema["doc_id"].dataType.simpleString()
    texts = documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    sketch = written(spark, texts.mapInArrow(_sketch, f"doc_id {id_type}, text_hash long, id long, n_words long, bands array<long>, registers binary"), "sketch")
    # band buckets with several texts
    cells = sketch.filter("id IS NOT NULL").select("id", "n_words", F.explode("bands").alias("band"))
    buckets = cells.groupBy("band").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low <> high")
    members = written(spark, cells.join(buckets, "band").select("band", "id", "n_words", "low", "high").distinct(), "members")
    # what is known of the texts in them: the registers and the text, one row each
    nodes = members.select("id").distinct()
    # one row holds each text: of its copies that with the least doc_id, found by partial aggregates, so copies meet in no task;
    # joins are by the text as well, so neither copies of one text nor many texts of one doc_id are multiplied.
    # Always merge joins: the ids grow with the documents, so a broadcast on small tables would not show what large ones need
    copies = sketch.filter("id IS NOT NULL")
    least = written(spark, copies.groupBy("id").agg(F.min("doc_id").alias("at")).join(nodes, "id").withColumnRenamed("id", "node"), "least")
    rows = copies.join(least.hint("merge"), (F.col("id") == F.col("node")) & F.col("doc_id").eqNullSafe(F.col("at")))
    witness = written(spark, rows.groupBy("id").agg(
        F.first("registers").alias("registers"), F.first("bands").alias("bands"), F.first("at").alias("at"), F.min("text_hash").alias("hash")), "witness")
    registers = witness.select("id", "registers", "bands")
    found = texts.join(witness.select("id", "at", "hash").hint("merge"), F.col("doc_id").eqNullSafe(F.col("at")) & (
        F.col("text_hash") == F.col("hash"))).select("id", "text").mapInArrow(_own_text, "id long, text string")
    bodies = written(spark, found.groupBy("id").agg(F.first("text").alias("text")), "texts")

    def of(rows: DataFrame, side: str) -> DataFrame:
        return rows.select(F.col("id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in rows.columns if c != "id"])

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(of(bodies, "a"), "a").join(of(bodies, "b"), "b").select("a", "b", "text_a", "text_b")
        return both.mapInArrow(_verify, "a long, b long")

    ends = members.select("id", F.explode(F.array("low", "high")).alias("end")).filter("id <> end")
    stars = ends.select(F.least("id", "end").alias("a"), F.greatest("id", "end").alias("b")).distinct()
    signs = registers.select("id", "registers")
    stars = stars.join(of(signs, "a"), "a").join(of(signs, "b"), "b").select("a", "b", "registers_a", "registers_b").mapInArrow(
        _likely, "a long, b long")
    stars = written(spark, stars, "stars")
    links = written(spark, verified(stars), "star-links")
    first = components(spark, links)
    # buckets that still hold several components
    placed = written(spark, members.select("band", "id", "n_words").join(first, "id", "left").select(
        "band", "id", "n_words", F.coalesce("component", "id").alias("component")), "placed")
    open_ = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.greatest(
        F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_words") / BLOCK_WORDS)).cast("int").alias("blocks")).filter("low <> high").select("band", "blocks")
    own = placed.join(open_, "band").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # each text meets every block once, as the smaller or the larger one
    meets = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "component")
    dealt = meets.join(registers, "id").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    rest = written(spark, dealt.select("band", "i", "j", "own", "id", "component", "registers", "bands").mapInArrow(
        _between, "band long, i int, j int, a long, partners array<long>"), "rest")
    sent = rest.filter("partners IS NULL").join(bodies.select(F.col("id").alias("a"), "text"), "a").select("band", "i", "j", "a", "partners", "text")
    asked = rest.filter("partners IS NOT NULL").withColumn("text", F.lit(None).cast("string"))
    by_cell = sent.unionByName(asked).repartition("band", "i", "j").sortWithinPartitions(
        "band", "i", "j", F.col("partners").isNotNull(), "a")
    more = written(spark, by_cell.mapInArrow(_verify_cells, "a long, b long"), "rest-links")
    final = components(spark, links.unionByName(more))
    rows = sketch.select("doc_id", "id").join(final, "id", "left").select(
        "doc_id", "id", F.coalesce("component", "id").alias("component"))
    classes = rows.filter("component IS NOT NULL").groupBy("component").agg(
        F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    # written first: a join with the aggregate itself could not be split where a class holds many rows
    classes = written(spark, classes, "classes")
    return rows.join(classes, "component", "left").select(
        "doc_id", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"))
