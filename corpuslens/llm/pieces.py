"""SentencePiece encoding of the merge type, without merging, and decoding.

Repeated merging of the best pair gives one exact segmentation.  It is found
here by backtracking: Aho-Corasick finds all pieces of the text at once; from
the left the longest piece is tried that may stand beside the one before it; if
none may, the position is marked as failed in a bitfield and the last piece is
replaced by its next shorter prefix.  Two pieces may stand together exactly if
merging their joined text again gives these two; the answers are kept.

The vocabulary is read through the library from a public model file; encoding
and decoding are done here.
"""

from __future__ import annotations

import codecs
import re
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

# executors need not have this package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPACE = "▁"
CACHED_UNITS, CACHED_PAIRS, LONGEST_CACHED = 200_000, 200_000, 64

# a text may be cut where no piece reaches across; the first of these that cuts no piece is used
_CUTS = [
    f"{SPACE}*[^\\W\\d_²³¹]+|{SPACE}*(?:[^\\w{SPACE}]|[\\d_²³¹])+|{SPACE}+",  # runs of letters and of other characters
    f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+",                                # words
    "(?s:.+)",
]


class Recent(dict):
    """A cache of two generations: a full one becomes the old one, from which what is used again returns."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value


@dataclass(frozen=True)
class Vocabulary:
    """Normal pieces with their scores, ids of the byte pieces, and the special ids."""

    pieces: dict[str, tuple[int, float]]
    byte_ids: tuple[int, ...]
    end_id: int
    unknown_id: int
    size: int


def read_vocabulary(path: str) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, byte_ids = {}, [-1] * 256
    for i in range(model.vocab_size()):
        if model.is_byte(i):
            byte_ids[int(model.id_to_piece(i)[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            pieces[model.id_to_piece(i)] = (i, model.get_score(i))
    return Vocabulary(pieces, tuple(byte_ids), model.eos_id(), model.unk_id(), model.vocab_size())


def merge(text: str, score: dict[str, float]) -> list[str]:
    """The definition: join the neighbours whose piece scores best, leftmost first, until none is left."""
    parts = list(text)
    while True:
        best = None
        for i in range(len(parts) - 1):
            s = score.get(parts[i] + parts[i + 1])
            if s is not None and (best is None or s > best[0]):
                best = (s, i)
        if best is None:
            return parts
        i = best[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


class Codec:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.score = {p: s for p, (_, s) in vocabulary.pieces.items()}
        # a piece that merging never makes cannot occur
        self.id = {p: i for p, (i, s) in vocabulary.pieces.items() if len(p) == 1 or merge(p, self.score) == [p]}
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in self.id), None) for p in self.id}
        cut = next(c for c in _CUTS if all(re.findall(c, p) == [p] for p in self.id))
        self.cut = re.compile(cut).findall
        self.letters = frozenset(p for p in self.id if len(p) == 1)
        self.bytes_of = [b""] * vocabulary.size
        for p, (i, _) in vocabulary.pieces.items():
            self.bytes_of[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(vocabulary.byte_ids):
            if i >= 0:
                self.bytes_of[i] = bytes([b])
        self.bytes_of[vocabulary.unknown_id] = " ⁇ ".encode()
        self.spaced = {i for p, (i, _) in vocabulary.pieces.items() if p.startswith(SPACE)}
        self.key = sha256(repr((sorted(vocabulary.pieces.items()), vocabulary.byte_ids, vocabulary.end_id)).encode()).hexdigest()
        self.start()

    def start(self) -> None:
        """The parts that each process builds for itself."""
        self.found = ahocorasick.Automaton()
        for p in self.id:
            self.found.add_word(p, len(p))
        self.found.make_automaton()
        self._units, self._pairs = Recent(CACHED_UNITS), Recent(CACHED_PAIRS)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("found", "cut", "_units", "_pairs")} | {"cut": self.cut.__self__.pattern}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.cut = re.compile(state["cut"]).findall

    # --- encoding -------------------------------------------------------------
    def encode(self, text: str | None) -> list[int]:
        """Ids of a text with the end id; null is the empty text."""
        if not text:
            return [self.vocabulary.end_id]
        known, out = self._units, []
        for unit in self.cut(SPACE + text.replace(" ", SPACE)):
            ids = known[unit]
            if ids is None:
                ids = self._unit_ids(unit)
                if len(unit) <= LONGEST_CACHED:
                    known.put(unit, ids)
            out.append(ids)
        ids = list(chain.from_iterable(out))
        ids.append(self.vocabulary.end_id)
        return ids

    def _unit_ids(self, unit: str) -> tuple[int, ...]:
        if unit in self.id:
            return (self.id[unit],)
        if self.letters.issuperset(unit):
            return tuple(map(self.id.__getitem__, self._backtrack(unit)))
        return tuple(chain.from_iterable(map(self._segment_ids, self._segments(unit))))

    def _segments(self, unit: str) -> Iterator[str]:
        """Runs of characters that are pieces, and single other characters."""
        start = 0
        for i, c in enumerate(unit):
            if c not in self.id:
                if i > start:
                    yield unit[start:i]
                yield c
                start = i + 1
        if start < len(unit):
            yield unit[start:]

    def _segment_ids(self, text: str) -> list[int]:
        if text not in self.id and len(text) == 1:
            ids = [self.vocabulary.byte_ids[b] for b in text.encode("utf-8", "surrogatepass")]
            return ids if -1 not in ids else [self.vocabulary.unknown_id]
        return [self.id[p] for p in self._backtrack(text)]

    def _backtrack(self, text: str) -> list[str]:
        n = len(text)
        longest = [0] * n
        for last, length in self.found.iter(text):
            if length > longest[last - length + 1]:
                longest[last - length + 1] = length
        pairs, shorter = self._pairs, self.shorter
        failed = bytearray(n // 8 + 1)  # bit i: what was tried before position i cannot be followed
        out: list[str] = []
        before, at, piece = None, 0, text[:longest[0]]
        while True:
            end = at + len(piece)
            if not failed[end >> 3] >> (end & 7) & 1:
                fits = before is None or pairs[before, piece]
                if fits is None:
                    fits = merge(before + piece, self.score) == [before, piece]
                    pairs.put((before, piece), fits)
                if fits:
                    out.append(piece)
                    if end == n:
                        return out
                    before, at, piece = piece, end, text[end:end + longest[end]]
                    continue
            if shorter[piece]:
                piece = shorter[piece]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()  # it ends at the failed position, so it is cut next
                at -= len(piece)
                before = out[-1] if out else None

    # --- decoding -------------------------------------------------------------
    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids: spaces for their mark, bytes joined, one replacement mark for each byte that is no UTF-8.

        The space before the first piece is the one that encoding adds.
        """
        ids = list(ids)
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = _by_byte(raw)
        first = next((i for i in ids if self.bytes_of[i]), None)
        return text[1:] if first in self.spaced else text


def _by_byte(raw: bytes) -> str:
    out = []
    while raw:
        try:
            out.append(raw.decode())
            break
        except UnicodeDecodeError as e:
            out.append(raw[:e.start].decode() + "�")
            raw = raw[e.start + 1:]
    return "".join(out)


def _kept_codec(codec: Codec) -> Codec:
    """The codec of this worker process: its caches outlive a task."""
    kept = sys.__dict__.setdefault("_corpuslens_codecs", {})
    if codec.key not in kept:
        kept.clear()
        codec.start()
        kept[codec.key] = codec
    return kept[codec.key]


def encode_documents(documents: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, ids (array), decoded of every document.

    Defined cases: a null or empty text has the end id only and decodes to "";
    repeated rows each give a row; an empty table gives none; other columns are
    not read.
    """
    return _map(documents, vocabulary, "ids array<int>, decoded string", lambda ids, decoded: (
        [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], ["ids", "decoded"]))


def encode_digests(documents: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of what `encode_documents` gives."""
    names = [str(i) for i in range(vocabulary.size)]

    def digest(ids, decoded):
        joined = [" ".join(map(names.__getitem__, x)) for x in ids]
        return ([pa.array([len(x) for x in ids], pa.int64()), pa.array([sha256(x.encode()).hexdigest() for x in joined]),
                 pa.array([sha256(x.encode()).hexdigest() for x in decoded])], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return _map(documents, vocabulary, "n_tokens long, ids_sha256 string, decoded_sha256 string", digest)


_ROWS = 256  # documents whose ids are held at a time


def _map(documents: DataFrame, vocabulary: Vocabulary, shape: str, columns) -> DataFrame:
    id_type = documents.schema["doc_id"].dataType.simpleString()
    sent = Codec(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _kept_codec(sent)
        for batch in batches:
            for i in range(0, batch.num_rows, _ROWS):
                part = batch.slice(i, _ROWS)
                ids = [codec.encode(t.as_py()) for t in part.column("text")]
                arrays, names = columns(ids, [codec.decode(x) for x in ids])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays], ["doc_id", *names])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, {shape}")
