"""Token ids in a byte-aligned variable-length file format.

Format: Parquet rows of one block each, in ascending (shard, block) and, within
them, ascending document order.  A block holds the ids of whole documents:

    ranks    the block's distinct ids by falling frequency, unsigned 32-bit little-endian
    control  two bits for each id, four ids a byte, lowest bits first: bytes of its rank, less one
    data     the ranks, each in 1 to 4 bytes, little-endian, without gaps
    doc_ids, lengths   the documents of the block and their numbers of ids

An id is written as its rank in its own block, so the most frequent 256 ids take
one byte and nearly all others two; counting by block makes it one pass over the
ids, and any block can be read alone.  Decoding looks up the four lengths of each
control byte in a table of 256 rows and gathers the bytes with numpy.

Texts are moved once, by ranges of their order (the place in the input parts
equal ids, so no id is too frequent for a range).  In a task, texts are cut into
pre-tokens by numpy over the bytes of many documents; a table of known
pre-tokens, kept by the worker process, gives their ids, and only unknown ones go
to the tokenizers library.  Texts with characters for which the byte rules were
not made take the library's own way.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.llm.staging import stage_folder

# executors need not have this package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])

END_ID = 0
BLOCK_IDS = 1_000_000       # a block is closed by the document that reaches this many ids
CHUNK_BYTES = 1 << 20       # texts are cut into pre-tokens about so many bytes at a time
TABLE_BITS = 21             # slots of the table of known pre-tokens; at most half are used

BLOCKS = ("shard int, block int, n_ids long, ranks binary, control binary, data binary, doc_ids array<{id}>, lengths array<long>")

# ASCII and the Latin letters U+00C0 to U+024F: all bytes from 0x80 on are then letters
_plain = re.compile("[\t\n\r\x20-\x7eÀ-ÖØ-öø-ɏ]*").fullmatch
_OTHER, _LETTER, _DIGIT, _SPACE, _END = range(5)
_KIND = np.array([_END if b == 0 else _LETTER if b >= 128 or chr(b).isalpha() else _DIGIT if chr(b).isdigit()
                  else _SPACE if b in b" \t\n\r" else _OTHER for b in range(256)], np.uint8)
_TABLE = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)  # lengths by control byte


# --- variable-length coding -----------------------------------------------------------
def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit numbers."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[:len(ranks)] = extra
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    widest = int(extra.max(initial=0)) + 1
    cells = ranks.view(np.uint8).reshape(-1, 4)[:, :widest]
    return control.tobytes(), cells[np.arange(widest) <= extra[:, None]].tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    length = _TABLE[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(length, dtype=np.int64) - length
    raw = np.frombuffer(data, np.uint8)
    out = raw[at].astype("<u4")
    for k in (1, 2, 3):
        longer = np.flatnonzero(length > k)
        if not len(longer):
            break
        out[longer] |= raw[at[longer] + k].astype("<u4") << np.uint32(8 * k)
    return out


def encode_block(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """(ranks, control, data) of a block's ids; equally frequent ids rank in their own order."""
    count = np.bincount(ids)
    present = np.flatnonzero(count)
    by_rank = present[np.argsort(-count[present], kind="stable")]
    rank = np.zeros(len(count), np.uint32)
    rank[by_rank] = np.arange(len(by_rank))
    return by_rank.astype("<u4").tobytes(), *encode_ranks(rank[ids])


def decode_block(ranks: bytes, control: bytes, data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(ranks, "<u4")[decode_ranks(control, data, n)]


# --- tokenization ---------------------------------------------------------------------
def pre_tokens(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the pre-tokens of zero-ended plain texts (the zeros give none).

    Runs of letters, digits or other characters, each with one space before it;
    the spaces before that one; the last of several spaces where it is no plain
    space; and contractions, an apostrophe alone and the letters it goes with.
    """
    kind = _KIND[raw]
    starts = np.empty(len(raw), bool)
    starts[0] = True
    np.not_equal(kind[1:], kind[:-1], out=starts[1:])
    starts[1:] |= kind[1:] == _END
    space = kind == _SPACE
    last = np.flatnonzero(space[:-1] & ~space[1:] & (kind[1:] != _END))
    starts[last] = True
    starts[last[raw[last] == 32] + 1] = False
    # apostrophes that start a pre-token and stand alone before a letter
    mark = np.flatnonzero(raw[:-1] == 39)
    mark = mark[starts[mark] & (kind[mark + 1] == _LETTER)]
    if len(mark):
        after = np.pad(raw, (0, 2))
        a, b = after[mark + 1], after[mark + 2]
        n = np.where(np.isin(a, list(b"stmd")), 2, np.where(
            ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108)), 3, 0))
        mark, n = mark[n > 0], n[n > 0]
        starts[mark + 1] = False
        ends = mark + n
        starts[ends[kind[ends] == _LETTER]] = True
    at = np.flatnonzero(starts)
    size = np.diff(at, append=len(raw))
    kept = kind[at] != _END
    return at[kept], size[kept]


class Known:
    """Pre-tokens of up to 16 bytes and their ids: an open-addressing table searched by numpy.

    A key is the first and the last eight bytes (zero-filled) and the length,
    which is the whole pre-token.
    """

    def __init__(self):
        self.mask = (1 << TABLE_BITS) - 1
        self.clear()

    def clear(self) -> None:
        slots = self.mask + 1
        self.head, self.tail = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64)
        self.size, self.row = np.zeros(slots, np.uint8), np.zeros(slots, np.int32)
        self.used = 0
        self.first, self.count, self.pool = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32)
        self.rows = self.filled = 0

    def room(self) -> int:
        """Keys that may still be entered: half of the slots stay free, so a search always ends."""
        return (self.mask + 1) // 2 - self.used

    @staticmethod
    def keys(padded: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last eight bytes; `padded` has eight bytes more at both ends than `at` counts."""
        eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        cut = (8 * np.maximum(8 - size, 0)).astype(np.uint64)
        head = eight[at + 8].copy().view("<u8").reshape(-1) & (full >> cut)
        tail = eight[at + size].copy().view("<u8").reshape(-1) >> cut
        return head, tail

    def _slot(self, head, tail, size):
        h = (head ^ (tail * np.uint64(0x9E3779B97F4A7C15)) ^ (size.astype(np.uint64) << np.uint64(56))) * np.uint64(0xD6E8FEB86659FD93)
        return ((h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def find(self, head, tail, size) -> np.ndarray:
        """Row of each key, -1 where unknown."""
        slot = self._slot(head, tail, size)
        out = np.full(len(head), -1, np.int64)
        left = np.arange(len(head))
        while len(left):
            there = self.size[slot]
            same = (self.head[slot] == head[left]) & (self.tail[slot] == tail[left]) & (there == size[left])
            out[left[same]] = self.row[slot[same]]
            go_on = ~same & (there != 0)
            left, slot = left[go_on], (slot[go_on] + 1) & self.mask
        return out

    def add_ids(self, ids: list[list[int]]) -> np.ndarray:
        """New rows for lists of ids."""
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(n.sum()))
        while self.rows + len(ids) > len(self.first):
            self.first, self.count = np.pad(self.first, (0, len(self.first))), np.pad(self.count, (0, len(self.count)))
        while self.filled + len(flat) > len(self.pool):
            self.pool = np.pad(self.pool, (0, len(self.pool)))
        rows = np.arange(self.rows, self.rows + len(ids))
        self.pool[self.filled:self.filled + len(flat)] = flat
        self.first[rows], self.count[rows] = self.filled + np.cumsum(n) - n, n
        self.rows, self.filled = self.rows + len(ids), self.filled + len(flat)
        return rows

    def put(self, head, tail, size, rows) -> None:
        """Enter distinct unknown keys."""
        slot = self._slot(head, tail, size)
        left = np.arange(len(head))
        while len(left):
            free = self.size[slot] == 0
            # of several keys that want one free slot the last one gets it
            self.row[slot[free]] = left[free]
            won = free.copy()
            won[free] = self.row[slot[free]] == left[free]
            mine, at = left[won], slot[won]
            self.head[at], self.tail[at], self.size[at] = head[mine], tail[mine], size[mine]
            self.row[at] = rows[mine]
            left, slot = left[~won], (slot[~won] + 1) & self.mask
        self.used += len(head)


class Tokenizer:
    """Ids of texts, as the library gives them without added tokens."""

    def __init__(self, spec: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        self.library = tokenizers.Tokenizer.from_str(spec)
        self.library.no_padding()
        self.library.no_truncation()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.known = Known()

    def whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        plain = [i for i, t in enumerate(texts) if _plain(t) and not any(s in t for s in self.special)]
        rows, owner = self._rows([texts[i] for i in plain])
        chosen = set(plain)
        odd = [i for i in range(len(texts)) if i not in chosen]
        # a text that is not plain is one row of its own
        rows = np.concatenate([rows, self.known.add_ids([self.whole(texts[i]) for i in odd])])
        owner = np.concatenate([np.array(plain, np.int64)[owner], np.array(odd, np.int64)])
        if odd:
            order = np.argsort(owner, kind="stable")
            rows, owner = rows[order], owner[order]
        n = self.known.count[rows]
        ends = np.cumsum(n)
        take = np.repeat(self.known.first[rows] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.known.pool[take], np.bincount(owner, n, len(texts)).astype(np.int64)

    def _rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Row and text of each pre-token of plain texts."""
        if not self.known.room() or self.known.filled > 1 << 23:
            self.known.clear()
        rows, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        raws = [t.encode() + b"\0" for t in texts]
        i = 0
        while i < len(raws):
            k, size = i, 0
            while k < len(raws) and (k == i or size + len(raws[k]) <= CHUNK_BYTES):
                size += len(raws[k])
                k += 1
            joined = b"".join(raws[i:k])
            at, n = pre_tokens(np.frombuffer(joined, np.uint8))
            ends = np.cumsum(np.fromiter(map(len, raws[i:k]), np.int64, k - i))
            rows.append(self._known_rows(joined, at, n))
            owners.append(i + np.searchsorted(ends, at, "right"))
            i = k
        return np.concatenate(rows), np.concatenate(owners)

    def _known_rows(self, joined: bytes, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        head, tail = self.known.keys(np.frombuffer(b"\0" * 8 + joined + b"\0" * 8, np.uint8), at, n)
        row = np.full(len(at), -1, np.int64)
        short = np.flatnonzero(n <= 16)
        row[short] = self.known.find(head[short], tail[short], n[short])
        new = short[row[short] < 0]
        if len(new):
            new = new[np.lexsort((n[new], tail[new], head[new]))]
            differs = np.ones(len(new), bool)
            differs[1:] = (np.diff(head[new]) != 0) | (np.diff(tail[new]) != 0) | (np.diff(n[new]) != 0)
            first, back = new[differs], np.cumsum(differs) - 1
            rows = self.known.add_ids([x.ids for x in self.library.encode_batch_fast(
                [joined[a:a + k].decode() for a, k in zip(at[first].tolist(), n[first].tolist())], add_special_tokens=False)])
            # what no longer fits is not remembered, and goes to the library again if it comes again
            kept = first[:self.known.room()]
            self.known.put(head[kept], tail[kept], n[kept], rows[:len(kept)])
            row[new] = rows[back]
        long = np.flatnonzero(n > 16)
        if len(long):
            words = [joined[a:a + k].decode() for a, k in zip(at[long].tolist(), n[long].tolist())]
            row[long] = self.known.add_ids([x.ids for x in self.library.encode_batch_fast(words, add_special_tokens=False)])
        return row


def _kept_tokenizer(spec: str) -> Tokenizer:
    """The tokenizer of this worker process: its table outlives a task."""
    kept = sys.__dict__.setdefault("_corpuslens_tokenizers", {})
    key = zlib.crc32(spec.encode()), len(spec)
    if key not in kept:
        kept.clear()
        kept[key] = Tokenizer(spec)
    return kept[key]


# --- files ----------------------------------------------------------------------------
def write_ids(
    spark: SparkSession, documents: DataFrame, spec: str, folder: str | None = None, end_id: int = END_ID, block_ids: int = BLOCK_IDS,
) -> str:
    """Write the ids of all documents in ascending doc_id order; returns the folder.

    `spec` is the tokenizer file's JSON text.  Null ids come first; documents
    with one id follow each other as they lie in the input.  A null or empty text has
    the end id alone; a text of any length is whole in one block; an empty table gives
    no blocks; columns other than doc_id and text are not read.
    """
    id_type = documents.schema["doc_id"].dataType
    folder = folder or stage_folder(spark, "token-ids")
    rows = documents.select("doc_id", "text", F.monotonically_increasing_id().alias("place"))
    ordered = rows.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokenizer, shard = _kept_tokenizer(spec), TaskContext.get().partitionId()
        block, held, size = 0, [], 0

        def closed() -> pa.RecordBatch:
            ids = np.concatenate([x for _, _, x in held])
            ranks, control, data = encode_block(ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([len(ids)], pa.int64()),
                 pa.array([ranks], pa.binary()), pa.array([control], pa.binary()), pa.array([data], pa.binary()),
                 pa.array([[i for x, _, _ in held for i in x]], pa.list_(arrow_id)),
                 pa.array([[int(k) for _, y, _ in held for k in y]], pa.list_(pa.int64()))],
                ["shard", "block", "n_ids", "ranks", "control", "data", "doc_ids", "lengths"])

        arrow_id = None
        for batch in batches:
            arrow_id = batch.column("doc_id").type
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                ids, n = tokenizer.texts([t or "" for t in part.column("text").to_pylist()])
                # the end id after each document
                ids, n = np.insert(ids, np.cumsum(n), end_id), n + 1
                held.append((part.column("doc_id").to_pylist(), n, ids))
                size += len(ids)
                if size >= block_ids:
                    yield closed()
                    block, held, size = block + 1, [], 0
        if held:
            yield closed()

    ordered.select("doc_id", "text").mapInArrow(encode, BLOCKS.format(id=id_type.simpleString())).write.parquet(folder)
    return folder


def read_ids(spark: SparkSession, folder: str, ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids, of every document of written files.

    start counts the ids of all documents before it, as the files order them.
    """
    blocks = spark.read.parquet(folder)
    id_type = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    sizes = blocks.select("shard", "block", "n_ids")
    # two steps: a window over the blocks of a shard, and one over the shards
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = shards.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("shard_start"))
    inside = F.sum("n_ids").over(W.partitionBy("shard").orderBy("block")) - F.col("n_ids")
    starts = sizes.select("shard", "block", inside.alias("block_start")).join(before, "shard").select(
        "shard", "block", (F.col("block_start") + F.col("shard_start")).alias("first"))
    more = ", ids array<long>" if ids else ""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                value = lambda c: row[c].as_py()
                found = decode_block(value("ranks"), value("control"), value("data"), value("n_ids"))
                n = np.array(value("lengths"), np.int64)
                ends = np.cumsum(n)
                raw = memoryview(found.tobytes())
                crc = [zlib.crc32(raw[4 * (e - m):4 * e]) for e, m in zip(ends.tolist(), n.tolist())]
                columns = [row["doc_ids"].values, pa.array([value("shard")] * len(n), pa.int32()), pa.array([value("block")] * len(n), pa.int32()),
                           pa.array(ends - n), pa.array(n), pa.array(crc, pa.int64())]
                names = ["doc_id", "shard", "block", "offset", "n_tokens", "ids_crc32"]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(found.astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = blocks.mapInArrow(
        decode, f"doc_id {id_type}, shard int, block int, offset long, n_tokens long, ids_crc32 long" + more)
    return rows.join(starts, ["shard", "block"]).select(
        "doc_id", (F.col("first") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if ids else []))
