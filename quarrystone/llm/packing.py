"""Packing of token sequences by bounded-space online best fit.

Each partition keeps a fixed number of open windows. A document is cut into full windows first; the rest of it
goes into the open window that it fills best. When none can take it, the fullest window is topped up with the
piece's beginning if more than `gap` tokens are left in it, and emitted; the piece's rest is placed again. So
no emitted window has over `gap` tokens of padding. When a partition ends, its open windows are left over:
`merge` partitions' leftovers at a time are packed once more with every window topped up in full, which
leaves at most one short window for each such group of partitions.

Documents are tokenised by white-space chunks: chunks go through a bounded cache. A missing chunk of Latin signs is
cut by the tokenizer's own pattern into pieces, which have a cache too and are merged by the tokenizer's model; any
other chunk, also one with the text of a special token, is encoded by the tokenizer as a whole. Its pattern never matches across a blank or a line feed, and its normaliser works on
signs that don't reach over them, so the ids are those of the whole text.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each; a text of any length is
packed whole; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import functools
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, n_partitions, small_batches

#: Chunks, and pieces of them, that one worker keeps before it starts afresh.
CHUNK_CACHE = 600_000

#: Chunks in which normalising means no more than lower case: no marks, no white space, no control signs.
PLAIN = regex.compile(r"[!-~\u00a1-\u017f]+")
#: The pattern of the tokenizer file (a fixed value): what it matches is encoded on its own.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

#: Signs that end most words; the pattern takes a run of them as one piece.
STOPS = ".,;:!?"

#: Sequence ids: the partition's number times this, plus the window's number in it.
SPAN = 1 << 36

COLUMNS = ["id", "doc_tokens", "start", "ids", "sequence_id", "offset", "leftover"]


@functools.cache
def visible() -> dict[int, str]:
    """The sign that stands for each byte in a byte-level vocabulary: itself where it is visible, else the next from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Known(dict):
    """What was encoded, at most `limit` entries; a missing one is encoded and kept, in place of all where it is full."""

    def __init__(self, encode: Callable[[str], bytes], limit: int):
        self.encode, self.limit = encode, limit

    def __missing__(self, text: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        got = self[text] = self.encode(text)
        return got


class ChunkTokenizer:
    """Ids of texts as little-endian unsigned 32-bit integers, by chunks between blanks and line feeds."""

    def __init__(self, path: str, end_id: int, limit: int = CHUNK_CACHE):
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        #: Texts that the tokenizer takes as tokens wherever they stand; none may hold what chunks are cut at.
        self.added = [t.content.lower() for t in self.encoder.get_added_tokens_decoder().values()]
        if any(" " in t or "\n" in t for t in self.added):
            raise ValueError("a token of several chunks")
        self.end = np.array([end_id], "<u4").tobytes()
        self.merge, self.table = self.encoder.model.tokenize, visible()
        self.known, self.pieces = Known(self.chunk, limit), Known(self.piece, limit)

    def piece(self, text: str) -> bytes:
        return array("I", [t.id for t in self.merge(text.encode().decode("latin-1").translate(self.table))]).tobytes()

    def chunk(self, text: str) -> bytes:
        low = text.lower()
        if PLAIN.fullmatch(text) and not any(t in low for t in self.added):
            stem = low.rstrip(STOPS)
            if stem.isalpha():  # letters, then perhaps stops: one piece each
                return self.pieces[stem] + self.pieces[low[len(stem) :]] if len(stem) < len(low) else self.pieces[stem]
            return b"".join(map(self.pieces.__getitem__, PIECE.findall(low)))
        return array("I", self.encoder.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def __call__(self, text: str | None) -> bytes:
        chunks = (text or "").replace("\n", " ").split(" ")
        return b"".join(map(self.known.__getitem__, chunks)) + self.end


@functools.lru_cache(maxsize=2)
def tokenizer(path: str, end_id: int) -> ChunkTokenizer:
    return ChunkTokenizer(path, end_id)


class Packer:
    """Open windows of one partition: at most `windows`, each a list of pieces (id, doc_tokens, start, ids)."""

    def __init__(self, window: int, windows: int, gap: int, first: int):
        self.window, self.windows, self.gap, self.next = window, windows, gap, first
        self.open: list[list[tuple]] = []
        self.room: list[int] = []
        self.done: list[tuple] = []

    def emit(self, pieces: list[tuple], leftover: bool = False) -> None:
        offset = 0
        for doc, total, start, ids in pieces:
            self.done.append((doc, total, start, ids, self.next, offset, leftover))
            offset += len(ids) // 4
        self.next += 1

    def add(self, doc, total: int, start: int, ids: bytes) -> None:
        """Place a piece; what fills whole windows is cut off first."""
        whole = self.window * 4
        while len(ids) >= whole:
            self.emit([(doc, total, start, ids[:whole])])
            start, ids = start + self.window, ids[whole:]
        while ids:
            need = len(ids) // 4
            best = min((r, i) for i, r in enumerate(self.room) if r >= need) if any(r >= need for r in self.room) else None
            if best:
                room, at = best
                self.open[at].append((doc, total, start, ids))
                self.room[at] = room - need
                if room == need:
                    self.close(at)
                return
            if len(self.open) < self.windows:
                self.open.append([(doc, total, start, ids)])
                self.room.append(self.window - need)
                return
            at = min(range(len(self.room)), key=self.room.__getitem__)
            if self.room[at] > self.gap:
                cut = self.room[at] * 4
                self.open[at].append((doc, total, start, ids[:cut]))
                start, ids = start + self.room[at], ids[cut:]
            self.close(at)

    def close(self, at: int) -> None:
        self.emit(self.open.pop(at))
        self.room.pop(at)

    def finish(self, leftover: bool) -> None:
        while self.open:
            self.emit(self.open.pop(), leftover)
            self.room.pop()

    def taken(self) -> pd.DataFrame:
        out, self.done = self.done, []
        return pd.DataFrame(out, columns=COLUMNS)


def pack(
    df: DataFrame,
    path: str,
    window: int = 2048,
    end_id: int = 1,
    windows: int = 64,
    gap: int = 16,
    merge: int = 32,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: id, doc_tokens, start, ids (little-endian unsigned 32-bit), sequence_id, offset.

    The first pass is written to shared storage, so that a lost executor can't deal pieces anew.
    """
    spark = df.sparkSession
    small_batches(spark)
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, doc_tokens long, start long, ids binary, sequence_id long, offset long, leftover boolean"

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokenizer(path, end_id)
        packer = Packer(window, windows, gap, TaskContext.get().partitionId() * SPAN)
        for pdf in batches:
            for doc, text in zip(pdf["id"], pdf["text"]):
                ids = encode(text)
                packer.add(doc, len(ids) // 4, 0, ids)
            yield packer.taken()
        packer.finish(True)
        yield packer.taken()

    picked = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    passed = materialise(picked.mapInPandas(first, schema), "packed")

    def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer, now = Packer(window, 1, 0, 0), None
        for pdf in batches:
            for group, doc, total, start, ids in zip(pdf["group"], pdf["id"], pdf["doc_tokens"], pdf["start"], pdf["ids"]):
                if group != now:
                    packer.finish(False)
                    # Numbers of the second pass are negative: no partition of the first has them.
                    now, packer.next = group, -(group + 1) * SPAN
                packer.add(doc, total, start, ids)
            yield packer.taken()
        packer.finish(False)
        yield packer.taken()

    left = (
        passed.filter("leftover")
        .withColumn("group", F.floor(F.col("sequence_id") / F.lit(SPAN * merge)))
        .repartition(n_partitions(spark), "group")
        .sortWithinPartitions("group", "sequence_id", "offset")
    )
    merged = left.mapInPandas(last, schema)
    out = passed.filter("NOT leftover").unionByName(merged)
    return out.drop("leftover").withColumnRenamed("id", id_col)


def digests(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The pieces with their length and the CRC-32 of their ids in place of the ids."""
    return pieces.select(
        id_col,
        "start",
        (F.octet_length("ids") / 4).cast("long").alias("length"),
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )
