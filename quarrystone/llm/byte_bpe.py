"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

The pattern  's|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^space L N]+|space+(?!not space)|space+  is a finite
automaton once each code point carries its class and one look-ahead. A symbol is then a transition function
on the automaton's states, and functions compose associatively: texts are cut into rows of equal length,
the rows' functions are composed for all rows at once, the states at the rows' starts follow by one scan
over the rows, and a second pass over the columns marks where slices begin. No regex is run.

Each slice goes through a bounded cache of merged slices; what is missing is merged by rank, slice by slice.
Byte offsets of the ids are kept, so any range of ids can be decoded and found again in its text.

Defined cases: a null or empty text has no ids and decodes to nothing; repeated rows are encoded each;
texts are never cut; an empty table gives an empty result; only the id and text columns are looked at.
"""

from __future__ import annotations

import base64
import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# States: nothing open, in letters, in numbers, in other signs, in white space, behind a space that belongs
# to what follows, and with one or two letters of a contraction to come.
START, LETTERS, NUMBERS, OTHERS, SPACES, PREFIX, ONE_MORE, TWO_MORE = range(8)
# Symbols: letter, number, other sign, apostrophe of a contraction of 2 or 3 signs, the space before a
# sign, other white space before a sign, white space before white space or the end, the end of a text.
L, N, O, A2, A3, SPACE_LAST, WHITE_LAST, WHITE, END = range(9)

#: Code points of a row of the scan.
ROW = 256

#: Merged slices that one worker keeps before it starts afresh.
SLICE_CACHE = 600_000

#: Code points that are scanned at once, so that the arrays stay in the processor's caches.
CHUNK = 200_000

#: Letters behind an apostrophe that make a contraction.
CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """For each symbol and state: the next state, and whether a slice begins here."""
    step = np.zeros((9, 8), np.uint8)
    begins = np.ones((9, 8), bool)
    run = {L: LETTERS, N: NUMBERS, O: OTHERS, A2: OTHERS, A3: OTHERS}
    for symbol, state in run.items():
        step[symbol, :] = state
        begins[symbol, [state, PREFIX]] = False
    for symbol, state in ((A2, ONE_MORE), (A3, TWO_MORE)):
        step[symbol, [s for s in range(8) if s not in (OTHERS, PREFIX)]] = state
    step[L, ONE_MORE], begins[L, ONE_MORE] = START, False
    step[L, TWO_MORE], begins[L, TWO_MORE] = ONE_MORE, False
    step[SPACE_LAST, :] = PREFIX
    step[WHITE_LAST, :] = START
    step[WHITE, :] = SPACES
    begins[WHITE, SPACES] = False
    step[END, :], begins[END, :] = START, False
    return step, begins


@functools.cache
def classes() -> np.ndarray:
    """Class of every code point: 0 letter, 1 number, 2 other, 3 white space."""
    out = np.full(0x110000, 2, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            out[cp] = 0
        elif kind == "N":
            out[cp] = 1
    # White_Space of Unicode.
    white = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    out[white] = 3
    return out


def symbols(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Symbols of code points; at ends (the texts' separators) stands END."""
    kind = classes()[points]
    after = np.empty_like(kind)
    after[:-1], after[-1] = kind[1:], 3
    is_end = np.zeros(len(points) + 1, bool)
    is_end[ends] = True
    out = kind.copy()
    white = kind == 3
    last = white & (after != 3) & ~is_end[1:]
    out[white] = WHITE
    out[last] = np.where(points[last] == 32, SPACE_LAST, WHITE_LAST)
    at = np.flatnonzero(points == 39)
    if len(at):
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        one, two = padded[at + 1], padded[at + 2]
        for c in CONTRACTIONS:
            hit = one == ord(c[0])
            if len(c) == 2:
                hit &= two == ord(c[1])
            out[at[hit]] = A2 if len(c) == 1 else A3
    out[ends] = END
    return out


def slice_starts(symbol: np.ndarray) -> np.ndarray:
    """Where slices begin, by a two-level scan of transition functions."""
    step, begins = tables()
    n = len(symbol)
    rows = -(-n // ROW)
    grid = np.full(rows * ROW, END, np.uint8)
    grid[:n] = symbol
    grid = np.ascontiguousarray(grid.reshape(rows, ROW).T)
    # Composed functions, as the state each of the eight states ends in, for all rows at once.
    flat, width = step.ravel(), np.uint8(8)
    function = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    for column in grid:
        function = flat[(column * width)[:, None] + function]
    # States at the rows' starts: a scan over rows.
    state = np.zeros(rows, np.uint8)
    now = START
    for i, f in enumerate(function.tolist()):
        state[i] = now
        now = f[now]
    mark = np.empty((ROW, rows), bool)
    starts = begins.ravel()
    for j, column in enumerate(grid):
        at = column * width + state
        mark[j] = starts[at]
        state = flat[at]
    return mark.T.ravel()[:n]


class Encoder:
    """Encodes batches of texts; keeps merged slices, as the bytes of their ids, in a bounded cache."""

    def __init__(self, path: str, limit: int = SLICE_CACHE):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.sizes[i] = len(token)
        # Merges pairs of one slice by rank; its pattern is never used here.
        self.merge = tiktoken.Encoding("slices", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.limit, self.known = limit, {}

    def learn(self, pieces: list[bytes]) -> None:
        if len(self.known) > self.limit:
            self.known.clear()
        known, merge = self.known, self.merge
        for p in pieces:
            if p not in known:
                known[p] = np.array(merge(p), "<u4").tobytes()

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        chunk: list[str] = []
        size = 0
        for t in texts:
            chunk.append(t or "")
            size += len(chunk[-1])
            if size >= CHUNK:
                out += self.chunk(chunk)
                chunk, size = [], 0
        return out + self.chunk(chunk) if chunk else out

    def chunk(self, raw: list[str]) -> list[bytes]:
        joined = "\0".join(raw) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        data = joined.encode("utf-8", "surrogatepass")
        ends = np.cumsum([len(t) + 1 for t in raw]) - 1
        begins = slice_starts(symbols(points, ends))
        begins[ends] = True
        cut = np.flatnonzero(begins)
        # A slice ends where the next begins or at its text's end; the separators are cut out again.
        texts_end = np.searchsorted(cut, ends)
        if len(data) == len(points):
            at = cut
        else:
            width = np.ones(len(points), np.int8)
            for limit in (0x80, 0x800, 0x10000):
                width += points >= limit
            at = (np.cumsum(width, dtype=np.int32) - width)[cut]
        at = at.tolist()
        pieces = [data[a:b] for a, b in zip(at, at[1:])]
        pieces.append(b"\0")
        first = 0
        out = []
        get = self.known.__getitem__
        for last in texts_end.tolist():
            own = pieces[first:last]
            try:
                out.append(b"".join(map(get, own)))
            except KeyError:
                self.learn(own)
                out.append(b"".join(map(get, own)))
            first = last + 1
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> list[bytes]:
    with open(path, "rb") as f:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    return [ranks.get(i, b"") for i in range(max(ranks) + 1)]


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (little-endian unsigned 32-bit integers) and offsets (bytes where each id's bytes begin, likewise)."""
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for pdf in batches:
            ids = enc(pdf["text"].tolist())
            size = [enc.sizes[np.frombuffer(i, "<u4")] for i in ids]
            yield pd.DataFrame(
                {
                    "id": pdf["id"],
                    "ids": ids,
                    "offsets": [(np.cumsum(s) - s).astype("<u4").tobytes() for s in size],
                }
            )

    picked = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInPandas(run, f"id {kind}, ids binary, offsets binary").withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """id, ids and decoded (bytes) of a table with ids."""
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = vocabulary(path)
        for pdf in batches:
            yield pdf.assign(decoded=[b"".join([words[i] for i in np.frombuffer(x, "<u4").tolist()]) for x in pdf["ids"]])

    picked = df.select(F.col(id_col).alias("id"), "ids")
    return picked.mapInPandas(run, f"id {kind}, ids binary, decoded binary").withColumnRenamed("id", id_col)
