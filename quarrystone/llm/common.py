"""What the operators of this subpackage share: shared storage, batch sizes, word hashing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession

from ..sources.storage import discard, materialise, reclaim, shared_dir

__all__ = ["WordHashes", "discard", "materialise", "mix64", "n_partitions", "reclaim", "shared_dir", "shingles", "small_batches"]

#: Bytes in an Arrow batch on its way to a worker; a longer text is a batch of its own.
BATCH_BYTES = 4 << 20

#: A-Z to a-z, and every other word space to a space, on UTF-8 bytes.
LOWER_BYTES = bytes(
    32 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256)
)

def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Bound the bytes of this session's Arrow batches, so that very long texts fit a worker.

    Plans read the setting when they run, which is after the operator has returned, so it stays; one that is
    lower already is left alone.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).removesuffix("b")) > most:
        spark.conf.set(key, str(most))


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """64-bit hashes of a text's words, lower-cased A-Z, all at once and without a table of words.

    A word's hash is a polynomial modulo 2^64 whose coefficients are random numbers for its bytes, mixed with its
    length. Sums run over the whole text; a word's is the difference of two, brought back to its first power. A text
    is taken in blocks that end between words, so memory is bounded by `block` or by its longest word.
    """

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, block: int = 1 << 18):
        self.block = block
        self.of = np.random.default_rng(11).integers(0, 2**64 - 1, 256, dtype=np.uint64, endpoint=True)
        self.grow(1 << 14)

    def grow(self, n: int) -> None:
        """Powers of the base and of its inverse, n of each."""
        self.powers, self.back = np.ones(n, np.uint64), np.ones(n, np.uint64)
        for powers, base in ((self.powers, self.BASE), (self.back, pow(self.BASE, -1, 2**64))):
            powers[1:] = base
            np.multiply.accumulate(powers, out=powers)

    def __call__(self, text: str | None) -> np.ndarray:
        data = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES)
        out, at = [], 0
        while len(data) - at > self.block:
            end = data.rfind(b" ", at, at + self.block) + 1 or data.find(b" ", at + self.block) + 1 or len(data)
            out.append(self.hashes(data[at:end]))
            at = end
        out.append(self.hashes(data[at:]))
        return out[0] if len(out) == 1 else np.concatenate(out)

    def hashes(self, data: bytes) -> np.ndarray:
        n = len(data)
        if n > len(self.powers):
            self.grow(max(n, 2 * len(self.powers)))
        signs = np.frombuffer(data, np.uint8)
        inside = np.zeros(n + 2, bool)
        np.not_equal(signs, 32, out=inside[1:-1])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        first, last = edges[::2], edges[1::2]
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.of[signs] * self.powers[:n], out=total[1:])
        return mix64((total[last] - total[first]) * self.back[first] + (last - first).astype(np.uint64))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k words in a row; with fewer words, one hash of the whole sequence; none for none."""
    n = len(words)
    if not n:
        return words
    span = min(k, n)
    out = mix64(words[: n - span + 1] + np.uint64(span))
    for j in range(1, span):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + words[j : n - span + 1 + j])
    return out
