"""Words and their hashes for whole Arrow batches, with numpy and no per-word Python.

Texts are handled as UTF-8 bytes. Both word classes of this subpackage are unions of byte
ranges (every byte of a non-ASCII character is a word byte), so words are runs of word bytes.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
#: Keeps the first 0 to 8 bytes of a little-endian word.
_LOW_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], _U)
#: Longer runs are hashed one by one.
LONG = 512
BATCH_ROWS = 300

#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of ``[^\x20\x09-\x0D]+``.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``: digits, a-z and non-ASCII (lower-case first).
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every input bit (the finalizer of splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty. Row i is bytes[offsets[i]:offsets[i+1]]."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def bounded_batches(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches of at most BATCH_ROWS texts: several long batches at once, on both sides
    of the pipe, would take more memory than all else in a worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    return spark


def _give_back() -> None:
    """Return freed memory to the system; a worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``most`` bytes of text; a longer text stands alone."""
    yield from _slices(batches, column, most)
    _give_back()


def _slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(at, to - at)
            at = to


class Words:
    """The words of a batch of texts: ``start``, ``end`` (byte places), ``row`` and ``hash`` of each,
    and ``first`` (first[i]:first[i+1] are the words of row i)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> None:
        self.data, self.offsets = data, offsets
        is_word = inside[data]
        before = np.empty_like(is_word)
        before[:1] = False
        before[1:] = is_word[:-1]
        after = np.empty_like(is_word)
        after[-1:] = False
        after[:-1] = is_word[1:]
        edges = offsets[1:-1]
        before[edges[edges < len(data)]] = False
        edges = edges[edges > 0] - 1
        after[edges] = False
        self.start = np.flatnonzero(is_word & ~before)
        self.end = np.flatnonzero(is_word & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(len(offsets) - 1), self.count)
        self.hash = byte_hashes(data, self.start, self.end)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first word, hash) of each run of k words within one row."""
        n = len(self.start) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, _U)
        whole = np.flatnonzero(self.row[:n] == self.row[k - 1 :])
        h = np.zeros(n, _U)
        for j in range(k):
            h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93) + self.hash[j : j + n]
        return whole, mix64(h[whole] + _U(k))

    def text(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The little-endian 64-bit word that starts at each byte, zeros after the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def byte_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte run data[start:end]; equal runs get equal hashes anywhere.

    Each eight bytes are mixed into the state by a bijection, so no algebra of the text's own
    pattern makes two runs agree; hashes of different seeds are independent. Runs of over LONG bytes are
    hashed by BLAKE2.
    """
    word = eight_bytes(data)
    size = end - start
    out = mix64(size.astype(_U) * _BASE + _U(seed * 0x632BE59BD9B4E019 % (1 << 64)))
    long = np.flatnonzero(size > LONG)
    for i in long.tolist():
        out[i] = _U(int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little"))
    left = np.flatnonzero((size > 0) & (size <= LONG))
    at, rest = start[left], size[left]
    while len(left):
        part = word[at]
        if (rest < 8).any():
            part = part & _LOW_BYTES[np.minimum(rest, 8)]
        out[left] = mix64((out[left] ^ part) * _BASE)
        more = rest > 8
        left, at, rest = left[more], at[more] + 8, rest[more] - 8
    return out


def words_of(column: pa.Array, inside: np.ndarray, lower: bool = False) -> Words:
    data, offsets = flat(column)
    return Words(LOWER[data] if lower else data, offsets, inside)
