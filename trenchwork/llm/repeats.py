"""Hashes that stand in two documents or more, as a bitmap of bounded size.

Tasks send sorted, packed runs of 40-bit hashes to the partition of their segment, where they are
merged; every hash of the table is counted, and only set bits come back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..store import materialize

MOST_BITS = 1 << 29

#: From the batches of a task to (hashes, row numbers that tell the task's documents apart).
Hashes = Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray]]]


def bits_for(total_bytes: int) -> int:
    """Bits of the map for texts of so many bytes, MOST_BITS at most."""
    return min(MOST_BITS, max(1 << 22, 1 << (max(1, total_bytes // 4) - 1).bit_length()))


def segments_for(total_bytes: int) -> int:
    """Segments for texts of so many bytes: 256 or more, about 32 MB of text each, at most 2^16 (a segment then has
    at most 2^24 distinct 40-bit hashes)."""
    return min(1 << 16, max(256, 1 << (max(1, total_bytes >> 25) - 1).bit_length()))


def _pack(values: np.ndarray) -> bytes:
    """Sorted 40-bit values as planes of the bytes of their gaps; the high planes are mostly zero."""
    gaps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return gaps.view(np.uint8).reshape(-1, 8)[:, :5].T.tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(5, -1)
    gaps = np.zeros((planes.shape[1], 8), np.uint8)
    gaps[:, :5] = planes.T
    return np.cumsum(gaps.view("<u8")[:, 0], dtype=np.uint64)


def _lists(docs: DataFrame, hashes: Hashes, segments: int) -> DataFrame:
    """(segment, once, more): the 40-bit hashes that a task saw in one document and in several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            value, row = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            order = np.argsort(value)
            value, row = value[order], row[order]
            first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
            several = np.maximum.reduceat(row, first) != np.minimum.reduceat(row, first)
            distinct = value[first]
            bounds = np.searchsorted(distinct >> np.uint64(40 - (segments.bit_length() - 1)), np.arange(segments + 1, dtype=np.uint64))
            rows = [(i, distinct[a:b], several[a:b]) for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])) if b > a]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([_pack(r[1][~r[2]]) for r in rows], pa.binary()), pa.array([_pack(r[1][r[2]]) for r in rows], pa.binary())], ["segment", "once", "more"])

        for value, row in hashes(batches):
            held.append((value >> np.uint64(24), row))
            size += len(value)
            if size > 1_000_000:
                yield from out()
                held, size = [], 0
        if size:
            yield from out()

    return docs.mapInArrow(run, "segment int, once binary, more binary")


def repeated(docs: DataFrame, hashes: Hashes, total_bytes: int) -> np.ndarray:
    """The bitmap (packed) of the hashes that stand in two documents or more, for texts of so many bytes."""
    bits, segments = bits_for(total_bytes), segments_for(total_bytes)
    each = bits // segments
    shift = 40 - (bits.bit_length() - 1)
    within = np.uint64((1 << (40 - (segments.bit_length() - 1))) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list[np.ndarray]] = {}
        found: dict[int, np.ndarray] = {}

        def merge(s: int) -> None:
            value = np.sort(np.concatenate(seen[s]))
            twice = value[1:][value[1:] == value[:-1]]
            found.setdefault(s, np.zeros(each, bool))[((twice & within) >> np.uint64(shift)).astype(np.int64)] = True
            seen[s] = [value[np.concatenate([[True], value[1:] != value[:-1]])]] if len(value) else []

        for batch in batches:
            for s, once, more in zip(*(batch.column(c).to_pylist() for c in ("segment", "once", "more"))):
                more = _unpack(more)
                of = seen.setdefault(s, [])
                of += [_unpack(once), more, more]
                if sum(map(len, of[1:])) > 2 * len(of[0]) + 500_000:
                    merge(s)
        for s in seen:
            merge(s)
            yield pa.record_batch([pa.array([s], pa.int32()), pa.array([np.packbits(found[s]).tobytes()])], ["segment", "bits"])

    parts = _lists(docs, hashes, segments).repartition(segments, "segment").mapInArrow(run, "segment int, bits binary")
    out = np.zeros(bits // 8, np.uint8)
    # At most MOST_BITS / 8 bytes reach the driver, one segment at a time.
    for r in materialize(parts, "repeated").toLocalIterator():
        out[r["segment"] * each // 8 : (r["segment"] + 1) * each // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def stands_in(bitmap: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Which hashes have their bit set."""
    at = (value >> np.uint64(64 - ((len(bitmap) * 8).bit_length() - 1))).astype(np.int64)
    return (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
