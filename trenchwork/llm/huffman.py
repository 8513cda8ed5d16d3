"""Canonical length-limited Huffman codes over token ids, packed and unpacked with numpy.

A run of ids is coded from the first bit of a byte on. Every ``STEP`` ids the bit offset within
the run is kept as a checkpoint, so that all pieces of a run, and of many runs, are decoded side
by side from one table of ``2 ** LIMIT`` entries.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LIMIT, STEP = 18, 512


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); 0 for ids that never occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    n = len(used)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols do not fit codes of {limit} bits")
    if n < 2:
        out[used] = 1
        return out
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    leaf_flags = []
    level = weight
    flags = np.ones(n, bool)
    for _ in range(limit - 1):
        leaf_flags.append(flags)
        half = len(level) // 2
        packages = level[0 : 2 * half : 2] + level[1 : 2 * half : 2]
        both = np.concatenate([weight, packages])
        rank = np.argsort(both, kind="stable")
        level, flags = both[rank], rank < n
    leaf_flags.append(flags)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for flags in reversed(leaf_flags):
        leaves = int(flags[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = lengths
    return out


@dataclass
class Code:
    """``length`` and ``code`` of each id; ``symbol`` and ``bits`` of each LIMIT-bit prefix."""

    length: np.ndarray
    code: np.ndarray
    symbol: np.ndarray
    bits: np.ndarray


def canonical(length: np.ndarray) -> Code:
    """Codes in the order of (length, id)."""
    used = np.flatnonzero(length)
    order = used[np.lexsort((used, length[used]))]
    widths = np.left_shift(np.int64(1), LIMIT - length[order])
    first = np.cumsum(widths) - widths
    code = np.zeros(len(length), np.uint32)
    code[order] = first >> (LIMIT - length[order])
    symbol, bits = np.zeros(1 << LIMIT, np.uint32), np.ones(1 << LIMIT, np.uint8)
    total = int(widths.sum())
    symbol[:total] = np.repeat(order, widths)
    bits[:total] = np.repeat(length[order], widths)
    return Code(length.astype(np.uint8), code, symbol, bits)


def encode(code: Code, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of ``counts`` ids each, one after another. Returns (bytes, bytes of each run,
    checkpoints, checkpoints of each run)."""
    size = code.length[ids].astype(np.int64)
    ends = np.cumsum(size)
    last = np.cumsum(counts)
    sums = np.concatenate([[0], ends])
    run_bits = sums[last] - sums[last - counts]
    run_bytes = -(-run_bits // 8)
    base = np.cumsum(run_bytes) - run_bytes
    shift = np.repeat(8 * base - sums[last - counts], counts)
    at = ends - size + shift
    out = np.zeros(int(run_bytes.sum()) + 4, np.uint8)
    if len(ids):
        place = at >> 3
        value = code.code[ids] << (32 - size - (at & 7)).astype(np.uint32)
        firsts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        merged, place = np.bitwise_or.reduceat(value, firsts), place[firsts]
        for k in range(4):
            out[place + k] |= (merged >> np.uint32(24 - 8 * k)).astype(np.uint8)
    marks = -(-counts // STEP)
    run = np.repeat(np.arange(len(counts)), marks)
    within = (np.arange(len(run)) - np.repeat(np.cumsum(marks) - marks, marks)) * STEP
    places = at[(last - counts)[run] + within] - 8 * base[run] if len(ids) else np.zeros(0, np.int64)
    return out[:-4], run_bytes, places.astype(np.uint32), marks


def decode(code: Code, data: np.ndarray, run_bytes: np.ndarray, counts: np.ndarray, checkpoints: np.ndarray) -> np.ndarray:
    """The ids of all runs, one after another; every checkpoint is a lane of its own."""
    marks = -(-counts // STEP)
    run = np.repeat(np.arange(len(counts)), marks)
    within = (np.arange(len(run)) - np.repeat(np.cumsum(marks) - marks, marks)) * STEP
    left = np.minimum(STEP, counts[run] - within)
    base = np.cumsum(run_bytes) - run_bytes
    at = 8 * base[run] + checkpoints.astype(np.int64)
    to = (np.cumsum(counts) - counts)[run] + within
    order = np.argsort(-left, kind="stable")
    left, at, to = left[order], at[order], to[order]
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint32)
    word = (padded[:-3] << np.uint32(24)) | (padded[1:-2] << np.uint32(16)) | (padded[2:-1] << np.uint32(8)) | padded[3:]
    out = np.zeros(int(counts.sum()), np.uint32)
    mask = np.uint32((1 << LIMIT) - 1)
    for step in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -step, "left"))
        bit = at[:n]
        prefix = (word[bit >> 3] >> (32 - LIMIT - (bit & 7)).astype(np.uint32)) & mask
        out[to[:n] + step] = code.symbol[prefix]
        at[:n] += code.bits[prefix]
    return out
