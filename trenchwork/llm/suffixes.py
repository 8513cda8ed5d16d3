"""Exact substring deduplication by sorted sampled suffixes.

A byte is removed if a ``LENGTH``-byte string over it also starts in a document with a smaller
``doc_id``. As in suffix sorting with a difference cover, only a sample of the suffixes is named
and sorted, and every other one is placed by the bytes up to the next sampled one. The cover is
taken from the text itself: in each LENGTH-byte string the K-byte gram with the least hash is
sampled, so that equal strings have a sampled suffix at the same offset. (A cover of fixed
residues has the same property, but needs 19 % of all positions at this length; this one needs
7 %, and positions whose gram stands in one document only drop out before anything is sorted.)
Sampled suffixes meet in the partition of their name (the gram); the suffixes that start up to
LENGTH - K bytes before are keyed by their LENGTH-byte prefix, sorted, and adjacent ones compared.

Exact copies are settled first: only one copy goes on. Grams that stand in two documents or more
are found by counts over all documents and sent to the workers as a bitmap of
bounded size; its false positives cost rows, not correctness.

Defined results: a null text is empty; texts under LENGTH bytes keep every byte; rows with equal
doc_ids do not remove each other's bytes; null doc_ids count as larger than all others. doc_id
must be an integer. Only doc_id and text are read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import repeated, stands_in
from ..store import join_small, materialize
from .text import bounded_batches, eight_bytes, flat, mix64, pieces

LENGTH, K = 50, 24
AROUND = LENGTH - K
WIDTH = LENGTH + AROUND
NO_ID = (1 << 63) - 1
_ODD = np.uint64(0x9E3779B97F4A7C15)


def sampled(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, gram hashes) of the sampled suffixes of all rows."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = eight_bytes(data)
    h = np.full(n - K + 1, np.uint64(K))
    for i in range(0, K, 8):
        h = mix64((h ^ word[i : i + n - K + 1]) * _ODD)
    least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    width, want = 1, LENGTH - K + 1
    while width * 2 <= want:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < want:
        least = np.minimum(least[: -(want - width)], least[want - width :])
    whole = np.ones(len(least), bool)
    for end in offsets[1:-1].tolist():
        whole[max(0, end - LENGTH + 1) : end] = False
    at = (least[whole] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    place = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
    return place, h[place]


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    base = 0
    for batch in pieces(batches, "text", 1 << 20):
        data, offsets = flat(batch.column("text"))
        place, gram = sampled(data, offsets)
        yield gram, np.searchsorted(offsets, place, "right") - 1 + base
        base += batch.num_rows


_PLACE = np.dtype([("id", "<i8"), ("rid", "<i8"), ("at", "<i4")])


def _contexts(docs: DataFrame, bitmap) -> DataFrame:
    """(name, context, left, right, places): the bytes around repeated grams; a task puts equal ones together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            name, context, left, right, place = (np.concatenate([h[i] for h in held]) for i in range(5))
            key = mix64(name ^ (left.astype(np.uint64) << np.uint64(8)) ^ right.astype(np.uint64))
            for i in range(0, WIDTH - WIDTH % 8, 8):
                key = mix64(key + context[:, i : i + 8].copy().view(np.uint64)[:, 0])
            key = mix64(key + context[:, WIDTH - 8 :].copy().view(np.uint64)[:, 0])
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
            pick = order[first]
            counts = np.diff(np.append(first, len(order)))
            offsets = lambda sizes: pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            blob = lambda data, sizes: pa.Array.from_buffers(pa.binary(), len(sizes), [None, offsets(sizes), pa.py_buffer(np.ascontiguousarray(data))])
            yield pa.record_batch(
                [
                    pa.array(name[pick].view(np.int64)), blob(context[pick], np.full(len(pick), WIDTH)), pa.array(left[pick], pa.int8()), pa.array(right[pick], pa.int8()),
                    blob(place[order], counts * _PLACE.itemsize),
                ],
                ["name", "context", "left", "right", "places"],
            )

        for batch in pieces(batches, "text", 1 << 20):
            data, offsets = flat(batch.column("text"))
            place, gram = sampled(data, offsets)
            some = stands_in(bitmap.value, gram)
            place, gram = place[some], gram[some]
            if not len(place):
                continue
            row = np.searchsorted(offsets, place, "right") - 1
            padded = np.concatenate([np.zeros(AROUND, np.uint8), data, np.zeros(WIDTH, np.uint8)])
            context = np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[place].copy()
            left, right = np.minimum(AROUND, place - offsets[row]), np.minimum(AROUND, offsets[row + 1] - place - K)
            column = np.arange(WIDTH)
            context[(column < (AROUND - left)[:, None]) | (column >= (AROUND + K + right)[:, None])] = 0
            where = np.zeros(len(place), _PLACE)
            where["id"] = batch.column("_id").to_numpy()[row]
            where["rid"] = batch.column("rid").to_numpy()[row]
            where["at"] = place - offsets[row]
            held.append((gram, context, left.astype(np.int8), right.astype(np.int8), where))
            size += len(place)
            if size > 150_000:
                yield from out()
                held, size = [], 0
        if size:
            yield from out()

    return docs.select("_id", "rid", "text").mapInArrow(run, "name long, context binary, left byte, right byte, places binary")


def _compare(name: np.ndarray, context: np.ndarray, left: np.ndarray, right: np.ndarray, places: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into places, mask): bit d of the mask says that the string starting d bytes before the
    gram also starts in a document with a smaller id."""
    first = np.cumsum(counts) - counts
    least = np.minimum.reduceat(places["id"], first)
    # The eight bytes from each column on, for a hash that sorts equal strings together.
    wide = np.ascontiguousarray(np.pad(context, ((0, 0), (0, 8))))
    of = np.repeat(np.arange(len(name)), counts)
    mask = np.zeros(len(places), np.int64)
    for d in range(AROUND + 1):
        valid = np.flatnonzero((left >= d) & (right >= AROUND - d))
        if not len(valid):
            continue
        a = AROUND - d
        # Equal names have equal grams, so only the bytes before and after them are hashed.
        key = name[valid]
        for at in [*range(a, AROUND, 8), *range(AROUND + K, a + LENGTH, 8)]:
            part = wide[valid, at : at + 8].copy().view("<u8")[:, 0]
            stop = AROUND if at < AROUND else a + LENGTH
            if stop - at < 8:
                part &= np.uint64((1 << 8 * (stop - at)) - 1)
            key = mix64((key ^ part) * _ODD)
        order = np.argsort(key, kind="stable")
        key = key[order]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        # The strings themselves decide: neighbours of one hash are compared byte by byte.
        pair = np.flatnonzero(~fresh)
        rows = valid[order]
        differ = (context[rows[pair], a : a + LENGTH] != context[rows[pair - 1], a : a + LENGTH]).any(axis=1)
        if differ.any():
            string = np.ascontiguousarray(context[rows, a : a + LENGTH]).view(f"V{LENGTH}")[:, 0]
            order = np.argsort(string, kind="stable")
            rows, string = rows[order], string[order]
            fresh = np.concatenate([[True], string[1:] != string[:-1]])
        starts = np.flatnonzero(fresh)
        lows = np.minimum.reduceat(least[rows], starts)
        smallest = np.full(len(name), NO_ID)
        smallest[rows] = np.repeat(lows, np.diff(np.append(starts, len(rows))))
        mask |= (places["id"] > smallest[of]).astype(np.int64) << d
    hit = np.flatnonzero(mask)
    return hit, mask[hit]


def _marked(contexts: DataFrame) -> DataFrame:
    """(_id, rid, at, mask) of the places with a repeated string; whole names at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
            name = table["name"].to_numpy().view(np.uint64)
            context = np.frombuffer(b"".join(table["context"].to_pylist()), np.uint8).reshape(-1, WIDTH)
            raw = table["places"].to_pylist()
            counts = np.array([len(x) // _PLACE.itemsize for x in raw], np.int64)
            places = np.frombuffer(b"".join(raw), _PLACE)
            hit, mask = _compare(name, context, table["left"].to_numpy(), table["right"].to_numpy(), places, counts)
            yield pa.record_batch([pa.array(places["id"][hit].copy()), pa.array(places["rid"][hit].copy()), pa.array(places["at"][hit].copy()), pa.array(mask.astype(np.int32))], ["_id", "rid", "at", "mask"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= 60_000:
                table = pa.Table.from_batches(held)
                name = table["name"].to_numpy()
                cut = int(np.searchsorted(name, name[-1], "left"))
                if cut:
                    yield from out(table.slice(0, cut))
                    held = table.slice(cut).combine_chunks().to_batches()
                    rows -= cut
        if rows:
            yield from out(pa.Table.from_batches(held))

    return contexts.repartition("name").sortWithinPartitions("name").mapInArrow(run, "_id long, rid long, at int, mask int")


def _digested(docs: DataFrame, kind: str) -> DataFrame:
    """Remove the marked strings (array ``marks`` of at and mask) from each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 2 << 20):
            out = []
            data, offsets = flat(batch.column("text"))
            for i in range(batch.num_rows):
                text = data[offsets[i] : offsets[i + 1]]
                marks = batch.column("marks")[i].values
                at, mask = marks.field("at").to_numpy(), marks.field("mask").to_numpy()
                gone = np.zeros(len(text) + 1, np.int32)
                for d in range(AROUND + 1):
                    start = at[(mask >> d) & 1 > 0] - d
                    np.add.at(gone, start, 1)
                    np.add.at(gone, start + LENGTH, -1)
                removed = np.cumsum(gone[:-1]) > 0
                spans = int(removed[0]) + int((removed[1:] & ~removed[:-1]).sum())
                out.append((len(text), int(removed.sum()), spans, hashlib.sha256(text[~removed].tobytes()).hexdigest()))
            columns = [pa.array(list(c)) for c in zip(*out)]
            yield pa.record_batch([batch.column("doc_id"), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return docs.select("doc_id", "text", "marks").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every document."""
    spark, kind = bounded_batches(docs.sparkSession), dict(docs.dtypes)["doc_id"]
    text = F.coalesce("text", F.lit(""))
    whole = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), text.alias("text"), F.md5(text.cast("binary")).alias("_md5"), F.xxhash64("doc_id", text).alias("rid"))
    sizes = materialize(whole.select("_id", "_md5", F.octet_length("text").cast("long").alias("n")), "dedup-sizes")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    groups = sizes.where(F.col("n") >= LENGTH).groupBy("_md5").agg(F.min("_id").alias("_first"), F.count("*").alias("_copies")).where("_copies > 1")
    later = materialize(join_small(sizes, materialize(groups, "dedup-copies"), "_md5").where("_id > _first").select("_id", "_md5").distinct(), "dedup-later")
    copies = join_small(whole, later, ["_id", "_md5"], "left_semi")
    single = join_small(whole, later, ["_id", "_md5"], "left_anti")
    bitmap = spark.sparkContext.broadcast(repeated(single.select("text"), _grams, total))
    marks = _marked(_contexts(single, bitmap)).groupBy("_id", "rid").agg(F.collect_list(F.struct("at", "mask")).alias("marks"))
    marks = materialize(marks, "dedup-marks")
    marked = marks.select("_id", "rid")
    touched = join_small(single, marked, ["_id", "rid"], "left_semi").join(marks, ["_id", "rid"])
    intact = join_small(single, marked, ["_id", "rid"], "left_anti")
    zero = F.lit(0).cast("long")
    size = F.octet_length("text").cast("long")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return (
        _digested(touched, kind)
        .unionByName(intact.select("doc_id", size.alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")))
        .unionByName(copies.select("doc_id", size.alias("n_bytes"), size.alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), nothing.alias("kept_sha256")))
    )
