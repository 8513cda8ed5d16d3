"""Language-model scores from a log-frequency Bloom filter.

Tokens are words and one end token for each text. Unigrams and bigrams are counted over all
training documents: tasks send sorted, packed (hash, count) runs to the partition of their hash
segment, where they are summed. Every n-gram goes into the filter with its count quantised to
``q = 1 + floor(log2(count))``: it is inserted with 1, 2, .. q, and a look-up probes 1, 2, .. until
one is missing. A segment's part of the filter is as long as its n-grams need (PER_INSERT bits for each insertion,
so a probe errs upwards with a fixed chance of about 0.09, whatever the input). All parts go to the workers; a filter of more than
``MOST_BITS`` bits goes in slices by the last word, one after another, and the terms of the score that a
slice gives are added up.

The model is a Dirichlet-smoothed bigram: ``p(w | v) = (low(vw) + MU * p(w)) / (high(v) + MU)`` with
``p(w) = (low(w) + 1) / (N + V + 1)``, where low and high are the ends of a quantised count. The sum over all
words is at most 1 (but for errors of the filter). Numerators need n-grams that end in w, denominators v, which is
why terms can be added by slices.

The exact add-one unigram score (``base_score``) uses exact counts: a table of the most frequent
words, at most ``MOST_WORDS`` of them, goes to the workers, and all other words of a text that its
own training does not settle are joined with the count table.

Defined results: a null text is empty and has only the end token; null doc_ids are neither held
out nor trained on; repeated rows are scored each; with nothing to train on, N is 0, every
token is unknown and both scores are 0. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import materialize
from .text import NOT_SPACE, Words, bounded_batches, mix64, pieces, words_of

MOST_BITS, SEGMENTS, PROBES, PER_INSERT = 1 << 29, 256, 3, 5
#: Bits that the filter needs at most for each byte of text, to choose the number of slices before anything is counted.
BITS_A_BYTE = 0.55
MOST_WORDS = 2_000_000
MU = 5.0
END = np.uint64(0x452821E638D01377)
START = np.uint64(0xBE5466CF34E90C6C)


def token_stream(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, hash of the token before, row) of all tokens, each row's end token after its words."""
    rows = len(words.count)
    ends = np.cumsum(words.count + 1)
    hashes = np.empty(int(ends[-1]) if rows else 0, np.uint64)
    is_end = np.zeros(len(hashes), bool)
    is_end[ends - 1] = True
    hashes[is_end], hashes[~is_end] = END, words.hash
    before = np.empty_like(hashes)
    before[1:] = hashes[:-1]
    before[np.concatenate([[0], ends[:-1]])] = START
    return hashes, before, np.repeat(np.arange(rows), words.count + 1)


def pair_key(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix64(before * np.uint64(0x9FB21C651E98DF25) + token)


def _planes(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(8, -1).T.copy().view("<u8")[:, 0]


def _sum_equal(key: np.ndarray, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order, and the sum of the counts of each (or how often it stands)."""
    if count is None:
        key = np.sort(key)
    else:
        order = np.argsort(key, kind="stable")
        key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    sums = np.diff(np.append(first, len(key))) if count is None else np.add.reduceat(count, first) if len(first) else count[:0]
    return key[first], sums


def slice_of(token: np.ndarray, slices: int) -> np.ndarray:
    """The slice of the filter that holds the n-grams ending in each token."""
    return (mix64(token ^ np.uint64(0xC2B2AE3D27D4EB4F)) % np.uint64(slices)).astype(np.int64)


def _counted(docs: DataFrame, slices: int) -> DataFrame:
    """(segment, slice, size, keys, counts): packed n-gram counts of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = texts = 0

        def out() -> Iterator[pa.RecordBatch]:
            token, before = (np.concatenate(x) for x in zip(*held))
            rows = []
            for n in (1, 2):
                last = token if n == 2 else np.concatenate([token, np.full(texts, START)])
                every = pair_key(before, token) if n == 2 else last
                which = slice_of(last, slices) if slices > 1 else None
                for part in range(slices):
                    key, count = _sum_equal(every if which is None else every[which == part])
                    bounds = np.searchsorted(key >> np.uint64(56), np.arange(SEGMENTS + 1, dtype=np.uint64))
                    for s, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                        if b > a:
                            rows.append((s, part, n, _planes(np.diff(key[a:b], prepend=np.uint64(0))), _planes(count[a:b])))
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["segment", "slice", "size", "keys", "counts"])

        for batch in pieces(batches, "text", 1 << 20):
            token, before, _ = token_stream(words_of(batch.column("text"), NOT_SPACE, lower=True))
            held.append((token, before))
            size, texts = size + len(token), texts + batch.num_rows
            if size > 800_000:
                yield from out()
                held, size, texts = [], 0, 0
        if size:
            yield from out()

    return docs.select("text").mapInArrow(run, "segment int, slice int, size int, keys binary, counts binary")


def levels(count: np.ndarray) -> np.ndarray:
    """1 + floor(log2(count)); 0 for a count of 0."""
    return np.where(count > 0, 1 + np.floor(np.log2(np.maximum(count, 1))), 0).astype(np.int64)


def low(level: np.ndarray) -> np.ndarray:
    """The least count of a level; 0 for level 0."""
    return np.where(level > 0, np.exp2(np.maximum(level, 1) - 1.0), 0.0)


def high(level: np.ndarray) -> np.ndarray:
    """The greatest count of a level."""
    return np.exp2(level.astype(float)) - 1.0


class LogFrequencyFilter:
    """Look-ups of quantised counts by repeated membership probes; parts[s] holds the bits of segment s, packed."""

    def __init__(self, parts: list[bytes]) -> None:
        sizes = np.array([len(p) for p in parts], np.int64)
        self.base = ((np.cumsum(sizes) - sizes) * 8).astype(np.uint64)
        self.bits = np.maximum(8, sizes * 8).astype(np.uint64)
        self.data = np.frombuffer(b"".join(parts) + b"\0", np.uint8)

    @staticmethod
    def places(key: np.ndarray, level: int, bits: np.ndarray | np.uint64) -> Iterator[np.ndarray]:
        """Places within a part of so many bits, one array for each probe."""
        h = mix64(key + np.uint64(level * 0xD1342543DE82EF95 % (1 << 64)))
        step = mix64(h) | np.uint64(1)
        for i in range(PROBES):
            yield ((h + np.uint64(i) * step) >> np.uint64(20)) % bits

    @staticmethod
    def part_of(key: np.ndarray, count: np.ndarray) -> bytes:
        """The part of one segment that holds these n-grams."""
        level = levels(count)
        bits = max(1 << 12, PER_INSERT * int(level.sum()) + 7 & ~7)
        part = np.zeros(bits, bool)
        for q in range(1, int(level.max(initial=0)) + 1):
            for place in LogFrequencyFilter.places(key[level >= q], q, np.uint64(bits)):
                part[place.astype(np.int64)] = True
        return np.packbits(part).tobytes()

    def look_up(self, key: np.ndarray) -> np.ndarray:
        """The level of each n-gram: how many probes in a row succeed."""
        out = np.zeros(len(key), np.int64)
        segment = (key >> np.uint64(56)).astype(np.int64)
        alive = np.arange(len(key))
        for q in range(1, 64):
            of = segment[alive]
            hit = np.ones(len(alive), bool)
            for place in self.places(key[alive], q, self.bits[of]):
                at = self.base[of] + place
                hit &= (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 > 0
            alive = alive[hit]
            if not len(alive):
                break
            out[alive] = q
        return out


def _summed(packed: DataFrame) -> DataFrame:
    """(key, n) rows of exact word counts, and (segment, slice, bits) rows of the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "n", "segment", "slice", "bits"]
        held: dict[tuple[int, int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        loose: dict[tuple[int, int, int], int] = {}
        for batch in batches:
            for s, part, n, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("segment", "slice", "size", "keys", "counts"))):
                key, count = np.cumsum(_from_planes(keys), dtype=np.uint64), _from_planes(counts).astype(np.int64)
                of = held.setdefault((s, part, n), [])
                of.append((key, count))
                loose[s, part, n] = loose.get((s, part, n), 0) + len(key)
                if loose[s, part, n] > 2 * len(of[0][0]) + 100_000:
                    of[:] = [_sum_equal(*(np.concatenate(x) for x in zip(*of)))]
                    loose[s, part, n] = 0
        for s, part in sorted({k[:2] for k in held}):
            sums = {n: _sum_equal(*(np.concatenate(x) for x in zip(*held.pop((s, part, n))))) for n in (1, 2) if (s, part, n) in held}
            key, count = (np.concatenate(x) for x in zip(*sums.values()))
            yield pa.record_batch([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([s], pa.int32()), pa.array([part], pa.int32()), pa.array([LogFrequencyFilter.part_of(key, count)])], names)
            if 1 in sums:
                key, count = sums[1]
                key, count = key[key != START], count[key != START]
                for a in range(0, len(key), 50_000):
                    k, c = key[a : a + 50_000], count[a : a + 50_000]
                    yield pa.record_batch([pa.array(k.view(np.int64)), pa.array(c), pa.nulls(len(k), pa.int32()), pa.nulls(len(k), pa.int32()), pa.nulls(len(k), pa.binary())], names)

    return packed.repartition(SEGMENTS, "segment").mapInArrow(run, "key long, n long, segment int, slice int, bits binary")


def _terms(batch: pa.RecordBatch, filter_: LogFrequencyFilter, part: int, slices: int, events: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token, row of each, whether trained on by row, sum of the slice's log10 terms by row)."""
    token, before, row = token_stream(words_of(batch.column("text"), NOT_SPACE, lower=True))
    rows = batch.num_rows
    own = slice_of(token, slices) == part if slices > 1 else np.ones(len(token), bool)
    near = slice_of(before, slices) == part if slices > 1 else own
    unique, inverse = np.unique(np.concatenate([token[own], before[near]]), return_inverse=True)
    level = filter_.look_up(unique)[inverse]
    alone, context = level[: own.sum()], level[own.sum() :]
    pair, again = np.unique(pair_key(before[own], token[own]), return_inverse=True)
    over = np.log10(low(filter_.look_up(pair))[again] + MU * np.minimum(1.0, (low(alone) + 1) / events))
    terms = np.bincount(row[own], over, rows).astype(float) - np.bincount(row[near], np.log10(high(context) + MU), rows).astype(float)
    return token, row, batch.column("trained").to_numpy(zero_copy_only=False), terms


def scored(docs: DataFrame, folds: int = 7, fold: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every document."""
    spark, kind = bounded_batches(docs.sparkSession), dict(docs.dtypes)["doc_id"]
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    parted = docs.select("doc_id", F.coalesce(rest == fold, F.lit(False)).alias("held_out"), F.coalesce(rest != fold, F.lit(False)).alias("trained"), "text")
    total_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    slices = max(1, -(-int(total_bytes * BITS_A_BYTE) // MOST_BITS))
    table = materialize(_summed(_counted(parted.where("trained"), slices)), "lm-counts")
    words = table.where("key is not null").select("key", "n")
    all_tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # The least count, 2 or more, whose words fit the table for the workers.
    by_count = words.groupBy(F.least("n", F.lit(100_000)).alias("n")).agg(F.count("*").alias("words")).where("n >= 2").orderBy(F.desc("n")).collect()
    least, room, whole = 100_001, MOST_WORDS, True
    for r in by_count:
        room -= r["words"]
        if room < 0:
            whole = False
            break
        least = r["n"]
    frequent = words.where(F.col("n") >= least).toArrow() if least <= 100_000 else None
    key = frequent["key"].to_numpy().view(np.uint64) if frequent is not None else np.zeros(0, np.uint64)
    order = np.argsort(key)
    known = spark.sparkContext.broadcast((key[order], frequent["n"].to_numpy()[order].astype(np.uint32) if frequent is not None else np.zeros(0, np.uint32)))
    events = float(all_tokens + distinct + 1)

    def first_slice(shared):  # noqa: ANN001
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ["row", "rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "key", "times"]
            at_row = TaskContext.get().partitionId() << 33
            table_key, table_n = known.value
            for batch in pieces(batches, "text", 1 << 20):
                rows = batch.num_rows
                token, row, trained, terms = _terms(batch, shared.value, 0, slices, events)
                place = np.minimum(np.searchsorted(table_key, token), max(0, len(table_key) - 1))
                count = np.where(table_key[place] == token, table_n[place], 0).astype(np.int64) if len(table_key) else np.zeros(len(token), np.int64)
                unsure = count == 0
                if whole:  # a word that is not in the table was counted once at most
                    count[unsure & trained[row]] = 1
                    unsure &= ~trained[row]
                sure = ~unsure
                base = np.bincount(row[sure], np.log10((count[sure] + 1) / events), rows).astype(float)
                n_known = np.bincount(row[sure], count[sure] > 0, rows).astype(np.int64)
                numbers = pa.array(at_row + np.arange(rows))
                yield pa.record_batch([numbers, batch.column("rid"), batch.column("doc_id"), batch.column("held_out"), pa.array(np.bincount(row, minlength=rows)), pa.array(n_known), pa.array(base), pa.array(terms), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int64())], names)
                if unsure.any():
                    late = np.flatnonzero(unsure)
                    late = late[np.lexsort((token[late], row[late]))]
                    fresh = np.flatnonzero(np.concatenate([[True], (row[late][1:] != row[late][:-1]) | (token[late][1:] != token[late][:-1])]))
                    n = len(fresh)
                    none = [pa.nulls(n, t) for t in (pa.int64(), batch.column("doc_id").type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                    yield pa.record_batch([pa.array(row[late][fresh] + at_row), *none, pa.array(token[late][fresh].view(np.int64)), pa.array(np.diff(np.append(fresh, len(late))))], names)
                at_row += rows

        return run

    def later_slice(shared, part: int):  # noqa: ANN001
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, "text", 1 << 20):
                yield pa.record_batch([batch.column("rid"), pa.array(_terms(batch, shared.value, part, slices, events)[3])], ["rid", "more"])

        return run

    whole_rows, more = None, None
    keyed = parted.withColumn("rid", F.xxhash64("doc_id", "text"))
    for part in range(slices):
        bits = {r["segment"]: bytes(r["bits"]) for r in table.where(F.col("slice") == part).select("segment", "bits").toLocalIterator()}
        shared = spark.sparkContext.broadcast(LogFrequencyFilter([bits.get(s, b"") for s in range(SEGMENTS)]))
        del bits
        if not part:
            schema = f"row long, rid long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, key long, times long"
            whole_rows = materialize(keyed.mapInArrow(first_slice(shared), schema), "lm-scores")
        else:
            # Rows of equal doc_id and text have equal terms.
            terms = materialize(keyed.mapInArrow(later_slice(shared, part), "rid long, more double").groupBy("rid").agg(F.first("more").alias("more")), f"lm-terms-{part}")
            more = terms if more is None else more.unionByName(terms)
        shared.destroy()
    late = whole_rows.where("key is not null").select("row", "key", "times").join(words, "key", "left")
    late = late.groupBy("row").agg(F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("late_known"), F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(events))).alias("late_base"))
    out = whole_rows.where("key is null").join(late, "row", "left")
    if more is not None:
        out = out.join(more.groupBy("rid").agg(F.sum("more").alias("more")), "rid", "left").withColumn("score", F.col("score") + F.coalesce("more", F.lit(0.0)))
    return out.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("late_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(all_tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("late_base", F.lit(0.0))).alias("base_score"),
        "score",
    )
