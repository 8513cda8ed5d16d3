"""Benchmark decontamination by winnowing.

Documents and benchmark items are cut into words; of every ``window`` consecutive words the
k-gram with the least hash is kept as a fingerprint, so two texts that share a span of ``window``
words keep the same k-gram of it. Fingerprints are joined, and each hit is extended word by word
on both sides: an agreement of ``window`` words or more marks the words as hit. Items shorter
than a window are fingerprinted whole, and documents keep all their runs of such a length.

A Bloom filter of the benchmark's fingerprints, of fixed size, goes to the workers and thins out
the documents' fingerprints before the join; its false positives are settled by the join, so the
result does not depend on its size.

Defined results: a null text has no words, n_words 0 and no hits; items without words match
nothing; equal items count each under its own item_id, null item_ids are not counted in n_items;
rows with equal doc_ids are separate documents. Only ``doc_id`` and ``text``, ``item_id`` and
``text`` are read. Empty tables give no rows or no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..store import join_small, materialize
from .text import ALNUM, Words, bounded_batches, mix64, pieces, words_of

#: Bits of the filter that is sent to the workers (1 MB).
FILTER_BITS = 1 << 23
_FOUND = "row long, id {kind}, n_words long, gram long, length int, place int, before array<string>, inside array<string>, after array<string>"


def winnow(words: Words, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the k-grams with the least hash of each ``window`` words, the last of equals."""
    place, gram = words.grams(k)
    span = window - k + 1
    n = len(place) - span + 1
    if n <= 0:
        return place[:0], gram[:0]
    least, at = gram[:n], np.arange(n)
    for j in range(1, span):
        other = gram[j : j + n]
        better = other <= least
        least, at = np.where(better, other, least), np.where(better, np.arange(j, j + n), at)
    row = words.row[place]
    at = np.unique(at[row[:n] == row[span - 1 : span - 1 + n]])
    return place[at], gram[at]


def _bits(gram: np.ndarray) -> np.ndarray:
    return (gram & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def _rows(words: Words, place: np.ndarray, gram: np.ndarray, length: int, around: int, base: int, ids: pa.Array) -> pa.RecordBatch:
    """A row for each fingerprint, with the words on both sides of it, nearest first."""
    row = words.row[place]
    lo, hi = words.first[row], words.first[row + 1]
    before = [[words.text(j) for j in range(p - 1, max(a, p - around) - 1, -1)] for p, a in zip(place.tolist(), lo.tolist())]
    inside = [[words.text(j) for j in range(p, p + length)] for p in place.tolist()]
    after = [[words.text(j) for j in range(p + length, min(b, p + length + around))] for p, b in zip(place.tolist(), hi.tolist())]
    n, texts = len(place), pa.list_(pa.string())
    return pa.record_batch(
        [
            pa.array(row + base, pa.int64()), ids.take(pa.array(row)), pa.array(words.count[row], pa.int64()),
            pa.array(gram.view(np.int64)), pa.array(np.full(n, length), pa.int32()), pa.array((place - lo).astype(np.int32)),
            pa.array(before, texts), pa.array(inside, texts), pa.array(after, texts),
        ],
        ["row", "id", "n_words", "gram", "length", "place", "before", "inside", "after"],
    )


def _plain(words: Words, base: int, ids: pa.Array) -> pa.RecordBatch:
    """A row without fingerprint for each text."""
    n = len(words.count)
    none = [pa.nulls(n, t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.string()))]
    return pa.record_batch([pa.array(np.arange(n) + base), ids, pa.array(words.count, pa.int64()), *none], ["row", "id", "n_words", "gram", "length", "place", "before", "inside", "after"])


def _fingerprints(table: DataFrame, id_column: str, k: int, window: int, lengths: list[int], keep, whole_short: bool) -> DataFrame:
    """Fingerprints of each text, and a row without one for each text."""
    kind = dict(table.dtypes)[id_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        found = None if keep is None else keep.value
        for batch in pieces(batches, "text"):
            words, ids = words_of(batch.column("text"), ALNUM, lower=True), batch.column("id")
            yield _plain(words, base, ids)
            grams = [(k, *winnow(words, k, window))]
            if whole_short:
                for n in range(1, window):
                    place, gram = words.grams(n)
                    of = words.count[words.row[place]] == n
                    grams.append((n, place[of], gram[of]))
            else:
                grams += [(n, *words.grams(n)) for n in lengths]
            for i, (length, place, gram) in enumerate(grams):
                key = gram if i == 0 else mix64(gram + np.uint64(length))
                if found is not None:
                    of = found[_bits(key)]
                    place, key = place[of], key[of]
                for at in range(0, len(place), 20_000):
                    yield _rows(words, place[at : at + 20_000], key[at : at + 20_000], length, window - k if i == 0 else 0, base, ids)
            base += batch.num_rows

    return table.select(F.col(id_column).alias("id"), "text").mapInArrow(run, _FOUND.format(kind=kind))


def contaminated_words(docs: DataFrame, bench: DataFrame, window: int = 10, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(texts, hits): one row for each document (row, doc_id, n_words) and the word runs
    [lo, hi) of documents (row) that also stand in an item (item_id)."""
    spark = bounded_batches(docs.sparkSession)
    items = materialize(_fingerprints(bench, "item_id", k, window, [], None, True).where("gram is not null"), "bench-fingerprints")
    lengths = [r[0] for r in items.where(f"n_words < {window}").select("length").distinct().collect()]
    filled = np.zeros(FILTER_BITS, bool)
    # The driver sees at most FILTER_BITS set places, in parts of 65,536 at most.
    bit = F.col("gram").bitwiseAND(FILTER_BITS - 1)
    parts = items.groupBy(F.shiftright(bit, 16).alias("part")).agg(F.collect_set(bit).alias("bits"))
    for row in parts.toLocalIterator():
        filled[row["bits"]] = True
    keep = spark.sparkContext.broadcast(filled)
    found = materialize(_fingerprints(docs, "doc_id", k, window, sorted(lengths), keep, False), "document-fingerprints")
    texts = found.where("gram is null").select("row", F.col("id").alias("doc_id"), "n_words")
    ours = found.where("gram is not null").select("row", "gram", "length", "place", "before", "inside", "after")
    theirs = items.select(F.col("id").alias("item_id"), "gram", "length", F.col("n_words").alias("item_words"), F.col("before").alias("_b"), F.col("inside").alias("_i"), F.col("after").alias("_a"))

    def agreed(x: str, y: str) -> F.Column:
        """How many leading words are equal."""
        both = F.least(F.size(x), F.size(y))
        differ = F.zip_with(F.slice(x, F.lit(1), both), F.slice(y, F.lit(1), both), lambda a, b: a != b)
        return F.when(both == 0, 0).otherwise(F.coalesce(F.nullif(F.array_position(differ, True), F.lit(0)) - 1, both)).cast("int")

    left, right = agreed("before", "_b"), agreed("after", "_a")
    joined = join_small(ours, theirs, ["gram", "length"], limit=100_000).where("inside = _i")
    hits = (
        joined.withColumn("lo", F.col("place") - left).withColumn("hi", F.col("place") + F.col("length") + right)
        .where((F.col("hi") - F.col("lo") >= window) | (F.col("item_words") < window))
        .select("row", "item_id", "lo", "hi").distinct()
    )
    return texts, materialize(hits, "contamination-hits")


def contamination(docs: DataFrame, bench: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for every document."""
    texts, hits = contaminated_words(docs, bench, window, k)
    runs = hits.select("row", "lo", "hi").distinct()
    earlier = Window.partitionBy("row").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.col("hi") - F.greatest("lo", F.coalesce(F.max("hi").over(earlier), F.lit(0)))
    covered = runs.withColumn("new", F.greatest(fresh, F.lit(0))).groupBy("row").agg(F.sum("new").cast("long").alias("n_hit"))
    found = hits.groupBy("row").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("_items"))
    return (
        texts.join(covered.join(found, "row"), "row", "left")
        .select(
            "doc_id", "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce(F.size("_items"), F.lit(0)).cast("long").alias("n_items"),
            F.sha2(F.coalesce(F.array_join("_items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        )
    )
