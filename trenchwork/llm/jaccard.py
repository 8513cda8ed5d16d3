"""N-gram Jaccard join with a token-group matrix.

A document is the set of its distinct word n-grams; equal sets are one class. A bitmap of the
tokens that stand in two documents or more bounds a set's overlap with all others together; sets
that could not reach the threshold are settled by it. Tokens are ordered by their frequency among
the remaining sets (a counting sketch over all of them), rare ones first, so two sets of similarity
``percent`` share one of the first ``s - ceil(percent * n / 100) + 1`` of the s shared tokens of each.

Similar sets are partitioned into groups first: each class is compared with one other, which
most of its leading tokens name, and those that reach the threshold form a group around that centre.
The token-group matrix then has a row for each leading token and group: the union of the members'
leading tokens, with the least and the most size among those that hold it and the most tokens that may
follow it in one of them. What follows the first common token, in the query and in the group, bounds
their overlap; only groups of another component that could hold enough are opened. An opened group's
centre is compared first; members only where their overlaps with it, the query's, and what both have
beside it could still reach what is needed. So no link that could join two components is passed over, and
neither copies nor members of one component are ever expanded into pairs.

Defined results: a null or wordless text has an empty set and is its own component; a text of
fewer than ``k`` words is its whole sequence; rows with equal doc_ids are separate documents, and
a null doc_id cannot be the smallest of a component that has another. Only doc_id and text are
read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.network import components
from .repeats import repeated, stands_in
from ..store import join_small, materialize
from .text import NOT_SPACE, Words, bounded_batches, mix64, pieces, words_of

#: Counters of the sketch of token frequencies; its parts of SPAN counters are summed apart.
COUNTERS, SPAN = 1 << 22, 1 << 15
#: Bits of a set's number within its task, and of the whole number.
ID_BITS, NODE_BITS = 30, 52


def _order(row: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """The order by row, then gram; two plain sorts take a third of the time of a lexicographic one."""
    if len(row) and row.max() >= 1 << 16:
        return np.lexsort((gram, row))
    first = np.argsort(gram)
    return first[np.argsort(row[first].astype(np.uint16), kind="stable")]


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash) of the distinct k-grams of each row, ordered by row and hash, and the rows' set sizes."""
    place, gram = words.grams(k)
    row = words.row[place]
    for n in range(1, k):
        short = np.flatnonzero(words.count == n)
        first = words.first[short]
        h = np.zeros(len(short), np.uint64)
        for j in range(n):
            h = h * np.uint64(0xD6E8FEB86659FD93) + words.hash[first + j]
        row, gram = np.concatenate([row, short]), np.concatenate([gram, mix64(h + np.uint64(n))])
    order = _order(row, gram)
    row, gram = row[order], gram[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
    row, gram = row[keep], gram[keep]
    return row, gram, np.bincount(row, minlength=len(words.count))


def _set_keys(row: np.ndarray, gram: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit keys of each row's set."""
    keys = []
    ends = np.cumsum(sizes)
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(gram ^ np.uint64(salt)), dtype=np.uint64)])
        keys.append(mix64(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64)).view(np.int64))
    return keys[0], keys[1]


def _sets(batches: Iterator[pa.RecordBatch], k: int):
    for batch in pieces(batches, "text"):
        words = words_of(batch.column("text"), NOT_SPACE, lower=True)
        row, gram, sizes = shingle_sets(words, k)
        yield batch, row, gram, sizes, *_set_keys(row, gram, sizes)


def _profile(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, set size and the two keys of the set of each document."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _, sizes, key, key2 in _sets(batches, k):
            yield pa.record_batch([batch.column("doc_id"), pa.array(sizes.astype(np.int64)), pa.array(key), pa.array(key2)], ["doc_id", "n", "key", "key2"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, key long, key2 long")


def frequency_levels(held: DataFrame) -> np.ndarray:
    """For each counter a level that grows with the number of sets holding its tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            tokens = batch.column("tokens").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            np.add.at(counts, (tokens & np.uint64(COUNTERS - 1)).astype(np.int64), np.uint32(1))
        for i in range(COUNTERS // SPAN):
            part = counts[i * SPAN : (i + 1) * SPAN]
            if part.any():
                yield pa.record_batch([pa.array([i], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts")):
                sums.setdefault(part, np.zeros(SPAN, np.int64))[:] += np.frombuffer(counts.as_buffer(), np.uint32)
        for part, total in sums.items():
            level = np.floor(4 * np.log2(total + 1.0)).astype(np.uint8)
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([level.tobytes()])], ["part", "levels"])

    out = np.zeros(COUNTERS, np.uint8)
    parts = held.select("tokens").mapInArrow(count, "part int, counts binary").repartition(COUNTERS // SPAN, "part")
    # COUNTERS bytes reach the driver.
    for r in parts.mapInArrow(add, "part int, levels binary").toLocalIterator():
        out[r["part"] * SPAN : (r["part"] + 1) * SPAN] = np.frombuffer(r["levels"], np.uint8)
    return out


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """The overlap that a set of size n needs with any partner: ceil(percent * n / 100)."""
    return (percent * n + 99) // 100


def _tokens(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        base = 0
        for batch, row, gram, *_ in _sets(batches, k):
            yield gram, row + base
            base += batch.num_rows

    return run


def _shared_sets(docs: DataFrame, k: int, percent: int, bitmap) -> DataFrame:
    """(id, key, key2, n, tokens): the shared tokens of each set that could reach the threshold with
    another set by what is shared at all. A task gives equal sets once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        base = TaskContext.get().partitionId() << ID_BITS
        for _, row, gram, sizes, key, key2 in _sets(batches, k):
            common = stands_in(bitmap.value, gram)
            shared = np.bincount(row[common], minlength=len(sizes))
            # A different set has at best one token more.
            fits = (100 * sizes >= percent * (sizes + 1)) & (shared >= least_overlap(sizes, percent))
            for i in np.flatnonzero(fits).tolist():
                value = (int(key[i]), int(key2[i]))
                fits[i] = value not in seen
                seen.add(value)
            if len(seen) > 200_000:
                seen.clear()
            rows = np.flatnonzero(fits)
            if len(rows):
                offsets = np.concatenate([[0], np.cumsum(shared[rows])]).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(gram[common & fits[row]].view(np.int64)))
                yield pa.record_batch([pa.array(base + np.arange(len(rows))), pa.array(key[rows]), pa.array(key2[rows]), pa.array(sizes[rows].astype(np.int64)), tokens], ["id", "key", "key2", "n", "tokens"])
                base += len(rows)

    return docs.select("doc_id", "text").mapInArrow(run, "id long, key long, key2 long, n long, tokens array<long>")


def _leading(held: DataFrame, percent: int, levels) -> DataFrame:
    """(node, n, shared, leading): the leading tokens of each set, rare ones first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy()
            column = batch.column("tokens")
            shared = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
            of = np.repeat(np.arange(len(n)), shared)
            tokens = column.flatten().to_numpy(zero_copy_only=False)
            # The tokens of a set are in one order (of their hashes) already.
            level = levels.value[(tokens.view(np.uint64) & np.uint64(COUNTERS - 1)).astype(np.int64)]
            tokens = tokens[np.argsort(of * 256 + level, kind="stable")]
            lead = shared - least_overlap(n, percent) + 1
            within = np.arange(len(of)) - np.repeat(np.cumsum(shared) - shared, shared)
            offsets = np.concatenate([[0], np.cumsum(lead)]).astype(np.int32)
            leading = pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens[within < np.repeat(lead, shared)]))
            yield pa.record_batch([batch.column("id"), pa.array(n), pa.array(shared), leading], ["node", "n", "shared", "leading"])

    return held.select("id", "n", "tokens").mapInArrow(run, "node long, n long, shared long, leading array<long>")


def _compared(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b) with the sizes, numbers of shared tokens and overlap of their sets, and whether they are linked."""
    left = join_small(held.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("_x")), pairs, "a")
    some = pairs.select("b").distinct()
    right = join_small(held.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("_y")), some, "b", "left_semi")
    both = left.join(right, "b").withColumns({"common": F.size(F.array_intersect("_x", "_y")).cast("long"), "s_a": F.size("_x").cast("long"), "s_b": F.size("_y").cast("long")}).drop("_x", "_y")
    return both.withColumn("linked", 100 * F.col("common") >= percent * (F.col("n_a") + F.col("n_b") - F.col("common")))


def needed(a: Column, b: Column, percent: int) -> Column:
    """The overlap that sets of sizes a and b need: ceil(percent * (a + b) / (100 + percent))."""
    return F.floor((percent * (a + b) + 99 + percent) / (100 + percent))


def _labelled(df: DataFrame, labels: DataFrame | None, node: str, out: str) -> DataFrame:
    """``df`` with the component that ``node`` is known to be in as ``out``; by itself, the node's own number."""
    if labels is None:
        return df.withColumn(out, F.col(node))
    named = labels.select(F.col("node").alias(node), F.col("label").alias(out))
    return join_small(df, named, node, "left").withColumn(out, F.coalesce(out, node))


def _components(postings: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """(node, label) of the sets that are linked with another one.

    ``postings`` has (token, pos, node, n, shared, leader), for tokens of two sets or more.
    """
    votes = postings.where("node <> leader").groupBy("node", "leader").agg(F.count("*").alias("votes"))
    choice = votes.groupBy("node").agg(F.max(F.struct("votes", "leader")).alias("best")).select(F.col("node").alias("a"), F.col("best.leader").alias("b"))
    stars = materialize(_compared(materialize(choice, "jaccard-choices"), held, percent).where("linked"), "jaccard-stars")
    labels = components(stars.select("a", "b"), "jaccard-labels")
    # A centre is a group of its own; what is linked with it, and no centre itself, is in its group.
    centres = stars.select(F.col("b").alias("a")).distinct()
    members = join_small(stars, centres, "a", "left_anti").select(F.col("a").alias("node"), F.col("b").alias("group"), F.col("n_a").alias("m"), F.col("common").alias("inside"), (F.col("s_a") - F.col("common")).alias("beside"))
    members = materialize(members, "jaccard-members")
    placed = join_small(_labelled(postings.drop("leader"), labels, "node", "label"), members.select("node", "group"), "node", "left").withColumn("group", F.coalesce("group", "node"))
    placed = materialize(placed, "jaccard-placed")
    several = placed.groupBy("token").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low <> _high").select("token")
    mixed = materialize(placed.join(several, "token"), "jaccard-mixed")
    follow = F.col("shared") - F.col("pos")
    # The matrix: which groups hold a token, in sets of what sizes, and how many tokens of a member may follow.
    matrix = mixed.groupBy("token", "group").agg(F.min("label").alias("of"), F.min("n").alias("least"), F.max("n").alias("most"), F.max(follow).alias("room"))
    queries = mixed.select("token", "node", "n", "label", follow.alias("follow"))
    size = F.greatest("least", F.ceil(percent * F.col("n") / 100))
    fits = (F.col("label") != F.col("of")) & (100 * F.col("most") >= percent * F.col("n")) & (100 * F.col("n") >= percent * F.col("least"))
    bound = F.least("follow", "room") >= needed(F.col("n"), size, percent)
    opened = materialize(queries.join(matrix, "token").where(fits & bound).select("node", "group").distinct(), "jaccard-opened")
    tests = materialize(opened.select(F.least("node", "group").alias("a"), F.greatest("node", "group").alias("b")).distinct(), "jaccard-tests")
    tested = materialize(_compared(tests, held, percent), "jaccard-tested")
    links = stars.select("a", "b").unionByName(tested.where("linked").select("a", "b"))
    labels = components(links, "jaccard-relabelled")
    # Of groups whose centre is not linked: members that could agree with the query beside the centre.
    missed = tested.where("not linked")
    either = None
    for q, c in (("a", "b"), ("b", "a")):
        side = missed.select(F.col(q).alias("node"), F.col(c).alias("group"), F.col(f"n_{q}").alias("n"), "common", (F.col(f"s_{q}") - F.col("common")).alias("extra"))
        either = side if either is None else either.unionByName(side)
    left = _labelled(_labelled(either.join(opened, ["node", "group"], "left_semi"), labels, "node", "own"), labels, "group", "other").where("own <> other").drop("own", "other")
    sizes = (100 * F.col("m") >= percent * F.col("n")) & (100 * F.col("n") >= percent * F.col("m"))
    # What a member and the query have in common lies within the centre or beside it.
    union = F.least("common", "inside") + F.least("extra", "beside") >= needed(F.col("n"), F.col("m"), percent)
    pairs = left.join(members.withColumnRenamed("node", "member"), "group").where(sizes & union)
    pairs = materialize(pairs.select(F.least("node", "member").alias("a"), F.greatest("node", "member").alias("b")).distinct(), "jaccard-pairs")
    if not pairs.limit(1).count():
        return labels
    links = links.unionByName(_compared(pairs, held, percent).where("linked").select("a", "b"))
    return components(links, "jaccard-components")


def similar_components(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id for every document."""
    spark = bounded_batches(docs.sparkSession)
    rows = materialize(_profile(docs, k), "jaccard-profile")
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bitmap = spark.sparkContext.broadcast(repeated(docs.select("doc_id", "text"), _tokens(k), total))
    held = materialize(_shared_sets(docs, k, percent, bitmap), "jaccard-sets")
    # Equal sets of several tasks are one node.
    classes = materialize(held.groupBy("key", "key2").agg(F.min("id").alias("node")), "jaccard-classes")
    once = join_small(held, classes.select(F.col("node").alias("id")), "id", "left_semi")
    levels = spark.sparkContext.broadcast(frequency_levels(once))
    leading = materialize(_leading(once, percent, levels).select("node", "n", "shared", F.posexplode("leading").alias("pos", "token")), "jaccard-leading")
    # Of the sets that hold a token, the one with the greatest part of shared tokens is the most typical: the text that others are copies of.
    typical = F.shiftleft(F.floor(1000 * F.col("shared") / F.col("n")), NODE_BITS) + F.col("node")
    tokens = leading.groupBy("token").agg(F.min("node").alias("_low"), F.max("node").alias("_high"), F.max(typical).alias("best")).where("_low <> _high")
    tokens = tokens.select("token", F.col("best").bitwiseAND(F.lit((1 << NODE_BITS) - 1)).alias("leader"))
    postings = materialize(leading.join(tokens, "token"), "jaccard-postings")
    labels = _components(postings, held, percent)
    linked = classes.join(labels, "node").select("key", "key2", "label")
    least = rows.where("n > 0").groupBy("key", "key2").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    named = materialize(least.join(linked, ["key", "key2"], "left").where("copies > 1 or label is not null"), "jaccard-named")
    of_label = named.where("label is not null").groupBy("label").agg(F.min("least").alias("component_id"))
    named = join_small(named, of_label, "label", "left").select("key", "key2", F.coalesce("component_id", "least").alias("component_id"))
    whole = join_small(rows, materialize(named, "jaccard-components"), ["key", "key2"], "left")
    return whole.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
