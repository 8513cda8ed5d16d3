"""Mixing sources to target weights with a low-discrepancy schedule (DataFrame functions only).

Every source's documents are put in a shuffled order (by the MD5 of ``doc_id``) and cut into
blocks of equally many words. The mix is a sequence of slots; slot times are van der Corput
points that are mapped through the cumulative slot counts of the sources, so that any stretch
of the mix holds the sources in about their shares. The slots of a source are ranked by time
and the slot of rank ``r`` takes the source's block ``r`` modulo its number of blocks, so a
source whose target exceeds its size starts over.

Defined results: a null text has size 0; null sources form one source, ordered last; a null
``doc_id`` is shuffled as the empty string; rows with equal ids are separate documents, tied by
size; documents of size 0 and sources without words take nothing; an empty table gives an empty
result. Only the columns ``doc_id``, ``text`` and ``source`` are read, so others cannot clash.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..store import join_small, materialize

#: Words of the size contract.
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame) -> DataFrame:
    """One narrow row for each document: doc_id, source, size, text_key and the shuffling key."""
    return docs.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64("text").alias("text_key"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("shuffle_key"),
    )


def source_targets(docs: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """One row for each source: source_no, source_size, target and the words to take.

    Targets are ``share`` of all words, shared by weight; no source gets more than ``cap`` times
    its size. Sources are filled in the order in which they reach their cap: the level is that of
    the first source which the rest would not fill. The windows run over one row per source.
    """
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_fill = Window.orderBy("fill", "source_no")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    after = by_fill.rowsBetween(0, Window.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    return (
        docs.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("source_no", F.row_number().over(by_name) - 1)
        .withColumn("weight", weight)
        .withColumn("most", F.col("source_size") * F.lit(float(cap)))
        .withColumn("fill", F.col("most") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after))
        .withColumn("first", F.min_by(F.when(F.col("level") < F.col("fill"), F.col("level")), F.when(F.col("level") < F.col("fill"), F.struct("fill", "source_no"))).over(every))
        .withColumn("target", F.coalesce(F.least("most", F.col("weight") * F.col("first")), F.col("most")))
        .withColumn("to_take", F.least(F.floor(F.col("target") + 0.5), F.floor("most")).cast("long"))
        .select("source", "source_no", "source_size", "target", "to_take")
    )


def running(df: DataFrame, group: str, bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """The sum of ``value`` over the earlier rows of the group, in two levels.

    ``bucket`` rises with the order, so no task sorts a whole group: windows run within a bucket
    and over the bucket totals of a group.
    """
    inner = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(group, bucket).agg(F.sum(value).alias("_total")).withColumn("_base", F.coalesce(F.sum("_total").over(outer), F.lit(0))).drop("_total")
    return df.join(totals, [group, bucket]).withColumn(out, (F.col("_base") + F.coalesce(F.sum(value).over(inner), F.lit(0))).cast("long")).drop("_base")


def stream_positions(light: DataFrame, targets: DataFrame, n_docs: int) -> DataFrame:
    """Each document with words gets ``start``, its place in its source's shuffled stream of words."""
    buckets = max(1, math.isqrt(n_docs))
    bucket = F.floor(F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("long") * buckets / F.lit(2.0**32)).cast("int")
    rows = join_small(light, targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "source")
    return running(rows.where("size > 0").withColumn("bucket", bucket), "source_no", "bucket", ["shuffle_key", "doc_id", "size", "text_key"], "size", "start").drop("bucket", "shuffle_key")


def schedule(targets: DataFrame, block_words: int) -> DataFrame:
    """The slots of the mix: source_no, time, rank, epoch, block and the words [lo, hi) of the block's stream.

    With K slots in all and N >= K a power of two, cell ``c`` of the cumulative slot counts holds the
    points j with ``floor(j * K / N) == c``; the earliest of them in van der Corput order (its bits
    reversed) is the slot's time.
    """
    size, take = F.col("source_size"), F.col("to_take")
    counted = targets.where("to_take > 0").select(
        "source_no",
        "source_size",
        "to_take",
        F.ceil(size / block_words).cast("long").alias("blocks"),
    ).withColumn("slots", F.floor(take / size).cast("long") * F.col("blocks") + F.ceil(F.pmod(take, size) / block_words).cast("long"))
    counted = counted.withColumn("first_cell", F.sum("slots").over(Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["first_cell"])
    total = counted.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    bits = max(1, (max(total, 1) - 1).bit_length())
    n = 1 << bits
    if total * n >= 1 << 63:
        raise ValueError(f"{total} slots are too many for 64-bit places; raise block_words")
    part = 1024
    high = max(0, bits - max(4, bits // 2))

    def time_of(j: F.Column) -> F.Column:
        return F.conv(F.reverse(F.lpad(F.bin(j), bits, "0")), 2, 10).cast("long")

    lo = F.expr(f"(cell * {n}L + {max(total, 1) - 1}L) div {max(total, 1)}L")
    hi = F.expr(f"((cell + 1) * {n}L + {max(total, 1) - 1}L) div {max(total, 1)}L")
    cells = (
        counted.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / part))).alias("part"))
        .repartition("source_no", "part")
        .select("*", F.explode(F.sequence(F.col("part") * part, F.least(F.col("part") * part + part - 1, F.col("slots") - 1))).alias("within"))
        .withColumn("cell", F.col("first_cell") + F.col("within"))
        .withColumn("_lo", lo)
        .withColumn("time", F.when(hi - F.col("_lo") > 1, F.least(time_of(F.col("_lo")), time_of(F.col("_lo") + 1))).otherwise(time_of(F.col("_lo"))))
        .withColumn("bucket", F.shiftright("time", high))
        .withColumn("one", F.lit(1))
    )
    ranked = running(cells, "source_no", "bucket", ["time"], "one", "rank")
    block = F.pmod(F.col("rank"), F.col("blocks"))
    epoch = F.floor(F.col("rank") / F.col("blocks")).cast("long")
    end = F.least(F.col("to_take") - F.col("epoch") * size, size, (F.col("block") + 1) * block_words)
    return (
        ranked.withColumn("block", block).withColumn("epoch", epoch)
        .select("source_no", "time", "rank", "epoch", "block", (F.col("block") * block_words).alias("lo"), end.alias("hi"))
    )


def mix_plan(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, block_words: int = 4096) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, targets, pieces). A piece is a run of a document's words that a slot of the mix takes.

    documents: one row each with doc_id, source, size and keys; targets: see ``source_targets``;
    pieces: doc_id, text_key, size, source_no, source_size, target, start, time, epoch, word_from and
    word_to (null where no slot takes anything of the block). Sorting pieces by (time, start) gives
    the mix.
    """
    light = materialize(sized(docs), "mix-sizes")
    targets = materialize(source_targets(light, weights, share, cap), "mix-targets")
    placed = stream_positions(light, targets, light.count())
    blocks = F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words))
    cut = placed.withColumn("block", F.explode(blocks))
    slots = schedule(targets, block_words)
    begins, ends = F.greatest("start", F.col("block") * block_words), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
    joined = cut.withColumn("_from", begins).withColumn("_to", ends).join(slots, ["source_no", "block"], "left")
    word_to = F.greatest("_from", F.least("_to", "hi"))
    pieces = joined.select(
        "doc_id", "text_key", "size", "source_no", "source_size", "target", "start", "time", "epoch",
        F.when(F.col("time").isNotNull(), F.col("_from") - F.col("start")).alias("word_from"),
        F.when(F.col("time").isNotNull(), word_to - F.col("start")).alias("word_to"),
    )
    return light, targets, pieces


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken for every document, in no order."""
    light, targets, pieces = mix_plan(docs, **options)
    some = pieces.groupBy("doc_id", "source_no", "start", "size", "source_size", "target").agg(
        F.coalesce(F.sum(F.col("word_to") - F.col("word_from")), F.lit(0)).alias("taken")
    )
    none = join_small(light.where("size = 0"), targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    cols = ["doc_id", "size", "source_size", "target", "taken"]
    return some.select(cols).unionByName(none.withColumn("taken", F.lit(0).cast("long")).select(cols))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, once for each pass over their source, with the columns of ``docs``.

    A document that the mix takes whole keeps its text; one that it takes in part (at most one for
    each source) keeps the words taken, joined by single spaces. Rows that agree in doc_id and text
    count as one document here.
    """
    _, _, pieces = mix_plan(docs.dropDuplicates(["doc_id", "text"]), **options)
    takes = (
        pieces.where("word_to > word_from")
        .groupBy("doc_id", "text_key", "source_no", "start", "size", "epoch")
        .agg(F.min("word_from").alias("_mix_from"), F.max("word_to").alias("_mix_to"))
        .select(F.col("doc_id").alias("_mix_id"), F.col("text_key").alias("_mix_key"), F.col("size").alias("_mix_size"), "_mix_from", "_mix_to")
    )
    taken = F.col("_mix_to") - F.col("_mix_from")
    words = F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.col("_mix_from") + 1, taken)
    text = F.when(taken == F.col("_mix_size"), F.col("text")).otherwise(F.array_join(words, " "))
    own = docs.dropDuplicates(["doc_id", "text"])
    out = own.join(takes, own["doc_id"].eqNullSafe(F.col("_mix_id")) & (F.xxhash64("text") == F.col("_mix_key")))
    columns = [text.alias("text") if c == "text" else F.length(text).cast("long").alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns]
    return out.select(columns)
