"""A Merkle manifest of a table: a leaf for each row, a tree for each group, a root over all, and a proof for each row.

Digests are lowercase hexadecimal SHA-256, and a node's digest is that of its children's hexadecimal digests, one
after the other. Leaves of a group ascend by ``order``; every ``arity`` consecutive nodes (the last run may be shorter,
even a single one) have a parent, until a group has one node, its subroot. The subroots, in the order of their groups,
are the leaves of the same tree over all groups, whose last node is the root.

A level is one window: rows are partitioned by (group, parent index), and the ordered list over the whole frame, at
most ``arity`` digests, is both the parent's preimage and each child's siblings. One row of each parent goes on to the
next level, so levels shrink by ``arity`` and no task holds a group, whatever its size. Places within groups come from
a range partitioning with counts by partition, not from a window over a group. Proofs are handed down the levels, each
node's to its children; a level's join has one partner on one side and at most ``arity`` on the other.

Defined results: a null field is ``-``, so it differs from an empty text; null groups form one group, ordered first;
null orders come first; rows of equal order are ordered by their leaves, and equal rows are leaves of their own; an
empty table gives an empty manifest. Only the named columns are read, under names of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..store import join_small, materialize


def row_digest(fields: list[Column]) -> Column:
    """Each field as its number of UTF-8 bytes, a colon and its value (numbers in decimal), ``-`` if null; hashed together."""
    texts = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _packed(digest: Column) -> Column:
    return F.unhex(digest)


def _hex(packed: Column) -> Column:
    return F.lower(F.hex(packed))


def _together(run: Column) -> Column:
    """The hexadecimal digests of a list, one after the other."""
    return F.array_join(F.transform(run, _hex), "")


def placed(leaves: DataFrame) -> DataFrame:
    """``leaves`` (_group, _order, _leaf, ...) with g (number of the group), n (rows of the group) and idx (place in it).

    The rows are sorted into ranges of (group, order, leaf); counts by range and group, at most a row for each range and
    for each group, give what lies before.
    """
    spark = leaves.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.asc_nulls_first("_group"), F.asc_nulls_first("_order"), F.asc("_leaf"), F.asc("_tie")]
    held = materialize(leaves.withColumn("_tie", F.monotonically_increasing_id()), "manifest-leaves")
    sorted_ = materialize(held.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()), "manifest-ranges")
    counts = materialize(sorted_.groupBy("_part", "_group").agg(F.count("*").alias("_rows")), "manifest-counts")
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    sum_before = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    groups = counts.groupBy("_group").agg(F.min("_part").alias("_first"), F.sum("_rows").alias("n"))
    # One row for each range.
    firsts = groups.groupBy("_first").agg(F.count("*").alias("_groups")).withColumn("_base", sum_before("_groups", earlier.orderBy("_first"))).drop("_groups")
    numbered = groups.join(firsts, "_first").select(
        F.col("_group").alias("_of"), "n", (F.col("_base") + F.row_number().over(Window.partitionBy("_first").orderBy(F.asc_nulls_first("_group"))) - 1).alias("g")
    )
    offsets = counts.withColumn("_before", sum_before("_rows", earlier.partitionBy("_group").orderBy("_part"))).drop("_rows")
    offsets = materialize(offsets.join(numbered, F.col("_group").eqNullSafe(F.col("_of"))).select(F.col("_part").alias("_at"), "_of", "_before", "g", "n"), "manifest-offsets")
    own = Window.partitionBy("_part", "_group").orderBy(*keys[1:])
    ranked = sorted_.withColumn("_own", F.row_number().over(own) - 1)
    on = (F.col("_part") == F.col("_at")) & F.col("_group").eqNullSafe(F.col("_of"))
    return join_small(ranked, offsets, on).withColumn("idx", F.col("_before") + F.col("_own")).drop("_part", "_group", "_order", "_tie", "_own", "_at", "_of", "_before")


def levels(nodes: DataFrame, arity: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(levels, tops) of the trees over ``nodes`` (g, idx, n, h and any more columns).

    Level k has g, idx, up (the parent's idx), left and right (packed digests of the siblings), and at level 0 the
    further columns; groups of one node have no row there. tops[k] has the groups that have one node left at level k:
    g, idx, h and at level 0 the further columns.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    more = [c for c in nodes.columns if c not in ("g", "idx", "n", "h")]
    found, tops = [], [nodes.where("n = 1").select("g", "idx", "h", *more)]
    while most > 1:
        family = Window.partitionBy("g", "up").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        at = F.col("idx") % arity
        run = nodes.where("n > 1").withColumn("up", F.floor(F.col("idx") / arity)).withColumn("run", F.collect_list("h").over(family))
        level = run.select(
            "g", "idx", "up", "n", *more,
            F.unhex(_together(F.slice("run", F.lit(1), at.cast("int")))).alias("left"),
            F.unhex(_together(F.slice("run", at.cast("int") + 2, F.lit(arity)))).alias("right"),
            F.when(at == 0, _packed(F.sha2(_together(F.col("run")), 256))).alias("parent"),
        )
        level = materialize(level, "manifest-level")
        found.append(level.drop("parent", "n"))
        nodes = level.where("parent is not null").select("g", F.col("up").alias("idx"), F.ceil(F.col("n") / arity).alias("n"), F.col("parent").alias("h"))
        tops.append(nodes.where("n = 1").select("g", "idx", "h"))
        more, most = [], -(-most // arity)
    return found, tops


def _handed_down(found: list[DataFrame], tops: list[DataFrame], above: DataFrame) -> DataFrame:
    """The nodes of level 0 with ``path`` (the siblings of each level upwards) and what ``above`` (g, path, ...) says of their group."""
    carried = [c for c in above.columns if c not in ("g", "path")]
    paths = None
    for k in range(len(tops) - 1, -1, -1):
        own = [c for c in tops[k].columns if c not in ("g", "idx", "h")]
        here = tops[k].join(above, "g").select("g", "idx", *own, "path", *carried)
        if paths is not None:
            step = F.array(F.struct("left", "right"))
            over = paths.select("g", F.col("idx").alias("up"), "path", *carried)
            here = here.unionByName(found[k].join(over, ["g", "up"]).select("g", "idx", *own, F.concat(step, "path").alias("path"), *carried))
        paths = here
    return paths


def manifest(docs: DataFrame, fields: list[str], group: str, order: str, arity: int = 3, carry: dict[str, Column] | None = None) -> DataFrame:
    """For each row of ``docs``: the column ``order``, leaf, subroot, root (hexadecimal), path and the columns of ``carry``.

    ``path`` lists, from the leaf to the root, the packed digests of the siblings to the left and to the right; a level
    at which a node has no siblings is an entry without digests.
    """
    carry = carry or {}
    leaf = _packed(row_digest([F.col(c) for c in fields])).alias("_leaf")
    leaves = docs.select(F.col(group).alias("_group"), F.col(order).alias("_order"), leaf, F.col(order).alias("_id"), *[c.alias(f"_with_{k}") for k, c in carry.items()])
    nodes = placed(leaves).withColumn("h", F.col("_leaf"))
    found, tops = levels(nodes, arity)
    subroots = tops[0].select("g", "h")
    for top in tops[1:]:
        subroots = subroots.unionByName(top.select("g", "h"))
    subroots = materialize(subroots, "manifest-subroots")
    over = subroots.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("idx"), F.lit(subroots.count()).cast("long").alias("n"), "h", F.col("h").alias("subroot"))
    upper, upper_tops = levels(over, arity)
    root = [r for top in upper_tops for r in top.select(_hex(F.col("h")).alias("h")).collect()]  # one row, or none
    start = upper[-1].sparkSession if upper else docs.sparkSession
    nothing = start.range(1).select(F.lit(0).cast("long").alias("g"), F.array().cast("array<struct<left:binary,right:binary>>").alias("path"))
    above = materialize(_handed_down(upper, upper_tops, nothing).select(F.col("idx").alias("g"), "path", "subroot"), "manifest-sources")
    rows = _handed_down(found, tops, above)
    return rows.select(
        F.col("_id").alias(order), _hex(F.col("_leaf")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"),
        F.lit(root[0]["h"] if root else None).cast("string").alias("root"), "path", *[F.col(f"_with_{k}").alias(k) for k in carry],
    )


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a path, level by level and left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(_hex(s["left"]), _hex(s["right"]))), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf (hexadecimal) and the siblings of its path give."""
    return F.aggregate(path, leaf, lambda at, s: F.sha2(F.concat(_hex(s["left"]), at, _hex(s["right"])), 256))


def audited(docs: DataFrame, arity: int = 3) -> DataFrame:
    """A manifest of documents by source and doc_id, held against documents of which some were tampered with.

    Where 2 divides the CRC-32 of the decimal doc_id, the line feeds are deleted from the text; folded_root is made of
    the leaf of what is there then and of the original proof, and verified says whether it is the root. A null doc_id
    is never tampered with.
    """
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False)) & F.col("text").contains("\n")
    changed = F.when(hit, _packed(row_digest([*map(F.col, fields[:-1]), F.replace(F.col("text"), F.lit("\n"), F.lit(""))])))
    rows = manifest(docs, fields, "source", "doc_id", arity, {"changed": changed})
    rows = rows.withColumn("folded_root", folded(F.coalesce(_hex(F.col("changed")), "leaf"), F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
