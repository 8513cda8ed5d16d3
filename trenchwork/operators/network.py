"""Trees and graphs as edge tables: walks to the source, subtree sums, shortest paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules as r
from ..store import materialize

#: A table of at most this many rows is broadcast in the joins of rounds. There are many of these, and each passes the driver.
ROUND_ROWS = 50_000


def join_small(big: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """As ``store.join_small``, for joins in rounds: beyond ``ROUND_ROWS`` rows Spark is told to shuffle, as it would itself send
    tables to the driver whose files are small."""
    return big.join(F.broadcast(small) if small.limit(ROUND_ROWS + 1).count() <= ROUND_ROWS else small.hint("merge"), on, how)


def _doubled(tree: DataFrame):
    """Jumps (node, to, step, way) up a forest (node, parent, length): of 1 edge, of 2, of 4 and so on, while any is left.

    Each is a written table with at most one row for each node.
    """
    jump = materialize(tree.where("parent is not null").select("node", F.col("parent").alias("to"), F.lit(1).cast("long").alias("step"), F.col("length").cast("double").alias("way")), "jumps")
    while jump.limit(1).count():
        yield jump
        after = jump.select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("step").alias("_step"), F.col("way").alias("_way"))
        jump = materialize(join_small(jump, after, "to").select("node", F.col("_to").alias("to"), (F.col("step") + F.col("_step")).alias("step"), (F.col("way") + F.col("_way")).alias("way")), "jumps")


def gathered(tree: DataFrame, values: dict[str, str]) -> DataFrame:
    """node and, over its whole subtree, each column of ``values`` put together by its aggregate ("sum" or "max").

    After k rounds a node holds what lies less than 2 ** k edges below it; what then lies as far below again comes
    from the nodes that are 2 ** k edges down. A tree of any depth d takes log2(d) rounds of one row for each node.
    """
    held = tree.select("node", *values)
    put = lambda name, c: getattr(F, name)(c).alias(c)
    for jump in _doubled(tree):
        below = join_small(held, jump.select("node", "to"), "node").groupBy(F.col("to").alias("node")).agg(*[put(f, c) for c, f in values.items()])
        held = materialize(held.unionByName(below).groupBy("node").agg(*[put(f, c) for c, f in values.items()]), "gathered")
    return held


def to_source(tree: DataFrame) -> DataFrame:
    """(node, source, hops, metres): the root of each node and the way there, in trees of any depth."""
    held = tree.select("node", F.col("node").alias("source"), F.lit(0).cast("long").alias("hops"), F.lit(0.0).alias("metres"))
    # The hops of a way to the root, as a sum of powers of two, greatest first: what is left can be jumped or not.
    jumps = list(_doubled(tree))
    for jump in reversed(jumps):
        on = jump.select(F.col("node").alias("source"), "to", "step", "way")
        moved = join_small(held, on, "source", "left")
        held = materialize(moved.select("node", F.coalesce("to", "source").alias("source"), (F.col("hops") + F.coalesce("step", F.lit(0))).alias("hops"), (F.col("metres") + F.coalesce("way", F.lit(0.0))).alias("metres")), "sources")
    return held.select("node", "source", F.col("hops").cast("int").alias("hops"), "metres")


def spread(tree: DataFrame, values: DataFrame, slope: float) -> DataFrame:
    """(node, low, high) of every node of a forest (node, parent, length): the greatest ``low - slope * distance`` and the
    least ``high + slope * distance`` of all ``values`` (node, low, high) of its tree, by the distance along the tree.

    What lies below a node is gathered upwards, then what its ancestors know is handed down; both by doubled jumps.
    """
    jumps = list(_doubled(tree))
    own = values.groupBy("node").agg(F.max("low").alias("low"), F.min("high").alias("high"))
    held = materialize(tree.select("node").join(own, "node", "left"), "spread")
    far = slope * F.col("way")
    for jump in jumps:
        below = join_small(held, jump.select("node", "to", "way"), "node").select(F.col("to").alias("node"), (F.col("low") - far).alias("low"), (F.col("high") + far).alias("high"))
        held = materialize(held.unionByName(below).groupBy("node").agg(F.max("low").alias("low"), F.min("high").alias("high")), "spread")
    for jump in jumps:
        above = held.select(F.col("node").alias("to"), F.col("low").alias("_low"), F.col("high").alias("_high"))
        moved = held.join(jump.select("node", "to", "way").join(above, "to"), "node", "left")
        held = materialize(moved.select("node", F.greatest("low", F.col("_low") - far).alias("low"), F.least("high", F.col("_high") + far).alias("high")), "spread")
    return held


def tree_distances(tree: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b of nodes, and further columns) with ``meet``, the lowest common ancestor, and ``metres`` between them
    along the forest; both null where they are in different trees or no nodes of it.

    The deeper node is lifted to the other's level, then both as long as they stay apart, by jumps of halving length.
    """
    jumps = list(_doubled(tree))
    level = materialize(to_source(tree), "levels")
    at = lambda name: level.select(F.col("node").alias(name), F.col("source").alias(f"_{name}s"), F.col("hops").alias(f"_{name}h"), F.col("metres").alias(f"_{name}m"))
    more = [c for c in pairs.columns if c not in ("a", "b")]
    held = pairs.join(at("a"), "a").join(at("b"), "b").where("_as = _bs")
    total = F.col("_am") + F.col("_bm")
    held = materialize(held.select(*pairs.columns, total.alias("_sum"), F.col("a").alias("x"), F.col("b").alias("y"), (F.col("_ah") - F.col("_bh")).cast("long").alias("_lead")), "lifted")
    jump = lambda j, name: j.select(F.col("node").alias(name), F.col("to").alias(f"_{name}"), F.col("step").alias("_step"))
    for step, j in reversed(list(enumerate(jumps))):
        for name, sign in (("x", 1), ("y", -1)):
            moved = held.join(jump(j, name), name, "left")
            go = (F.col("_lead") * sign >= (1 << step)) & F.col(f"_{name}").isNotNull()
            held = moved.withColumns({name: F.when(go, F.col(f"_{name}")).otherwise(F.col(name)), "_lead": F.when(go, F.col("_lead") - sign * (1 << step)).otherwise(F.col("_lead"))}).drop(f"_{name}", "_step")
        held = materialize(held, "lifted")
    for j in reversed(jumps):
        moved = held.join(jump(j, "x").drop("_step"), "x", "left").join(jump(j, "y").drop("_step"), "y", "left")
        go = F.col("_x") != F.col("_y")
        held = materialize(moved.withColumns({n: F.when(go, F.col(f"_{n}")).otherwise(F.col(n)) for n in ("x", "y")}).drop("_x", "_y"), "lifted")
    up = tree.select(F.col("node").alias("x"), "parent")
    top = held.join(up, "x", "left").withColumn("meet", F.when(F.col("x") == F.col("y"), F.col("x")).otherwise(F.col("parent")))
    found = top.join(level.select(F.col("node").alias("meet"), F.col("metres").alias("_m")), "meet").select("a", "b", *more, "meet", (F.col("_sum") - 2 * F.col("_m")).alias("metres"))
    return pairs.join(found.dropDuplicates(["a", "b"]).select("a", "b", "meet", "metres"), ["a", "b"], "left")


def subtree_sums(tree: DataFrame, value: str) -> DataFrame:
    """(node, total, nodes): the sum of ``value`` over each node's subtree."""
    return gathered(tree.withColumns({"total": F.col(value), "nodes": F.lit(1).cast("long")}), {"total": "sum", "nodes": "sum"})


def monotone_dn(tree: DataFrame) -> DataFrame:
    """(node, dn): no pipe is narrower than one upstream of it feeds; the greatest diameter of the subtree."""
    return gathered(tree, {"dn": "max"})


def shortest_paths(edges: DataFrame, sources: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, metres, source, via): the shortest way from any source along edges (a, b, metres) that can be
    gone both ways, at most ``rounds`` of them if given, and the node before on it; the smallest source, then
    node before, of equals. Sources (node) may carry a ``label`` to be named by. Each round joins the nodes that
    changed only, and is a written table. An edge of 0 m is gone only where it makes the way or the source less, so that
    nodes 0 m apart do not name each other as the one before."""
    both = materialize(edges.select("a", "b", "metres").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "metres")), "ways")
    label = F.col("label") if "label" in sources.columns else F.col("node")
    held = sources.select("node", F.lit(0.0).alias("metres"), label.alias("source"), F.lit(None).cast(dict(both.dtypes)["a"]).alias("via"), F.lit(0).alias("flat"), F.lit(True).alias("fresh"))
    rank = lambda x: F.struct(x["metres"].alias("m"), x["source"].alias("s"), x["flat"].alias("f"), F.when(x["flat"] == 0, x["via"]).alias("v"))
    turn = 0
    while rounds is None or turn < rounds:
        turn += 1
        frontier = held.where("fresh").select(F.col("node").alias("a"), F.col("metres").alias("_m"), "source")
        step = join_small(both, frontier, "a")
        offers = step.groupBy(F.col("b").alias("node")).agg(F.min(F.struct((F.col("_m") + F.col("metres")).alias("metres"), "source", (F.col("metres") == 0).cast("int").alias("flat"), F.col("a").alias("via"))).alias("n"))
        old = held.select("node", F.struct("metres", "source", "flat", "via").alias("o"))
        better = F.col("o").isNull() | (F.col("n").isNotNull() & (rank(F.col("n")) < rank(F.col("o"))))
        merged = old.join(offers, "node", "full").select("node", F.when(better, F.col("n")).otherwise(F.col("o")).alias("x"), better.alias("fresh"))
        held = materialize(merged.select("node", "x.metres", "x.source", "x.via", "x.flat", "fresh"), "paths")
        if not held.where("fresh").limit(1).count():
            break
    return held.drop("fresh", "flat")


def rooted(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, parent, length) of the trees that the edges (a, b, metres) of a forest form, seen from ``roots`` (node);
    at most one root in a tree. Trees without a root are left out.

    Every edge is gone once each way on a tour around its tree; ranking the tour by doubled jumps tells which
    way comes first, away from the root. Trees of any depth take log2(n) rounds.
    """
    top = F.lit(-(1 << 62)).cast("long")
    inner = edges.select("a", "b", F.col("metres").cast("double").alias("metres"))
    every = inner.unionByName(roots.select(top.alias("a"), F.col("node").cast("long").alias("b"), F.lit(0.0).alias("metres")))
    arcs = materialize(every.unionByName(every.select(F.col("b").alias("a"), F.col("a").alias("b"), "metres")), "arcs")
    order = Window.partitionBy("a").orderBy("b")
    # After (a, b) comes, of b's arcs in their order, the one after (b, a); after the last the first.
    turn = arcs.select("a", "b", F.lead("b").over(order).alias("next"), F.first("b").over(order).alias("first"), F.row_number().over(order).alias("place"))
    after = turn.select(F.col("b").alias("a"), F.col("a").alias("b"), F.coalesce("next", "first").alias("to_b"), F.col("next").isNull().alias("last"))
    # The tour ends where it would start again from the top.
    ends = (F.col("b") == top) & F.col("last")
    jump = materialize(after.select(F.struct("a", "b").alias("arc"), F.when(~ends, F.struct(F.col("b").alias("a"), F.col("to_b").alias("b"))).alias("to"), F.lit(1).cast("long").alias("steps")), "tour")
    # After so many doublings only tours without an end are left, around trees without a root.
    for _ in range(arcs.count().bit_length()):
        on = jump.select(F.col("arc").alias("to"), F.col("to").alias("_to"), F.col("steps").alias("_steps"))
        jump = materialize(join_small(jump, on, "to", "left").select("arc", F.col("_to").alias("to"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps")), "tour")
        if not jump.where("to is not null").limit(1).count():
            break
    left = jump.where("to is null").select("arc.a", "arc.b", "steps")
    back = left.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("steps").alias("_steps"))
    down = left.join(back, ["a", "b"]).where(F.col("steps") > F.col("_steps")).select(F.col("b").alias("node"), F.col("a").alias("parent"))
    lengths = arcs.select(F.col("a").alias("parent"), F.col("b").alias("node"), "metres")
    return down.join(lengths, ["node", "parent"]).select("node", F.when(F.col("parent") != top, F.col("parent")).alias("parent"), F.col("metres").alias("length"))


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """node and label (the smallest node reachable) for every node of ``links`` (a, b).

    Labels spread along links and jump along labels until none changes; every round is a written table.
    """
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), f"{name}-links")
    labels = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("node"), "label"), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        near = join_small(both, labels.select(F.col("node").alias("b"), F.col("label").alias("_near")), "b").groupBy(F.col("a").alias("node")).agg(F.min("_near").alias("_near"))
        spread = labels.join(near, "node").select("node", F.least("label", "_near").alias("label"), (F.col("_near") < F.col("label")).alias("changed"))
        spread = materialize(spread, f"{name}-spread-{turn}")
        jumped = join_small(spread, spread.select(F.col("node").alias("label"), F.col("label").alias("_far")), "label", "left")
        jumped = jumped.select("node", F.coalesce("_far", "label").alias("label"), (F.col("changed") | (F.col("_far") < F.col("label"))).alias("changed"))
        labels = materialize(jumped, f"{name}-{turn}")
        if not labels.where("changed").limit(1).count():
            return labels.select("node", "label")


def spanning_forest(edges: DataFrame) -> DataFrame:
    """The edges (a, b, metres) of a minimum spanning forest: each round every component takes its
    least edge out, components that so meet become one, and only edges between components stay."""
    held = edges.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("metres").alias("metres"))
    open_ = materialize(held.select("a", "b", "metres", F.col("a").alias("ca"), F.col("b").alias("cb")), "forest-edges")
    none = open_.limit(0).select("a", "b", "metres")
    taken = None
    while True:
        choice = F.struct("metres", "a", "b", "ca", "cb")
        least = open_.select(F.col("ca").alias("c"), choice.alias("e")).unionByName(open_.select(F.col("cb").alias("c"), choice.alias("e"))).groupBy("c").agg(F.min("e").alias("e"))
        chosen = materialize(least.select("c", F.when(F.col("e.ca") == F.col("c"), F.col("e.cb")).otherwise(F.col("e.ca")).alias("to"), "e.a", "e.b", "e.metres"), "forest-taken")
        if not chosen.limit(1).count():
            return taken if taken is not None else none
        new = chosen.select("a", "b", "metres").distinct()
        taken = new if taken is None else taken.unionByName(new)
        # Each component points to the one that it takes; of two that take each other the smaller is the root.
        mutual = chosen.select(F.col("to").alias("c"), F.col("c").alias("to"), F.lit(True).alias("both"))
        point = chosen.select("c", "to").join(mutual, ["c", "to"], "left").select("c", F.when(F.col("both") & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("to"))
        point = materialize(point, "forest-points")
        while True:
            on = point.select(F.col("c").alias("to"), F.col("to").alias("_to"))
            moved = materialize(join_small(point, on, "to", "left").select("c", F.coalesce("_to", "to").alias("to"), (F.coalesce("_to", "to") != F.col("to")).alias("moved")), "forest-points")
            point = moved.select("c", "to")
            if not moved.where("moved").limit(1).count():
                break
        for side in ("ca", "cb"):
            open_ = join_small(open_, point.select(F.col("c").alias(side), F.col("to").alias("_to")), side, "left").withColumn(side, F.coalesce("_to", side)).drop("_to")
        # Of several edges between the same two components only the least can be taken.
        between = open_.where("ca <> cb").groupBy(F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")).agg(F.min(F.struct("metres", "a", "b")).alias("e"))
        open_ = materialize(between.select("e.a", "e.b", "e.metres", "ca", "cb"), "forest-open")


def run_limited_dn(tree: DataFrame, rules: r.Rules = r.DEFAULT) -> DataFrame:
    """(node, dn, run) of the pipes of a forest (node, parent, length, flow; a root has no pipe).

    A pipe is no narrower than its flow needs nor than the pipes below it. The run is its length and the longest run of
    those below with its diameter; while it is longer than the diameter may run, the next diameter is taken. Pipes in a row with one
    flow are one pipe to this rule and are raised together, so such rows are put together first; then
    units are sized from the leaves on, one round for each level of them.
    """
    pipes = tree.where("parent is not null").select("node", "parent", "length", "flow")
    above = pipes.select(F.col("node").alias("parent"), F.col("flow").alias("_over"))
    rows = pipes.join(above, "parent", "left").select("node", "parent", "length", "flow", F.when(F.abs(F.col("flow") - F.col("_over")) < 1e-6, F.col("parent")).alias("_same"))
    rows = materialize(rows, "dn-rows")
    tops = materialize(to_source(rows.select("node", F.col("_same").alias("parent"), "length")).select("node", F.col("source").alias("unit")), "dn-units")
    whole = rows.join(tops, "node").groupBy("unit").agg(F.sum("length").alias("length"), F.max("flow").alias("flow"), F.max(F.when(F.col("node") == F.col("unit"), F.col("parent"))).alias("_parent"))
    pending = materialize(whole.join(tops.select(F.col("node").alias("_parent"), F.col("unit").alias("over")), "_parent", "left").select("unit", "over", "length", "flow"), "dn-pending")
    done = None
    while pending.limit(1).count():
        ready = pending.join(pending.select(F.col("over").alias("unit")), "unit", "left_anti")
        if done is None:
            below = ready.withColumn("_dn", F.lit(0)).withColumn("_run", F.lit(0.0))
        else:
            widest = done.where("over is not null").groupBy(F.col("over").alias("unit")).agg(F.max(F.struct("dn", "run")).alias("w"))
            below = ready.join(widest, "unit", "left").withColumn("_dn", F.coalesce("w.dn", F.lit(0))).withColumn("_run", F.coalesce("w.run", F.lit(0.0))).drop("w")
        least = F.greatest(r.dn_for_flow(F.col("flow"), rules), "_dn")
        run = lambda dn: F.col("length") + F.when(F.col("_dn") == dn, F.col("_run")).otherwise(0.0)
        dn = F.lit(rules.diameters[-1][0])
        for d in reversed(rules.diameters[:-1]):
            dn = F.when((least <= d[0]) & (run(F.lit(d[0])) <= d[2] + 1e-6), d[0]).otherwise(dn)
        sized = materialize(below.withColumn("dn", dn).select("unit", "over", "dn", run(F.col("dn")).alias("run")), "dn-sized")
        done = sized if done is None else done.unionByName(sized)
        pending = materialize(pending.join(sized.select("unit"), "unit", "left_anti"), "dn-pending")
    if done is None:
        return pending.select(F.col("unit").alias("node"), F.lit(0).alias("dn"), F.col("length").alias("run"))
    return tops.join(done, "unit").select("node", "dn", "run")


def contracted(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """(a, b, metres, path): the chains of edges (a, b, metres) between nodes that are kept: those of ``kept`` (node), those where not
    just two edges meet, and of a ring without any of these its least node. ``path`` lists the nodes of a chain in their order, from a to b.

    Each edge is an arc in either direction, and the arc behind it is that which leaves its far node, where just two edges meet.
    Doubled jumps along these tell every arc the last one of its chain and how far it is; of the two directions one is taken.
    Two edges between the same nodes are two chains; an edge from a node to itself is none.
    """
    numbered = materialize(edges.where("a <> b").select("a", "b", "metres").withColumn("edge", F.monotonically_increasing_id()), "chain-edges")
    one = lambda a, b, way: numbered.select("edge", F.lit(way).alias("way"), F.col(a).alias("u"), F.col(b).alias("v"), "metres")
    arcs = materialize(one("a", "b", 0).unionByName(one("b", "a", 1)), "chain-arcs")
    inner = arcs.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("n")).where("n = 2").join(kept.select("node"), "node", "left_anti").select("node")
    # A part of the graph whose nodes are all inner is a ring, or several edges between two nodes.
    labels = components(numbered, "chain-parts")
    stop = arcs.select(F.col("u").alias("node")).distinct().join(inner, "node", "left_anti")
    stopped = labels.join(stop, "node", "left_semi").select("label").distinct()
    broken = labels.join(stopped, "label", "left_anti").select(F.col("label").alias("node")).distinct()
    inner = materialize(inner.join(broken, "node", "left_anti"), "chain-inner")
    after = arcs.select(F.col("edge").alias("_edge"), F.col("way").alias("_way"), F.col("u").alias("v")).join(inner.withColumnRenamed("node", "v"), "v", "left_semi")
    behind = arcs.join(after, "v").where("edge <> _edge")
    name = lambda e, w: F.col(e) * 2 + F.col(w)
    tree = arcs.select(name("edge", "way").alias("node"), "u", "v", "metres").join(behind.select(name("edge", "way").alias("node"), name("_edge", "_way").alias("parent")), "node", "left")
    tree = materialize(tree.withColumn("length", F.lit(0.0)), "chain-tree")
    way = to_source(tree.select("node", "parent", "length")).drop("metres").join(tree.select("node", "u", "v", "metres"), "node")
    # A chain has the least of its arcs' numbers, halved, in common with its reverse; the direction of the lesser last arc is taken.
    whole = way.groupBy("source").agg(F.min(F.floor(F.col("node") / 2)).alias("_least"), F.sum("metres").alias("metres"), F.max(F.struct("hops", "u")).alias("_first"), F.min(F.struct("hops", "v")).alias("_end"), F.sort_array(F.collect_list(F.struct(F.negative("hops").alias("h"), "u"))).alias("_nodes"))
    taken = whole.groupBy("_least").agg(F.min_by(F.struct("metres", "_first", "_end", "_nodes"), F.struct("_first.u", "source")).alias("c")).select("c.*")
    nodes = F.concat(F.transform("_nodes", lambda x: x["u"]), F.array("_end.v"))
    return taken.select(F.col("_first.u").alias("a"), F.col("_end.v").alias("b"), "metres", nodes.alias("path"))


def plans_priced(trees: DataFrame, unconnected: DataFrame, limited: bool = True, rules: r.Rules = r.DEFAULT) -> DataFrame:
    """(plan, pipes, chambers, penalty, length, score): all plans of a run priced in one job.

    Plans are forests (plan, node, parent, length, flow: own demand; root_kind of roots: ``chamber`` for one that is there already)
    and consumers that are left (plan, flow). Nodes of all plans are told apart by the plan, so that flows are gathered and diameters
    sized for all of them at once; ``limited`` also keeps to the greatest runs. Where two pipes or more meet in a node that is no root,
    a chamber is built; a pipe that joins an existing chamber is a tie-in.
    """
    keyed = materialize(trees.select(F.struct("plan", "node").alias("node"), F.when(F.col("parent").isNotNull(), F.struct("plan", F.col("parent").alias("node"))).alias("parent"), "plan", "length", F.coalesce("flow", F.lit(0.0)).alias("own"), "root_kind"), "plans")
    flows = subtree_sums(keyed.select("node", "parent", "length", F.col("own").alias("flow")), "flow").select("node", F.col("total").alias("flow"))
    pipes = keyed.where("parent is not null").join(flows, "node")
    if limited:
        sized = run_limited_dn(keyed.select("node", "parent", "length").join(flows, "node"), rules).select("node", "dn")
    else:
        sized = flows.select("node", r.dn_for_flow(F.col("flow"), rules).alias("dn"))
    priced = materialize(pipes.join(sized, "node").withColumn("cost", F.floor(F.col("length") * r.pipe_price(F.col("dn"), rules) * 100 + 0.5)), "plans-priced")
    sums = priced.groupBy("plan").agg((F.sum("cost") / 100).alias("pipes"), F.sum("length").alias("length"))
    roots = keyed.where("parent is null").select("node", F.coalesce("root_kind", F.lit("source")).alias("_kind"))
    ends = priced.select("plan", F.col("parent").alias("node"), "dn").join(roots, "node", "left")
    meets = ends.where("_kind is null").groupBy("plan", "node").agg(F.count("*").alias("n"), F.max("dn").alias("dn")).where("n > 1")
    built = meets.groupBy("plan").agg(F.sum(r.chamber_price(F.col("dn"), rules)).alias("built"))
    tied = ends.where("_kind = 'chamber'").groupBy("plan").agg((F.count("*") * rules.tie_in).alias("tied"))
    left = unconnected.groupBy("plan").agg(F.sum(r.unconnected_penalty(F.col("flow"), rules)).alias("penalty"))
    out = trees.select("plan").distinct()
    for part in (sums, built, tied, left):
        out = out.join(part, "plan", "left")
    out = out.fillna(0.0).withColumn("chambers", F.col("built") + F.col("tied"))
    total = F.col("pipes") + F.col("chambers") + F.col("penalty")
    score = rules.cost_weight * total / rules.cost_base + rules.length_weight * F.col("length") / rules.length_base
    return out.select("plan", "pipes", "chambers", "penalty", "length", score.alias("score"))
