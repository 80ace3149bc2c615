"""Call-graph operators: rounds of joins on the driver's command, each round written where all executors find it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import fixed


def arrows(edges: DataFrame) -> DataFrame:
    """Distinct edges (src, dst) without null ends, written once: loops read them every round."""
    return fixed(edges.select("src", "dst").filter("src is not null and dst is not null").distinct())


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, include_seeds: bool = True, stored: bool = False) -> DataFrame:
    """(node, depth) of what *seeds* (node) reach over *edges* (src, dst); depth is the least.

    Breadth first: a round extends only the nodes found last and drops those known, so cycles end. Without *include_seeds* a
    seed is in the result only if an edge leads to it. Null ends are no edges.
    """
    e = arrows(edges)
    seen = frontier = fixed(seeds.select("node").filter("node is not null").distinct().withColumn("depth", F.lit(0)))
    depth, returns = 0, None
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        if not include_seeds:
            back = step.join(seen.filter("depth = 0"), "node", "left_semi").withColumn("depth", F.lit(depth))
            returns = back if returns is None else returns.union(back)
        frontier = fixed(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)  # each round is written once; what is known is their union
    if include_seeds:
        return seen
    again = returns.groupBy("node").agg(F.min("depth").alias("depth")) if returns is not None else seen.limit(0)
    return seen.filter("depth > 0").union(again)


def reverse_reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Callers, direct or not, of *seeds*."""
    return reach(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), seeds, max_depth)


def closure(edges: DataFrame, max_depth: int | None = None, stored: bool = False) -> DataFrame:
    """All pairs (src, dst) joined by a path of one edge or more: semi-naive, only new pairs are extended. *stored*: *edges* are of arrows()."""
    e = edges if stored else arrows(edges)
    known, fresh, depth = e, e, 1
    step = e.select(F.col("src").alias("dst"), F.col("dst").alias("next"))
    while max_depth is None or depth < max_depth:
        depth += 1
        fresh = fixed(fresh.join(step, "dst").select("src", F.col("next").alias("dst")).distinct().join(known, ["src", "dst"], "left_anti"))
        if fresh.isEmpty():
            break
        known = known.union(fresh)
    return known


def reach_counts(edges: DataFrame, nodes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Each of *nodes* (node) with its direct and reachable callees; 0 where it has none."""
    edges = arrows(edges)
    direct = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("direct"))
    all_ = closure(edges, max_depth, stored=True).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("reachable"))
    return nodes.join(direct, "node", "left").join(all_, "node", "left").na.fill(0, ["direct", "reachable"])


def orchestrators(edges: DataFrame, nodes: DataFrame, direct: int = 5, reachable: int = 20, max_depth: int | None = None) -> DataFrame:
    return reach_counts(edges, nodes, max_depth).filter((F.col("direct") >= direct) & (F.col("reachable") >= reachable))


def unreachable(edges: DataFrame, nodes: DataFrame, roots: DataFrame, stored: bool = False) -> DataFrame:
    """Those of *nodes* that no root reaches."""
    return nodes.join(reach(edges, roots, stored=stored), "node", "left_anti")


REPORT = ("reaches", "reach_count", "orchestrators", "unreachable_from_main", "subsystem_pairs", "truly_unreachable")


def reach_report(edges: DataFrame, functions: DataFrame, entries: DataFrame, root: str = "main", least: int = 3, only: Sequence[str] = REPORT) -> dict[str, DataFrame]:
    """The six relations of a call graph, for one program, or *only* some of them: loops run for what is asked for.

    reaches (src, dst); reach_count (node, name, reachable); orchestrators (node, name, direct, reachable); unreachable_from_main
    and truly_unreachable (node, name): what neither *root* reaches nor, for the latter, any of *entries* (node);
    subsystem_pairs (name_a, name_b, shared): callers with *least* callees in common. *functions*: node, name. Functions called
    *root* are entries too.
    """
    e = arrows(edges)
    out = {}
    if {"reaches", "reach_count", "orchestrators"} & set(only):
        pairs = closure(e, stored=True)
        direct = e.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("direct"))
        count = pairs.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("reachable"))
        counted = functions.select("node", "name").join(direct, "node", "left").join(count, "node", "left").na.fill(0, ["direct", "reachable"])
        out |= {"reaches": pairs, "reach_count": counted.select("node", "name", "reachable"), "orchestrators": counted.filter("direct >= 5 and reachable >= 20")}
    if {"unreachable_from_main", "truly_unreachable"} & set(only):
        mains = fixed(functions.filter(F.col("name") == root).select("node"))
        if "unreachable_from_main" in only:
            out["unreachable_from_main"] = unreachable(e, functions, mains, stored=True).select("node", "name")
        if "truly_unreachable" in only:
            out["truly_unreachable"] = unreachable(e, functions, mains.union(entries.select("node")), stored=True).select("node", "name")
    if "subsystem_pairs" in only:
        names = lambda side: functions.select(F.col("node").alias(side), F.col("name").alias(f"name_{side}"))
        out["subsystem_pairs"] = shared_callees(e, least, stored=True).join(names("a"), "a").join(names("b"), "b").select("name_a", "name_b", "shared")
    return {k: out[k] for k in REPORT if k in only}


def shared_callees(edges: DataFrame, least: int = 3, stored: bool = False) -> DataFrame:
    """Pairs of callers a < b with *least* callees or more in common."""
    e = edges if stored else arrows(edges)
    e = e.join(e.groupBy("src").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least), "src", "left_semi")  # others have too few callees
    a, b = e.alias("a"), e.alias("b")
    both = a.join(b, (F.col("a.dst") == F.col("b.dst")) & (F.col("a.src") < F.col("b.src")))
    return both.groupBy(F.col("a.src").alias("a"), F.col("b.src").alias("b")).agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= least)


def affinity(edges: DataFrame, direct: DataFrame, decay: float = 0.5, depth: int = 3) -> DataFrame:
    """(node, label, affinity): a node's own weight for each label and what its callees hand up, *decay* a step, over its largest.

    Level by level: the weights at d steps are those at d - 1 sent along the edges once, so a callee counts once for each path
    of at most *depth* edges, cycles included. *direct*: node, label, weight.
    """
    e = arrows(edges)
    level = fixed(direct.select("node", "label", F.col("weight").cast("double").alias("weight")))
    total = level
    for _ in range(depth):
        level = fixed(level.join(e, F.col("node") == F.col("dst")).groupBy(F.col("src").alias("node"), "label").agg((decay * F.sum("weight")).alias("weight")))
        total = total.union(level)
    total = total.groupBy("node", "label").agg(F.sum("weight").alias("weight"))
    most = total.groupBy("node").agg(F.max("weight").alias("most"))
    return total.join(most, "node").select("node", "label", F.try_divide("weight", "most").alias("affinity"))


def propagate_labels(edges: DataFrame, known: DataFrame, least_links: int = 2, rounds: int = 10, share: float = 0.05) -> DataFrame:
    """(node, label, round): unlabelled nodes take the label of most neighbours, if *least_links* or more have it, round by round.

    Rounds are synchronous: all nodes look at the labels of the round before. Ends when a round adds nothing, or fewer than *share* of the
    labelled nodes.
    """
    e = edges.select("src", "dst").filter("src is not null and dst is not null")
    e = fixed(e.union(e.select("dst", "src")).distinct())
    held = fixed(known.select("node", "label").withColumn("round", F.lit(0)))
    for i in range(1, rounds + 1):
        votes = e.join(held.select(F.col("node").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("node"), "label").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_links)
        best = votes.groupBy("node").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("label"))
        fresh = fixed(best.join(held, "node", "left_anti").select("node", "label", F.lit(i).alias("round")))
        added, before = fresh.count(), held.count()
        if not added:
            break
        held = held.union(fresh)
        if added < share * before:
            break
    return held
