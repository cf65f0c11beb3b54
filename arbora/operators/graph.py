"""Traversals over the property graph as frontier joins, for many seeds at once.

Every level joins the frontier (seed, node) with the edges on the node, removes what was seen and cuts the
lineage with a written table.  Results are sets with the least depth, so they do not depend on any order;
where the depth-first form of a traversal would depend on it, reachability within the depth is meant.
Edges whose far end has no node row are dropped where nodes are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbora.session import materialise

USE_KINDS = ("calls", "references", "imports")
CONTAINERS = ("class", "interface", "struct", "trait", "module", "enum")
ANSWER_KINDS = ("calls", "references", "implements", "extends", "instantiates", "uses")
#: Steps that one written round takes where rounds are short.
STEPS = 2
#: Steps that one task may hold.
LOCAL_STEPS = 500_000


def arcs(edges: DataFrame, direction: str = "out", kinds: tuple[str, ...] | None = None) -> DataFrame:
    """(src, dst) of the steps that a traversal may take."""
    e = edges.filter(F.col("kind").isin(*kinds)) if kinds else edges
    out = e.select(F.col("source").alias("src"), F.col("target").alias("dst"))
    back = e.select(F.col("target").alias("src"), F.col("source").alias("dst"))
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction].filter("src IS NOT NULL AND dst IS NOT NULL").distinct()


def reach(steps: DataFrame, seeds: DataFrame, depth: int | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """(seed, node, depth): everything within ``depth`` steps (any number if None) of each seed (seed)."""
    steps = materialise(steps.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi") if nodes is not None else steps, "steps")
    seen = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth")).distinct()
    frontier, level = seen, 0
    while depth is None or level < depth:
        level += 1
        step = frontier.join(steps, frontier["node"] == steps["src"]).select("seed", F.col("dst").alias("node")).distinct()
        new = materialise(step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(level)), "level")
        if new.isEmpty():
            break
        seen, frontier = seen.unionByName(new), new
    return seen


def impact(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, node, depth): incoming reach over all kinds; the contents of containers count as the container."""
    known = nodes.select("id").distinct()
    back = materialise(arcs(edges, "in").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi"), "back")
    boxes = nodes.filter(F.col("kind").isin(*CONTAINERS)).select(F.col("id").alias("src")).distinct()
    inner = materialise(arcs(edges, "out", ("contains",)).join(boxes, "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi"), "inner")
    held = closure(inner)
    seen = None
    frontier = seeds.select("seed", F.col("seed").alias("node")).distinct()
    for level in range(depth + 1):
        if level:
            frontier = frontier.join(back, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
        # Contents of containers join at the same depth.
        layer = frontier.unionByName(frontier.join(held, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node"))).distinct()
        layer = layer if seen is None else layer.join(seen.select("seed", "node"), ["seed", "node"], "left_anti")
        layer = materialise(layer.withColumn("depth", F.lit(level)), "layer")
        seen = layer if seen is None else seen.unionByName(layer)
        frontier = layer.select("seed", "node")
    return seen


def closure(steps: DataFrame) -> DataFrame:
    """(src, dst): all pairs that one step or more connect; every round doubles the steps that are looked over."""
    now = materialise(steps.select("src", "dst").distinct(), "closure")
    size = now.count()
    while True:
        two = now.join(now.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").select("src", F.col("far").alias("dst"))
        now = materialise(now.unionByName(two).distinct(), "closure")
        size, before = now.count(), size
        if size == before:
            return now


def tree_edges(edges: DataFrame, reached: DataFrame, direction: str = "out") -> DataFrame:
    """(seed, node, edge_id): the edge that discovers each node, contains before calls before the rest."""
    ends = {"out": ("source", "target"), "in": ("target", "source")}[direction]
    parent = reached.select("seed", F.col("node").alias("up"), (F.col("depth") + 1).alias("depth"))
    j = reached.filter("depth > 0").join(edges.select("id", "kind", F.col(ends[0]).alias("up"), F.col(ends[1]).alias("node")), "node").join(
        parent, ["seed", "up", "depth"])
    rank = F.when(F.col("kind") == "contains", 0).when(F.col("kind") == "calls", 1).otherwise(2)
    return j.groupBy("seed", "node").agg(F.min(F.struct(rank.alias("rank"), F.col("id"))).alias("m")).select("seed", "node", F.col("m.id").alias("edge_id"))


def shortest_paths(steps: DataFrame, pairs: DataFrame, depth: int) -> DataFrame:
    """(seed, goal, path): the shortest path of each (seed, goal), the smallest in order among equals."""
    steps = materialise(steps, "steps")
    now = pairs.select("seed", "goal", F.col("seed").alias("node"), F.array("seed").alias("path"))
    found = now.filter("node = goal")
    seen = now.select("seed", "goal", "node")
    for _ in range(depth):
        now = now.join(found.select("seed", "goal"), ["seed", "goal"], "left_anti").join(steps, F.col("node") == F.col("src"))
        now = now.groupBy("seed", "goal", F.col("dst").alias("node")).agg(F.min(F.concat("path", F.array("dst"))).alias("path"))
        now = materialise(now.join(seen, ["seed", "goal", "node"], "left_anti"), "paths")
        if now.isEmpty():
            break
        seen = seen.unionByName(now.select("seed", "goal", "node"))
        found = found.unionByName(now.filter("node = goal"))
    return found.select("seed", "goal", F.concat_ws(" > ", "path").alias("path"), (F.size("path") - 1).alias("length"))


def components(pairs: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph (a, b): the smallest node that is connected, by spreading minima
    and jumping pointers; the number of rounds grows with the logarithm of the longest chain."""
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a IS NOT NULL AND b IS NOT NULL").distinct()
    both = materialise(both, "pairs")
    label = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "label")
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("low"))
        hop = label.join(near, "node").select("node", F.least("component", "low").alias("low"), F.col("component").alias("old"))
        jump = hop.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        new = materialise(hop.join(jump, "low", "left").select("node", F.least("low", F.coalesce("lower", "low")).alias("component"), "old"), "label")
        if new.filter("component <> old").isEmpty():
            return new.select("node", "component")
        label = new.drop("old")


def _sets_of_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Strongly connected sets of the steps of one task (Tarjan, without recursion), by their smallest node."""
    parts = [b for b in batches if len(b)]
    if not parts:
        return
    e = pd.concat(parts, ignore_index=True)
    codes, names = pd.factorize(pd.concat([e["src"], e["dst"]], ignore_index=True), sort=True)
    n, half = len(names), len(e)
    order = np.argsort(codes[:half], kind="stable")
    to, start = codes[half:][order].tolist(), np.searchsorted(codes[:half][order], np.arange(n + 1)).tolist()
    index, low, group, held = [-1] * n, [0] * n, [-1] * n, []
    clock = 0
    for root in range(n):
        if index[root] >= 0:
            continue
        index[root] = low[root] = clock
        clock += 1
        held.append(root)
        work = [(root, start[root])]
        while work:
            at, k = work.pop()
            if k < start[at + 1]:
                work.append((at, k + 1))
                v = to[k]
                if index[v] < 0:
                    index[v] = low[v] = clock
                    clock += 1
                    held.append(v)
                    work.append((v, start[v]))
                elif group[v] < 0:
                    low[at] = min(low[at], index[v])
                continue
            if work:
                low[work[-1][0]] = min(low[work[-1][0]], low[at])
            if low[at] == index[at]:
                members = []
                while not members or members[-1] != at:
                    members.append(held.pop())
                first = min(members)
                for v in members:
                    group[v] = first
    yield pd.DataFrame({"node": names, "group": np.asarray(names, dtype=object)[group]})


def cyclic_groups(steps: DataFrame, local_steps: int = LOCAL_STEPS) -> DataFrame:
    """(node, group): nodes on cycles, by the smallest node of their strongly connected set.

    By colouring: nodes without an incoming or outgoing step are peeled off; the smallest node that reaches a
    node is spread forwards as its colour; what reaches a colour's own node within the colour is one connected
    set.  Sets are taken out and the rest is coloured again.  Every round is linear in the steps left.  As soon as
    at most ``local_steps`` steps are left (some 200 bytes each), one task reads the sets off them.
    """
    e = materialise(steps.select("src", "dst").filter("src <> dst").distinct(), "cycle_steps")
    found: DataFrame | None = None
    while True:
        size = e.count()
        while size > local_steps:
            for _ in range(STEPS):
                # What nothing enters goes, then what nothing leaves.
                e = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
                e = e.join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
            e = materialise(e, "peeled")
            size, before = e.count(), size
            if size == before:
                break
        if size <= local_steps:
            sets = e.coalesce(1).mapInPandas(_sets_of_task, "node string, `group` string")
            found = sets if found is None else found.unionByName(sets)
            break
        colour = e.select(F.col("src").alias("node")).distinct().withColumn("colour", F.col("node"))
        while True:
            began = colour.withColumnRenamed("colour", "began")
            for _ in range(STEPS):
                low = e.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("low"))
                colour = colour.join(low, "node", "left").select("node", F.least("colour", "low").alias("colour"))
            colour = materialise(colour.join(began, "node").select("node", "colour", (F.col("colour") < F.col("began")).alias("moved")), "colour")
            still = colour.filter("moved").isEmpty()
            colour = colour.drop("moved")
            if still:
                break
        c = materialise(e.join(colour.withColumnRenamed("node", "src").withColumnRenamed("colour", "a"), "src").join(colour.withColumnRenamed("node", "dst").withColumnRenamed("colour", "b"), "dst")
                        .filter("a = b").select(F.col("dst").alias("at"), F.col("src").alias("node"), F.col("a").alias("group")), "coloured")
        part = front = materialise(colour.filter("node = colour").select("node", F.col("colour").alias("group")), "roots")
        while True:
            new = materialise(front.withColumnRenamed("node", "at").join(c, ["at", "group"]).select("node", "group").distinct().join(part, ["node", "group"], "left_anti"), "back")
            if new.isEmpty():
                break
            part, front = part.unionByName(new), new
        part = materialise(part, "set")
        found = part if found is None else found.unionByName(part)
        e = materialise(e.join(part.select(F.col("node").alias("src")), "src", "left_anti").join(part.select(F.col("node").alias("dst")), "dst", "left_anti"), "rest")
    if found is None:
        return steps.sparkSession.createDataFrame([], "node string, `group` string")
    many = found.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("group")
    return found.join(many, "group", "left_semi").select("node", "group")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree, degree); both sides are aggregated before they meet the nodes."""
    i = edges.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))
    o = edges.groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"))
    z = F.lit(0).cast("long")
    return nodes.select("id").distinct().join(i, "id", "left").join(o, "id", "left").select(
        "id", F.coalesce("in_degree", z).alias("in_degree"), F.coalesce("out_degree", z).alias("out_degree"),
        (F.coalesce("in_degree", z) + F.coalesce("out_degree", z)).alias("degree"))


def is_test_path_wide(path: str) -> Column:
    """Whether impact reports take a path for a test's: file names and folders of many languages, either kind of slash."""
    p = F.lower(F.replace(F.col(path), F.lit("\\"), F.lit("/")))
    name = F.substring_index(p, "/", -1)
    return (name.rlike(r"^test[_.]|\.(?:test|spec)\.|_test\.|(?:test\.java|tests\.cs|test\.go)$") | p.rlike(r"/(?:__tests__|tests|test|spec)/"))


def is_test_path(path: str = "file_path"):
    """The path looks like that of a test file."""
    p = F.lower(F.col(path))
    name = F.substring_index(p, "/", -1)
    return (name.startswith("test_") | name.startswith("test.") | name.contains(".test.") | name.contains(".spec.") | name.endswith("_test.go")
            | p.contains("/__tests__/") | p.contains("/tests/") | p.contains("/test/") | p.contains("/spec/"))


def ranked_neighbours(pairs: DataFrame, nodes: DataFrame, degree: DataFrame, cap: int) -> DataFrame:
    """Of (seed, id): the first ``cap`` per seed by tests last, degree, name, id."""
    j = pairs.distinct().join(nodes.select("id", "name", "file_path"), "id").join(degree.select("id", "degree"), "id")
    w = Window.partitionBy("seed").orderBy(is_test_path(), F.desc("degree"), "name", "id")
    return j.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= cap).select("seed", "id", "name", "degree", "rank")


def file_dependencies(edges: DataFrame, nodes: DataFrame, kinds: tuple[str, ...] | None = ("imports",)) -> DataFrame:
    """(src, dst) between different files that an edge connects."""
    e = edges.filter(F.col("kind").isin(*kinds)) if kinds else edges
    f = nodes.select("id", "file_path").filter("file_path IS NOT NULL").distinct()
    return e.select("source", "target").join(f.select(F.col("id").alias("source"), F.col("file_path").alias("src")), "source").join(
        f.select(F.col("id").alias("target"), F.col("file_path").alias("dst")), "target").filter("src <> dst").select("src", "dst").distinct()


def line_clusters(spans: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """(keys, cluster_start, cluster_end, n): spans (start_line, end_line) merged where at most ``gap`` lines lie between."""
    w = Window.partitionBy(*keys).orderBy("start_line", "end_line")
    before = F.max("end_line").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("fresh", F.when(before.isNull() | (F.col("start_line") - before > gap), 1).otherwise(0))
    numbered = marked.withColumn("cluster", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "cluster").agg(F.min("start_line").alias("cluster_start"), F.max("end_line").alias("cluster_end"), F.count(F.lit(1)).alias("n")).drop("cluster")
