"""Parent-child links to full hierarchies.

1. Every child gets one parent, and links that stood close together in the input are put into blocks of about
   ``BLOCK_LINKS`` links.  Each block becomes a weighted disjoint-set forest: a node points to the topmost node
   that its block knows above it, with the number of steps to it (its root offset), the least id passed over
   and, if asked for, the ids on the way.
2. Only the links that cross blocks (a block's top that is a child in another block) are merged further, level
   by level: each level composes every open pointer with the pointer of the node it ends at, so that after r
   levels it spans 2**r blocks.  A pointer that ends at a root is settled and takes no further part.
3. When a level settles nothing, what is still open lies on or below cycles (of the open nodes nearest to a
   root, some would have settled).  Their pointers go on until they all end on cycles and the least ids have
   gone round.
4. The blocks' pointers meet the merged ones, which gives root, depth and path of every node.

One way for every size: nothing is collected, no task holds more than a block or a shuffle partition.

Defined results for dirty input: links with a null end are ignored; repeated links count once; of two
parents of one child the smaller id wins; a node that contains itself is a cycle of one; an empty table
gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.session import materialise

SEP = " > "
_FOREST = "node string, root string, steps int, cyclic boolean, least string, trail string"
#: Links that one block holds at most before repeated ones are folded, as a power of two (some 200 bytes a link).
BLOCK_BITS = 16


def _compress(par: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Path compression of all nodes at once: (root pointer, root offset, least id passed over, on or below a cycle).

    On a cycle the pointers go round at least once, so the least id passed over is that of the whole cycle.
    """
    n = len(par)
    top = par < 0
    ptr = np.where(top, np.arange(n), par)
    off = np.where(top, 0, 1).astype(np.int64)
    for _ in range(max(1, int(n).bit_length()) + 1):
        nxt = ptr[ptr]
        if np.array_equal(nxt, ptr):
            break
        off = off + off[ptr]
        low = np.minimum(low, low[ptr])
        ptr = nxt
    return ptr, off, low, ~top[ptr]


def _forest(pdf: pd.DataFrame, paths: bool) -> pd.DataFrame:
    """Weighted forest of links (child, parent), one per child: each child's pointer goes to its top."""
    n = len(pdf)
    codes, names = pd.factorize(pd.concat([pdf["child"], pdf["parent"]], ignore_index=True), sort=True)
    names = np.asarray(names, dtype=object)
    child, up = codes[:n], codes[n:]
    par = np.full(len(names), -1, dtype=np.int64)
    par[child] = up
    ptr, off, low, looped = _compress(par, np.arange(len(names)))  # codes are in the order of the names
    root = names[np.where(looped, low[ptr], ptr)]
    trail: list[str | None] = [None] * n
    if paths:
        full: list[str | None] = [None] * len(names)
        for i in child:
            chain = []
            at = int(i)
            while not looped[at] and par[at] >= 0 and full[at] is None:
                chain.append(at)
                at = int(par[at])
            for j in reversed(chain):
                above = full[int(par[j])]
                full[j] = names[j] if above is None else above + SEP + names[j]
        trail = [full[i] for i in child]
    return pd.DataFrame({
        "node": pdf["child"].to_numpy(), "root": root[child], "steps": np.where(looped[child], 0, off[child]).astype("int32"),
        "cyclic": looped[child], "least": names[low[child]], "trail": trail,
    })


def contains_links(edges: DataFrame) -> DataFrame:
    """(child, parent) of the edges whose kind is ``contains`` in whatever spelling."""
    from arbora.sources.tables import norm_kind

    return edges.filter((norm_kind() == "contains") & F.col("source").isNotNull() & F.col("target").isNotNull()).select(
        F.col("target").alias("child"), F.col("source").alias("parent")
    )


def forest(links: DataFrame, paths: bool = False, block_bits: int = BLOCK_BITS) -> DataFrame:
    """(node_id, root_id, depth[, path]) of every node at either end of a link.

    A node on or below a cycle has the smallest id on that cycle as root, depth -1 and a null path.
    """
    clean = links.filter(F.col("child").isNotNull() & F.col("parent").isNotNull()).select("child", "parent")
    near = F.shiftright(F.monotonically_increasing_id(), block_bits)  # any blocks give the right rows; neighbours of the input give few links between blocks
    one = clean.withColumn("near", near).groupBy("child").agg(F.min("parent").alias("parent"), F.min("near").alias("near"))
    local = materialise(one.groupBy("near").applyInPandas(lambda pdf: _forest(pdf, paths), _FOREST), "forest")
    tops = local.filter(~F.col("cyclic")).select(F.col("root").alias("node")).distinct()
    merged = _merge(materialise(local.join(tops, "node", "left_semi"), "bridge"))
    above = merged.select(F.col("node").alias("root"), F.col("root").alias("up"), F.col("steps").alias("more"),
                          F.col("cyclic").alias("loops"), F.col("trail").alias("before"))
    j = local.join(above, "root", "left")
    cyclic = F.col("cyclic") | F.coalesce("loops", F.lit(False))
    top = F.when(F.col("cyclic") | F.col("up").isNull(), F.col("root")).otherwise(F.col("up"))
    rows = j.select(
        F.col("node").alias("node_id"), top.alias("root_id"),
        F.when(cyclic, F.lit(-1)).otherwise(F.col("steps") + F.coalesce("more", F.lit(0))).cast("int").alias("depth"),
        *([F.when(~cyclic, F.concat_ws(SEP, top, "before", "trail")).alias("path")] if paths else []),
    )
    rows = materialise(rows, "rows")
    roots = rows.filter("depth > 0").select(F.col("root_id").alias("node_id")).distinct().select(
        "node_id", F.col("node_id").alias("root_id"), F.lit(0).alias("depth"), *([F.col("node_id").alias("path")] if paths else [])
    )
    return rows.unionByName(roots)


def _merge(bridge: DataFrame) -> DataFrame:
    """Settled pointers (node, root, steps, cyclic, least, trail) of all links between blocks."""
    settled = bridge.filter("cyclic")
    active = bridge.filter("NOT cyclic")
    before = -1
    while True:
        marked = settled.withColumn("open", F.lit(False)).unionByName(active.withColumn("open", F.lit(True)))
        up = marked.select(F.col("node").alias("root"), F.col("root").alias("r2"), F.col("steps").alias("s2"), F.col("cyclic").alias("c2"),
                           F.col("least").alias("l2"), F.col("trail").alias("t2"), F.col("open").alias("o2"))
        go = F.col("r2").isNotNull()
        level = materialise(active.join(up, "root", "left").select(
            "node", F.coalesce("r2", "root").alias("root"), (F.col("steps") + F.coalesce("s2", F.lit(0))).alias("steps"),
            F.coalesce("c2", F.lit(False)).alias("cyclic"), F.least("least", "l2").alias("least"),
            F.when(go & F.col("trail").isNotNull(), F.concat_ws(SEP, "t2", "trail")).otherwise(F.col("trail")).alias("trail"),
            F.coalesce("o2", F.lit(False)).alias("open"),
        ), "level")
        settled = settled.unionByName(level.filter("NOT open").drop("open"))
        active = level.filter("open").drop("open")
        left = active.count()
        if left == 0:
            return settled
        if left == before:
            return settled.unionByName(_rings(active))
        before = left


def _rings(active: DataFrame) -> DataFrame:
    """Settled pointers of nodes on or below cycles: the root is the least id on the cycle.

    The nodes that pointers end at become fewer with every level until they are just those on cycles; their
    least ids are whole when another level changes none.
    """
    now = active.select("node", "root", "least")
    ends = -1
    while True:
        up = now.select(F.col("node").alias("root"), F.col("root").alias("r2"), F.col("least").alias("l2"))
        now = materialise(now.join(up, "root").select(
            "node", F.col("r2").alias("root"), F.least("least", "l2").alias("least"), (F.col("l2") < F.col("least")).alias("fell")), "ring")
        seen = now.agg(F.countDistinct("root").alias("ends"), F.count_if("fell").alias("fell")).first()
        if seen["ends"] == ends and not seen["fell"]:
            break
        ends, now = seen["ends"], now.drop("fell")
    name = now.select(F.col("node").alias("root"), F.col("least").alias("name"))
    return now.join(name, "root").select("node", F.col("name").alias("root"), F.lit(0).alias("steps"), F.lit(True).alias("cyclic"), F.col("name").alias("least"), F.lit(None).cast("string").alias("trail"))


def descendants(forest_with_paths: DataFrame) -> DataFrame:
    """(ancestor_id, node_id, distance) for every node and every node above it; none on or below a cycle."""
    ids = F.split("path", SEP)
    return forest_with_paths.filter("depth > 0").select(
        F.posexplode(F.slice(ids, 1, F.size(ids) - 1)).alias("level", "ancestor_id"), "node_id", "depth"
    ).select("ancestor_id", "node_id", (F.col("depth") - F.col("level")).cast("int").alias("distance"))


def hierarchy(links: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """(node_id, root_id, depth, path, n_descendants); null path and 0 descendants on or below a cycle.

    Descendants are counted off the paths, so the work follows the size of the paths that are returned anyway.
    """
    f = materialise(forest(links, True, block_bits), "hierarchy")
    n = descendants(f).groupBy("ancestor_id").agg(F.count(F.lit(1)).alias("n_descendants"))
    return f.join(n.withColumnRenamed("ancestor_id", "node_id"), "node_id", "left").select(
        "node_id", "root_id", "depth", "path", F.coalesce("n_descendants", F.lit(0)).cast("long").alias("n_descendants")
    )
