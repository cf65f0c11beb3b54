"""One cycle of synchronisation: what changed is taken out of the index, read again, stored and resolved.

Detection, deletion, extraction and resolution are the operators of their own modules; this chains them.  Nothing
is written in place: the result is a new set of tables, which ``operators.store`` commits as a version.

Defined results: a path seen without a text (excerpts, unreadable files) is stored as a file without nodes; texts of
paths that were not seen are not read; an unchanged path keeps its rows; empty tables give an empty index.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.extract.imports import bindings
from arbora.extract.symbols import extracted
from arbora.operators.graph import file_dependencies
from arbora.operators.resolve import resolve
from arbora.operators.store import delete_files, drop_orphans
from arbora.session import materialise
from arbora.streaming.changes import detect, scoped_refs


@dataclass
class Cycle:
    diff: DataFrame  # path, action
    nodes: DataFrame
    edges: DataFrame
    files: DataFrame
    refs: DataFrame
    resolved: DataFrame  # ref, source, target, kind, confidence, method


def cycle(seen: DataFrame, texts: DataFrame, nodes: DataFrame, edges: DataFrame, files: DataFrame, refs: DataFrame, now: int) -> Cycle:
    """The tables after one cycle.

    seen: (path, modified_at, size, content_hash) of the tree; texts: (path, text); the other tables are the index,
    one row per node, edge, path and reference.  ``now`` is entered as the time of indexing.
    """
    diff = materialise(detect(seen, files), "diff")
    work = diff.filter("action IN ('added', 'modified')").select("path")
    stale = diff.filter("action IN ('removed', 'modified')").select("path")
    depend = file_dependencies(edges, nodes, None).join(stale.withColumnRenamed("path", "dst"), "dst", "left_semi").select(F.col("src").alias("path"))
    kept_nodes, kept_edges, kept_files, kept_refs = delete_files(stale, nodes, edges, files, refs)
    rows = materialise(extracted(texts.join(work, "path", "left_semi")), "extracted")
    own = rows.filter("sort = 'node'").dropDuplicates(["id"])
    columns = [c for c in nodes.columns if c in own.columns]
    all_nodes = kept_nodes.select(columns).unionByName(own.select(columns))
    inside = rows.filter("sort = 'edge'").select(F.xxhash64("source", "target", "kind", "line").alias("id"), "source", "target", "kind", "line").distinct()
    asked = rows.filter("sort = 'ref'").select(
        F.xxhash64("source", "reference_name", "reference_kind", "line").alias("id"), F.col("source").alias("from_node_id"), "reference_name", "reference_kind", "line", "file_path", "language").distinct()
    counts = own.groupBy(F.col("file_path").alias("path")).agg(F.count(F.lit(1)).cast("int").alias("node_count"))
    fresh = seen.join(work, "path", "left_semi").join(counts, "path", "left").select(
        "path", "content_hash", "size", "modified_at", F.lit(now).cast("long").alias("indexed_at"), F.coalesce("node_count", F.lit(0)).alias("node_count"))
    all_files = kept_files.select(fresh.columns).unionByName(fresh)
    all_refs = materialise(kept_refs.select(asked.columns).unionByName(asked), "refs")
    all_nodes = materialise(all_nodes, "nodes")
    n_files = all_files.agg(F.count(F.lit(1)).alias("n")).scalar()
    again = scoped_refs(all_refs, work, depend, all_nodes, n_files)
    resolved = materialise(resolve(all_refs.join(again, "id", "left_semi"), all_nodes, all_files.select("path"), bindings(texts)), "resolved")
    found = resolved.select(F.xxhash64("source", "target", "kind", "ref").alias("id"), "source", "target", "kind", F.lit(None).cast("int").alias("line"))
    all_edges = drop_orphans(kept_edges.select(inside.columns).unionByName(inside).unionByName(found), all_nodes)
    return Cycle(diff, all_nodes, all_edges, all_files, all_refs, resolved)
