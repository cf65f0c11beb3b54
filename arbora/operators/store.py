"""Writes to the stored index: versioned tables, keyed upserts, cascading deletes, snapshots.

A version is a folder with all tables; the pointer file names the current one and is replaced as a whole, so
readers see a version or the next one, never a mixture, and a failed write leaves the pointer alone.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora.session import join_uri
from arbora.streaming.capture import SharedFiles

TABLES = ("nodes", "edges", "files", "refs")


class IndexStore:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base, self.files = spark, base, SharedFiles(spark, base)

    def version(self) -> int:
        return json.loads(self.files.read("current.json"))["version"] if self.files.exists("current.json") else 0

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(join_uri(self.base, str(self.version() if version is None else version), name))

    def commit(self, **tables: DataFrame) -> int:
        """Write a new version; tables that are not given are carried over."""
        now, new = self.version(), self.version() + 1
        for name in TABLES:
            df = tables.get(name)
            if df is None and now:
                df = self.read(name, now)
            if df is not None:
                df.write.mode("overwrite").parquet(join_uri(self.base, str(new), name))
        self.files.write(json.dumps({"version": new}), "current.json")
        return new

    def snapshot(self, target: str) -> None:
        for name in TABLES:
            self.read(name).write.mode("overwrite").parquet(join_uri(target, name))

    def restore(self, source: str) -> int:
        return self.commit(**{name: self.spark.read.parquet(join_uri(source, name)) for name in TABLES})

    # ---- mutations

    def store_files(self, files: DataFrame, nodes: DataFrame, edges: DataFrame, refs: DataFrame) -> int:
        """Replace what is stored of these files, except where hash and node count are unchanged."""
        if not self.version():
            return self.commit(files=files, nodes=nodes, edges=drop_orphans(edges, nodes), refs=refs)
        old = self.read("files").select("path", F.col("content_hash").alias("h"), F.col("node_count").alias("c"))
        todo = files.join(old, "path", "left").filter(~(F.col("h").eqNullSafe(F.col("content_hash")) & F.col("c").eqNullSafe(F.col("node_count")) & F.col("h").isNotNull())).select("path")
        kept = delete_files(todo, *[self.read(t) for t in TABLES])
        new_nodes = nodes.join(todo.withColumnRenamed("path", "file_path"), "file_path", "left_semi")
        all_nodes = kept[0].unionByName(new_nodes)
        own = edges.join(new_nodes.select(F.col("id").alias("source")), "source", "left_semi")
        return self.commit(nodes=all_nodes, edges=drop_orphans(kept[1].unionByName(own), all_nodes), files=kept[2].unionByName(files.join(todo, "path", "left_semi")),
                           refs=kept[3].unionByName(refs.join(todo.withColumnRenamed("path", "file_path"), "file_path", "left_semi")))

    def delete(self, paths: DataFrame) -> int:
        kept = delete_files(paths, *[self.read(t) for t in TABLES])
        return self.commit(**dict(zip(TABLES, kept, strict=True)))


def delete_files(paths: DataFrame, nodes: DataFrame, edges: DataFrame, files: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What is left of nodes, edges (at either end), files and references without these paths."""
    gone = nodes.join(paths.select(F.col("path").alias("file_path")), "file_path", "left_semi").select("id").distinct()
    by = lambda df, col: df.join(gone.withColumnRenamed("id", col), col, "left_anti")
    return (nodes.join(paths.select(F.col("path").alias("file_path")), "file_path", "left_anti"), by(by(edges, "source"), "target"), files.join(paths, "path", "left_anti"),
            by(refs, "from_node_id").join(paths.select(F.col("path").alias("file_path")), "file_path", "left_anti"))


def drop_orphans(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends exist."""
    k = nodes.select("id").distinct()
    return edges.join(k.withColumnRenamed("id", "source"), "source", "left_semi").join(k.withColumnRenamed("id", "target"), "target", "left_semi")


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the one with the greatest ``order``; new rows win ties."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc(order), F.desc("_new"))
    return both.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_new")
