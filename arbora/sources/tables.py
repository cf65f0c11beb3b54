"""Readers of the stored index: one DataFrame per table, cleaned in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "nodes", "edges", "files", "file_scans", "unresolved_refs", "documents", "sync_runs",
    "builtin_symbols", "library_hashes", "eval_items",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def norm_kind(col: str | Column = "kind") -> Column:
    """An edge kind without regard to case and surrounding blanks."""
    return F.lower(F.trim(F.col(col) if isinstance(col, str) else col))


def norm_hash(col: str | Column = "content_hash") -> Column:
    """A content hash in one spelling: trimmed, lower case, no ``sha256:`` or ``0x`` in front."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(F.lower(F.trim(c)), r"^(?:sha-?256[:=]|0x)", "")


def norm_language(col: str | Column = "language") -> Column:
    """One canonical language name: ``TypeScript``, ``type_script``, ``TYPESCRIPT`` -> ``typescript``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9+#]", "")


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with whole-row repeats folded; one row per id (the smallest row wins)."""
    n = table(spark, sf_dir, "nodes")
    rest = [c for c in n.columns if c != "id"]
    return n.groupBy("id").agg(F.min(F.struct(*rest)).alias("r")).select("id", *[F.col(f"r.{c}").alias(c) for c in rest])


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with whole-row repeats folded by their id and kinds in one spelling; parallel edges stay."""
    e = table(spark, sf_dir, "edges")
    return (
        e.groupBy("id").agg(F.min(F.struct("source", "target", norm_kind().alias("kind"), "line", "col", "provenance")).alias("r"))
        .select("id", "r.*")
    )
