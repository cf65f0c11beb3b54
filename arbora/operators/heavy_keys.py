"""Per-key results where a few keys hold most records.

Every measure is algebraic, so each task folds its rows into one mergeable state per key (Spark's hash
aggregate spills those states when they outgrow memory) and only the states are shuffled: a key with a
third of all rows ships one state per task.  Distinct counts are made algebraic by folding
(key, value) pairs first.

Defined results: a null key is a key of its own; repeated rows count; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.sources.tables import norm_kind


def per_target_kind(edges: DataFrame) -> DataFrame:
    """(target, kind, n_rows, n_sources, n_lines, first_line, last_line) of each target and kind."""
    pairs = edges.groupBy("target", norm_kind().alias("kind"), "source").agg(
        F.count(F.lit(1)).alias("n"), F.count("line").alias("l"), F.min("line").alias("lo"), F.max("line").alias("hi")
    )
    return pairs.groupBy("target", "kind").agg(
        F.sum("n").alias("n_rows"), F.count("source").alias("n_sources"), F.sum("l").alias("n_lines"),
        F.min("lo").alias("first_line"), F.max("hi").alias("last_line"),
    )


def heavy_keys(edges: DataFrame, share: float = 0.01) -> DataFrame:
    """(target, kind, n_rows) of the keys that hold at least ``share`` of all rows.

    The states of all keys are shuffled once; those that stay below the threshold are dropped on arrival.
    """
    counts = edges.groupBy("target", norm_kind().alias("kind")).agg(F.count(F.lit(1)).alias("n_rows"))
    total = edges.agg(F.count(F.lit(1)).alias("total")).scalar()
    return counts.filter(F.col("n_rows") >= F.lit(share) * total)
