"""Change detection, coalescing and debouncing of file events, scoped re-resolution, as batch and as stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def detect(seen: DataFrame, known: DataFrame) -> DataFrame:
    """(path, action) from two (path, modified_at, size, content_hash): added, modified, removed or unchanged.

    Another time of change is a change; at the same time only another size with another hash is one.
    """
    a = seen.select("path", *[F.col(c).alias(f"s_{c}") for c in ("modified_at", "size", "content_hash")], F.lit(True).alias("is_seen"))
    b = known.select("path", *[F.col(c).alias(f"k_{c}") for c in ("modified_at", "size", "content_hash")], F.lit(True).alias("is_known"))
    differs = ~F.col("s_modified_at").eqNullSafe(F.col("k_modified_at")) | (~F.col("s_size").eqNullSafe(F.col("k_size")) & ~F.col("s_content_hash").eqNullSafe(F.col("k_content_hash")))
    action = F.when(F.col("is_known").isNull(), "added").when(F.col("is_seen").isNull(), "removed").when(differs, "modified").otherwise("unchanged")
    return a.join(b, "path", "full_outer").select("path", action.alias("action"))


def coalesce(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(path, action, n): one action per path; removed beats modified beats added."""
    rank = F.when(F.col("action") == "removed", 3).when(F.col("action") == "modified", 2).when(F.col("action") == "added", 1)
    keys = ["path", *(by or [])]
    return events.filter(F.col("action").isin("added", "modified", "removed")).groupBy(*keys).agg(F.max(rank).alias("r"), F.count(F.lit(1)).alias("n")).select(
        *keys, F.element_at(F.array(*[F.lit(x) for x in ("added", "modified", "removed")]), F.col("r")).alias("action"), "n")


def debounce(events: DataFrame, gap_seconds: int) -> DataFrame:
    """(path, started, ended, n): bursts of events of a path with pauses of at most ``gap_seconds`` inside."""
    w = Window.partitionBy("path").orderBy("ts", "event_id")
    fresh = F.when(F.lag("ts").over(w).isNull() | (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp")) > gap_seconds * 1_000_000), 1).otherwise(0)
    numbered = events.withColumn("fresh", fresh).withColumn("burst", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("path", "burst").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("n")).drop("burst")


def action_of(event_type: Column) -> Column:
    """How the event log's types stand for file events."""
    return F.when(event_type == "view", "added").when(event_type.isin("click", "signup"), "modified").when(event_type == "error", "removed")


def file_events(events: DataFrame) -> DataFrame:
    return events.select("event_id", "ts", F.col("user_id").cast("string").alias("path"), action_of(F.col("event_type")).alias("action"))


def scoped_refs(refs: DataFrame, changed: DataFrame, dependent: DataFrame, nodes: DataFrame, n_files: Column) -> DataFrame:
    """References to look at again: of changed files, of files that depend on them, or by a name defined in them.

    Where a tenth of all files (one at least) has changed, all of them.  ``n_files``: the number of files, a scalar.
    """
    many = changed.select("path").distinct().agg(F.count(F.lit(1)).alias("n")).scalar() >= F.greatest(F.lit(1), F.floor(n_files / 10))
    scope = changed.select(F.col("path").alias("file_path")).unionByName(dependent.select(F.col("path").alias("file_path"))).distinct()
    names = nodes.join(changed.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi").select(F.col("name").alias("reference_name")).distinct()
    near = refs.join(scope, "file_path", "left_semi").select("id").unionByName(refs.join(names, "reference_name", "left_semi").select("id"))
    return near.unionByName(refs.filter(many).select("id")).distinct()


def effective_writes(log: DataFrame) -> DataFrame:
    """(path, indexed_at, written): a row of the log is written unless hash and node count equal the row before."""
    w = Window.partitionBy("path").orderBy("indexed_at", "content_hash", "node_count")
    same = F.lag("content_hash").over(w).eqNullSafe(F.col("content_hash")) & F.lag("node_count").over(w).eqNullSafe(F.col("node_count")) & F.lag("path").over(w).isNotNull()
    return log.select("path", "indexed_at", "content_hash", "node_count").distinct().withColumn("written", ~same).select("path", "indexed_at", "content_hash", "node_count", "written")


def stream_coalesced(spark: SparkSession, source: str, folder: str, gap: str = "2 seconds", late: str = "10 minutes") -> DataFrame:
    """(path, action, n) from a stream of event files: every available file is read once, per micro-batch the
    rows are merged into a new version of the state, so that a replayed batch overwrites its own version."""
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).parquet(source)
    versions = f"{folder}/versions"

    def merge(batch: DataFrame, number: int) -> None:
        new = coalesce(file_events(batch))
        if number:
            old = spark.read.parquet(f"{versions}/{number - 1}")
            both = old.unionByName(new)
            n = both.groupBy("path").agg(F.sum("n").alias("n"))
            new = coalesce(both.drop("n")).drop("n").join(n, "path")
        new.select("path", "action", "n").write.mode("overwrite").parquet(f"{versions}/{number}")

    q = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    last = q.lastProgress["batchId"] if q.lastProgress else 0
    while last >= 0:
        try:
            return spark.read.parquet(f"{versions}/{last}")
        except Exception:  # noqa: BLE001  the last progress may report a batch without data
            last -= 1
    raise RuntimeError("no batch was written")


def debounced_stream(events: DataFrame, gap: str = "2 seconds", late: str = "10 minutes") -> DataFrame:
    """The streaming form of ``debounce``: session windows under a watermark that bounds the state."""
    return events.withWatermark("ts", late).groupBy("path", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("ended"))
