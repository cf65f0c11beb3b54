"""Processing only new or changed records: log-based change capture.

The log (one row per observation, ``seq`` rising) is split by key into a fixed number of log partitions.
A run
  1. reads the offsets of the last committed batch (the highest ``seq`` done, per partition),
  2. writes the plan of its batch (from- and to-offsets of every partition) ahead of any work,
  3. writes the newest state of the keys it touched (a delta; every ``COMPACT`` batches the deltas are folded
     into a new base) and one verdict per touched key into folders that carry the batch number,
  4. commits by renaming a marker into place.
A run that finds a plan without a commit replays exactly that plan: the folders are overwritten, so nothing
is skipped or repeated.  A key that is absent or equals what is recorded gets a verdict with a null hash, which
takes back what an earlier batch said of it.  The sink is read through ``dedup``: one row per key, the highest
offset (the last log row of the key that had been read) wins, and keys taken back drop out; so any cut of the
log into batches leaves the same rows.  Log files below the lowest offset are skipped by their key ranges.
Plans and markers go through Hadoop's file system API, so they live beside the data on any shared store.

Defined results: rows with a null key or null ``seq`` are ignored; repeated rows count once; of two
observations of one key at one time the later ``seq`` wins; empty tables give an empty batch; hash
spelling does not matter; modified_at and size are never trusted.
"""

from __future__ import annotations

import json
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora.session import join_uri, materialise
from arbora.sources.tables import norm_hash

LOG_PARTITIONS = 16
#: Batches after which the deltas of the state are folded into one base.
COMPACT = 16
_STATE = "path string, s struct<seen_at: bigint, seq: bigint, content_hash: string>, offset bigint"
_SINK = "path string, content_hash string, offset bigint"


class SharedFiles:
    """Small text files in a shared folder."""

    def __init__(self, spark: SparkSession, base: str):
        jvm = self._jvm = spark.sparkContext._jvm
        self._gateway, self._conf = spark.sparkContext._gateway, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(base).getFileSystem(self._conf)
        self._io = jvm.org.apache.commons.io.IOUtils
        self.base = base

    def exists(self, *name: str) -> bool:
        return self._fs.exists(self._path(join_uri(self.base, *name)))

    def read(self, *name: str) -> str:
        stream = self._fs.open(self._path(join_uri(self.base, *name)))
        try:
            return self._io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, text: str, *name: str) -> None:
        """All or nothing: the file appears under its name only when it is whole."""
        target, part = self._path(join_uri(self.base, *name)), self._path(join_uri(self.base, *name) + ".part")
        out = self._fs.create(part, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        jvm = self._jvm
        ways = jvm.org.apache.hadoop.fs.Options.Rename
        how = self._gateway.new_array(ways, 1)
        how[0] = ways.OVERWRITE  # in one step, so that no crash leaves neither file
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf).rename(part, target, how)

    def names(self, *folder: str) -> list[str]:
        path = self._path(join_uri(self.base, *folder))
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []


class ChangeCapture:
    """Change capture over an append-only log of observations with exactly-once batches."""

    def __init__(self, spark: SparkSession, base: str, partitions: int = LOG_PARTITIONS):
        self.spark, self.base, self.partitions = spark, base, partitions
        self.files = SharedFiles(spark, base)

    def _slot(self) -> Column:
        return F.pmod(F.xxhash64("path"), F.lit(self.partitions)).cast("int")

    def committed(self) -> int:
        done = [int(x.split(".")[0]) for x in self.files.names("commits") if x.endswith(".json")]
        return max(done, default=0)

    def offsets(self) -> dict[int, int]:
        last = self.committed()
        return {int(k): v for k, v in json.loads(self.files.read("plans", f"{last}.json"))["to"].items()} if last else {}

    def plan(self, log: DataFrame, upto: int | None = None) -> dict:
        """The plan of the next batch: the unfinished one if there is one, else a new one, written ahead."""
        last = self.committed()
        number = last + 1
        if self.files.exists("plans", f"{number}.json"):
            return json.loads(self.files.read("plans", f"{number}.json"))
        since = self.offsets()
        new = log.filter(F.col("seq") > min(since.values())) if len(since) == self.partitions else log
        new = new if upto is None else new.filter(F.col("seq") <= upto)
        # One row per log partition (a fixed number) comes to the driver, never log rows.
        top = {r["slot"]: r["hi"] for r in new.groupBy(self._slot().alias("slot")).agg(F.max("seq").alias("hi")).collect()}
        to = {k: max(since.get(k, top.get(k)), top.get(k, since.get(k))) for k in since.keys() | top.keys()}
        base = json.loads(self.files.read("commits", f"{last}.json"))["base"] if last else 0
        plan = {"batch": number, "base": base, "from": {str(k): v for k, v in since.items()}, "to": {str(k): v for k, v in to.items()}}
        self.files.write(json.dumps(plan), "plans", f"{number}.json")
        return plan

    def _between(self, plan: dict, side: str, default: int) -> Column:
        offsets = plan[side]
        if not offsets:
            return F.lit(default).cast("long")
        pairs = [x for k, v in offsets.items() for x in (F.lit(int(k)), F.lit(v).cast("long"))]
        return F.coalesce(F.create_map(*pairs)[self._slot()], F.lit(default).cast("long"))

    def _state(self, base: int, last: int) -> DataFrame:
        """All that batches up to ``last`` left: the base and the deltas since (a path can occur in several)."""
        folders = [join_uri(self.base, "base", str(base))] if base else []
        return self.spark.read.schema(_STATE).parquet(*folders, *[join_uri(self.base, "delta", str(k)) for k in range(base + 1, last + 1)])

    def run(self, observations: DataFrame, recorded: DataFrame, upto: int | None = None, fail_before: str = "") -> DataFrame:
        """Process one batch and return its verdicts (path, content_hash, offset); the hash is null where nothing is to be done.

        observations: (path, seq, seen_at, content_hash), the hash null where the path was absent.
        recorded: (path, content_hash) that the last successful run left, one row per path.
        upto: a new batch ends at this ``seq``; an unfinished one at that of its plan.
        fail_before: "sink" or "commit" raises there, for tests of recovery.
        """
        log = observations.filter(F.col("path").isNotNull() & F.col("seq").isNotNull())
        plan = self.plan(log, upto)
        number, base = plan["batch"], plan["base"]
        if len(plan["from"]) == self.partitions:
            log = log.filter(F.col("seq") > min(plan["from"].values()))
        fresh = log.filter((F.col("seq") > self._between(plan, "from", -(2**62))) & (F.col("seq") <= self._between(plan, "to", -(2**62))))
        newest = fresh.groupBy("path").agg(F.max(F.struct("seen_at", "seq", "content_hash")).alias("s"), F.max("seq").alias("offset"))
        if number > 1:  # a late row may be older than what an earlier batch saw of its path
            before = self._state(base, number - 1).join(newest.select("path"), "path", "left_semi")
            newest = newest.unionByName(before).groupBy("path").agg(F.max("s").alias("s"), F.max("offset").alias("offset"))
        delta = join_uri(self.base, "delta", str(number))
        newest.write.mode("overwrite").parquet(delta)
        if fail_before == "sink":
            raise RuntimeError("stopped before the sink")
        old = recorded.select("path", norm_hash().alias("had"))
        seen = norm_hash(F.col("s.content_hash"))
        verdict = self.spark.read.schema(_STATE).parquet(delta).join(old, "path", "left").select(
            "path", F.when(F.col("had").isNull() | (seen != F.col("had")), seen).alias("content_hash"), "offset")
        sink = join_uri(self.base, "sink", f"batch={number}")
        verdict.write.mode("overwrite").parquet(sink)
        if number - base >= COMPACT:
            self._state(base, number).groupBy("path").agg(F.max("s").alias("s"), F.max("offset").alias("offset")).write.mode("overwrite").parquet(join_uri(self.base, "base", str(number)))
            base = number
        if fail_before == "commit":
            raise RuntimeError("stopped before the commit")
        self.files.write(json.dumps({"batch": number, "base": base}), "commits", f"{number}.json")
        return self.spark.read.schema(_SINK).parquet(sink)

    def sink(self) -> DataFrame:
        """What is to be done after all committed batches, one row per key."""
        last = self.committed()
        rows = self.spark.read.schema(_SINK + ", batch int").parquet(join_uri(self.base, "sink"))
        return dedup(rows.filter(F.col("batch") <= last).drop("batch")).filter("content_hash IS NOT NULL")


def dedup(rows: DataFrame) -> DataFrame:
    """One row per key: that of the highest offset."""
    return rows.groupBy("path").agg(F.max(F.struct("offset", "content_hash")).alias("r")).select("path", "r.content_hash", "r.offset")


DAY_MS = 86_400_000


def with_run_status(files: DataFrame, runs: DataFrame) -> DataFrame:
    """Adds ``run_status``: the status of the last run started at or before ``indexed_at``.

    An as-of join: every run's interval up to the next start is cut into days, so that the join has an
    equal key; times after the last start fall into the last run's first day.
    """
    own = runs.filter("started_at IS NOT NULL").groupBy("started_at").agg(F.max(F.struct("run_id", "status")).alias("r"))
    span = own.select("started_at", F.lower(F.trim(F.col("r.status"))).alias("run_status"),
                      F.lead("started_at").over(Window.orderBy("started_at")).alias("next_at"))  # one row per run, a fixed number
    day = lambda c: F.floor(F.col(c) / DAY_MS)
    cut = span.select("*", F.explode(F.sequence(day("started_at"), F.coalesce(day("next_at"), day("started_at")))).alias("run_day"))
    last = own.agg(F.floor(F.max("started_at") / DAY_MS).alias("last_day")).scalar()
    keyed = files.withColumn("run_day", F.least(day("indexed_at"), last))
    return keyed.join(cut, "run_day").filter((F.col("started_at") <= F.col("indexed_at")) & (F.col("next_at").isNull() | (F.col("indexed_at") < F.col("next_at"))))


def recorded_state(files: DataFrame, runs: DataFrame) -> DataFrame:
    """(path, content_hash): the newest row per path that belongs to a run which ended well.

    Ties of indexed_at: the greatest hash wins.
    """
    ok = with_run_status(files.filter("path IS NOT NULL AND indexed_at IS NOT NULL").select("path", "content_hash", "indexed_at"), runs).filter("run_status = 'ok'")
    return ok.groupBy("path").agg(F.max(F.struct("indexed_at", norm_hash().alias("content_hash"))).alias("r")).select("path", "r.content_hash")


def observations_of(file_scans: DataFrame) -> DataFrame:
    return file_scans.select("path", F.col("scan_id").alias("seq"), F.col("scanned_at").alias("seen_at"), "content_hash")


def changed_paths(spark: SparkSession, file_scans: DataFrame, files: DataFrame, runs: DataFrame, base: str, batches: int = 3, broken: int = 2) -> DataFrame:
    """Capture over everything that was seen: (path, content_hash, offset) of what must be indexed.

    The log is read in so many batches of about equal ranges of ``seq``; batch ``broken`` (0: none) breaks off before its commit and is replayed.
    """
    capture = ChangeCapture(spark, base)
    log, recorded = observations_of(file_scans), materialise(recorded_state(files, runs), "recorded")
    span = log.agg(F.min("seq").alias("lo"), F.max("seq").alias("hi")).first()
    lo, hi = span["lo"] or 0, span["hi"] or 0
    for k in range(1, batches + 1):
        upto = lo + (hi - lo) * k // batches
        if k == broken:
            try:
                capture.run(log, recorded, upto, fail_before="commit")
            except RuntimeError:
                capture = ChangeCapture(spark, base)  # what a new process finds
        capture.run(log, recorded, upto)
    return capture.sink()
