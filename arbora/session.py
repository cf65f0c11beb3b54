"""Session defaults, the shared working folder and lineage cutting."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: str | None = None


def build_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that tests and the bench use."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("arbora")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session, or what ``setCheckpointDir`` was given.

    Only where neither is set and the master is local (tests, a laptop) a folder of our own is made and set; on a
    cluster that is an error, as a machine's own folder is not shared.
    """
    global _OWN_DIR
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if _OWN_DIR is None:
            _OWN_DIR = tempfile.mkdtemp(prefix="arbora-")
            atexit.register(shutil.rmtree, _OWN_DIR, ignore_errors=True)
        named = "file://" + _OWN_DIR
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """The part of the shared folder that belongs to this application."""
    return f"{shared_dir(spark)}/arbora/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back.

    The written table survives the loss of any executor, is compressed and can be pruned by column,
    which a row checkpoint cannot.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes that are sent to all tasks at once, at most.
SENT_BYTES = 32_000_000


def sent(df: DataFrame) -> DataFrame:
    """A side that is small (it is counted first) is marked to be sent to all tasks; any other is left to the join."""
    width = sum((F.coalesce(F.length(c), F.lit(0)) for c, kind in df.dtypes if kind == "string"), F.lit(64))
    return F.broadcast(df) if (df.agg(F.sum(width.cast("long"))).first()[0] or 0) <= SENT_BYTES else df


def sweep(spark: SparkSession) -> None:
    """Remove every table that this application's ``materialise`` has written; results that still read them must be saved before."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer splits than there are cores is dealt out to all of them; any other is left alone.

    For scans only (no shuffle below), where counting the splits costs nothing.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.toJavaRDD().getNumPartitions() < cores else df


def join_uri(base: str, *parts: str) -> str:
    return "/".join([base.rstrip("/"), *parts])


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="arbora-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = Path(folder) / "arbora.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path("arbora") / p.relative_to(root))
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)
