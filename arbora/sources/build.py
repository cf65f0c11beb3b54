"""Building the stored index once, so that queries start from clean tables laid out for their joins.

Nodes and edges are folded to one row each; edges are written twice, once grouped and sorted by source and once
by target, so that traversals in either direction read sorted runs of a key and skip files by the keys' ranges
in the Parquet footers; names have their lower-case form beside them; postings are counted once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.operators.search import postings
from arbora.plans import graph_queries as q
from arbora.session import join_uri

#: Tables of a built index and the column each is ranged and sorted by.
LAYOUT = {"nodes": "id", "edges_by_source": "source", "edges_by_target": "target", "files": "path", "refs": "reference_name", "postings": "token"}


def built_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    n = q.nodes(spark, folder).withColumn("name_lc", F.lower("name"))
    e = q.edges(spark, folder)
    return {"nodes": n, "edges_by_source": e, "edges_by_target": e, "files": q.files(spark, folder), "refs": q.refs(spark, folder), "postings": postings(n)}


def build(spark: SparkSession, folder: str, target: str, partitions: int | None = None) -> None:
    """Write the built tables of the raw tables in ``folder``.

    Ranges and not hashes: the hub that holds a tenth of all edges is cut over several files by the second sort
    key, and each file's key range serves as an index.
    """
    for name, df in built_tables(spark, folder).items():
        key = LAYOUT[name]
        second = next(c for c in df.columns if c != key)
        ranged = df.repartitionByRange(partitions, key, second) if partitions else df.repartitionByRange(key, second)
        ranged.sortWithinPartitions(key, second).write.mode("overwrite").parquet(join_uri(target, name))


def load(spark: SparkSession, target: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(join_uri(target, name)) for name in LAYOUT}
