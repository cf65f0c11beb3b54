"""One object with a method per question that the engine answers; every method returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora.operators import context, resolve
from arbora.operators import graph as G
from arbora.operators import hierarchy as H
from arbora.operators import search as S
from arbora.session import ship_package
from arbora.sources.tables import table
from arbora.streaming import changes


class GraphEngine:
    """Questions over nodes, edges, files and references (cleaned tables: one row per node and edge)."""

    def __init__(self, spark: SparkSession, nodes: DataFrame, edges: DataFrame, files: DataFrame | None = None, refs: DataFrame | None = None, documents: DataFrame | None = None):
        ship_package(spark)
        self.spark, self.nodes, self.edges, self.files, self.refs, self.documents = spark, nodes, edges, files, refs, documents

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> GraphEngine:
        from arbora.plans import graph_queries as q

        return cls(spark, q.nodes(spark, folder), q.edges(spark, folder), q.files(spark, folder), q.refs(spark, folder), table(spark, folder, "documents"))

    def _seeds(self, *ids: str) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in ids], "seed string")

    def _query(self, text: str) -> DataFrame:
        return self.spark.createDataFrame([(0, text)], "qid long, query string")

    # ---- search and context

    def search(self, text: str, limit: int = 10) -> DataFrame:
        p = S.parse_query(text)
        n = self.nodes
        if p.kinds:
            n = n.filter(F.lower(F.trim("kind")).isin(*p.kinds))
        if p.languages:
            from arbora.sources.tables import norm_language

            n = n.filter(norm_language().isin(*p.languages))
        limit = max(1, min(limit, 100))
        if not p.text:
            hits = n.select(F.col("id").alias("node"), F.lit(1.0).alias("score"), "name").orderBy("name", "node").limit(limit)
            hits = hits.withColumn("rank", F.row_number().over(Window.orderBy("name", "node"))).drop("name")  # of at most ``limit`` rows
        else:
            hits = S.search(self._query(p.text), n, limit).drop("qid")
        hits = hits.join(self.nodes.select(F.col("id").alias("node"), "kind", "name", "qualified_name", "file_path", "start_line"), "node")
        for part in p.paths:  # after the cut, as a last filter
            hits = hits.filter(F.lower("file_path").contains(part.lower()))
        for part in p.names:
            hits = hits.filter(F.lower("name").contains(part.lower()))
        return hits.orderBy("rank")

    def context(self, question: str, max_nodes: int = 20) -> DataFrame:
        return context.context(self._query(" ".join(context.question_symbols(question))), self.nodes, self.edges, 1, max_nodes).drop("qid")

    def explore(self, question: str, max_files: int | None = None) -> DataFrame:
        cap = max_files or context.budget(self.files.count() if self.files is not None else 0)["max_files"]
        return context.explore(self._query(" ".join(context.question_symbols(question))), self.nodes, self.edges, max(1, min(cap, 20))).drop("qid")

    # ---- neighbours and traversals

    def _family(self, symbol: str) -> DataFrame:
        last = symbol.replace("->", "::").split("::")[-1].split(".")[-1]
        f = self.nodes.filter(F.lower("name") == last.lower()) if last == symbol else self.nodes.filter((F.col("qualified_name") == symbol) | F.col("qualified_name").endswith("::" + symbol))
        return f.select("id", "name").orderBy("name", "id").limit(32).select("id")

    def _aggregated(self, symbol: str, own: str, other: str, cap: int) -> DataFrame:
        f = self._family(symbol).withColumnRenamed("id", own)
        pairs = self.edges.filter(F.col("kind").isin(*G.USE_KINDS)).join(f, own, "left_semi").select(F.lit(symbol).alias("seed"), F.col(other).alias("id"))
        return G.ranked_neighbours(pairs, self.nodes, G.degrees(self.nodes, self.edges), cap).drop("seed").orderBy("rank")

    def callers(self, symbol: str, limit: int = 20) -> DataFrame:
        return self._aggregated(symbol, "target", "source", min(limit, 80))

    def callees(self, symbol: str, limit: int = 20) -> DataFrame:
        return self._aggregated(symbol, "source", "target", min(limit, 80))

    def callers_of(self, node: str, depth: int = 1) -> DataFrame:
        return G.reach(G.arcs(self.edges, "in", G.USE_KINDS), self._seeds(node), depth, self.nodes).filter("depth > 0")

    def callees_of(self, node: str, depth: int = 1) -> DataFrame:
        return G.reach(G.arcs(self.edges, "out", G.USE_KINDS), self._seeds(node), depth, self.nodes).filter("depth > 0")

    def impact(self, node: str, depth: int = 2) -> DataFrame:
        return G.impact(self.edges, self.nodes, self._seeds(node), max(1, min(depth, 10)))

    def neighbourhood(self, node: str, depth: int = 1, kinds: tuple[str, ...] | None = None) -> DataFrame:
        return G.reach(G.arcs(self.edges, "both", kinds), self._seeds(node), max(1, min(depth, 4)), self.nodes)

    def path(self, start: str, goal: str, kinds: tuple[str, ...] | None = None, depth: int = 10) -> DataFrame:
        pairs = self.spark.createDataFrame([(start, goal)], "seed string, goal string")
        return G.shortest_paths(G.arcs(self.edges, "out", kinds), pairs, depth)

    def type_hierarchy(self, node: str) -> DataFrame:
        side = lambda way, name: G.reach(G.arcs(self.edges, way, ("extends", "implements")), self._seeds(node), None, self.nodes).filter("depth > 0").withColumn("side", F.lit(name))
        return side("out", "above").unionByName(side("in", "below"))

    def children(self, node: str) -> DataFrame:
        return self.edges.filter((F.col("kind") == "contains") & (F.col("source") == node)).select(F.col("target").alias("id")).join(self.nodes, "id")

    def usages(self, node: str) -> DataFrame:
        return self.edges.filter(F.col("target") == node).join(self.nodes.select(F.col("id").alias("source"), "name", "file_path"), "source")

    def hierarchy(self) -> DataFrame:
        return H.hierarchy(H.contains_links(self.edges))

    def cycles(self) -> DataFrame:
        return G.cyclic_groups(G.file_dependencies(self.edges, self.nodes))

    # ---- catalogue

    def node(self, node: str) -> DataFrame:
        return self.nodes.filter(F.col("id") == node).join(G.degrees(self.nodes, self.edges), "id")

    def top(self, metric: str = "degree", limit: int = 50) -> DataFrame:
        return G.degrees(self.nodes, self.edges).orderBy(F.desc(metric), "id").limit(min(limit, 50))

    def status(self) -> DataFrame:
        part = lambda df, name, col: df.groupBy(F.col(col).alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("section"), "key", "n")
        out = part(self.nodes, "node", "kind").unionByName(part(self.edges, "edge", "kind"))
        return out.unionByName(part(self.files, "file", "language")) if self.files is not None else out

    def file_list(self, language: str | None = None, prefix: str = "") -> DataFrame:
        from arbora.sources.tables import norm_language

        f = self.files.filter(F.col("path").startswith(prefix))
        return f.filter(norm_language() == language.lower()) if language else f

    # ---- maintenance

    def resolve(self) -> DataFrame:
        from arbora.extract.imports import bindings

        return resolve.resolve(self.refs, self.nodes, self.files, bindings(self.documents))

    def affected(self, paths: DataFrame) -> DataFrame:
        direct = self.nodes.join(paths.select(F.col("path").alias("file_path")), "file_path", "left_semi").select("id").distinct()
        near = self.edges.join(direct.withColumnRenamed("id", "target"), "target", "left_semi").select(F.col("source").alias("id"))
        return direct.unionByName(near).distinct().join(self.nodes, "id")

    def changes(self, seen: DataFrame) -> DataFrame:
        return changes.detect(seen, self.files)
