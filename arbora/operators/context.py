"""Task-oriented context: ranked roots for a question, expanded over the graph, and files to read first.

Only what is bounded comes to the driver: at most ``roots`` roots and the parsed question; ranking and
expansion are DataFrame plans.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbora.operators import graph as G
from arbora.operators import search as S
from arbora.session import materialise, sent

#: Words of a question that name no symbol.
STOP_WORDS = frozenset(
    "a an the and or not of to in on at by for from with without into over under is are was were be been do does did how what where which who why when can could should would will i we you it "
    "this that these those there here get gets set sets use uses used using make makes show find all any each every some me my our your its as if then else new old file files code function "
    "functions method methods class classes work works".split())


def question_symbols(question: str) -> list[str]:
    """Names and words of a question: camel, snake, dotted and plain words of three letters or more."""
    found: list[str] = []
    for w in re.findall(r"[A-Za-z_][\w.:]*", question):
        parts = [w, *re.split(r"\.|::", w)] if "." in w or "::" in w else [w]
        found += [p.strip(".:") for p in parts]
    return [w for w in dict.fromkeys(found) if len(w) >= 3 and w.lower() not in STOP_WORDS]


def roots(questions: DataFrame, nodes: DataFrame, per_question: int = 3) -> DataFrame:
    """(qid, node, score, rank): the best nodes per question; tests count less, files of several hits more."""
    return _roots(questions, S.kept(nodes), per_question)


def _roots(questions: DataFrame, nodes: DataFrame, per_question: int = 3) -> DataFrame:
    hits = S.search_kept(questions, nodes.filter("kind <> 'file'"), max(10, per_question * 3)).join(nodes.select(F.col("id").alias("node"), "file_path", "name"), "node")
    together = F.count(F.lit(1)).over(Window.partitionBy("qid", "file_path")) - 1
    score = (F.col("score") + 20 * together) * F.when(G.is_test_path(), 0.3).otherwise(1.0)
    w = Window.partitionBy("qid").orderBy(F.desc("total"), "node")
    return hits.withColumn("total", F.round(score, 6)).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= per_question).select("qid", "node", F.col("total").alias("score"), "rank")


def nearest(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int, most: int) -> DataFrame:
    """(seed, node, depth): the nodes within ``depth`` steps either way of each seed (seed), nearest first, at least the first ``most``.

    Only seeds that have found fewer go on.  Such a seed has all nodes of its levels and each of these brings at most ``most``
    that are ahead of others and not among them, so the first 2 * ``most`` neighbours of a node are enough.
    """
    pairs = materialise(edges.select("source", "target").distinct().filter("source IS NOT NULL AND target IS NOT NULL"), "pairs")
    place = F.struct(G.is_test_path().alias("test"), (F.col("kind") == "file").alias("file"), (-S.kind_bonus()).alias("bonus"), "name", "id").alias("place")
    seen = materialise(seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth")).distinct(), "level")
    frontier = seen
    for level in range(1, depth + 1):
        going = sent(materialise(frontier.select(F.col("node").alias("src")).distinct(), "going"))
        out = pairs.join(going, F.col("source") == F.col("src")).select("src", F.col("target").alias("id"))
        back = pairs.join(going, F.col("target") == F.col("src")).select("src", F.col("source").alias("id"))
        steps = out.unionByName(back).join(nodes.select("id", "kind", "name", "file_path"), "id").groupBy("src", "id").agg(F.min(place).alias("place"))
        steps = materialise(S.best(steps, "src", [F.col("place")], 2 * most).select("src", "id", "place"), "steps")
        new = frontier.join(steps, F.col("node") == F.col("src")).select("seed", F.col("id").alias("node"), "place").distinct().join(seen.select("seed", "node"), ["seed", "node"], "left_anti")
        new = materialise(S.best(new, "seed", [F.col("place")], most).select("seed", "node", F.lit(level).alias("depth")), "level")
        seen = seen.unionByName(new)
        full = seen.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= most).select("seed")
        frontier = new.join(full, "seed", "left_anti")
    return seen


def context(questions: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 1, max_nodes: int = 20) -> DataFrame:
    """(qid, node, depth, place): the roots and what is around them, nearest first, within ``max_nodes``."""
    return _context(questions, S.kept(nodes), edges, depth, max_nodes)


def _context(questions: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int, max_nodes: int) -> DataFrame:
    r = materialise(_roots(questions, nodes).select("qid", F.col("node").alias("seed")), "roots")
    reached = nearest(r.select("seed").distinct(), nodes, edges, depth, max_nodes)
    j = r.join(reached, "seed").groupBy("qid", "node").agg(F.min("depth").alias("depth"))
    j = j.join(nodes.select(F.col("id").alias("node"), "kind", "name", "file_path"), "node")
    w = Window.partitionBy("qid").orderBy("depth", G.is_test_path(), (F.col("kind") == "file"), F.desc(S.kind_bonus()), "name", "node")
    return j.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= max_nodes).select("qid", "node", "depth", "place")


def budget(n_files: int) -> dict[str, int]:
    """How much to show, by the size of the collection."""
    tier = 0 if n_files < 500 else 1 if n_files < 5_000 else 2 if n_files < 15_000 else 3
    return {"max_files": (5, 6, 12, 14)[tier], "tier": tier}


def explore(questions: DataFrame, nodes: DataFrame, edges: DataFrame, max_files: int = 12) -> DataFrame:
    """(qid, file_path, relevance, n_nodes, place): the files that matter for a question."""
    nodes = S.kept(nodes)
    c = _context(questions, nodes, edges, depth=2, max_nodes=200).join(nodes.select(F.col("id").alias("node"), "kind", "file_path"), "node").filter("file_path IS NOT NULL")
    weight = (1.0 + S.kind_bonus()) / (1 + F.col("depth"))
    per = c.groupBy("qid", "file_path").agg(F.round(F.sum(weight), 6).alias("points"), F.count(F.lit(1)).alias("n_nodes")).join(questions, "qid")
    rel = (F.col("points") + S.path_relevance("file_path", "query")) * F.when(G.is_test_path(), 0.7).otherwise(1.0) * F.when(F.lower("file_path").rlike("icon|i18n|locale"), 0.5).otherwise(1.0)
    w = Window.partitionBy("qid").orderBy(F.desc("relevance"), "file_path")
    return per.withColumn("relevance", F.round(rel, 6)).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= max_files).select("qid", "file_path", "relevance", "n_nodes", "place")
