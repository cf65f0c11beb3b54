import random

import pytest

from arbora.engine import GraphEngine
from arbora.operators import graph as G
from arbora.operators import store as ST
from arbora.session import fresh_path

NODES = "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, end_line int, signature string, docstring string, is_exported boolean, is_async boolean"
EDGES = "id long, source string, target string, kind string, line int, col int, provenance string"


def node(i, kind="function", name=None, path="/w/r/a.py", line=1):
    return (i, kind, name or i, name or i, path, "python", line, line + 2, "()", None, True, False)


@pytest.fixture(scope="module")
def graph(spark):
    n = [node("f"), node("g", path="/w/r/b.py"), node("h", path="/w/r/tests/c.py"), node("K", "class"), node("m", "method", line=9), node("l", "method", line=5)]
    e = [(1, "f", "g", "calls"), (2, "g", "h", "calls"), (3, "h", "f", "imports"), (4, "K", "m", "contains"), (5, "K", "l", "contains"), (6, "f", "m", "references"), (7, "f", "g", "calls"), (8, "x", "f", "calls")]
    return spark.createDataFrame(n, NODES), spark.createDataFrame([(*r, None, None, None) for r in e], EDGES)


def test_engine_answers(spark, graph):
    e = GraphEngine(spark, *graph)
    assert {(r["node"], r["depth"]) for r in e.callers_of("g", 3).collect()} == {("f", 1), ("h", 2)}
    assert {(r["node"], r["depth"]) for r in e.impact("K", 1).collect()} == {("K", 0), ("m", 0), ("l", 0), ("f", 1)}
    assert [r["id"] for r in e.callers("g").collect()] == ["f"]
    assert e.path("f", "h").collect()[0]["path"] == "f > g > h"
    assert {r["id"] for r in e.children("K").collect()} == {"m", "l"}
    assert e.top("in_degree", 1).collect()[0]["in_degree"] == 2
    assert {r["node"] for r in e.neighbourhood("K").collect()} == {"K", "m", "l"}
    assert e.search("name:k K").collect()[0]["node"] == "K"
    assert e.status().count() > 3
    assert {r["id"] for r in e.node("f").collect()} == {"f"}


def test_file_cycles_and_components(spark, graph):
    n, e = graph
    deps = G.file_dependencies(e, n, None)
    assert {tuple(r) for r in G.cyclic_groups(deps).collect()} == {(p, "/w/r/a.py") for p in ("/w/r/a.py", "/w/r/b.py", "/w/r/tests/c.py")}
    rnd = random.Random(7)
    some = [(f"s{rnd.randrange(60):02}", f"s{rnd.randrange(60):02}") for _ in range(90)] + [(f"t{i}", f"t{(i + 1) % 9}") for i in range(9)] + [("t0", "u0"), ("u0", "u0")]
    reach = {n: {n} for e in some for n in e}
    while any(not reach[b] <= reach[a] for a, b in some):
        for a, b in some:
            reach[a] |= reach[b]
    want = {(n, min(m for m in reach if m in reach[n] and n in reach[m])) for n in reach if any(m != n and m in reach[n] and n in reach[m] for m in reach)}
    for most in (0, 10**6):
        assert {tuple(r) for r in G.cyclic_groups(spark.createDataFrame(some, "src string, dst string"), most).collect()} == want
    pairs = spark.createDataFrame([("a", "b"), ("c", "b"), ("d", "e"), ("q", "q"), (None, "z")] + [(f"p{i:02}", f"p{i + 1:02}") for i in range(40)], "a string, b string")
    got = dict(tuple(r) for r in G.components(pairs).collect())
    assert (got["c"], got["e"], got["q"], got["p40"]) == ("a", "d", "q", "p00")


def test_line_clusters(spark):
    s = spark.createDataFrame([("f", 1, 5), ("f", 4, 4), ("f", 8, 9), ("f", 20, 30), ("g", 1, 1)], "file string, start_line int, end_line int")
    assert {tuple(r) for r in G.line_clusters(s, ["file"], 3).collect()} == {("f", 1, 9, 3), ("f", 20, 30, 1), ("g", 1, 1, 1)}


def test_store_versions(spark, graph):
    n, e = graph
    files = spark.createDataFrame([("/w/r/a.py", "h1", 4), ("/w/r/b.py", "h2", 1), ("/w/r/tests/c.py", "h3", 1)], "path string, content_hash string, node_count int")
    refs = spark.createDataFrame([(1, "f", "/w/r/a.py"), (2, "g", "/w/r/b.py")], "id long, from_node_id string, file_path string")
    s = ST.IndexStore(spark, fresh_path(spark, "store"))
    assert s.store_files(files, n, e, refs) == 1 and s.read("edges").count() == 7  # the edge from an unknown node is dropped
    s.delete(spark.createDataFrame([("/w/r/b.py",)], "path string"))
    assert {r["id"] for r in s.read("nodes").collect()} == {"f", "h", "K", "m", "l"}
    assert {r["id"] for r in s.read("edges").collect()} == {3, 4, 5, 6} and s.read("refs").count() == 1 and s.read("nodes", 1).count() == 6
    s.store_files(files, n, e, refs)
    assert s.read("nodes").count() == 6 and s.version() == 3
    out = fresh_path(spark, "snap")
    s.snapshot(out)
    assert s.restore(out) == 4


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 5, "y")], "k string, t int, v string")
    new = spark.createDataFrame([("a", 1, "z"), ("b", 2, "w"), ("c", 1, "n")], "k string, t int, v string")
    assert {tuple(r) for r in ST.upsert(old, new, "k", "t").collect()} == {("a", 1, "z"), ("b", 5, "y"), ("c", 1, "n")}
