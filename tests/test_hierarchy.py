import random

import pytest

from arbora.operators import hierarchy as H

LINKS = "child string, parent string"


def rows(df):
    return {r[0]: (r[1], r[2]) for r in df.select("node_id", "root_id", "depth").collect()}


def brute(links):
    parent = {}
    for c, p in links:
        if c is not None and p is not None:
            parent[c] = min(parent.get(c, p), p)
    out = {}
    for n in set(parent) | set(parent.values()):
        seen, at = [n], n
        while at in parent:
            at = parent[at]
            if at in seen:
                ring = seen[seen.index(at):]
                out[n] = (min(ring), -1)
                break
            seen.append(at)
        else:
            out[n] = (at, len(seen) - 1)
    return out


@pytest.mark.parametrize("bits", [16, 3])
def test_random_forests_with_cycles(spark, bits):
    rnd = random.Random(5)
    links = []
    for i in range(1, 300):
        links.append((f"n{i:03}", f"n{rnd.randrange(i):03}" if i % 37 else f"n{(i + 2) % 300:03}"))
    links += [("x1", "x2"), ("x2", "x3"), ("x3", "x1"), ("y", "x2"), ("s", "s"), ("t", "s")] + links[:20]
    df = spark.createDataFrame(links, LINKS).repartition(5)
    assert rows(H.forest(df, block_bits=bits)) == brute(links)


@pytest.mark.parametrize("bits", [16, 3])
def test_cycles_over_partitions(spark, bits):
    links = [(f"r{k:02}n{i:02}", f"r{k:02}n{(i * 7 + 7) % 23:02}" if i * 7 % 23 else f"r{k:02}n07") for k in range(30) for i in range(23)]
    links += [(f"a{k:02}", f"r{k:02}n05") for k in range(30)]  # smaller than any id of the cycle that it hangs on
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert rows(H.forest(spark.createDataFrame(links, LINKS), block_bits=bits)) == brute(links)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)


@pytest.mark.parametrize("bits", [16, 3])
def test_long_chain_with_paths(spark, bits):
    links = [(f"c{i:03}", f"c{i - 1:03}") for i in range(1, 150)] + [("a", "b"), ("b", "a"), ("c", "a")]
    got = {r["node_id"]: r for r in H.hierarchy(spark.createDataFrame(links, LINKS).repartition(6), bits).collect()}
    assert got["c149"]["path"] == " > ".join(f"c{i:03}" for i in range(150)) and got["c149"]["depth"] == 149
    assert got["c000"]["n_descendants"] == 149 and got["c000"]["path"] == "c000"
    assert (got["c"]["root_id"], got["c"]["depth"], got["c"]["path"], got["a"]["n_descendants"]) == ("a", -1, None, 0)


def test_dirty_links(spark):
    links = [("a", None), (None, "b"), ("k", "p"), ("k", "p"), ("k", "o"), ("", "p")]
    assert rows(H.forest(spark.createDataFrame(links, LINKS))) == {"k": ("o", 1), "o": ("o", 0), "": ("p", 1), "p": ("p", 0)}
    assert H.forest(spark.createDataFrame([], LINKS)).count() == 0
    assert H.hierarchy(spark.createDataFrame([], LINKS)).count() == 0


def test_links_of_edges_with_other_columns(spark):
    e = spark.createDataFrame([("s", "t", " Contains", 1, "x"), ("s", "u", "calls", 2, "y"), (None, "v", "contains", 3, None)], "source string, target string, kind string, node int, root string")
    assert [tuple(r) for r in H.contains_links(e).collect()] == [("t", "s")]


def test_descendants(spark):
    f = H.forest(spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "b")], LINKS), paths=True)
    assert {tuple(r) for r in H.descendants(f).collect()} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1), ("a", "d", 2), ("b", "d", 1)}
