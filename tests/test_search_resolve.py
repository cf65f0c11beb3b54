import math
import re
from collections import defaultdict

from pyspark.sql import functions as F

from arbora.extract.imports import bindings
from arbora.operators import context as X
from arbora.operators import graph as G
from arbora.operators import resolve as V
from arbora.operators import search as S
from tests.test_graph import EDGES, NODES, node


def test_parse_query():
    p = S.parse_query('kind:Function lang:TypeScript path:"src/a b" name:foo kind:nothing bar "two words"')
    assert (p.kinds, p.languages, p.paths, p.names, p.text) == (["function"], ["typescript"], ["src/a b"], ["foo"], "kind:nothing bar two words")
    assert S.parse_query("").text == ""


def test_words():
    assert S.stem_variants("caching") == ["cache", "cach"] and S.stem_variants("cached") == ["cach", "cache"] and S.stem_variants("runs") == ["run"]
    assert X.question_symbols("How does parseQuery use graph.Node and the cache?") == ["parseQuery", "graph.Node", "graph", "Node", "cache"]


def test_search_falls_back(spark):
    n = spark.createDataFrame([node("1", name="getTökenValue"), node("2", name="parser"), node("3", name="Walker", kind="class")], NODES)
    q = spark.createDataFrame([(1, "token"), (2, "arse"), (3, "walkre")], "qid long, query string")
    got = {r["qid"]: r["node"] for r in S.search(q, n, 1).collect()}
    assert got[2] == "2" and got[3] == "3"
    fuzzy = {tuple(r) for r in S.fuzzy_names(q, n).collect()}
    assert fuzzy == {(3, "Walker", 2)}
    assert S.like_tiers(q, n).filter("qid = 2").collect()[0]["score"] == 0.8


def test_resolution_tiers(spark):
    ref = "id long, from_node_id string, reference_name string, reference_kind string, line int, col int, candidates array<string>, file_path string, language string"
    n = spark.createDataFrame([node("1", name="run", path="/r/a.py"), node("2", name="run", path="/r/b.py", line=50), node("3", "class", "Tool", path="/r/b.py"), node("4", name="only", path="/r/c.go")], NODES)
    rows = [(1, "x", "run", "calls", 49, 0, None, "/r/b.py", ""), (2, "x", "Tool.run", "calls", 1, 0, None, "/r/a.py", ""), (3, "x", "tool.run", "calls", 1, 0, None, "/r/a.py", ""), (4, "x", "ONLY", "calls", 1, 0, None, "/r/a.py", ""),
            (5, "x", "only", "inherits", 1, 0, None, "/r/a.py", ""), (6, "x", "print", "calls", 1, 0, None, "/r/a.py", ""), (9, "x", "go2", "calls", 1, 0, None, "/r/a.py", ""), (10, "x", "weak", "calls", 1, 0, None, "/r/a.py", ""), (7, "x", "b.py", "imports", 1, 0, None, "/r/a.py", ""), (8, "x", None, None, None, None, None, None, None)]
    n = n.unionByName(n.filter("id = '4'").withColumn("is_exported", F.lit(True)).withColumn("id", F.lit("5")).withColumn("name", F.lit("walk"))).unionByName(n.filter("id = '3'").withColumn("id", F.lit("6")).withColumn("name", F.lit("weak")))
    docs = spark.createDataFrame([("/r/a.py", "from m import walk as go2\nimport weak\n"), (None, "import x"), ("/r/c.go", None)], "path string, text string")
    paths = spark.createDataFrame([("/r/a.py",), ("/r/b.py",), ("/r/c.go",)], "path string")
    got = {r["ref"]: (r["target"], r["confidence"], r["method"], r["kind"]) for r in V.resolve(spark.createDataFrame(rows, ref), n, paths, bindings(docs)).collect()}
    assert got[1] == ("2", 0.9, "exact_name", "calls") and got[2] == ("2", 0.85, "method_call", "calls") and got[3] == ("2", 0.75, "method_call", "calls")
    assert got[9] == ("5", 0.9, "import", "calls") and got[10][0] == "6"  # imported under another name; a class of another file
    assert got[5] == ("4", 0.9, "exact_name", "extends")
    assert 6 not in got and 8 not in got and 4 not in got  # the language itself; no name; not an indexed name


def test_structural(spark):
    i = spark.createDataFrame([("I", "Read", 1), ("I", "Close", 0), ("J", "Read", 1)], "iface_id string, name string, arity int")
    t = spark.createDataFrame([("T", "Read", 1), ("T", "Close", 0), ("T", "Other", 2), ("U", "Read", 2), ("V", "Read", 1)], "type_id string, name string, arity int")
    assert {tuple(r) for r in V.structural_implements(i, t).collect()} == {("T", "I", 0.75), ("T", "J", 0.55), ("V", "J", 0.55)}


def bm25_by_hand(queries, nodes, top):
    """Every word of every query against every text of every row."""
    cut = lambda x: re.findall(r"[^\W_]+", (x or "").lower())
    rows = [(r[0], {"id": cut(r[0]), "name": cut(r[2]), "qualified_name": cut(r[3]), "signature": cut(r[8]), "docstring": cut(r[9])}) for r in nodes]
    size = {i: sum(map(len, c.values())) for i, c in rows}
    mean, terms, hits = sum(size.values()) / len(size), {q: {" ".join(cut(w)) for w in text.split()} - {""} for q, text in queries}, defaultdict(dict)
    for t in set().union(*terms.values()):
        for i, c in rows:
            tf = sum(w * ((x := "".join(f" {y}" for y in c[k])).count(" " + t)) for k, w in S.WEIGHTS.items() if k != "id")
            if tf:
                hits[t][i] = tf
    out = set()
    for q, words in terms.items():
        score = defaultdict(float)
        for t in words:
            idf = max(math.log((len(size) - len(hits[t]) + 0.5) / (len(hits[t]) + 0.5)) if hits[t] else 0, 1e-6)
            for i, tf in hits[t].items():
                score[i] += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size[i] / mean))
        out |= {(q, i, round(s, 6), k) for k, (i, s) in enumerate(sorted(((i, round(s, 6)) for i, s in score.items()), key=lambda x: (-x[1], x[0]))[:top], 1)}
    return out


def written(monkeypatch, *modules):
    """(name, rows) of all tables that a search writes on its way."""
    seen, write = [], S.materialise

    def keep(df, name):
        out = write(df, name)
        seen.append((name, out.count()))
        return out

    for m in modules or (S,):
        monkeypatch.setattr(m, "materialise", keep, raising=False)
    return seen


def test_common_word_of_many_queries(spark, monkeypatch):
    rows = [node(f"n{i:03}", name=f"common word{i % 40}" + " common" * (i % 3) + " lock lock lock" * (i % 50 == 0)) for i in range(200)] + [node("x1", name="lock"), node("x2", name="a::b")]
    asked = [(i, f"common word{i}") for i in range(60)] + [(70, "lock.lo"), (71, "lock_lock.l common"), (72, "b.a"), (73, "comm wor word1 lo"), (74, "common.word3.comm"), (75, "::")]
    seen = written(monkeypatch)
    got = {(r["qid"], r["node"], r["score"], r["rank"]) for r in S.bm25(spark.createDataFrame(asked, "qid long, query string"), spark.createDataFrame(rows, NODES), 5).collect()}
    assert got == bm25_by_hand(asked, rows, 5)
    assert max(n for _, n in seen) < 10 * len(rows)  # no table holds the hits of a word once for each of its queries


def test_substrings_meet_by_their_rarest_piece(spark, monkeypatch):
    rows = [node(f"n{i:03}", name=f"lockLock{'Zebra' if i % 50 == 0 else 'Horse'}{i}") for i in range(200)]
    rows += [("x1", "class", None, "m::lockzebra", "/w/r/b.py", "python", 1, 3, "()", None, True, False), ("x2", "class", "Lo", None, "/w/r/b.py", "python", 1, 3, "()", None, True, False)]
    asked = [(i, t) for i, t in enumerate(["lockzebra", "LockZebra", "lockLockZebra0", "lockqqq", "locklockhorse", "lo", "LO", "x", "lock::zebra", "k\nl"])]
    want = set()
    for q, text in asked:
        t = text.lower()
        for r in rows:
            low, long = (r[2] or "").lower(), (r[3] or "").lower()
            score = 1.0 if r[2] == text else 0.9 if low.startswith(t) else 0.8 if t in low else 0.7 if t in long else None
            want |= {(q, r[0], score)} if score and len(text) > 1 else set()
    seen = written(monkeypatch)
    n = spark.createDataFrame(rows, NODES)
    assert {(r["qid"], r["node"], r["score"]) for r in S.like_tiers(spark.createDataFrame(asked, "qid long, query string"), n).collect()} == want
    assert [k for name, k in seen if name == "rare"] == [1, 3]  # those with a piece that no name holds meet none
    again = S.fuzzy_names(spark.createDataFrame([(1, "lock"), (2, "LOCK"), (3, "horse"), (4, "lo")], "qid long, query string"), spark.createDataFrame([("lck",), ("lo",), ("Lock",), ("norsk",), ("house1",), ("loc",)], "name string"))
    assert {tuple(r) for r in again.collect()} == {(1, "lck", 1), (1, "Lock", 0), (1, "loc", 1), (2, "lck", 1), (2, "Lock", 0), (2, "loc", 1), (3, "norsk", 2), (3, "house1", 2)}


def test_context_around_a_hub(spark, monkeypatch):
    kinds = ["function", "class", "file", "variable", "interface"]
    rows = [node(f"a{i:02}", name=f"alpha{i:02}") for i in range(20)] + [node("hub", name="middle")]
    rows += [node(f"b{i:03}", kinds[i % 5], name=f"leaf{i % 7}", path=f"/w/r/{'test_' * (i % 3 == 0)}{i}.py") for i in range(150)] + [node("b007", "struct", name="another")]
    pairs = [(f"a{i:02}", "hub") for i in range(20)] + [(f"b{i:03}", "hub") if i % 2 else ("hub", f"b{i:03}") for i in range(150)]
    pairs += [(f"a{i:02}", f"b{k:03}") for i in range(20) for k in range(i)] + [("a00", "absent"), ("absent", "a01"), ("hub", "hub")]
    n, e = spark.createDataFrame(rows, NODES), spark.createDataFrame([(k, a, b, "calls", 1, 0, None) for k, (a, b) in enumerate(pairs)], EDGES)
    asked = [(i, f"alpha{i:02}") for i in range(20)]
    seen = written(monkeypatch, X, G)
    got = {tuple(r) for r in X.context(spark.createDataFrame(asked, "qid long, query string"), n, e, 2, 12).collect()}
    near, want = defaultdict(set), set()
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    for q, _ in asked:
        depth, last = {f"a{q:02}": 0}, {f"a{q:02}"}
        for k in (1, 2):
            last = {b for a in last for b in near[a] if b != "absent"} - set(depth)
            depth |= dict.fromkeys(last, k)
        order = sorted((depth[r[0]], "/test_" in r[4], r[1] == "file", -S.KIND_BONUS.get(r[1], 0), r[2], r[0]) for r in rows if r[0] in depth)
        want |= {(q, x[-1], x[0], k) for k, x in enumerate(order[:12], 1)}
    assert got == want
    assert max(k for name, k in seen if name == "level") <= 20 * 12  # not all neighbours of the hub for each question
