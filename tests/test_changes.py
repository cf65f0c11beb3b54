import datetime as dt

from arbora.render import cut_utf8, numbered, table
from arbora.session import fresh_path
from arbora.streaming import changes as C

ROW = "path string, modified_at long, size long, content_hash string"


def test_detect(spark):
    seen = [("new", 1, 1, "a"), ("same", 5, 5, "b"), ("touched", 6, 5, "b"), ("bom", 5, 8, "c"), ("grown", 5, 9, "d"), ("silent", 5, 5, "e")]
    known = [("same", 5, 5, "b"), ("touched", 5, 5, "b"), ("bom", 5, 5, "c"), ("grown", 5, 5, "x"), ("silent", 5, 5, "z"), ("gone", 1, 1, "q")]
    got = {r["path"]: r["action"] for r in C.detect(spark.createDataFrame(seen, ROW), spark.createDataFrame(known, ROW)).collect()}
    assert got == {"new": "added", "same": "unchanged", "touched": "modified", "bom": "unchanged", "grown": "modified", "silent": "unchanged", "gone": "removed"}


def test_stream_equals_batch(spark):
    t = dt.datetime(2026, 1, 1)
    rows = [(i, t + dt.timedelta(seconds=i), i % 5, ["view", "click", "error", "purchase"][(i * 7) % 4 if i % 5 else 0]) for i in range(40)]
    e = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string")
    src = fresh_path(spark, "events")
    e.repartition(3).write.parquet(src)
    want = {tuple(r) for r in C.coalesce(C.file_events(e)).select("path", "action", "n").collect()}
    assert {tuple(r) for r in C.stream_coalesced(spark, src, fresh_path(spark, "stream")).collect()} == want


def test_debounced_stream(spark):
    src = fresh_path(spark, "events")
    t = dt.datetime(2026, 1, 1)
    spark.createDataFrame([("a", t), ("a", t + dt.timedelta(seconds=1)), ("a", t + dt.timedelta(seconds=9)), ("z", t + dt.timedelta(hours=5))], "path string, ts timestamp").write.parquet(src)
    stream = C.debounced_stream(spark.readStream.schema("path string, ts timestamp").parquet(src))
    q = stream.writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["n"] for r in spark.table("bursts").filter("path = 'a'").collect()) == [1, 2]


def test_render():
    assert cut_utf8("aé", 2) == "a" and numbered("x\ny", 3) == "3\tx\n4\ty" and table([{"a": 1, "b": None}], ["a", "b"]).endswith("| 1 |  |")


def test_sync_cycle(spark):
    from arbora.streaming import sync
    from tests.test_graph import NODES, node

    seen = spark.createDataFrame([("/r/a.py", 2, 9, "h2"), ("/r/b.py", 1, 9, "h1"), ("/r/n.py", 1, 9, "h4"), ("/r/x.bin", 1, 9, "h5")], ROW)
    texts = spark.createDataFrame([("/r/a.py", "def new():\n    helper()\n"), ("/r/b.py", "never read again"), ("/r/n.py", "def fresh():\n    new()\n"), ("/r/lost.py", "def f(): pass")], "path string, text string")
    n = spark.createDataFrame([node("old", name="gone", path="/r/a.py"), node("h", name="helper", path="/r/b.py"), node("z", name="zap", path="/r/del.py")], NODES)
    e = spark.createDataFrame([(1, "old", "h", "calls", 1), (2, "h", "old", "calls", 2), (3, "z", "h", "calls", 3)], "id long, source string, target string, kind string, line int")
    f = spark.createDataFrame([("/r/a.py", "h1", 9, 1, 5, 1), ("/r/b.py", "h1", 9, 1, 5, 1), ("/r/del.py", "h3", 9, 1, 5, 1)], "path string, content_hash string, size long, modified_at long, indexed_at long, node_count int")
    refs = spark.createDataFrame([(1, "h", "new", "calls", 4, "/r/b.py", "python"), (2, "z", "helper", "calls", 3, "/r/del.py", "python")], "id long, from_node_id string, reference_name string, reference_kind string, line int, file_path string, language string")
    c = sync.cycle(seen, texts, n, e, f, refs, 77)
    assert {r["path"]: r["action"] for r in c.diff.collect()} == {"/r/a.py": "modified", "/r/b.py": "unchanged", "/r/n.py": "added", "/r/x.bin": "added", "/r/del.py": "removed"}
    names = {r["id"]: r["name"] for r in c.nodes.collect()}
    assert sorted(names.values()) == ["a.py", "fresh", "helper", "n.py", "new"]
    links = {(names[r["source"]], names[r["target"]], r["kind"]) for r in c.edges.collect()}
    assert links == {("a.py", "new", "contains"), ("n.py", "fresh", "contains"), ("new", "helper", "calls"), ("fresh", "new", "calls"), ("helper", "new", "calls")}
    assert {r["path"]: (r["indexed_at"], r["node_count"]) for r in c.files.collect()} == {"/r/a.py": (77, 2), "/r/b.py": (5, 1), "/r/n.py": (77, 2), "/r/x.bin": (77, 0)}
