from arbora.engine import GraphEngine
from arbora.session import fresh_path
from arbora.sources import build as B

SF = "/root/testdata/sf0.001"


def test_build_and_load(spark):
    target = fresh_path(spark, "index")
    B.build(spark, SF, target, 3)
    t = B.load(spark, target)
    assert t["nodes"].count() == t["nodes"].select("id").distinct().count() > 0
    assert t["edges_by_source"].count() == t["edges_by_target"].count() and "name_lc" in t["nodes"].columns
    raw, built = GraphEngine.load(spark, SF), GraphEngine(spark, t["nodes"].drop("name_lc"), t["edges_by_target"], t["files"], t["refs"])
    assert [tuple(r) for r in raw.top("in_degree", 5).collect()] == [tuple(r) for r in built.top("in_degree", 5).collect()]
    plan = t["edges_by_target"].filter("target = 'x'").select("source")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(target), EqualTo(target,x)]" in plan and "ReadSchema: struct<source:string,target:string>" in plan
