from arbora.operators import heavy_keys as K

EDGES = "id long, source string, target string, kind string, line int, n int, total string"


def test_per_key_and_threshold(spark):
    data = [(i, f"s{i % 7}", "hot", " Calls" if i % 2 else "calls", i if i % 3 else None, 0, None) for i in range(60)]
    data += [(100 + i, "s", f"t{i}", "calls", None, 1, "") for i in range(40)] + [(None, None, None, None, None, None, None)] * 2
    e = spark.createDataFrame(data, EDGES)
    got = {(r["target"], r["kind"]): r for r in K.per_target_kind(e).collect()}
    hot = got[("hot", "calls")]
    assert (hot["n_rows"], hot["n_sources"], hot["n_lines"], hot["first_line"], hot["last_line"]) == (60, 7, 40, 1, 59)
    assert got[(None, None)]["n_rows"] == 2 and got[(None, None)]["n_sources"] == 0
    assert {tuple(r) for r in K.heavy_keys(e, 0.5).collect()} == {("hot", "calls", 60)}
    # exactly at the threshold counts
    assert {tuple(r)[:2] for r in K.heavy_keys(e, 2 / 102).collect()} == {("hot", "calls"), (None, None)}


def test_empty(spark):
    e = spark.createDataFrame([], EDGES)
    assert K.per_target_kind(e).count() == 0 and K.heavy_keys(e).count() == 0
