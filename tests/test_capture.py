import random

import pytest

from arbora.session import fresh_path
from arbora.streaming import capture as C

OBS, REC, FILES, RUNS = ("path string, seq long, seen_at long, content_hash string", "path string, content_hash string",
                         "path string, content_hash string, indexed_at long, run_day string", "run_id long, started_at long, finished_at long, status string")


def got(df):
    return {(r["path"], r["content_hash"]) for r in df.collect() if r["content_hash"] is not None}


def test_batches_recover_without_gaps_or_repeats(spark):
    base = fresh_path(spark, "t")
    c = C.ChangeCapture(spark, base, 4)
    rec = spark.createDataFrame([("a", "H1"), ("b", "h2")], REC)
    one = [("a", 1, 10, "h1"), ("b", 2, 10, "h9"), ("c", 3, 10, "h3"), ("c", 3, 10, "h3"), ("d", 4, 10, None), (None, 5, 10, "x")]
    for stage in ("sink", "commit"):
        with pytest.raises(RuntimeError):
            c.run(spark.createDataFrame(one, OBS), rec, fail_before=stage)
    # rows that arrive after the plan was written belong to the next batch
    two = one + [("e", 6, 20, "h5"), ("c", 7, 5, "old"), ("b", 8, 30, None), ("d", 9, 30, "h4")]
    assert got(c.run(spark.createDataFrame(two, OBS), rec)) == {("b", "h9"), ("c", "h3")}
    assert c.committed() == 1
    # the late observation of c is older than what was seen of it, so c is judged by the newer one again
    assert got(c.run(spark.createDataFrame(two, OBS), rec)) == {("e", "h5"), ("d", "h4"), ("c", "h3")}
    assert got(c.run(spark.createDataFrame(two, OBS), rec)) == set()
    # b was seen absent in the second batch, which takes back what the first one said
    assert got(c.sink()) == {("c", "h3"), ("e", "h5"), ("d", "h4")}


def test_any_cut_into_batches_leaves_the_same_rows(spark):
    rnd = random.Random(3)
    rec = [(f"p{i}", f"h{rnd.randrange(3)}") for i in range(40)]
    log = [(f"p{rnd.randrange(60)}", k, rnd.randrange(200), rnd.choice(["h0", "h1", "h2", None])) for k in range(400)]
    newest = {}
    for p, k, t, h in log:
        newest[p] = max(newest.get(p, (-1, -1, None)), (t, k, h), key=lambda x: x[:2])
    want = {(p, h) for p, (_, _, h) in newest.items() if h is not None and dict(rec).get(p) != h}
    df, old = spark.createDataFrame(log, OBS), spark.createDataFrame(rec, REC)
    for n in (1, 4, 19):  # the last goes over a folded base
        c = C.ChangeCapture(spark, fresh_path(spark, "t"), 4)
        for k in range(1, n + 1):
            if k == 3:
                with pytest.raises(RuntimeError):
                    c.run(df, old, 400 * k // n, fail_before="commit")
            c.run(df, old, 400 * k // n)
        assert c.committed() == n and got(c.sink()) == want


def test_spelling_ties_and_empty(spark):
    scans = spark.createDataFrame([("a", 1, 5, "ABC"), ("a", 2, 5, "abd"), ("b", 3, 5, " Abc ")], OBS)
    rec = spark.createDataFrame([("a", "abd"), ("b", "abc")], REC)
    c = C.ChangeCapture(spark, fresh_path(spark, "t"))
    assert got(c.run(scans, rec)) == set()
    c = C.ChangeCapture(spark, fresh_path(spark, "t"))
    assert got(c.run(spark.createDataFrame([], OBS), spark.createDataFrame([], REC))) == set()


def test_recorded_state(spark):
    runs = spark.createDataFrame([(1, 100, 200, "ok"), (2, 300, None, "aborted"), (3, 500, 600, "failed"), (4, 90_000_000, 90_000_100, " OK")], RUNS)
    files = spark.createDataFrame([("a", "x1", 150, ""), ("a", "x2", 350, ""), ("b", "y1", 550, ""), ("c", "z", 50, ""), ("d", "d1", 999_000_000, None), ("d", "d1", 999_000_000, None), (None, "q", 150, ""), ("e", None, None, "")], FILES)
    assert {tuple(r) for r in C.recorded_state(files, runs).collect()} == {("a", "x1"), ("d", "d1")}
    assert C.recorded_state(spark.createDataFrame([], FILES), runs).count() == 0
    assert C.recorded_state(files, spark.createDataFrame([], RUNS)).count() == 0
