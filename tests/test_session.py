import os

import pytest

from arbora import session as S


def test_materialise_and_sweep(spark):
    df = S.materialise(spark.range(3), "t")
    assert df.count() == 3
    base = S.own_dir(spark).removeprefix("file:").replace("///", "/")
    other = os.path.join(os.path.dirname(base), "another-application")
    os.makedirs(other, exist_ok=True)
    assert os.path.isdir(base) and spark.sparkContext.applicationId in base
    S.sweep(spark)
    assert not os.path.isdir(base) and os.path.isdir(other)


class _Session:
    def __init__(self, master, named=None, given=None):
        self.conf, self.sparkContext, self.master, self.given = {"spark.checkpoint.dir": named} if named else {}, self, master, given

    def getCheckpointDir(self):
        return self.given

    def setCheckpointDir(self, d):
        self.given = d


def test_shared_folder_of_a_cluster():
    assert S.shared_dir(_Session("yarn", "hdfs:///x/")) == "hdfs:///x" and S.shared_dir(_Session("yarn", None, "hdfs:///y")) == "hdfs:///y"
    assert S.shared_dir(_Session("local[4]")).startswith("file:///")
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            S.shared_dir(_Session(master))


def test_fresh_paths(spark):
    own = S.shared_dir(spark)
    assert own == S.shared_dir(spark) and S.fresh_path(spark, "x") != S.fresh_path(spark, "x")
