import os

import pytest
from pyspark.sql import functions as F

from codeloom import runtime as T
from codeloom.operators.copies import carried, twins


def test_dense_rank_over_many_parts(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("v")).repartition(7)
    got = T.dense_rank(rows, ["v"], "n").orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(1, 5001)) and [r["v"] for r in got] == sorted(r["v"] for r in got)
    assert T.dense_rank(rows.limit(0), ["v"], "n").count() == 0


def test_scratch_removes_what_was_made_inside(spark):
    outside = T.checkpoint(spark.range(3))
    with T.scratch(spark):
        inside = T.checkpoint(spark.range(4))
        assert inside.count() == 4 and T.scan([outside, inside]).count() == 7
    gone = lambda d: not os.path.exists(d._codeloom_table.removeprefix("file://"))
    assert gone(inside) and not gone(outside)


def test_a_machine_local_folder_is_refused_on_a_cluster():
    class Holder:
        def isDefined(self):
            return False

    class Session:
        def __init__(self, master):
            self.sparkContext = type("C", (), {"master": master, "applicationId": "a", "_jsc": type("J", (), {"sc": lambda s: type("S", (), {"getCheckpointDir": lambda s: Holder()})()})()})()
            self.conf = type("F", (), {"get": lambda s, k, d=None: d})()

    for master in ("spark://h:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(RuntimeError):
            T._shared_folder(Session(master))
    assert "codeloom-checkpoints" in T._shared_folder(Session("local[4]"))


def test_spread_deals_out_a_table_of_few_parts_only(spark, tmp_path):
    slots = spark.sparkContext.defaultParallelism
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    assert T.spread(spark.read.parquet(str(tmp_path / "one"))).rdd.getNumPartitions() == slots
    assert T.spread(spark.range(0, 100, 1, slots * 2)).rdd.getNumPartitions() == slots * 2
    joined = spark.read.parquet(str(tmp_path / "one")).groupBy("id").count()
    assert T.spread(joined) is joined


def test_copies_in_parts(spark):
    members = spark.createDataFrame([(0, k, 7) for k in range(7)] + [(10, 10, 2), (10, 11, 2)], "rep long, key long, n long")
    near = range(7)
    assert sorted(tuple(r)[1:] for r in twins(members, 2).collect()) == sorted([(a, b) for a in near for b in near if a < b] + [(10, 11)])
    pairs = spark.createDataFrame([(0, 10, "x"), (10, 20, "y"), (20, 21, "z")], "a long, b long, note string")
    want = [(a, b, "x") for a in near for b in (10, 11)] + [(10, 20, "y"), (11, 20, "y"), (20, 21, "z")]
    assert sorted(map(tuple, carried(pairs, members, 3).collect())) == sorted(want)
    assert carried(pairs, members.limit(0)).count() == 3 and twins(members.limit(0)).count() == 0
