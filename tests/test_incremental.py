from codeloom.operators import incremental as I


def test_changed_since_the_last_good_run(spark):
    runs = spark.createDataFrame([(1, "ok"), (2, "failed"), (3, "ok"), (4, "running"), (5, "ok"), (5, "ok"), (None, "ok")], "run_id int, status string")
    rows = [(1, "a", "s1", 1, 10), (1, "b", "s1", None, 10), (2, "c", "s1", 1, 10), (3, "a", "s2", 1, 11), (3, "a", "s1", 1, 12), (3, "b", "s1", None, 10), (3, "c", "s1", 1, 10), (3, "d", None, 1, 9), (5, "a", "s1", 2, 1), (5, "c", "s1", 1, 1), (5, "c", "s1", 1, 1), (5, None, "s1", 1, 1), (5, "e", "s9", 1, None)]
    records = spark.createDataFrame([(*r, "noise") for r in rows], "run_id int, path string, sha1 string, index_version int, mtime_ns long, status string")
    got = sorted(tuple(r) for r in I.changed_since_last_good(records, runs, "run_id", "path", ["sha1", "index_version"], "sha1", "mtime_ns").collect())
    assert got == [(3, "c"), (5, "a"), (5, "e")]


def test_ties_take_the_greatest_version(spark):
    rows = spark.createDataFrame([(1, "a", "x", 5), (1, "a", "y", 5)], "run_id int, path string, sha1 string, mtime_ns long")
    assert I.standing(rows, ["run_id", "path"], ["sha1"], "mtime_ns").first()["sha1"] == "y"


def test_empty(spark):
    records = spark.createDataFrame([], "run_id int, path string, sha1 string, index_version int, mtime_ns long")
    runs = spark.createDataFrame([], "run_id int, status string")
    assert I.changed_since_last_good(records, runs, "run_id", "path", ["sha1", "index_version"], "sha1", "mtime_ns").count() == 0


def test_ledger_survives_a_run_that_died(spark, tmp_path):
    ledger = I.Ledger(spark, str(tmp_path / "ledger"), ["k"], ["v"])
    first = spark.createDataFrame([("a", 1, 10), ("b", 1, 11), ("b", 1, 11)], "k string, v int, t int")
    todo = ledger.pending(first, "t")
    assert sorted(r["k"] for r in todo.collect()) == ["a", "b"]
    ledger.commit("r1", todo, open_from=11)
    # A run that died: its folder has no _SUCCESS.
    (tmp_path / "ledger" / "run=r2").mkdir()
    later = spark.createDataFrame([("a", 1, 10), ("b", 1, 11), ("b", 2, 12), ("c", 1, 11)], "k string, v int, t int")
    todo = ledger.pending(later, "t")
    assert sorted((r["k"], r["v"]) for r in todo.collect()) == [("b", 2), ("c", 1)]
    ledger.commit("r2", todo, open_from=12)
    assert ledger.pending(later, "t").count() == 0


def test_ledger_gives_out_a_version_that_comes_back(spark, tmp_path):
    ledger = I.Ledger(spark, str(tmp_path / "ledger"), ["k"], ["v"])
    rows = []
    # Ten runs and more, so that run names do not sort as they were made.
    for i, version in enumerate(["x", "y", "x", "y", "y", "x", "x", "z", "x", "y", "x", "y"], start=1):
        rows.append(("a", version, i))
        todo = ledger.pending(spark.createDataFrame(rows, "k string, v string, t int"), "t")
        got = [r["v"] for r in todo.collect()]
        assert got == ([] if i > 1 and rows[-2][1] == version else [version]), i
        ledger.commit(f"r{i}", todo, open_from=1)
    assert ledger.pending(spark.createDataFrame([*rows, ("a", "w", None), ("b", "x", 1)], "k string, v string, t int"), "t").first()["k"] == "b"


def test_marks_reach_back_to_the_oldest_open_run(spark):
    rows = [(1, 10, 20, "ok"), (2, 12, None, "failed"), (3, 30, 40, "ok"), (4, 35, 50, "failed"), (5, 60, 70, "ok"), (6, None, None, "running")]
    runs = spark.createDataFrame(rows, "run_id int, started_at int, finished_at int, status string")
    got = {r["run"]: (r["before"], r["open_from"]) for r in I.low_water_marks(runs.filter("run_id < 6")).collect()}
    assert got == {3: (1, 10), 5: (3, 12)}
    assert {r["open_from"] for r in I.low_water_marks(runs).collect()} == {None}
    assert I.low_water_marks(runs.limit(0)).count() == 0


def test_a_run_rereads_from_its_mark_only(spark):
    runs = spark.createDataFrame([(1, 10, 20, "ok"), (2, 25, 30, "failed"), (3, 40, 50, "ok")], "run_id int, started_at int, finished_at int, status string")
    rows = [(1, "a", "s1", 1, 1, 11), (1, "b", "s1", None, 1, 12), (3, "a", "s1", 1, 1, 41), (3, "b", "s1", None, 2, 99), (3, "c", "s1", 1, 1, None), (3, "d", "s1", 1, 1, 9), (2, "e", "s1", 1, 1, 26)]
    records = spark.createDataFrame(rows, "run_id int, path string, sha1 string, index_version int, mtime_ns long, seen_at int")
    got = I.changed_since_last_good(records, runs, "run_id", "path", ["sha1", "index_version"], "sha1", "mtime_ns", clock="seen_at")
    assert sorted(tuple(r) for r in got.collect()) == [(3, "c")]  # d was written before any open transaction began


def test_compaction_commits_and_null_parts(spark, tmp_path):
    ledger = I.Ledger(spark, str(tmp_path / "ledger"), ["k"], ["v", "w"])
    table = lambda rows: spark.createDataFrame(rows, "k string, v int, w int, t int")
    for i in range(4):
        todo = ledger.pending(table([("a", i, None, i), ("b", 1, None, 0), ("c", None, 1, 0), (None, 1, 1, 0)]), "t")
        assert sorted(r["k"] for r in todo.collect()) == (["a", "b"] if i == 0 else ["a"])
        ledger.commit(f"r{i}", todo, open_from=i)
        ledger.commit(f"r{i}", table([("z", 9, 9, 9)]), open_from=99)  # a run commits once
    before = sorted(map(tuple, ledger.processed().collect()))
    ledger.compact()
    assert sorted(map(tuple, ledger.processed().collect())) == before == [("a", 3, None), ("b", 1, None)] and ledger.low_water() == 3
    assert len(list((tmp_path / "ledger").iterdir())) == 1
    ledger.commit("r2", table([("z", 9, 9, 9)]), open_from=99)
    ledger.commit("r9", table([]), open_from=7)
    assert ledger.low_water() == 7 and sorted(map(tuple, ledger.processed().collect())) == before
