"""The commit log and tables merged on read."""

import json
import threading
import uuid

import pytest
from pyspark.sql import functions as F

from larkspire.operators.log import CommitLog, Conflict
from larkspire.operators import store
from larkspire.operators.merge import MergeTable


def test_log_folds_commits_and_keeps_states(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}", lambda s, c: {"n": s.get("n", 0) + c["n"]})
    assert log.state() == (0, {})
    for i in range(45):
        log.commit({"n": 1}, i)
    assert log.state() == (45, {"n": 45}) and log.state(7) == (7, {"n": 7})
    assert sorted(p.name for p in (tmp_path / "_log").glob("*.state")) == ["20.state", "40.state"]
    assert not list((tmp_path / "_log").glob("*.tmp"))


def test_one_of_two_writers_of_a_version_fails(spark, tmp_path):
    a, b = CommitLog(spark, f"file://{tmp_path}"), CommitLog(spark, f"file://{tmp_path}")
    at = a.version()
    a.commit({"active": "x"}, at)
    with pytest.raises(Conflict):
        b.commit({"active": "y"}, at)
    assert b.commit({"note": 1}, at, lambda other: "note" in other) == 2 and a.state()[1] == {"active": "x", "note": 1}


def test_writers_at_once_get_numbers_of_their_own(spark, tmp_path):
    won, lost = [], []

    def write(i):
        log = CommitLog(spark, f"file://{tmp_path}")
        try:
            won.append(log.commit({"by": i}, 0, (lambda other: True) if i % 2 else (lambda other: False)))
        except Conflict:
            lost.append(i)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(12)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(won) == list(range(1, len(won) + 1)) and len(won) + len(lost) == 12 and len(lost) >= 5


def plain(rows, *batches):
    out = {r[0]: r for r in rows}
    for kind, batch in batches:
        for r in batch:
            out.pop(r[0], None) if kind == "delete" else out.__setitem__(r[0], r)
    return sorted(out.values())


def test_merge_on_read(spark, tmp_path):
    rows = [(i, f"a{i}", 0) for i in range(200)]
    schema = "id long, name string, n int"
    t = MergeTable.create(spark, f"file://{tmp_path}/t", spark.createDataFrame(rows, schema), ["id"], 4)
    one = [(i, f"b{i}", 1) for i in range(190, 230)]
    two = [(i, None, 2) for i in range(0, 220, 10)]
    got = lambda at=None: sorted((tuple(r) for r in t.read(at).collect()), key=lambda r: r[0])
    t.upsert(spark.createDataFrame(one, schema))
    t.delete(spark.createDataFrame([(5,), (200,), (999,)], "id long"))
    t.upsert(spark.createDataFrame(two, schema))
    want = plain(rows, ("upsert", one), ("delete", [(5,), (200,)]), ("upsert", two))
    assert got() == want and got(1) == rows and got(2) == plain(rows, ("upsert", one))
    again = MergeTable(spark, f"file://{tmp_path}/t")
    assert again.compact() == 5 and got() == want and again.log.state()[1]["deltas"] == []
    assert len(again.vacuum()) == 4 and got() == want
    # A batch that lacks a column keeps it; of a key's rows the last by order counts.
    again.upsert(spark.createDataFrame([(1, 7), (300, 8)], "id long, n int"))
    assert {tuple(r) for r in again.read().where("id IN (1, 300)").collect()} == {(1, "a1", 7), (300, None, 8)}
    again.upsert(spark.createDataFrame([(1, "x", 1), (1, "y", 3), (1, "z", 2)], schema), "n")
    assert again.read().where("id = 1").first()["name"] == "y"
    with pytest.raises(Exception, match="null"):
        again.upsert(spark.createDataFrame([(None, "x", 1)], schema))


def test_the_base_is_not_shuffled(spark, tmp_path):
    t = MergeTable.create(spark, f"file://{tmp_path}/t", spark.range(5000).withColumn("x", F.col("id") * 2), ["id"], 8)
    t.upsert(spark.range(10, 40).withColumn("x", F.lit(1)))
    plan = t.read()._jdf.queryExecution().executedPlan().toString()
    base = t._name(t.log.state()[1]["base"])
    lines = plan.splitlines()
    at = next(i for i, x in enumerate(lines) if base in x)
    depth = len(lines[at]) - len(lines[at].lstrip(" :+-*"))
    above = []
    for x in reversed(lines[:at]):  # the operators over the base's scan
        d = len(x) - len(x.lstrip(" :+-*"))
        if d < depth:
            above.append(x.strip(" :+-*"))
            depth = d
    assert not any(x.startswith("Exchange") or x.startswith("Sort") for x in above), above
    assert any("ShuffledHashJoin" in x for x in above)


def test_a_compaction_lets_deltas_that_came_meanwhile_stand(spark, tmp_path):
    t = MergeTable.create(spark, f"file://{tmp_path}/t", spark.range(20).withColumn("x", F.lit(0)), ["id"], 2)
    t.upsert(spark.range(3).withColumn("x", F.lit(1)))
    slow, write = MergeTable(spark, f"file://{tmp_path}/t"), None
    write = slow._write

    def late(rows, state):
        slow._write = write
        t.upsert(spark.createDataFrame([(0, 2)], "id long, x int"))
        return write(rows, state)

    slow._write = late
    slow.compact()
    assert {r["id"]: r["x"] for r in t.read().where("id < 4").collect()} == {0: 2, 1: 1, 2: 1, 3: 0} and len(t.log.state()[1]["deltas"]) == 1
    version, state = t.log.state()
    t.compact()
    with pytest.raises(Conflict):
        t.log.commit({"base": state["base"], "remove": []}, version, lambda other: "base" in other)
    assert json.loads(state["schema"]) and uuid.UUID(state["base"].rpartition("/")[2])


def test_of_two_activations_one_wins(spark, tmp_path):
    from larkspire.operators.snapshot import Generations

    a, b = Generations(spark, f"file://{tmp_path}/g"), Generations(spark, f"file://{tmp_path}/g")
    for name in ("one", "two", "three"):
        a.stage(spark.range(3), name)
    a.activate("one")
    won, lost, gate = [], [], threading.Barrier(2)

    def switch(g, name):
        state, commit = g.log.state(), g.log.commit

        def late(change, read_at, conflicts):
            gate.wait()  # both have read the same state before either commits
            return commit(change, read_at, conflicts)

        g.log.commit = late
        try:
            g.activate(name, "one")
            won.append(name)
        except Conflict:
            lost.append(name)
        assert state[1]["active"] == "one"

    threads = [threading.Thread(target=switch, args=x) for x in ((a, "two"), (b, "three"))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == len(lost) == 1 and Generations(spark, f"file://{tmp_path}/g").active() == won[0]


def test_imports_make_no_canonical_form_for_each_request(spark, monkeypatch):
    """Requests are grouped by their location as written first; the plan has the kind's rules a few times, not for each use of them."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        seen.add(1)
        return x

    whole = store.canonical
    monkeypatch.setattr(store, "canonical", lambda c: whole(counted(c)))
    rows = [("t", "web", ("HTTP://A.org/", "http://a.org/")[i % 2] + str(i % 3) + "/" * (i % 5 == 0), f"n{i % 7}", i // 4) for i in range(2000)] + [("t", "web", None, "none", None), ("t", "web", "http://b.org", "old", None), ("t", "web", "http://b.org", "z", None)]
    req = spark.createDataFrame(rows, "tenant_id string, source_type string, location string, name string, at long")
    none = spark.createDataFrame([], "source_id string, tenant_id string, source_type string, location string, name string, status string, updated_at long")
    got = store.imported(none, req)
    found = {r["location"]: (r["name"], r["updated_at"]) for r in got.collect()}
    assert found == {None: ("none", None), "http://b.org/": ("z", None)} | {f"http://a.org/{k}": max(((n, at) for _, _, p, n, at in rows[:2000] if p.rstrip("/")[-1] == str(k)), key=lambda x: (x[1], x[0])) for k in range(3)}
    assert 0 < seen.value < 300
    assert len(got._jdf.queryExecution().optimizedPlan().toString()) < 100_000
