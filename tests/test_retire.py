"""Mark and sweep of uploaded objects."""

import pytest
from pyspark.sql import functions as F

from larkspire.operators import retire

def test_a_sweep_that_stops_is_taken_up_again(spark, tmp_path):
    now = F.expr("timestamp_ntz'2024-02-01 00:00:00'")
    for i in range(20):
        (tmp_path / f"o{i}").write_text("x")
    rows = [(str(i), "t", "active", None, f"{tmp_path}/o{i}") for i in range(20)]
    inventory = spark.createDataFrame(rows, "object_id string, tenant_id string, state string, retired_at timestamp_ntz, storage_path string").withColumn("created_at", F.expr("timestamp_ntz'2024-01-01 00:00:00'"))
    uses = spark.createDataFrame([(str(i), "t" if i < 5 else "u") for i in range(8)] + [("77", "t")], "object_id string, tenant_id string")
    m = retire.marked(inventory, uses, F.expr("timestamp_ntz'2024-01-05 00:00:00'"))
    assert {r["object_id"]: r["state"] for r in m.collect() if r["tenant_id"] == "t"} == {str(i): "active" if i < 5 else "retired" for i in range(20)} | {"77": "dangling"}
    assert retire.due(m, F.expr("timestamp_ntz'2024-01-05 10:00:00'")).count() == 0 and retire.due(m, now).count() == 15

    def fails(path):
        retire._delete(path)
        if path.endswith("o9"):
            raise SystemExit("the executor is lost")

    with pytest.raises(Exception):
        retire.Sweep(spark, f"file://{tmp_path}/s", fails).run(m, now)
    assert not (tmp_path / "o9").exists() and (tmp_path / "o3").exists()
    done = retire.Sweep(spark, f"file://{tmp_path}/s").run(m.limit(0), now)  # the manifest says what was to go
    assert done.count() == 15 and done.where("deleted").count() == 15
    after = retire.swept(m, done, now)
    assert sorted(p.name for p in tmp_path.glob("o*")) == [f"o{i}" for i in range(5)] and after.where("state = 'deleted'").count() == 15
    assert retire.Sweep(spark, f"file://{tmp_path}/s").run(after, now).count() == 0
