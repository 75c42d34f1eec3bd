"""Leases by timers of the state store."""

import time

from larkspire.streaming import leases

SCHEMA = "job_id long, at long, event string, worker string"


def test_leases_expire_without_input_and_after_a_restart(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    out = []

    def start():
        events = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        q = leases.queue(events, lease_seconds=8, max_attempts=2)
        return q.writeStream.foreachBatch(lambda df, i: out.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/cp").outputMode("update").trigger(processingTime="500 milliseconds").start()

    def add(*rows):
        spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def wait(job, status, seconds=90):
        end = time.time() + seconds
        while time.time() < end:
            found = [r for r in out if r["job_id"] == job]
            if found and found[-1]["status"] == status:
                return found[-1]
            time.sleep(0.3)
        raise AssertionError((job, status, out))

    add((1, 0, "enqueue", None), (1, 1, "claim", "a"), (2, 0, "enqueue", None), (2, 1, "claim", "a"), (2, 2, "done", "b"), (3, 0, "claim", "a"))
    q = start()
    try:
        assert wait(1, "running")["owner"] == "a" and wait(2, "running")["attempts"] == 1 and wait(3, "new")["attempts"] == 0
        add((2, 5, "done", "a"))
        assert wait(2, "completed")["lease_until"] is None
        got = wait(1, "pending")
        assert got["cause"] == "expired" and got["failures"] == 1 and got["owner"] is None
        add((1, 9, "claim", "b"))
        assert wait(1, "running")["attempts"] == 2
        q.stop()
        q.awaitTermination()
        q = start()  # the timer that was set before comes with the checkpoint; any event sets the stream going
        add((4, 0, "enqueue", None))
        got = wait(1, "dead_lettered")
        assert got["cause"] == "expired" and got["failures"] == 2
        assert [r["status"] for r in out if r["job_id"] == 2] == ["running", "completed"]
    finally:
        q.stop()
        if before:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
