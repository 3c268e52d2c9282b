"""The state of jobs as a stream, with a late, a lost and a failed job."""

from datetime import datetime, timedelta, timezone

from leafmill.streaming.status import job_status

SCHEMA = "job string, kind string, ts timestamp, detail string"


def test_job_status(spark, tmp_path):
    t0 = datetime(2024, 5, 3, 10, 0, tzinfo=timezone.utc)
    at = lambda s: t0 + timedelta(seconds=s)
    batches = [
        [("a", "start", at(0), None), ("b", "start", at(1), None), ("c", "start", at(2), None), (None, "start", at(0), None), ("d", "start", at(3), None)],
        [("a", "progress", at(60), None), ("c", "error", at(70), "broken"), ("c", "done", at(80), None), ("d", "error", at(90), "unsupported kind"), ("x", "other", at(5), None)],
        [("a", "done", at(200), "out.html"), ("e", "start", at(210), None)],
        [("b", "done", at(50), "too late"), ("e", "progress", at(215), None), ("f", "start", at(400), None)],
    ]
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        folder = tmp_path / "in"
        folder.mkdir()
        got = []
        out = job_status(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder)))
        for n, rows in enumerate(batches):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(str(folder))
            q = out.writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            q.awaitTermination(120)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    seen = {}
    for r in got:
        seen.setdefault(r["job"], []).append((r["status"], r["detail"]))
    assert seen == {
        "a": [("working", None), ("success", "out.html")], "b": [("working", None), ("error", "timed out")], "c": [("working", None), ("error", "broken")],
        "d": [("working", None), ("unsupported", "unsupported kind")], "e": [("working", None)], "f": [("working", None)],
    }
