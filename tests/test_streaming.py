"""Dismissals over a replayed stream."""

import datetime

from mendwright.streaming import events


def day(n, hour=0):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n, hours=hour)


def replay(spark, tmp_path, batches):
    """Runs the batches one after another, each a file; the state lives in the checkpoint, so every batch is a run of its own."""
    shown = []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "id string, kind string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("id string, kind string, ts timestamp").parquet(f"{tmp_path}/in")
        q = events.alerts_with_dismissals(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        now = sorted((r["id"], r["shown_at"], r["why"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
        shown.append([r for r in now if r not in [x for b in shown for x in b]])
    return shown


def test_dismissed_alerts_come_back(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        got = replay(spark, tmp_path, [
            [("a", "alert", day(0)), ("b", "alert", day(0)), (None, "alert", day(0)), ("n", None, day(0))],
            [("a", "dismiss", day(1)), ("c", "dismiss", day(1))],
            [("a", "alert", day(3)), ("b", "alert", day(3)), ("c", "alert", day(4))],
            [("a", "dismiss", day(5)), ("x", "alert", day(9))],
            [("x", "alert", day(14))],
            [("x", "alert", day(40)), ("a", "alert", day(40))],
        ])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == [("a", day(0), "new"), ("b", day(0), "new"), ("n", day(0), "new")] and got[1] == []
    assert got[2] == [("b", day(3), "new")]
    assert ("c", day(8), "back") in got[3] and ("x", day(9), "new") in got[3] and not [r for r in got[3] if r[0] == "a"]
    rest = got[4] + got[5]
    # seven days from the second dismissal, once, and no sooner
    assert [r for r in rest if r[0] == "a"] == [("a", day(12), "back"), ("a", day(40), "new")]
    assert [r for r in rest if r[0] == "c"] == []
