import time
from datetime import datetime

from pyspark.sql import functions as F

from claimlake.streaming import streams

SCHEMA = "user string, ts timestamp"


def at(minute):
    return datetime(2024, 1, 1, minute // 60, minute % 60)


def written(spark, folder, *batches):
    """A file for each batch, read as a stream one at a time."""
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(str(folder))
        time.sleep(0.05)  # files are taken by their times
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder))


def test_a_late_row_is_counted_and_no_other(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    listener = streams.ProgressTable(spark, str(tmp_path / "metrics"))
    spark.streams.addListener(listener)
    try:
        stream = written(spark, tmp_path / "in", [("a", at(0)), ("b", at(5))], [("a", at(180))], [("a", at(181))], [("a", at(182)), ("a", at(1)), ("b", at(120))])
        counts = streams.windowed_counts(streams.watched(stream, "arrivals", "ts"), "ts", "user", "10 minutes", delay="30 minutes")
        streams.into_table(counts, "late_counts", str(tmp_path / "c"), "append").awaitTermination()
        for _ in range(100):
            try:
                (got,) = [r for r in streams.progress(spark, str(tmp_path / "metrics")).collect() if r["query"] == "late_counts"]
                if got["rows"] == 7 and got.late:
                    break
            except Exception:  # the table is not there yet
                pass
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert got["rows"] == 7 and got.late == 2  # of minutes 1 and 120, behind 180 - 30 as the batch before knew
    seen = spark.read.schema(streams.ProgressTable.SCHEMA).json(str(tmp_path / "metrics")).filter("query = 'late_counts'").select(F.col("observed")["arrivals.rows"].cast("long").alias("n"))
    assert seen.agg(F.sum("n")).head()[0] == 7
    assert {(r.user, r.n) for r in spark.table("late_counts").collect()} == {("a", 1), ("b", 1)}


def test_sliding_windows_and_sessions(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    rows = [("a", at(0)), ("a", at(4)), ("a", at(20)), ("b", at(3)), ("a", at(23)), ("b", at(50))]
    stream = written(spark, tmp_path / "in", rows[:4], rows[4:], [("z", at(600))], [("z", at(601))])
    streams.into_table(streams.sessions(stream, "ts", "user", "10 minutes", "0 minutes"), "some_sessions", str(tmp_path / "c1")).awaitTermination()
    got = {(r.user, r.start.hour * 60 + r.start.minute, r.end.hour * 60 + r.end.minute, r.n) for r in spark.table("some_sessions").collect()}
    assert got == {("a", 0, 14, 2), ("a", 20, 33, 2), ("b", 3, 13, 1), ("b", 50, 60, 1)}
    streams.into_table(streams.windowed_counts(stream, "ts", "user", "20 minutes", "10 minutes", "0 minutes"), "sliding", str(tmp_path / "c2")).awaitTermination()
    want = {}
    for user, t in rows:
        for start in range(-10, 600, 10):
            if start <= t.hour * 60 + t.minute < start + 20:
                want[user, start] = want.get((user, start), 0) + 1
    minutes = lambda d: int((d - at(0)).total_seconds() // 60)
    assert {(r.user, minutes(r.start)): r.n for r in spark.table("sliding").collect() if r.user != "z"} == want


def test_a_task_left_alone_is_free_again(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    events = spark.createDataFrame([("t", at(0), "assign"), ("s", at(0), "assign"), ("s", at(1), "submit")], "task string, ts timestamp, kind string")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = streams.annotation_states(stream, "task", patience=500).writeStream.format("memory").queryName("left_alone").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()
    try:
        seen = []
        for _ in range(300):
            seen = [(r.task_id, r.status) for r in spark.table("left_alone").collect()]
            if ("t", "PENDING") in seen:
                break
            time.sleep(0.1)
    finally:
        query.stop()
    assert ("t", "IN_PROGRESS") in seen and ("t", "PENDING") in seen and [s for t, s in seen if t == "s"] == ["SUBMITTED"]
