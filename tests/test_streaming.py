from datetime import datetime

from quern.streaming import windows


def events(spark, path):
    rows = [(k, datetime(2024, 1, 1, h, m)) for k, h, m in (("a", 0, 5), ("a", 0, 50), ("b", 1, 0), ("a", 3, 0), ("b", 1, 20))]
    spark.createDataFrame(rows, "key string, ts timestamp_ntz").coalesce(1).write.parquet(path)
    return windows.event_stream(spark, path)


def test_stream_windows_equal_batch_windows(spark, tmp_path):
    stream = events(spark, f"file://{tmp_path}/e")
    batch = spark.read.parquet(f"file://{tmp_path}/e").withColumn("ts", stream_ts())
    for f, width in ((windows.tumbling_counts, "1 hour"), (windows.session_counts, "30 minutes")):
        assert sorted(map(tuple, windows.drained(f(stream, width, "key")).collect())) == sorted(map(tuple, f(batch, width, "key").collect()))


def stream_ts():
    from pyspark.sql import functions as F

    return F.col("ts").cast("timestamp")


def test_stream_gaps(spark, tmp_path):
    found = windows.drained(windows.stream_gaps(events(spark, f"file://{tmp_path}/g"), "key", "ts", 1500), mode="append").collect()
    assert sorted((r.key, r.gap) for r in found) == [("a", 2700.0), ("a", 7800.0)]
