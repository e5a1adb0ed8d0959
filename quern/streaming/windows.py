"""Event streams (an extension): windows with watermarks, and gaps by keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.sources.shared import shared_dir


def event_stream(spark: SparkSession, path: str, ts: str = "ts", files_per_trigger: int = 16) -> DataFrame:
    """A Parquet folder, or a pattern for single files, as a stream; zone-less times become instants, as watermarks need."""
    schema = spark.read.parquet(path).schema
    found = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return found.withColumn(ts, F.col(ts).cast("timestamp"))


def tumbling_counts(events: DataFrame, width: str, key: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """window_start, key, n for each window; rows later than the watermark are dropped by a stream, and kept in batches."""
    dated = events.withWatermark(ts, late) if events.isStreaming else events
    return dated.groupBy(F.window(ts, width), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), key, "n")


def session_counts(events: DataFrame, gap: str, key: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """session_start, session_end, key, n: windows that end ``gap`` after their last row."""
    dated = events.withWatermark(ts, late) if events.isStreaming else events
    return dated.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), key, "n")


def stream_gaps(events: DataFrame, key: str, ts: str, max_diff: float) -> DataFrame:
    """key, ts, gap for rows over ``max_diff`` seconds after the latest earlier row of their key; state: one time for each key."""
    kind = events.schema[key].dataType.simpleString()

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        times = sorted(t for b in batches for t in b[ts])
        out = []
        for t in times:
            now = t.value // 1000  # microseconds: whole numbers, so that gaps are exact
            if last is not None and now - last > max_diff * 1_000_000:
                out.append((keys[0], t, (now - last) / 1_000_000))
            last = now if last is None else max(last, now)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=[key, ts, "gap"])

    return events.select(key, ts).filter(F.col(ts).isNotNull()).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {ts} timestamp, gap double", "last long", "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, mode: str = "complete", name: str = "drained") -> DataFrame:
    """What a finite stream has written by its end, read back from the shared folder."""
    import uuid

    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/quern/{name}-{uuid.uuid4().hex}"
    if mode == "append":
        query = stream.writeStream.outputMode("append").option("checkpointLocation", f"{base}/state").format("parquet").option("path", f"{base}/out").trigger(availableNow=True).start()
    else:  # the last batch has everything
        query = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/out")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
