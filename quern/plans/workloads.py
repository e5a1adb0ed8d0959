"""The workloads that drive a sorted exchange: sort, word count, pi, storage round trips."""

from __future__ import annotations

import math
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.exchange import sorted_partitions
from quern.operators.validate import byte_totals, checksum, validate_files

MAPS, SAMPLES = 10, 100
#: Bytes that a storage task holds at once.
PIECE = 1 << 20
TOLERANCE = 0.1
#: Steps of a plane-filling lattice of integers modulo 2 ** 31: the fractions of the plastic number's powers.
MODULUS, STEP_X, STEP_Y = 1 << 31, 1621132907, 1223770913


def sort_workload(records: DataFrame, path: str, keys: list[str], n: int | None = None, mode: str = "signed") -> dict:
    """Sort a table to ``path`` and validate it: seconds, whether order is right, and whether contents are the input's."""
    spark = records.sparkSession
    began = time.monotonic()
    sorted_partitions(records, keys, n, mode=mode).write.mode("overwrite").parquet(path)
    seconds = time.monotonic() - began
    found = validate_files(spark, path, keys, mode).first()
    return {"seconds": seconds, "rows": found["rows"], "sorted": found["ok"], "same": checksum(records).first() == checksum(spark.read.parquet(path)).first()}


def pi_estimate(spark: SparkSession, maps: int = MAPS, samples: int = SAMPLES) -> DataFrame:
    """One row: points, inside, estimate, close (within the tolerance). All arithmetic on points is exact."""
    at = lambda step: F.pmod(F.col("id") * F.lit(step), F.lit(MODULUS)).cast("double") / MODULUS - 0.5
    inside = at(STEP_X) * at(STEP_X) + at(STEP_Y) * at(STEP_Y) <= 0.25
    sums = spark.range(0, maps * samples, 1, maps).agg(F.count(F.lit(1)).alias("points"), F.count_if(inside).alias("inside"))
    estimate = F.col("inside") * 4.0 / F.col("points")
    return sums.withColumn("estimate", estimate).withColumn("close", F.abs(estimate - math.pi) <= TOLERANCE)


def storage_round_trip(df: DataFrame, path: str, *columns: str) -> DataFrame:
    """Write a table and read it again: rows and bytes in and out, and whether they agree."""
    df.select(*columns).write.mode("overwrite").parquet(path)
    back = byte_totals(df.sparkSession.read.parquet(path), *columns).select(F.col("rows").alias("rows_out"), F.col("bytes").alias("bytes_out"))
    # One row on either side.
    return byte_totals(df, *columns).select(F.col("rows").alias("rows_in"), F.col("bytes").alias("bytes_in")).join(F.broadcast(back)).withColumn("valid", (F.col("rows_in") == F.col("rows_out")) & (F.col("bytes_in") == F.col("bytes_out")))


def storage_files(spark: SparkSession, path: str, files: int, size: int, mode: str) -> DataFrame:
    """Write (``mode`` "write"), read ("read") or remove ("clean") ``files`` files of ``size`` bytes, a task for each: file, bytes, seconds.

    ``analytics.io_report`` sums this up.
    """
    if mode not in ("write", "read", "clean"):
        raise ValueError(f"mode {mode!r} is not 'write', 'read' or 'clean'")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(path)
        system.create_dir(folder, recursive=True)
        for batch in batches:
            for i in batch["id"]:
                name, began, done = f"{folder}/io-{i:05d}.dat", time.monotonic(), 0
                if mode == "write":
                    with system.open_output_stream(name) as out:
                        while done < size:
                            done += out.write(bytes(min(PIECE, size - done)))
                elif mode == "read":
                    with system.open_input_stream(name) as data:
                        while piece := data.read(PIECE):
                            done += len(piece)
                else:
                    done = system.get_file_info(name).size
                    system.delete_file(name)
                yield pd.DataFrame({"file": [i], "bytes": [done], "seconds": [max(time.monotonic() - began, 1e-9)]})

    return spark.range(0, files, 1, files).mapInPandas(run, "file long, bytes long, seconds double")


def throughput(spark: SparkSession, df: DataFrame, path: str, files: int) -> dict:
    """Seconds and MB a second of writing and reading ``files`` files."""
    began = time.monotonic()
    df.repartition(files).write.mode("overwrite").parquet(path)
    wrote = time.monotonic()
    back = spark.read.parquet(path)
    back.select(F.count(F.lit(1)), *[F.max(F.col(f"`{c}`")) for c, kind in back.dtypes if not kind.startswith(("map", "array", "struct"))]).collect()
    read = time.monotonic()
    mb = sum(x.getLen() for x in _files(spark, path)) / 1e6
    return {"files": files, "mb": mb, "write_mb_s": mb / max(wrote - began, 1e-9), "read_mb_s": mb / max(read - wrote, 1e-9)}


def _files(spark: SparkSession, path: str) -> list:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    return [x for x in found if x.getPath().getName().startswith("part-")]
