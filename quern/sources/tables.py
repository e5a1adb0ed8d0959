"""Parquet table access; paths are only ever opened by Spark's own readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns stored without a zone; cast to instants in UTC sessions before time arithmetic.
NTZ_COLUMNS = {"events": ["ts"], "orders": ["o_orderdate"], "lineitem": ["l_shipdate"]}


def load(spark: SparkSession, sf_dir: str, table: str, *, instants: bool = False) -> DataFrame:
    """Read ``<sf_dir>/<table>.parquet``; ``instants`` casts zone-less timestamps to TIMESTAMP."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if instants:
        for name in NTZ_COLUMNS.get(table, []):
            df = df.withColumn(name, F.col(name).cast("timestamp"))
    return df
