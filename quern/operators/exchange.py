"""Exchanges: rows dealt by range, by hash or by given split points, each partition sorted by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import order_exprs

PARTITIONERS = ("range", "hash")


def partitions_of(df: DataFrame, n: int | None) -> int:
    return n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def sorted_partitions(df: DataFrame, keys: Sequence[str], n: int | None = None, partitioner: str = "range", mode: str = "signed", desc: bool = False) -> DataFrame:
    """One shuffle, then a spillable sort inside each partition.

    ``range`` gives a globally sorted table: all keys of a partition precede those of the next one.
    ``hash`` keeps equal keys together and sorts each partition on its own.
    """
    order = order_exprs(df, keys, mode, desc)
    n = partitions_of(df, n)
    if partitioner == "range":
        return df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    if partitioner == "hash":
        return df.repartition(n, *[F.col(f"`{k}`") for k in keys]).sortWithinPartitions(*order)
    raise ValueError(f"partitioner {partitioner!r} is not one of {PARTITIONERS}")


def range_partition(key: Column, splits: Sequence) -> Column:
    """The number of split points that are not above ``key``: its partition among len(splits) + 1; a null key is in the first.

    A binary search in one array literal, so that thousands of split points make no larger plan than two.
    """
    n = len(splits)
    if not n:
        return F.lit(0)
    points = F.array(*map(F.lit, sorted(splits)))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        above = F.coalesce(key >= F.get(points, middle), F.lit(False))
        return F.when(s["low"] >= s["high"], s).when(above, F.struct((middle + 1).alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), middle.alias("high")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(n.bit_length())), F.struct(F.lit(0).alias("low"), F.lit(n).alias("high")), halve, lambda s: s["low"])


def modulo_partition(key: Column, n: int) -> Column:
    """An integer key's partition among ``n``, never negative."""
    return F.pmod(key, F.lit(n)).cast("int")


def salted(df: DataFrame, salts: int, name: str = "salt") -> DataFrame:
    """A column that spreads the rows of one key over ``salts`` groups, the same in every run."""
    return df.withColumn(name, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(salts)).cast("int"))


def partition_directory(df: DataFrame, partition: Column, length: Column, name: str = "part") -> DataFrame:
    """An index row for each partition: part, records, length, start (bytes of all partitions before it).

    Rows are summed map-side; the window sees one row for each partition, so ``partition`` must be a number among
    a bounded many, as the partitioners above give it.
    """
    sums = df.groupBy(partition.alias(name)).agg(F.count(F.lit(1)).alias("records"), F.sum(length.cast("long")).alias("length"))
    before = Window.orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn("start", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))


def chunk_requests(directory: DataFrame, chunk: int, name: str = "part") -> DataFrame:
    """The ranged reads that fetch each partition: part, chunk, offset in the file, length (the last may be shorter)."""
    some = directory.filter(F.col("length") > 0).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / chunk).cast("long"))))
    at = F.col("chunk") * F.lit(chunk)
    return some.select(name, "chunk", (F.col("start") + at).alias("offset"), F.least(F.lit(chunk).cast("long"), F.col("length") - at).alias("length"))
