"""Merges of sorted runs, global ranks and top-k."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.shared import written

from .exchange import partitions_of, sorted_partitions
from .ordering import order_exprs


def union_of(runs: Sequence[DataFrame]) -> DataFrame:
    """The multiset union of runs, in any order."""
    if not runs:
        raise ValueError("no runs to merge")
    return reduce(DataFrame.unionByName, runs)


def merged_runs(runs: Sequence[DataFrame], keys: Sequence[str], n: int | None = None, mode: str = "signed") -> DataFrame:
    """The sorted multiset union of runs: every record of every run, in key order over all partitions."""
    return sorted_partitions(union_of(runs), keys, n, mode=mode)


def _unclaimed(names: Sequence[str], taken: Sequence[str]) -> None:
    if both := sorted(set(names) & set(taken)):
        raise ValueError(f"columns {both} have the names of results; rename them")


def _named(df: DataFrame, keys: Sequence[str], mode: str) -> tuple[DataFrame, list]:
    """``df``'s keys alone, as k0, k1 and so on, and the orders of these: no name of a column can clash."""
    keyed = df.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)])
    return keyed, order_exprs(keyed, keyed.columns, mode)


def key_ranks(df: DataFrame, keys: Sequence[str], n: int | None = None, mode: str = "signed") -> DataFrame:
    """One row per distinct key: the keys, copies, rank (as SQL's), dense_rank.

    Copies of a key are counted before the range exchange, so a hot key is one row of it. Ranks are
    counted inside ranges; only one row for each range, its totals, is summed in one place.
    """
    _unclaimed(keys, ("copies", "rank", "dense_rank"))
    keyed, order = _named(df, keys, mode)
    counted = keyed.groupBy(*keyed.columns).agg(F.count(F.lit(1)).alias("copies"))
    # Written, as ranges come from a sample and must be the same for the totals and the rows.
    ranges = written(counted.repartitionByRange(partitions_of(df, n), *order).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranges.groupBy("part").agg(F.sum("copies").alias("rows"), F.count(F.lit(1)).alias("keys"))
    totals = totals.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows"), F.coalesce(F.sum("keys").over(before), F.lit(0)).alias("keys"))
    inside = Window.partitionBy("part").orderBy(*order)
    rank = F.col("rows") + F.coalesce(F.sum("copies").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1
    # A row for each range: as many as shuffle partitions.
    return ranges.join(F.broadcast(totals), "part").select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "copies", rank.cast("long").alias("rank"), (F.col("keys") + F.row_number().over(inside)).cast("long").alias("dense_rank"))


def global_rank(df: DataFrame, keys: Sequence[str], n: int | None = None, mode: str = "signed") -> DataFrame:
    """``df`` with rank and dense_rank over all its rows.

    Rows go through one range exchange over the keys and a salt, so a hot key spans as many ranges as its rows
    fill. Ranks are counted inside ranges; what comes before a range, and whether its first key has begun
    earlier, is told by one row for each range.
    """
    _unclaimed(df.columns, ("rank", "dense_rank"))
    keyed = df.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)], F.struct("*").alias("row"))
    names = [f"k{i}" for i in range(len(keys))]
    order = order_exprs(keyed, names, mode)
    dealt = keyed.withColumn("salt", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(partitions_of(df, n), *order, "salt")
    ranges = written(dealt.drop("salt").withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy(*order)
    key = F.struct(*names)
    ranked = ranges.withColumns({"own": F.rank().over(inside), "own_dense": F.dense_rank().over(inside)})
    by = Window.orderBy("part")  # a row for each range
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    ends = ranked.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.max("own_dense").alias("keys"), F.max("own").alias("last_rank"), F.min_by(key, "own").alias("first"), F.max_by(key, "own").alias("last"))
    ends = ends.withColumn("goes_on", F.coalesce(F.col("first").eqNullSafe(F.lag("last").over(by)), F.lit(False)) & (F.row_number().over(by) > 1))
    ends = ends.withColumn("rows_before", F.coalesce(F.sum("rows").over(before), F.lit(0))).withColumn("keys_before", F.coalesce(F.sum(F.col("keys") - F.col("goes_on").cast("int")).over(before), F.lit(0)))
    # The rank of a range's last key; where the range holds nothing else and that key has begun earlier, it is the one found there.
    last_rank = F.when(~(F.col("goes_on") & (F.col("keys") == 1)), F.col("rows_before") + F.col("last_rank"))
    ends = ends.withColumn("last_rank", last_rank).withColumn("begun", F.last("last_rank", ignorenulls=True).over(before))
    side = ends.select("part", "goes_on", "rows_before", "keys_before", "begun")
    rank = F.when(F.col("goes_on") & (F.col("own") == 1), F.col("begun")).otherwise(F.col("rows_before") + F.col("own"))
    dense = F.col("keys_before") + F.col("own_dense") - F.col("goes_on").cast("int")
    return ranked.join(F.broadcast(side), "part").select("row.*", rank.cast("long").alias("rank"), dense.cast("long").alias("dense_rank"))


def top_k(df: DataFrame, keys: Sequence[str], k: int, mode: str = "signed", desc: bool = False) -> DataFrame:
    """The first ``k`` rows in key order: each task keeps ``k``, and only those meet."""
    return df.orderBy(*order_exprs(df, keys, mode, desc)).limit(k)


def top_k_per_group(df: DataFrame, group: Sequence[str], keys: Sequence[str], k: int, mode: str = "signed", desc: bool = False) -> DataFrame:
    """The first ``k`` rows of each group with their position (1 to k).

    Spark keeps ``k`` rows of a group in each map task before the exchange (WindowGroupLimit), so a hot group
    sends no more than that.
    """
    _unclaimed(df.columns, ("position",))
    own = Window.partitionBy(*[F.col(f"`{g}`") for g in group]).orderBy(*order_exprs(df, keys, mode, desc))
    return df.withColumn("position", F.row_number().over(own)).filter(F.col("position") <= k)
