"""Analytics over logs, machine statistics and job results."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.shared import written

#: Seconds without a line after which a log counts as hanging, lines around a snippet, per cent of bad tasks that are an error.
MAX_DIFF, CONTEXT, BAD_TASKS = 10, 1000, 10


def _ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows in ranges of ``order``, each numbered by ``part``: a file's or group's rows spread over as many ranges as they fill."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written, as ranges come from a sample and must be the same wherever they are read again.
    return written(df.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))


def _before(ranges: DataFrame, order: list[str], *columns: str) -> DataFrame:
    """``ranges`` with the values that the row before has, as a struct ``before`` (null for the first row of all)."""
    own, inside = F.struct(*columns), Window.partitionBy("part").orderBy(*order)
    last = ranges.groupBy("part").agg(F.max_by(own, F.struct(*order)).alias("last"))
    # A row for each range.
    ends = last.select("part", F.lag("last").over(Window.orderBy("part")).alias("end"))
    return ranges.join(F.broadcast(ends), "part").withColumn("before", F.coalesce(F.lag(own).over(inside), F.col("end"))).drop("end")


def log_gaps(lines: DataFrame, file: str, row: str, ts: str, max_diff: float = MAX_DIFF) -> DataFrame:
    """Lines that come over ``max_diff`` whole seconds after the dated line before them in their file: file, row, gap.

    Lines go by ranges of file and row, so one long file is no single task.
    """
    seconds = F.floor(F.unix_micros(F.col(f"`{ts}`")) / 1_000_000)
    own = lines.select(F.col(f"`{file}`").alias("file"), F.col(f"`{row}`").alias("row"), seconds.alias("s")).filter(F.col("s").isNotNull())
    found = _before(_ranged(own, ["file", "row"]), ["file", "row"], "file", "s")
    gap = F.when(F.col("before.file").eqNullSafe(F.col("file")), F.col("s") - F.col("before.s"))
    return found.withColumn("gap", gap).filter(F.col("gap") > max_diff).select("file", "row", "gap")


def rollup_runs(rows: DataFrame, group: Sequence[str], order: Sequence[str], key: str, averages: Sequence[str] = (), sums: Sequence[str] = (), run: str = "run") -> DataFrame:
    """One row per run of consecutive rows with equal keys: the group, run number (``run`` names it), key, n, averages and sums.

    Rows go by ranges of group and order, so a large group is no single task: runs are numbered over all groups
    by how many have begun, then inside their group.
    """
    given = [*group, key, "n", *[f"avg_{c}" for c in averages], *[f"sum_{c}" for c in sums]]
    if run in given or len(set(given)) < len(given):
        raise ValueError(f"the result would have two columns of one name among {[run, *given]}")
    values = list(dict.fromkeys([*averages, *sums]))
    named = {**{f"g{i}": c for i, c in enumerate(group)}, **{f"o{i}": c for i, c in enumerate(order)}, "key": key, **{f"v{i}": c for i, c in enumerate(values)}}
    own = rows.select(*[F.col(f"`{c}`").alias(a) for a, c in named.items()])
    groups, by = [c for c in own.columns if c.startswith("g")], [c for c in own.columns if c.startswith(("g", "o"))]
    found = _before(_ranged(own, by), by, *groups, "key")
    same = lambda *names: reduce(lambda a, b: a & b, [F.col(f"before.{c}").eqNullSafe(F.col(c)) for c in names], F.col("before").isNotNull())
    begins = F.when(same(*groups, "key"), 0).otherwise(1).cast("long")
    # The runs that have begun up to a row: inside its range, and in all ranges before, of which each is one row.
    upto = Window.partitionBy("part").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    marked = found.withColumn("begins", begins).withColumn("first", (~same(*groups)).cast("int")).withColumn("inside", F.sum("begins").over(upto)).drop("before")
    totals = marked.groupBy("part").agg(F.sum("begins").alias("total"))
    earlier = totals.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    numbered = marked.join(F.broadcast(earlier), "part").withColumn("number", F.col("earlier") + F.col("inside"))
    at = {c: f"v{i}" for i, c in enumerate(values)}
    runs = numbered.groupBy(*groups, "number", "key").agg(F.count(F.lit(1)).alias("n"), *[F.avg(at[c]).alias(f"a{i}") for i, c in enumerate(averages)], *[F.sum(at[c]).alias(f"s{i}") for i, c in enumerate(sums)])
    firsts = numbered.filter("first = 1").select(*[F.col(c).alias(f"f{c}") for c in groups], F.col("number").alias("start"))
    if groups:
        runs = runs.join(firsts, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"f{c}")) for c in groups]))
    else:
        runs = runs.withColumn("start", F.lit(1))
    out = [F.col(f"g{i}").alias(c) for i, c in enumerate(group)] + [(F.col("number") - F.col("start") + 1).alias(run), F.col("key").alias(key), "n"]
    return runs.select(*out, *[F.col(f"a{i}").alias(f"avg_{c}") for i, c in enumerate(averages)], *[F.col(f"s{i}").alias(f"sum_{c}") for i, c in enumerate(sums)])


def truncated(x: Column, places: int = 2) -> Column:
    """A number cut, not rounded, to so many decimal places."""
    scaled = x * float(10**places)
    return F.when(scaled < 0, F.ceil(scaled)).otherwise(F.floor(scaled)).cast("double") / float(10**places)


def stats_summary(rows: DataFrame, value: str, group: Sequence[str] = (), places: int | None = None) -> DataFrame:
    """count, avg, min, max and population standard deviation of a value, nulls left out; ``places``: cut to so many decimal places."""
    x = F.col(f"`{value}`")
    cut = (lambda c: truncated(c, places)) if places is not None else (lambda c: c)
    found = {"average": F.avg(x), "least": F.min(x), "most": F.max(x), "std_dev": F.stddev_pop(x)}
    return rows.groupBy(*[F.col(f"`{g}`") for g in group]).agg(F.count(x).alias("n"), *[cut(c).alias(k) for k, c in found.items()])


def io_report(files: DataFrame, size: str = "bytes", seconds: str = "seconds", group: Sequence[str] = ()) -> DataFrame:
    """What a storage benchmark says of its files: files, mb, throughput (MB of all by seconds of all), average_rate and std_dev (population) of the files' own MB a second."""
    mb, took = F.col(f"`{size}`") / 1e6, F.col(f"`{seconds}`")
    rate = mb / took
    return files.groupBy(*[F.col(f"`{g}`") for g in group]).agg(F.count(rate).alias("files"), F.sum(mb).alias("mb"), (F.sum(mb) / F.sum(took)).alias("throughput"), F.avg(rate).alias("average_rate"), F.stddev_pop(rate).alias("std_dev"))


def bad_share(launched: Column, failed: Column, killed: Column) -> Column:
    """Whole per cent of bad tasks against good ones; null where none is good."""
    bad = failed + killed
    return F.when(launched != bad, F.floor(bad * 100 / (launched - bad)).cast("long"))


def classify(fatal: Column, error: Column, warn: Column) -> Column:
    """The worst of what holds."""
    return F.when(fatal, "fatal").when(error, "error").when(warn, "warn").otherwise("success")


def log_snippet(lines: DataFrame, file: str, row: str, mentions: Column, context: int = CONTEXT) -> DataFrame:
    """The lines of each file from its first to its last mention, and ``context`` around them; files without one are left out.

    The bounds are one row for each file, by partial aggregation; lines are never sorted.
    """
    bounds = lines.filter(mentions).groupBy(F.col(f"`{file}`").alias("file")).agg(F.min(F.col(f"`{row}`")).alias("first"), F.max(F.col(f"`{row}`")).alias("last"))
    # The lines' own columns stay apart in a struct, whatever they are called.
    own = lines.select(F.struct("*").alias("line"), F.col(f"`{file}`").alias("own_file"), F.col(f"`{row}`").alias("own_row"))
    inside = (F.col("own_file") == F.col("file")) & F.col("own_row").between(F.col("first") - context, F.col("last") + context)
    return own.join(bounds, inside).select("line.*")
