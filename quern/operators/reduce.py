"""Reduction of groups: built-in aggregates first, Python reducers where those can't say it."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exchange import sorted_partitions

#: Separators of words: space, tab and line ends.
BLANKS = r"[ \t\n\r\f]+"


def reduce_groups(df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """Partial sums in the map tasks (the combiner), one exchange by key, final sums."""
    return df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(*aggregates)


def reduce_stream(df: DataFrame, keys: Sequence[str], step: Callable, start: Callable[[], object], end: Callable, schema: str, n: int | None = None) -> DataFrame:
    """A Python reducer over sorted groups that holds one state, never a group.

    ``start()`` gives a group's state, ``step(state, rows)`` takes some of its rows as a frame and returns the
    next state, ``end(key, state)`` returns the group's output row as a tuple of ``schema``.
    """
    names = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = state = None
        columns = None
        for batch in batches:
            out = []
            for key, rows in batch.groupby(names, sort=False, dropna=False):
                if last is None or key != last:
                    if last is not None:
                        out.append(end(last, state))
                    last, state = key, start()
                state = step(state, rows)
            if out:
                yield pd.DataFrame(out, columns=columns or _columns(schema))
        if last is not None:
            yield pd.DataFrame([end(last, state)], columns=_columns(schema))

    return sorted_partitions(df, keys, n, partitioner="hash").mapInPandas(run, schema)


def _columns(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(",")]


def words(df: DataFrame, text: str = "text", name: str = "word") -> DataFrame:
    """One row per word of each text."""
    return df.select(F.explode(F.filter(F.split(F.col(f"`{text}`"), BLANKS), lambda x: x != "")).alias(name))


def wordcount(df: DataFrame, text: str = "text") -> DataFrame:
    """word, n over all texts."""
    return reduce_groups(words(df, text), ["word"], F.count(F.lit(1)).alias("n"))


def first_success(events: DataFrame, task: str, attempt: str, status: str, succeeded: Sequence[str], order: str | None = None, revoked: Sequence[str] = (), on_revoked: str = "raise") -> DataFrame:
    """One row per task that succeeded: the attempt whose success was reported first (``winner``), and how many reports said so (``successes``).

    Reports come in the order of ``order`` (the attempt's own where that is None). An attempt whose success
    was taken may not be taken back: if one of ``revoked`` is reported for a winner later than its success, the
    query fails, or with ``on_revoked="mark"`` says so in a column ``revoked``. Other attempts may fail freely.
    """
    if on_revoked not in ("raise", "mark"):
        raise ValueError(f"on_revoked {on_revoked!r} is neither 'raise' nor 'mark'")
    at, is_ok = F.col(f"`{order or attempt}`"), F.col(f"`{status}`").isin(*succeeded)
    gone = F.col(f"`{status}`").isin(*revoked) if revoked else F.lit(False)
    by = events.filter(is_ok | gone).groupBy(F.col(f"`{task}`").alias("task"), F.col(f"`{attempt}`").alias("attempt"))
    attempts = by.agg(F.min(F.when(is_ok, at)).alias("ok"), F.max(F.when(gone, at)).alias("gone"), F.count_if(is_ok).alias("n")).filter("ok IS NOT NULL")
    tasks = attempts.groupBy("task").agg(F.min(F.struct("ok", "attempt", "gone")).alias("first"), F.sum("n").alias("successes"))
    late = F.coalesce(F.col("first.gone") > F.col("first.ok"), F.lit(False))
    winner = F.col("first.attempt")
    if on_revoked == "raise" and revoked:
        winner = F.when(late, F.raise_error(F.concat(F.lit("attempt "), winner.cast("string"), F.lit(" was taken back after its success was taken"))).cast(events.schema[attempt].dataType)).otherwise(winner)
    return tasks.select(F.col("task").alias(task), winner.alias("winner"), "successes", *([late.alias("revoked")] if on_revoked == "mark" else []))
