"""Connected components of a link table by forests, and by alternating stars (large star, small star) where these are large.

First each task reduces its links, in pieces, to a forest: one link for each node but one of a tree. If what is left
is small, one task joins it; its bytes are counted beforehand, so that neither its time nor its memory grow with
the input. Otherwise rounds of two aggregations and two joins on node ids follow: links are never gathered in one place,
a node with very many links is spread over tasks, and every round's table is written, so the plan stays short and
lost executors cost one round at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fits, hubs, mapped, spread_join, written

#: Most bytes of links, after the tasks' own forests, that one task joins; and links that become a forest at once.
ALONE_BYTES, PIECE = 32 << 20, 1 << 15


class Union:
    """Which members are linked, by their places in a block."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _roots(u: pd.Series, v: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links in the order in which they first appear, ``v``'s before ``u``'s, and the place of each one's root: its tree's first."""
    codes, nodes = pd.factorize(pd.concat([v, u], ignore_index=True), use_na_sentinel=False)
    known = Union(len(nodes))
    for i, j in zip(codes[: len(v)].tolist(), codes[len(v) :].tolist(), strict=True):
        known.join(i, j)
    return np.asarray(nodes), np.array([known.root(i) for i in range(len(nodes))], dtype=np.int64)


def _forests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links (u, v) that connect what those of the batches connect; about PIECE of them are held at once."""
    kept: list[pd.DataFrame] = []
    n = 0

    def forest() -> pd.DataFrame:
        rows = pd.concat(kept, ignore_index=True)
        nodes, roots = _roots(rows["u"], rows["v"])
        other = np.flatnonzero(roots != np.arange(len(roots)))
        return pd.DataFrame({"u": nodes[other], "v": nodes[roots[other]]})

    for batch in batches:
        kept.append(batch)
        n += len(batch)
        if n >= PIECE:
            kept = [forest()]
            n = len(kept[0])
            if n >= PIECE // 2:
                yield kept.pop()
                n = 0
    if n:
        yield forest()


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """id, component of all links (u, v < u) at once, sorted by ``v``: a component's least node is a ``v``, and the first of its nodes."""
    rows = list(batches)
    if sum(map(len, rows)):
        rows = pd.concat(rows, ignore_index=True)
        nodes, roots = _roots(rows["u"], rows["v"])
        for a in range(0, len(nodes), PIECE):
            yield pd.DataFrame({"id": nodes[a : a + PIECE], "component": nodes[roots[a : a + PIECE]]})


def components(edges: DataFrame, a: str = "a", b: str = "b", alone: int = ALONE_BYTES) -> DataFrame:
    """One row per node that has a link to another: id, component (the smallest id reachable).

    Links may be repeated and come in either direction; links to oneself and those with a null end are ignored.
    """
    one, two = F.col(a), F.col(b)
    links = edges.select(F.greatest(one, two).alias("u"), F.least(one, two).alias("v")).filter(one.isNotNull() & two.isNotNull() & (one != two))
    kind = links.schema["u"].dataType.simpleString()
    now = written(mapped(links, _forests, f"u {kind}, v {kind}").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    small = fits(now, alone)
    if not small:  # tasks may have had the same links
        now = written(now.distinct())
        small = fits(now, alone)
    if small:
        return written(mapped(now.repartition(1).sortWithinPartitions("v"), _joined, f"id {kind}, component {kind}"))
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
        if not least.filter("m < u AND n > 1").limit(1).count():  # all are stars: who has a smaller neighbour has no other
            break
        hot = hubs(least, ["u"])
        stars = lambda rows, least: spread_join(rows, least, ["u"], hot, "v")  # noqa: B023, E731
        large = stars(both, least.select("u", F.least("u", "m").alias("m"))).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # No node has more links now than before, so the same nodes are spread.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = stars(large, least).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
