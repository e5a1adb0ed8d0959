"""Pieces that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.sources.batches import BATCH_BYTES, bounded, mapped  # noqa: F401
from quern.sources.shared import shared_dir, written  # noqa: F401

#: White space of every contract here, as a Java and RE2 character class.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def fold(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


#: Most bytes of values that a side may hold to be broadcast.
BROADCAST_BYTES = 64 << 20


def fits(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether the values of a table, counted in bytes, are few enough to broadcast it."""
    each = F.lit(16)
    for field in df.schema.fields:
        own = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            each += F.coalesce(F.octet_length(own), F.lit(0)) + 16
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            each += F.coalesce(F.octet_length(F.to_json(F.struct(own))), F.lit(0)) + 16
        else:
            each += 8
    return (df.agg(F.sum(each.cast("long"))).first()[0] or 0) <= most


#: Rows of one key from which on a join spreads them, and the most keys that can have so many.
HUB_ROWS, HUBS = 256, 100_000


def hubs(found: DataFrame, keys: list[str], n: str = "n") -> DataFrame | None:
    """The keys of ``found`` (a row for each) that have very many rows by its column ``n``, with the salts they need; None: there are none.

    As no key counts that has less than 1 / HUBS of all rows, there are never more than HUBS of them.
    """
    total, most = found.agg(F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.max(n), F.lit(0))).first()
    limit = max(HUB_ROWS, total // HUBS)
    if most <= limit:
        return None
    return written(found.filter(F.col(n) > limit).select(*keys, F.ceil(F.col(n) / limit).cast("int").alias("salts")))


def spread_join(rows: DataFrame, found: DataFrame, keys: list[str], hot: DataFrame | None, by: str, how: str = "inner") -> DataFrame:
    """``rows`` with what ``found`` has for their keys; rows of a hot key meet a copy of its row in each of as many tasks as it has salts.

    ``by`` is a column of ``rows`` that spreads them.
    """
    if hot is None:
        return rows.join(found, keys, how)
    salts = F.coalesce("salts", F.lit(1))
    rows = rows.join(F.broadcast(hot), keys, "left").withColumn("salt", F.pmod(F.xxhash64(by), salts).cast("int")).drop("salts")
    found = found.join(F.broadcast(hot), keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return rows.join(found, [*keys, "salt"], how).drop("salt")


def groups(batches: Iterator[pd.DataFrame], keys: list[str], most: int | None = None) -> Iterator[pd.DataFrame]:
    """The runs of equal keys in a partition that is sorted by them, cut into pieces of ``most`` rows; only one piece is held."""
    kept: list[pd.DataFrame] = []
    last, n = None, 0

    def out() -> pd.DataFrame:
        return pd.concat(kept, ignore_index=True) if len(kept) > 1 else kept[0]

    for batch in batches:
        if not len(batch):
            continue
        values = batch[keys]
        starts = [0, *((values != values.shift()).any(axis=1).to_numpy().nonzero()[0][1:]), len(batch)]
        for a, b in zip(starts, starts[1:], strict=False):
            key = tuple(values.iloc[a])
            while a < b:
                if kept and (key != last or n == most):
                    yield out()
                    kept, n = [], 0
                part = batch.iloc[a : b if most is None else min(b, a + most - n)]
                kept.append(part)
                last, n, a = key, n + len(part), a + len(part)
    if kept:
        yield out()
