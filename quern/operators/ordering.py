"""Key orderings as sort expressions.

Text sorts by its UTF-8 bytes, binary by unsigned bytes with a prefix first, booleans false first:
Spark's own orders. Integers have two orders: signed, and that of their big-endian two's complement
bytes, in which negative numbers follow all others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
MODES = ("signed", "bytes")


def sort_terms(df: DataFrame, keys: Sequence[str], mode: str = "signed") -> list[Column]:
    """The ascending terms whose order is that of ``keys``; nulls first."""
    if mode not in MODES:
        raise ValueError(f"key order {mode!r} is not one of {MODES}")
    out: list[Column] = []
    for key in keys:
        kind = df.schema[key].dataType
        if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            raise TypeError(f"{key}: a {kind.simpleString()} is no sort key")
        if mode == "bytes" and isinstance(kind, INTEGERS):
            out.append(F.col(f"`{key}`") < 0)
        out.append(F.col(f"`{key}`"))
    return out


def order_exprs(df: DataFrame, keys: Sequence[str], mode: str = "signed", desc: bool = False) -> list[Column]:
    """``keys`` as sort orders for ``orderBy``, ``sortWithinPartitions``, windows and range exchanges."""
    return [t.desc() if desc else t.asc() for t in sort_terms(df, keys, mode)]
