"""Validators: an exchange lost nothing, and left its output in order."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordering import sort_terms

_LEAST = {"string": "", "binary": b"", "boolean": False}


def _terms(df: DataFrame, keys: Sequence[str], mode: str) -> list[Column]:
    """The sort terms without nulls: whether there is a value, then the value or a fixed one."""
    out = []
    for i, term in enumerate(sort_terms(df, keys, mode)):
        kind = df.select(term.alias("x")).schema["x"].dataType
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            term, kind = F.unix_micros(term.cast("timestamp")), T.LongType()
        elif isinstance(kind, T.DateType):
            term, kind = F.unix_date(term), T.IntegerType()
        none = F.lit(_LEAST.get(kind.simpleString(), 0)).cast(kind)
        out += [term.isNotNull().alias(f"h{i}"), F.coalesce(term, none).alias(f"t{i}")]
    return out


def partition_summary(df: DataFrame, keys: Sequence[str], mode: str = "signed", label: Column | None = None) -> DataFrame:
    """One row for each partition that has rows: part, rows, violations, first and last key.

    A pass over ``df`` as it lies, without a shuffle: the tasks compare neighbouring keys, a batch at a time.
    ``label`` names what counts as a partition (default: Spark's partition number).
    """
    label = F.spark_partition_id() if label is None else label
    terms = df.select(*_terms(df, keys, mode), label.alias("part"))
    names = terms.columns[:-1]
    kinds = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in terms.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None

        def out(schema: pa.Schema) -> pa.RecordBatch:
            key = pa.struct([schema.field(n) for n in names])
            fields = [("part", schema.field("part").type), ("rows", pa.int64()), ("violations", pa.int64()), ("first", key), ("last", key)]
            return pa.RecordBatch.from_pylist([held], pa.schema(fields))

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = [batch.column(name) for name in names]
            key_at = lambda i: {name: c[i].as_py() for name, c in zip(names, columns, strict=True)}  # noqa: B023, E731
            parts = batch.column("part")
            less, same = np.zeros(n - 1, dtype=bool), np.ones(n - 1, dtype=bool)
            for c in columns:
                a, b = c.slice(0, n - 1), c.slice(1)
                less |= same & pc.less(b, a).to_numpy(zero_copy_only=False)
                same &= pc.equal(b, a).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(pc.not_equal(parts.slice(1), parts.slice(0, n - 1)).to_numpy(zero_copy_only=False)) + 1), n]
            for a, b in zip(edges, edges[1:], strict=False):
                a, b = int(a), int(b)
                first, part = key_at(a), parts[a].as_py()
                if held is None or part != held["part"]:
                    if held is not None:
                        yield out(batch.schema)
                    held = {"part": part, "rows": 0, "violations": 0, "first": first, "last": None}
                elif tuple(first.values()) < tuple(held["last"].values()):
                    held["violations"] += 1
                held["rows"] += b - a
                held["violations"] += int(less[a : b - 1].sum())
                held["last"] = key_at(b - 1)
            schema = batch.schema
        if held is not None:
            yield out(schema)

    return terms.mapInArrow(run, f"part {terms.schema['part'].dataType.simpleString()}, rows long, violations long, first struct<{kinds}>, last struct<{kinds}>")


def validate_sorted(df: DataFrame, keys: Sequence[str], mode: str = "signed", label: Column | None = None) -> DataFrame:
    """One row: partitions, rows, violations inside partitions, overlaps between neighbours, ok."""
    parts = partition_summary(df, keys, mode, label)
    before = F.lag("last").over(Window.orderBy("part"))  # a row for each partition
    return parts.withColumn("overlap", F.coalesce(before > F.col("first"), F.lit(False))).agg(
        F.count(F.lit(1)).alias("partitions"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("violations"), F.lit(0)).alias("violations"), F.count_if("overlap").alias("overlaps")
    ).withColumn("ok", (F.col("violations") == 0) & (F.col("overlaps") == 0))


def validate_files(spark: SparkSession, path: str, keys: Sequence[str], mode: str = "signed") -> DataFrame:
    """``validate_sorted`` for a written table: its part files in the order of their names, their splits by place."""
    where = F.concat_ws(":", F.col("_metadata.file_name"), F.lpad(F.col("_metadata.file_block_start").cast("string"), 20, "0"))
    own = [f"k{i}" for i in range(len(keys))]
    df = spark.read.parquet(path).select(*[F.col(f"`{k}`").alias(c) for k, c in zip(keys, own, strict=True)], where.alias("place"))
    return validate_sorted(df, own, mode, F.col("place"))


def multiset_difference(a: DataFrame, b: DataFrame, surplus: str = "surplus") -> DataFrame:
    """Rows that ``a`` has more often (positive ``surplus``) or less often (negative); none: equal multisets.

    One exchange with sums on the map side instead of a set difference either way. ``surplus`` names the result,
    which may be no column of the tables.
    """
    if surplus in a.columns:
        raise ValueError(f"a column {surplus!r} has the name of the result; give another")
    side = lambda df, n: df.select(F.struct(*[F.col(f"`{c}`") for c in a.columns]).alias("row"), F.lit(n).cast("long").alias("n"))
    both = side(a, 1).unionByName(side(b, -1))
    found = both.groupBy("row").agg(F.sum("n").alias("n")).filter("n != 0")
    return found.select(*[F.col("row").getField(c).alias(c) for c in a.columns], F.col("n").alias(surplus))


def checksum(df: DataFrame) -> DataFrame:
    """One row that is equal for equal multisets whatever their order: rows, sum and xor of row hashes."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias("hash_sum"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("hash_xor"))


def byte_totals(df: DataFrame, *columns: str) -> DataFrame:
    """One row: rows, bytes (UTF-8 for text) of the columns."""
    each = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)).cast("long") for c in columns]
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(sum(each[1:], each[0])), F.lit(0)).alias("bytes"))
