"""Generated tables. Every value follows from the row number alone, so parts can be made again anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one unit of the sort workload has.
ROWS_PER_UNIT = 10_000_000
KEY_BYTES, VALUE_BYTES = 10, 90
VOCABULARY = "apple river stone cloud paper garden window silver yellow forest candle bridge market winter summer needle basket copper velvet harbor lantern meadow pepper rocket saddle timber tunnel violin walnut zephyr anchor butter".split()


def digest(x: Column, salt: str) -> Column:
    """32 hex digits that look random and depend on the number and the salt only."""
    return F.md5(F.concat(F.lit(f"{salt}:"), x.cast("string")).cast("binary"))


def sort_records(spark: SparkSession, rows: int, partitions: int | None = None) -> DataFrame:
    """row_id, key (10 random bytes), value (90 bytes): the input of the sort benchmark."""
    ids = spark.range(0, rows, 1, partitions) if partitions else spark.range(rows)
    value = F.rpad(F.concat(F.lpad(F.col("id").cast("string"), 20, "0"), digest(F.col("id"), "v"), digest(F.col("id"), "w")), VALUE_BYTES, "x")
    return ids.select(F.col("id").alias("row_id"), F.unhex(F.substring(digest(F.col("id"), "k"), 1, 2 * KEY_BYTES)).alias("key"), value.cast("binary").alias("value"))


def random_records(spark: SparkSession, rows: int, key_bytes: tuple[int, int] = (5, 10), value_bytes: tuple[int, int] = (20, 60)) -> DataFrame:
    """row_id, key, value: random bytes of random lengths between the bounds, both inclusive."""
    i = F.col("id")

    def cut(bounds: tuple[int, int], salt: str) -> Column:
        least, most = bounds
        n = F.lit(least) + F.pmod(F.conv(F.substring(digest(i, f"n{salt}"), 1, 8), 16, 10).cast("long"), F.lit(most - least + 1))
        whole = F.concat(*[digest(i, f"{salt}{k}") for k in range(-(-most // 16))])
        return F.unhex(F.substring(whole, F.lit(1), (2 * n).cast("int")))

    return spark.range(rows).select(i.alias("row_id"), cut(key_bytes, "a").alias("key"), cut(value_bytes, "b").alias("value"))


def random_text(spark: SparkSession, rows: int, words: tuple[int, int] = (5, 25), vocabulary: list[str] = VOCABULARY) -> DataFrame:
    """row_id, text: words drawn from the vocabulary, as many as a draw between the bounds says."""
    of = lambda x, salt, n: F.pmod(F.conv(F.substring(digest(x, salt), 1, 8), 16, 10).cast("long"), F.lit(n))
    n = (F.lit(words[0]) + of(F.col("id"), "words", words[1] - words[0] + 1)).cast("long")
    known = F.array(*[F.lit(w) for w in vocabulary])
    drawn = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda k: F.element_at(known, (of(F.col("id") * 1000 + k, "word", len(vocabulary)) + 1).cast("int")))
    return spark.range(rows).select(F.col("id").alias("row_id"), F.array_join(drawn, " ").alias("text"))
