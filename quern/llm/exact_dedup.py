"""Exact deduplication by skew-safe combining.

Texts are equal when identical after each run of white space became one space. Copies are
combined in three steps, each of which compares whole texts and not only digests: inside
every map task, then among the salts of a digest, then among the winners of those salts.
Only digests with more than ``salt_rows`` copies get salts, as many as keep each salted
group at ``salt_rows`` rows or so, so no task ever holds more of one text's rows than that:
what the salts' winners have found goes back to each salt by a row of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, fits, written

#: Rows of one digest that a single group may hold.
SALT_ROWS = 20_000


def normalised(text: str = "text"):
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " ")


def _salted(docs: DataFrame, doc_id: str, text: str, salt_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of digests with few copies, and those of hot digests with a salt each (None: there are none)."""
    own = docs.select(F.struct("*").alias("row"), F.col(f"`{doc_id}`").alias("doc_id"), normalised(f"`{text}`").alias("text"))
    rows = own.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    hot = written(rows.groupBy("digest").count().filter(F.col("count") > salt_rows).select("digest", F.ceil(F.col("count") / salt_rows).cast("int").alias("salts")))
    if not hot.limit(1).count():
        return rows, None
    side = F.broadcast(hot) if fits(hot) else hot
    # Salts by the row's number, as repeated rows share their id.
    salt = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.col("salts")).cast("int")
    return rows.join(side, "digest", "left_anti"), rows.join(side, "digest").withColumn("salt", salt)


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salt_rows: int = SALT_ROWS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty. Of equal texts the row with the smallest doc_id stays; a null id
    stays only where all ids of the group are null. If several rows share the smallest id (repeated
    rows), one of them is kept. An empty table gives an empty result; other columns are ignored.
    """
    cold, hot = _salted(docs, doc_id, text, salt_rows)

    def combined(rows: DataFrame, *keys: str) -> DataFrame:
        # The text is part of the key: map tasks combine copies before the exchange, and unequal texts never meet.
        return rows.groupBy("digest", *keys, "text").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"), F.collect_list(F.struct("doc_id")).alias("ids"))

    def spread(found: DataFrame, mine: Column) -> DataFrame:
        own = F.array_position(F.transform("ids", lambda x: F.coalesce(x["doc_id"] == F.col("keep_id"), F.col("keep_id").isNull())), True)
        rows = found.select("digest", "keep_id", "n", F.when(mine, own).alias("own"), F.posexplode("ids").alias("pos", "id"))
        return rows.select(F.col("id.doc_id").alias("doc_id"), "keep_id", F.col("n").alias("group_size"), F.coalesce(F.col("pos") + 1 == F.col("own"), F.lit(False)).alias("kept"), F.col("digest").alias("text_sha256"))

    found = spread(combined(cold), F.lit(True))
    if hot is None:
        return found
    parts = written(combined(hot, "salts", "salt"))
    first = F.min(F.struct(F.col("keep_id").isNull().alias("none"), "keep_id", "salt")).alias("first")
    won = parts.groupBy("digest", "salts", "text").agg(first, F.sum("n").alias("n"))
    # A row for each salt, so that the salts of a text stay apart.
    won = won.select("digest", "text", F.col("first.keep_id").alias("keep_id"), F.col("first.salt").alias("winner"), "n", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return found.unionByName(spread(parts.select("digest", "salt", "text", "ids").join(won, ["digest", "salt", "text"]), F.col("salt") == F.col("winner")))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salt_rows: int = SALT_ROWS) -> DataFrame:
    """The rows that ``exact_dedup`` keeps, with all their columns; repeated rows become one.

    A null text counts as empty, so of null and empty texts one row stays; an empty table stays empty.
    """
    cold, hot = _salted(docs, doc_id, text, salt_rows)
    # Ids first: the smallest id stays, and a null id only where there is no other.
    least = F.min_by("row", F.struct(F.col("doc_id").isNull(), F.col("doc_id"))).alias("row")
    found = cold.groupBy("digest", "text").agg(least)
    if hot is not None:
        parts = hot.groupBy("digest", "salt", "text").agg(least).withColumn("doc_id", F.col(f"row.`{doc_id}`"))
        found = found.unionByName(parts.groupBy("digest", "text").agg(least))
    return found.select("row.*")
