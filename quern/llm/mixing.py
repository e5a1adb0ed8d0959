"""Mixing sources to target weights by pivotal dependent rounding.

A source's target says how many copies of its documents are wanted on average. Whole copies
are taken outright; the fractions are rounded by duels: two sides exchange mass, counted in words
so that the source's expected words never change, until a document's fraction is 0 or 1. In a
bucket a document first meets the block of all smaller ones, which keeps the last open
fraction small, then documents meet one another. Each bucket leaves at most one open fraction,
and a tree of such duels, ``fan_in`` open fractions at a time, leaves one for each source.

Duels are folds over a bucket's array in the JVM, and targets come from passes over the table of
sources, so neither documents nor sources meet in one place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.merge import key_ranks

from .common import WORD, fits, written

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
BUCKET_ROWS = 256
FAN_IN = 64
#: Fractions nearer than this to 0 or 1 are whole.
NEAR = 1e-9
DOC = "struct<k:int,row:string,size:double,p:double>"


def _sizes(doc_id: str, text: str, source: str) -> list[Column]:
    """doc_id, source, size, and n: a number of the row's own that only tells repeated ids apart."""
    size = F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    return [F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), size, F.monotonically_increasing_id().alias("n")]


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def duel(p, a, q, b, u, least=min, pick=lambda yes, x, y: x if yes else y):
    """New fractions of two documents of ``a`` and ``b`` words: one becomes 0 or 1, expectations stay, and so do the words p * a + q * b.

    For numbers, and for columns with their own ``least`` and ``pick``.
    """
    up, down = least((1 - p) * a, q * b), least(p * a, (1 - q) * b)
    gain = pick(u * (up + down) < down, up, -down)
    snap = lambda x: pick(x < NEAR, 0.0, pick(x > 1 - NEAR, 1.0, x))
    return snap(p + gain / a), snap(q - gain / b)


def draw(seed: int, *key: Column) -> Column:
    """A number in [0, 1) that depends on nothing but the key."""
    return F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)


def with_p(doc: Column, p: Column) -> Column:
    return F.struct(doc["k"].alias("k"), doc["row"].alias("row"), doc["size"].alias("size"), p.alias("p"))


def against_rest(docs: Column, seed: int) -> Column:
    """The array of (k, row, size, p) after duels of each document with the block of all smaller ones; all begin with one and the same fraction.

    As a block shares its gain or loss evenly, its fractions stay equal and everyone's expectation stays. A
    document too large for its block stays open.
    """

    def step(s: Column, x: Column) -> Column:
        own, rest, a = s["own"], s["rest"] - x["size"], x["size"]
        fits_in = (rest > 0) & ((1 - own) * a <= own * rest) & (own * a <= (1 - own) * rest)
        p = F.when(~fits_in, own).when(draw(seed, x["row"], F.lit("rest")) < own, 1.0).otherwise(0.0)
        return let(p, lambda p: F.struct(F.when(rest > 0, own + (own - p) * a / rest).otherwise(own).alias("own"), rest.alias("rest"), F.concat(s["out"], F.array(with_p(x, p))).alias("out")))

    start = F.struct(F.element_at(docs, 1)["p"].alias("own"), F.aggregate(docs, F.lit(0).cast("double"), lambda n, x: n + x["size"]).alias("rest"), F.array().cast(f"array<{DOC}>").alias("out"))
    return F.aggregate(docs, start, step, lambda s: s["out"])


def duels(docs: Column, seed: int) -> Column:
    """(k, p) of each document of an array of (k, row, size, p) after duels between neighbours, of which one at most is open."""
    closed = lambda k, p: F.struct(k.alias("k"), p.alias("p"))
    none = F.lit(None).cast(DOC)

    def meet(s: Column, x: Column) -> Column:
        o = s["open"]

        def after(r: Column) -> Column:
            first, second = (r["p"] > 0) & (r["p"] < 1), (r["q"] > 0) & (r["q"] < 1)
            done = F.concat(F.when(~first, F.array(closed(o["k"], r["p"]))).otherwise(F.array()), F.when(~second, F.array(closed(x["k"], r["q"]))).otherwise(F.array()))
            return F.struct(F.when(first, with_p(o, r["p"])).when(second, with_p(x, r["q"])).otherwise(none).alias("open"), F.concat(s["out"], done).alias("out"))

        p, q = duel(o["p"], o["size"], x["p"], x["size"], draw(seed, o["row"], x["row"]), F.least, lambda yes, a, b: F.when(yes, a).otherwise(b))
        return let(F.struct(p.alias("p"), q.alias("q")), after)

    def step(s: Column, x: Column) -> Column:
        whole = (x["p"] <= 0) | (x["p"] >= 1)
        return (
            F.when(whole, F.struct(s["open"].alias("open"), F.concat(s["out"], F.array(closed(x["k"], x["p"]))).alias("out")))
            .when(s["open"].isNull(), F.struct(x.alias("open"), s["out"].alias("out")))
            .otherwise(meet(s, x))
        )

    start = F.struct(none.alias("open"), F.array().cast("array<struct<k:int,p:double>>").alias("out"))
    end = lambda s: F.when(s["open"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(closed(s["open"]["k"], s["open"]["p"]))))
    return F.aggregate(docs, start, step, end)


def rounded(df: DataFrame, level: int, seed: int) -> DataFrame:
    """``df`` (n, row, source, size, p, bucket) with the fractions that the duels of each source's buckets leave."""
    # Larger documents first, so that what stays open is small; a bucket has a bounded number of rows.
    grouped = df.groupBy("source", "bucket").agg(F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("less"), "row", "n", "p"))).alias("docs"))
    now = F.transform("docs", lambda x, i: F.struct(i.alias("k"), x["row"].alias("row"), (-x["less"]).cast("double").alias("size"), x["p"].alias("p")))
    seeds = seed * 64 + level
    if level == 0:
        now = against_rest(now, seeds)
    each = grouped.select("source", "bucket", "docs", F.explode(duels(now, seeds)).alias("x"))
    own = F.get("docs", F.col("x.k"))
    return each.select(own["n"].alias("n"), own["row"].alias("row"), "source", (-own["less"]).alias("size"), F.col("x.p").alias("p"), "bucket")


def water_level(above: Callable[[float], tuple[int, float, float]], total: float) -> float:
    """The level at which all of ``total`` is spent. ``above`` says of a level how many sources are capped below it, what these take, and the weight of the others."""
    level, before = 0.0, None
    while True:
        n, spent, weight = above(level)
        if n == before or not weight:
            return level
        level, before = max(level, (total - spent) / weight), n


def water_fill(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Targets in proportion to weights, none above ``most`` times its size; excess goes to the others by weight."""

    def above(level: float) -> tuple[int, float, float]:
        over = [w * level >= most * s for s, w in zip(sizes, weights, strict=True)]
        return sum(over), sum(most * s for s, x in zip(sizes, over, strict=True) if x), sum(w for w, x in zip(weights, over, strict=True) if not x)

    level = water_level(above, share * sum(sizes))
    return [min(w * level, most * s) for s, w in zip(sizes, weights, strict=True)]


def source_targets(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The table of sources: source, source_size, source_rows, target, as ``water_fill`` has them; weights repeat in code point order, null last.

    Each pass over the table is one sum; only three numbers come to the driver, however many sources there are.
    """
    sums = written(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows")))
    whole, named = sums.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.count("source")).first()
    places = key_ranks(sums.filter(F.col("source").isNotNull()).select("source"), ["source"]).select(F.col("source").alias("name"), (F.col("rank") - 1).alias("place"))
    placed = sums.join(F.broadcast(places) if fits(sums) else places, F.col("source") == F.col("name"), "left").withColumn("place", F.coalesce("place", F.lit(named)))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    table = written(placed.select("source", "source_size", "source_rows", weight.alias("weight")))
    cap = most * F.col("source_size")

    def above(level: float) -> tuple[int, float, float]:
        over = F.col("weight") * level >= cap
        return table.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))).first()

    level = water_level(above, share * whole)
    return table.select("source", "source_size", "source_rows", F.least(F.col("weight") * level, cap).alias("target"))


def copies(rows: DataFrame, targets: DataFrame, bucket_rows: int = BUCKET_ROWS, fan_in: int = FAN_IN, seed: int = 0) -> DataFrame:
    """n, doc_id, size, source, source_size, target, copies of ``rows`` (n, doc_id, source, size): whole numbers whose words come within a document of each source's target.

    Draws depend on ids alone; only rows that repeat one id over and over are told apart by ``n``.
    """
    named = targets.withColumnRenamed("source", "name")
    rated = rows.join(F.broadcast(named) if fits(named) else named, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    rate = F.when((F.col("source_size") > 0) & (F.col("size") > 0), F.col("target") / F.col("source_size")).otherwise(0.0)
    row = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    # Buckets by a hash of the id, as many as the source has rows for: neither a hot source nor the reader's splits matter.
    buckets = F.greatest(F.lit(1), F.ceil(F.col("source_rows") / bucket_rows)).cast("long")
    rated = written(rated.select("n", "doc_id", row.alias("row"), "source", "size", "source_size", "target", F.floor(rate).alias("whole"), (rate - F.floor(rate)).alias("p"), buckets.alias("buckets"), F.pmod(F.xxhash64(row), buckets).alias("bucket")))
    is_open = (F.col("p") > 0) & (F.col("p") < 1)
    open_ = rated.filter(is_open).select("n", "row", "source", "size", "p", "buckets", "bucket")
    # A bucket far above its share has an id that is repeated very often: its rows go to all of their source's buckets.
    held = open_.groupBy(F.col("source").alias("s"), F.col("bucket").alias("b")).count()
    if (held.agg(F.max("count")).first()[0] or 0) > 4 * bucket_rows:
        hot = written(held.filter(F.col("count") > 4 * bucket_rows).select("s", "b"))
        again = open_.join(F.broadcast(hot) if fits(hot) else hot, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")), "left")
        open_ = again.withColumn("bucket", F.when(F.col("b").isNotNull(), F.pmod(F.xxhash64("n"), F.col("buckets"))).otherwise(F.col("bucket"))).drop("s", "b")
    now = written(rounded(open_.drop("buckets"), 0, seed))
    taken, open_, level = now.filter(F.col("p") >= 1).select("n"), now.filter(is_open), 0
    while (top := open_.agg(F.max("bucket")).first()[0]) is not None:
        level += 1
        if top == 0:  # one open fraction for each source
            taken = taken.unionByName(open_.filter(draw(seed, F.col("row")) < F.col("p")).select("n"))
            break
        now = written(rounded(open_.withColumn("bucket", F.floor(F.col("bucket") / fan_in)), level, seed))
        taken, open_ = taken.unionByName(now.filter(F.col("p") >= 1).select("n")), now.filter(is_open)
    more = taken.select("n", F.lit(1).alias("more"))
    return rated.join(more, "n", "left").select("n", "doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.coalesce("more", F.lit(0))).cast("long").alias("copies"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, bucket_rows: int = BUCKET_ROWS, fan_in: int = FAN_IN, seed: int = 0) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken (words taken, repeats counted), copies, source.

    A null text has size 0, a null source is a source of its own, and documents without words are taken 0
    times. Repeated rows are rounded each for itself. The draws depend on ids only, so runs agree. Other
    columns are ignored, and an empty table gives no rows.
    """
    rows = written(docs.select(*_sizes(doc_id, text, source)))
    found = copies(rows, source_targets(rows, weights, share, most), bucket_rows, fan_in, seed)
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source")


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, bucket_rows: int = BUCKET_ROWS, fan_in: int = FAN_IN, seed: int = 0) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with its own columns.

    Cases as for ``mix``: null and empty texts are not taken, and an empty table stays empty.
    """
    # Written, as a row's number must be the same wherever it is read again.
    own = written(docs.select(F.struct("*").alias("row"), *_sizes(doc_id, text, source)))
    rows = own.drop("row")
    found = copies(rows, source_targets(rows, weights, share, most), bucket_rows, fan_in, seed)
    taken = written(found.filter("copies > 0").select(F.col("n").alias("taken"), "copies"))
    joined = own.join(F.broadcast(taken) if fits(taken) else taken, F.col("n") == F.col("taken"))
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
