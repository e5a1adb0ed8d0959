"""Near-duplicate embeddings by PCA-ordered, tiled comparison.

Vectors with equal labels are dealt into blocks in the order of their first principal coordinate, and two
blocks of a label are a tile. A block keeps the ranges of its leading coordinates and its largest suffix
norm: a tile whose products cannot reach the threshold within these is never made. In a
tile, unit vectors are turned so that the leading dimensions carry most of their products: products
are summed over leading dimensions first, what is left is at most the product of the suffixes'
norms, and a pair is dropped as soon as both together cannot reach the threshold. The turn is
orthonormal, so a bounded sample fits it without any effect on the result; pairs that come to the end
are decided by the cosine of the vectors as they are, in double precision.

Copies of a vector are one class with a weight; tiles return links that connect and sums of
weights, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fits, groups, hubs, spread_join, written
from .components import components
from .near_dedup import Union

THRESHOLD = 0.93
BLOCK = 512
#: Vectors, chosen by a hash, that the turn is fitted on.
SAMPLE = 10_000
#: Dimensions summed before each test.
LEADING = (8, 16, 32, 64, 128, 256, 512)
#: Rows of a tile compared at once.
CHUNK = 128
SLACK = 1e-9
#: The same for whole tiles, whose bound goes by angles.
TILE_SLACK = 1e-6


def turn(sample: np.ndarray) -> np.ndarray:
    """Principal directions of unit vectors about the origin, in falling order of their share in the products."""
    values, vectors = np.linalg.eigh(sample.T @ sample)
    return vectors[:, np.argsort(-values, kind="stable")]


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; rows are scaled so that no product overflows."""
    scaled = lambda x: x / np.abs(x).max(axis=1, keepdims=True) if np.abs(x).max(initial=0) > 1e100 or np.abs(x).max(axis=1).min(initial=1) < 1e-100 else x
    a, b = scaled(a), scaled(b)
    return np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


class Block:
    """Vectors as they are and turned, with their suffixes' norms after each number of leading dimensions."""

    def __init__(self, vectors: np.ndarray, axes: np.ndarray):
        self.vectors = vectors
        self.turned = unit(vectors) @ axes
        d = vectors.shape[1]
        self.cuts = [k for k in LEADING if k < d]
        self.suffix = [np.sqrt(np.maximum(0, np.square(self.turned[:, k:]).sum(axis=1))) for k in self.cuts]


def similar(a: Block, b: Block, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of all pairs that reach the threshold, some at a time; same: the blocks are one, and i < j."""
    cuts = a.cuts
    for at in range(0, len(a.vectors), CHUNK):
        rows = slice(at, at + CHUNK)
        k = cuts[0] if cuts else a.vectors.shape[1]
        part = a.turned[rows, :k] @ b.turned[:, :k].T
        bound = part + (np.outer(a.suffix[0][rows], b.suffix[0]) if cuts else 0)
        i, j = np.nonzero(bound >= threshold - SLACK)
        part = part[i, j]
        i = i + at
        if same:
            ok = i < j
            i, j, part = i[ok], j[ok], part[ok]
        for n, k in enumerate(cuts[1:], 1):
            part = part + np.einsum("ij,ij->i", a.turned[i, cuts[n - 1] : k], b.turned[j, cuts[n - 1] : k])
            ok = part + a.suffix[n][i] * b.suffix[n][j] >= threshold - SLACK
            i, j, part = i[ok], j[ok], part[ok]
        ok = cosines(a.vectors[i], b.vectors[j]) >= threshold
        yield i[ok], j[ok]


def usable(vector: str, label: str):
    """Neither null nor zero, and nothing in it null or not finite."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.col(label).isNotNull() & F.col(vector).isNotNull() & ~F.exists(vector, odd) & F.exists(vector, lambda x: x != 0)


def tiles_of(blocks: DataFrame, threshold: float) -> DataFrame:
    """x, y (x <= y): the pairs of blocks of one label whose vectors may reach the threshold.

    Two unit vectors are no nearer than their first coordinates' angles are, and their product is at most what
    the ranges of the leading coordinates and the suffix norms allow.
    """
    own = blocks.select("label", "d", "block", F.zip_with("low", "high", lambda a, b: F.struct(a.alias("low"), b.alias("high"))).alias("box"), "tail")
    x = own.select("label", "d", F.col("block").alias("x"), F.col("box").alias("box_x"), F.col("tail").alias("tail_x"))
    y = own.select("label", "d", F.col("block").alias("y"), F.col("box").alias("box_y"), F.col("tail").alias("tail_y"))
    angle = lambda c: F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), c)))
    a, b = F.get("box_x", F.lit(0)), F.get("box_y", F.lit(0))
    apart = F.greatest(angle(a["high"]) - angle(b["low"]), angle(b["high"]) - angle(a["low"]), F.lit(0.0))
    each = F.zip_with("box_x", "box_y", lambda p, q: F.greatest(p["low"] * q["low"], p["low"] * q["high"], p["high"] * q["low"], p["high"] * q["high"]))
    most = F.aggregate(each, F.col("tail_x") * F.col("tail_y"), lambda s, v: s + v)
    # A few numbers for each block of vectors.
    met = x.join(F.broadcast(y) if fits(y) else y, ["label", "d"]).filter(F.col("x") <= F.col("y"))
    return met.filter((F.cos(apart) >= threshold - TILE_SLACK) & (most >= threshold - TILE_SLACK)).select("x", "y")


def near_embeddings(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors are compared if their labels are equal and not null, and their lengths are equal. Null and zero
    vectors, and those that hold null or non-finite components, link with nothing; so do rows without an id, whose
    component is null and which are kept. Repeated rows are links of each other and share one result. An
    empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{embedding}`").alias("embedding"), F.col(f"`{label}`").alias("label"))
    kind, label_kind = rows.schema["vec_id"].dataType.simpleString(), rows.schema["label"].dataType.simpleString()
    single = rows.schema["embedding"].dataType.elementType.simpleString() == "float"
    some = rows.filter(usable("embedding", "label") & F.col("vec_id").isNotNull())
    classes = written(some.groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n")))
    axes = {}
    chosen = classes.select("embedding").orderBy(F.xxhash64("embedding")).limit(sample).toArrow().to_pandas()  # ``sample`` vectors at most
    if len(chosen):
        for d, own in chosen["embedding"].groupby(chosen["embedding"].map(len)):
            axes[int(d)] = turn(unit(np.stack(own.to_numpy()).astype(np.float64)))
    shared = spark.sparkContext.broadcast(axes)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed_as = np.dtype("<f4" if single else "<f8")

    def turned_first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            first = np.zeros(len(batch))
            for d, places in batch.groupby("d", sort=False).indices.items():
                own = unit(np.stack(batch["embedding"].to_numpy()[places]).astype(np.float64))
                first[places] = own @ shared.value[d][:, 0] if d in shared.value else own[:, 0]
            yield batch.assign(first=first)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in groups(batches, ["label", "d"], block):
            own, d = part.iloc[:1][["label", "d"]], int(part["d"].iloc[0])
            vectors = np.stack(part["embedding"].to_numpy()).astype(packed_as)
            turned = unit(vectors.astype(np.float64)) @ shared.value.get(d, np.eye(d))
            lead = turned[:, : LEADING[0]]
            tail = float(np.sqrt(np.square(turned[:, LEADING[0] :]).sum(axis=1)).max())
            yield own.assign(ids=[part["id"].to_numpy()], weights=[part["n"].to_numpy()], packed=[vectors.tobytes()], low=[lead.min(axis=0)], high=[lead.max(axis=0)], tail=tail)

    first = classes.withColumn("d", F.size("embedding")).select("label", "d", "id", "n", "embedding")
    first = first.mapInPandas(turned_first, f"label {label_kind}, d int, id {kind}, n long, embedding {rows.schema['embedding'].dataType.simpleString()}, first double")
    # One range exchange: a large label's rows fill many ranges, and blocks are cut from each range as it comes.
    ordered = written(first).repartitionByRange(n, "label", "d", "first").sortWithinPartitions("label", "d", "first").drop("first")
    made = ordered.mapInPandas(pack, f"label {label_kind}, d int, ids array<{kind}>, weights array<long>, packed binary, low array<double>, high array<double>, tail double")
    blocks = written(made.withColumn("block", F.monotonically_increasing_id()))
    pairs = written(tiles_of(blocks, threshold))
    side = blocks.select("block", "d", "ids", "weights", "packed")
    tiles = pairs.join(side, F.col("x") == F.col("block")).unionByName(pairs.filter("x != y").join(side, F.col("y") == F.col("block")))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        axes = shared.value
        for tile in groups(batches, ["x", "y"]):
            d = int(tile["d"].iloc[0])
            turned = axes.get(d)
            if turned is None:
                turned = np.eye(d)
            tile = tile.sort_values("block")
            own = [Block(np.frombuffer(p, packed_as).reshape(-1, d).astype(np.float64), turned) for p in tile["packed"]]
            a, b, same = own[0], own[-1], len(own) == 1
            ids = np.concatenate([np.asarray(x) for x in tile["ids"]])
            weights = [np.asarray(x, dtype=np.int64) for x in tile["weights"]]
            first, last = len(weights[0]), 0 if same else len(weights[0])
            links, known, a_out, b_out = np.zeros(len(ids), np.int64), Union(len(ids)), [], []
            for i, j in similar(a, b, threshold, same):
                np.add.at(links, i, weights[-1][j])
                np.add.at(links, j + last, weights[0][i])
                for p, q in zip(i.tolist(), (j + last).tolist(), strict=True):
                    if known.join(p, q):
                        a_out.append(ids[p])
                        b_out.append(ids[q])
            at = np.flatnonzero(links)
            if len(at):
                yield pd.DataFrame({"a": ids[at], "b": [None] * len(at), "links": links[at]}).astype({"b": "object"})
                yield pd.DataFrame({"a": a_out, "b": b_out, "links": 0})

    dealt = tiles.repartition(n, "x", "y").sortWithinPartitions("x", "y")
    found = written(dealt.mapInPandas(compare, f"a {kind}, b {kind}, links long"))
    parts = components(found.filter(F.col("b").isNotNull()))
    links = found.filter(F.col("b").isNull()).groupBy(F.col("a").alias("linked")).agg(F.sum("links").alias("links"))
    result = classes.join(links, classes["id"] == links["linked"], "left").drop("linked").join(parts, "id", "left")
    result = result.select(
        F.col("label").alias("l"), F.xxhash64("embedding").alias("digest"), F.col("embedding").alias("e"), F.coalesce("component", "id").alias("component"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "n"
    )
    result = written(result)
    # Back to the rows, of which copies of one vector are spread over tasks; equal digests are not taken for equal vectors.
    fit = F.coalesce(usable("embedding", "label") & F.col("vec_id").isNotNull(), F.lit(False))
    asked = rows.filter(fit).select("vec_id", F.col("label").alias("l"), F.xxhash64("embedding").alias("digest"), "embedding")
    joined = spread_join(asked, result.drop("n"), ["l", "digest"], hubs(result, ["l", "digest"]), "vec_id").filter(F.col("embedding") == F.col("e"))
    found = joined.select("vec_id", F.col("n_links").cast("long").alias("n_links"), F.col("component").alias("component_id"))
    others = rows.filter(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(others).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
