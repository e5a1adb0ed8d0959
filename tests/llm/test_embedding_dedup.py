import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm.embedding_dedup import Block, near_embeddings, similar, turn, unit

from .helpers import EXTRA, components


def brute(data, threshold=0.93):
    ok = [(i, np.array(v, dtype=np.float64), label) for i, v, label in data if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = []
    for k, (i, a, x) in enumerate(ok):
        for j, b, y in ok[:k]:
            if x == y and len(a) == len(b) and i != j:
                s, t = a / np.abs(a).max(), b / np.abs(b).max()
                if s @ t / np.sqrt((s @ s) * (t @ t)) >= threshold:
                    links.append((i, j))
    part = components([i for i, *_ in data if i is not None], links)
    n = {i: 0 for i in part}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return {i: (n[i], part[i], part[i] == i) for i in part}


def vectors(rng, n=260, d=24):
    centres = rng.normal(size=(9, d))
    out = [(i, (centres[i % 9] + rng.normal(scale=(0.05, 0.3, 1.0)[i % 3], size=d)).astype(np.float32).tolist(), i % 4) for i in range(n)]
    out += [(1000 + i, out[0][1], 0) for i in range(20)] + [(2000, [1e30] * d, 1), (2001, [2e30] * d, 1), (2002, [1e-30] * d, 1)]
    odd = [None, [0.0] * d, [], [None] + [1.0] * (d - 1), [float("nan")] * d, [float("inf")] + [1.0] * (d - 1), [1.0] * (d + 3), [2.0] * (d + 3)]
    return out + [(3000 + i, v, 2) for i, v in enumerate(odd)] + [(4000, out[0][1], None)]


@pytest.mark.parametrize("block", [16, 512])
def test_against_brute_force(spark, block):
    data = vectors(np.random.default_rng(3))
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").repartition(5).withColumns({c: F.lit(v) for c, v in EXTRA.items() if c != "label"})
    data = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], y) for i, v, y in data]
    found = near_embeddings(df, block=block, sample=50).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found} == brute(data)
    assert len(found) == len(data)


def test_rows_without_id_and_repeated_rows(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (2, [0.0, 1.0], 1)]
    found = near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id or 0, r.component_id or 0, r.kept) for r in found) == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 2, True)]
    assert near_embeddings(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_the_bound_drops_no_pair():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 70)) + 2 * rng.normal(size=(6, 70))[np.arange(300) % 6]
    axes = turn(unit(x[:40]))
    assert np.allclose(axes.T @ axes, np.eye(70))
    a, b = Block(x[:150], axes), Block(x[150:], axes)
    found = {(int(i), int(j)) for p, q in similar(a, b, 0.8, False) for i, j in zip(p, q, strict=True)}
    assert found == {(int(i), int(j)) for i, j in zip(*np.nonzero(unit(x[:150]) @ unit(x[150:]).T >= 0.8), strict=True)} and found


def test_query_on_test_table(spark):
    from quern.llm.queries import op6_embedding_near_dedup

    sf = "/root/testdata/sf0.001"
    data = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in op6_embedding_near_dedup(spark, sf).collect()} == brute(data)


def test_tiles_that_cannot_reach_the_threshold_are_never_made(spark):
    from quern.llm.embedding_dedup import tiles_of

    rows = [("a", 2, k, [low, 0.0], [high, 0.1], tail) for k, (low, high, tail) in enumerate([(0.95, 1.0, 0.2), (0.9, 0.94, 0.3), (-1.0, -0.9, 0.1), (0.1, 0.3, 0.99), (0.96, 0.99, 0.01)])]
    blocks = spark.createDataFrame(rows + [("b", 2, 9, [1.0, 0.0], [1.0, 0.0], 0.0)], "label string, d int, block long, low array<double>, high array<double>, tail double")
    assert {tuple(r) for r in tiles_of(blocks, 0.93).collect()} == {(0, 0), (0, 1), (1, 1), (2, 2), (3, 3), (0, 4), (1, 4), (4, 4), (9, 9)}


def test_clusters_apart_share_no_tile(spark, monkeypatch):
    from quern.llm import embedding_dedup

    rng = np.random.default_rng(4)
    centres = np.eye(12)[:6]
    data = [(i, (centres[i % 6] * (1 + i % 3) + rng.normal(scale=0.01, size=12)).tolist(), 1) for i in range(360)]
    made = []

    def counted(blocks, threshold, real=embedding_dedup.tiles_of):
        out = real(blocks, threshold)
        made.append((blocks.count(), out.count()))
        return out

    monkeypatch.setattr(embedding_dedup, "tiles_of", counted)
    found = near_embeddings(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int"), block=15).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found} == brute(data)
    blocks, tiles = made[0]
    assert tiles < 0.8 * blocks * (blocks + 1) / 2
