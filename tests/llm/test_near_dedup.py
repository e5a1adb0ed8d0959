import random

import numpy as np
import pandas as pd
import pytest

from quern.llm import components as components_module
from quern.llm.components import components as spark_components
from quern.llm.near_dedup import REGISTERS, likely, near_dedup, registers_of, representatives
from quern.sources import shared

from .helpers import WORD, ascii_lower, components, frame, rows


def shingles(text):
    words = WORD.findall(ascii_lower(text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def brute(data):
    sets = {i: shingles(t) for i, t, *_ in data if i is not None}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    part = components(ids, links)
    return {i: (len(sets[i]), part[i], part[i] == i) for i in ids}


def families(n=40, seed=2, edits=(0, 1, 2, 4, 8)):
    rng = random.Random(seed)
    out = []
    for f in range(n):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(3, 260))]
        for _ in range(rng.randint(1, 7)):
            own = list(base)
            for _ in range(rng.choice(edits)):
                k = rng.randrange(len(own))
                own[k : k + 1] = rng.choice([[], [f"w{rng.randrange(3000)}"], [own[k].upper(), "more"]])
            out.append((10_000 + len(out), " ".join(own) if rng.random() < 0.8 else "\n\t".join(own), None, None, None))
    return out


@pytest.mark.parametrize("seed", [2, 3])
def test_against_brute_force(spark, seed):
    data = families(seed=seed) + rows()[:13]
    found = near_dedup(frame(spark, extra=True, data=data)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == brute(data)
    assert len(found) == len(data)


def test_large_family_in_many_blocks(spark):
    """A chain: neighbours are alike and ends are not, and blocks and pivots hold few of them."""
    words = [f"w{k}" for k in range(700)]
    data = [(i, " ".join(words[i * 4 : i * 4 + 150]), None, None, None) for i in range(110)] + [(500 + i, " ".join(words[:150]), None, None, None) for i in range(30)]
    random.Random(1).shuffle(data)
    expected = brute(data)
    found = near_dedup(frame(spark, data=data), block=8, wide_block=24).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == expected
    assert max(sum(c == x for _, c, _ in expected.values()) for _, x, _ in expected.values()) > 100


def test_representatives(spark):
    data = families(12) + [families(1)[0]] + rows()
    docs = frame(spark, extra=True, data=data)
    out = representatives(docs)
    assert out.columns == docs.columns
    expected = brute(data)
    stays = {i for i, (_, _, kept) in expected.items() if kept}
    ids = [r.doc_id for r in out.collect()]
    assert {i for i in ids if i is not None} == stays
    assert representatives(frame(spark, empty=True)).count() == 0 == near_dedup(frame(spark, empty=True)).count()


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    x, y = (rng.integers(0, 2**63, 5000, dtype=np.uint64) for _ in range(2))
    assert (registers_of(np.concatenate([x, y])) == np.maximum(registers_of(x), registers_of(y))).all()
    for share in (0.3, 0.7, 0.85, 0.97):
        n = 4000
        both = int(2 * n * share / (1 + share))
        a, b = np.concatenate([x[:both], y[: n - both]]), np.concatenate([x[:both], y[n : 2 * n - both]]) if 2 * n - both <= 5000 else np.concatenate([x[:both], y[5000 - (n - both) :]])
        ra, rb = registers_of(a), registers_of(b)
        larger, smaller = np.array([(ra > rb).sum()]), np.array([(ra < rb).sum()])
        assert abs((REGISTERS - larger - smaller)[0] / REGISTERS - share) < 0.15
        ok = likely(larger, smaller, np.array([float(n)]), np.array([float(n)]), 0.85)[0]
        assert ok if share >= 0.85 else True
        assert not ok if share == 0.3 else True


def test_components(spark):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(100)] + [(rng.randrange(3000, 3200), rng.randrange(3000, 3200)) for _ in range(120)] + [(7, 7), (None, 3), (4, None), (1, 0), (0, 1)]
    found = {r.id: r.component for r in spark_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    assert found == components({x for e in real for x in e}, real)
    assert spark_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pairs_foundthat_share_an_id_but_not_a_text(spark):
    words = [f"w{k}" for k in range(100)]
    data = [(1, " ".join(words), None, None, None), (2, " ".join(words[:99]), None, None, None), (2, "quite another text of its own", None, None, None), (3, "quite another text of its own", None, None, None)]
    found = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup(frame(spark, data=data)).collect())
    assert found == [(1, 96, 1, True), (2, 2, 2, True), (2, 95, 1, False), (3, 2, 2, False)]
    assert sorted((r.doc_id, len(r.text)) for r in representatives(frame(spark, extra=True, data=data)).collect()) == [(1, len(data[0][1])), (2, len(data[2][1]))]


def test_hubs_are_spread(spark):
    rng = random.Random(1)
    edges = [(rng.choice([0, 100_000]), k) for k in range(1, 3000)] + [(5, 100_000)]
    found = {r.id: r.component for r in spark_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == components({x for e in edges for x in e}, edges)


def paths_and_stars(seed=7):
    rng = random.Random(seed)
    edges = [(rng.choice([0, 5000]), k) for k in range(1, 900)] + [(6000 + k, 6001 + k) for k in range(150)] + [(rng.randrange(8000, 8300), rng.randrange(8000, 8300)) for _ in range(260)] + [(1, 9), (9, 1), (9, 9), (None, 9), (9, None)]
    rng.shuffle(edges)
    return edges, [(a, b) for a, b in edges if a is not None and b is not None and a != b]


@pytest.mark.parametrize("alone", [None, 0])
def test_components_by_forests_and_by_stars(spark, alone):
    edges, real = paths_and_stars()
    for kind, of in (("long", lambda x: x), ("string", lambda x: None if x is None else str(x)), ("binary", lambda x: None if x is None else str(x).encode())):
        data = [(of(a), of(b)) for a, b in edges]
        pairs = [(of(a), of(b)) for a, b in real]
        table = spark.createDataFrame(data, f"a {kind}, b {kind}").repartition(5)
        found = spark_components(table) if alone is None else spark_components(table, alone=alone)
        pairs_found = [(r.id, r.component) if kind != "binary" else (bytes(r.id), bytes(r.component)) for r in found.collect()]
        assert len(pairs_found) == len(dict(pairs_found))
        assert dict(pairs_found) == components({x for e in pairs for x in e}, pairs), kind
    assert spark_components(spark.createDataFrame([], "a long, b long"), alone=-1).count() == 0


def test_forests_in_pieces(monkeypatch):
    edges, real = paths_and_stars()
    monkeypatch.setattr(components_module, "PIECE", 64)
    batches = [pd.DataFrame(real[k : k + 50], columns=["u", "v"]) for k in range(0, len(real), 50)]
    out = list(components_module._forests(iter(batches)))
    assert max(map(len, out)) <= 64 + 50 and len(out) > 2
    left = [e for part in out for e in zip(part["u"].tolist(), part["v"].tolist(), strict=True)]
    nodes = {x for e in real for x in e}
    assert components(nodes, left) == components(nodes, real)


@pytest.mark.parametrize("alone", [None, 0])
def test_tables_written_for_components(spark, monkeypatch, alone):
    """A path of 300 nodes took 19 tables and more; each is a shuffle of every partition, however few its rows are. Stars that are complete take no round."""
    n = [0]

    def counted(df):
        n[0] += 1
        return shared.written(df)

    monkeypatch.setattr(components_module, "written", counted)
    star = [(0, k) for k in range(1, 50)] + [(100, k) for k in range(101, 140)]
    path = [(k, k + 1) for k in range(300)]
    for edges in [path, star] if alone is None else [star]:
        n[0] = 0
        table = spark.createDataFrame(edges, "a long, b long").repartition(6)
        found = spark_components(table) if alone is None else spark_components(table, alone=alone)
        assert n[0] <= (2 if alone is None else 3)
        assert {r.id: r.component for r in found.collect()} == components({x for e in edges for x in e}, edges)
