import random
from collections import defaultdict

import numpy as np

from quern.llm.mixing import duel, mix, mixed, water_fill

from .helpers import WORD, frame, rows


def targets(sizes, weights, share=1.5, most=2.0):
    """By search for the level at which all that is shared is spent."""
    total = min(share * sum(sizes), most * sum(sizes))
    low, high = 0.0, 1e18
    for _ in range(300):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(most * s, level * w) for s, w in zip(sizes, weights, strict=True)) < total else (low, level)
    return [min(most * s, high * w) for s, w in zip(sizes, weights, strict=True)]


def test_targets_share_the_excess():
    rng = random.Random(4)
    for _ in range(100):
        sizes = [rng.choice([0, 1, 10, 1000, 10**6]) for _ in range(rng.randint(1, 9))]
        weights = [(5.0, 2.0, 1.0)[i % 3] for i in range(len(sizes))]
        assert np.allclose(water_fill(sizes, weights), targets(sizes, weights), rtol=1e-6, atol=1e-6)


def test_duels_keep_words_and_expectations():
    rng = random.Random(1)
    for _ in range(2000):
        p, q, a, b = rng.uniform(0.01, 0.99), rng.uniform(0.01, 0.99), rng.randint(1, 90), rng.randint(1, 90)
        both = [duel(p, a, q, b, u) for u in (0.0, 1 - 1e-12)]
        for x, y in both:
            assert abs(x * a + y * b - p * a - q * b) < 1e-6 and (x in (0, 1) or y in (0, 1)) and 0 <= x <= 1 and 0 <= y <= 1
    outcomes = [duel(0.3, 10, 0.6, 7, (k + 0.5) / 4000)[0] for k in range(4000)]
    assert abs(np.mean(outcomes) - 0.3) < 1e-3


def many(n=4000):
    rng = random.Random(9)
    return [(i, " ".join(["w"] * rng.choice([1, 3, 20, 100])), None, "hot" if i % 3 == 0 else f"s{rng.randrange(8)}", None) for i in range(n)]


def check(data, found, slack=1.0):
    size, source = defaultdict(int), {}
    own = defaultdict(int)
    for i, t, _, s, _ in data:
        own[s] += len(WORD.findall(t or ""))
    names = sorted(own, key=lambda s: (s is None, s or ""))
    expected = dict(zip(names, targets([own[s] for s in names], [(5.0, 2.0, 1.0)[k % 3] for k in range(len(names))]), strict=True))
    taken, largest = defaultdict(int), defaultdict(int)
    assert len(found) == len(data)
    for r in found:
        assert r.source_size == own[r.source] and abs(r.target - expected[r.source]) <= 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 2 * r["size"] and (r.taken == 0 or r.taken % r["size"] == 0)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    for s in own:
        assert abs(taken[s] - expected[s]) <= slack * largest[s] + 1e-6, (s, taken[s], expected[s])
    return size, source


def test_sources_come_to_their_targets_and_reruns_agree(spark):
    data = many()
    found = mix(frame(spark, data=data), bucket_rows=64, fan_in=4).collect()
    check(data, found)
    again = mix(frame(spark, data=data).repartition(11), bucket_rows=64, fan_in=4).collect()
    assert {r.doc_id: r.taken for r in found} == {r.doc_id: r.taken for r in again}
    other = mix(frame(spark, data=data), seed=1).collect()
    assert {r.doc_id: r.taken for r in found} != {r.doc_id: r.taken for r in other}


def test_each_document_has_its_share(spark):
    data = [(i, " ".join(["w"] * (1 + i % 4)), None, "ab"[i % 2], None) for i in range(40)]
    total = defaultdict(float)
    for seed in range(12):
        for r in mix(frame(spark, data=data), bucket_rows=16, seed=seed).collect():
            total[r.source] += r.taken
    sizes = [sum(1 + i % 4 for i in range(k, 40, 2)) for k in range(2)]
    for s, t in zip("ab", targets(sizes, [5.0, 2.0]), strict=True):
        assert abs(total[s] / 12 - t) < 4


def test_all_cases(spark):
    found = mix(frame(spark, extra=True)).collect()
    check(rows(), found)
    assert mix(frame(spark, empty=True)).count() == 0 == mixed(frame(spark, empty=True)).count()


def test_mixed_rows_are_copies(spark):
    data = [r for r in rows() if r[1] is None or len(r[1]) < 10_000] + many(300)
    docs = frame(spark, extra=True, data=data)
    out = mixed(docs)
    assert out.columns == docs.columns
    words = lambda collected: sum(len(WORD.findall(r.text or "")) for r in collected)
    own, got = words(docs.collect()), words(out.collect())
    assert abs(got - 1.5 * own) <= 100 * 10
    assert {r.doc_id for r in out.collect()} <= {r[0] for r in data}
