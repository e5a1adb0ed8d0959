import math
from collections import Counter

import numpy as np

from quern.llm.class_lm import Items, exchange, score_lm, train

from .helpers import WORD, ascii_lower, fold, frame, rows


def tokens(text):
    return [*WORD.findall(ascii_lower(text or "")), None]


def small():
    return [(i, f"The cat {'sat' if i % 2 else 'ran'} on the mat{i % 5} É{i % 3}" if i % 7 else None, None, None, None) for i in range(120)]


def test_base_score_and_counts_against_brute_force(spark):
    data = small() + rows()
    for head in (3, 10_000):  # most counts by join, and all by broadcast
        docs = frame(spark, data=data)
        found = score_lm(docs, *train(docs, head=head)).collect()
        counts = Counter(t for i, text, *_ in data if fold(i, 10) != 0 for t in tokens(text))
        n, v = sum(counts.values()), len(counts)

        def expected(row):
            own = tokens(row[1])
            base = math.fsum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own)
            return (row[0], fold(row[0], 10) == 0, len(own), sum(counts[t] > 0 for t in own), n, round(base, 6))

        assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == Counter(map(expected, data))
        assert all(r.score < 0 and abs(r.perplexity - 10 ** (-r.score / r.n_tokens)) < 1e-6 * r.perplexity for r in found)


def test_score_is_the_models_probability(spark):
    docs = frame(spark, data=small())
    model, counts = train(docs, item_words=8, classes=4)
    n = {bytes(r.word): r.n for r in counts.collect()}
    items = Items(model.words)
    of = lambda t: model.classes[items[b" " if t is None else t.encode()]]
    members, distinct = Counter(), Counter()
    for w, k in n.items():
        members[model.classes[items[w]]] += k
        distinct[model.classes[items[w]]] += 1
    pairs = Counter()
    for i, text, *_ in small():
        if fold(i, 10) != 0:
            own = [of(t) for t in tokens(text)]
            pairs.update(zip([of(None), *own[:-1]], own, strict=True))
    classes = range(int(model.classes.max()) + 1)
    total = sum(members[c] + 0.1 for c in classes)

    def log_p(before, t):
        c = of(t)
        step = (pairs[before, c] + 8.0 * (members[c] + 0.1) / total) / (sum(pairs[before, x] for x in classes) + 8.0)
        return math.log10(step) + math.log10((n.get(b" " if t is None else t.encode(), 0) + 0.1) / (members[c] + 0.1 * (distinct[c] + 1)))

    for r in score_lm(docs, model, counts).collect():
        text = next(t for i, t, *_ in small() if i == r.doc_id)
        before, score = of(None), 0.0
        for t in tokens(text):
            score += log_p(before, t)
            before = of(t)
        assert abs(score - r.score) < 1e-6
    for before in classes:  # steps between classes are a distribution
        assert abs(sum((pairs[before, c] + 8.0 * (members[c] + 0.1) / total) / (sum(pairs[before, x] for x in classes) + 8.0) for c in classes) - 1) < 1e-9


def test_exchange_raises_the_class_likelihood():
    rng = np.random.default_rng(5)
    kind = rng.permutation(40) % 4
    bigrams = np.where((kind[:, None] + 1) % 4 == kind[None, :], rng.poisson(20, (40, 40)), rng.poisson(0.2, (40, 40))).astype(float)

    def likelihood(of):
        table = np.eye(4)[of].T @ bigrams @ np.eye(4)[of]
        f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
        return f(table) - f(table.sum(axis=0)) - f(table.sum(axis=1))

    found = exchange(bigrams, 4)
    assert likelihood(found) >= likelihood(kind) - 1
    assert likelihood(kind) - 1 > likelihood(np.random.default_rng(0).permutation(kind))


def test_held_out_text_is_likelier_than_under_the_base(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = [r for r in score_lm(docs, *train(docs)).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_all_cases(spark):
    docs = frame(spark, extra=True)
    model = train(docs)
    assert score_lm(docs, *model).count() == len(rows())
    assert score_lm(frame(spark, empty=True), *model).count() == 0
    nothing = train(frame(spark, empty=True))
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in score_lm(docs, *nothing).collect())


def test_own_classes_against_brute_force(spark, monkeypatch):
    from quern.llm import class_lm

    monkeypatch.setattr(class_lm, "BLOCK", 4)  # several blocks, runs and sums
    monkeypatch.setattr(class_lm, "RUN", 7)
    monkeypatch.setattr(class_lm, "GATHERED", 50)
    rng = np.random.default_rng(3)
    first, last, k = 5, 30, 3
    of = rng.integers(0, k, last + 4)
    prior, ending, weigh = rng.random((4, 2 * k)), rng.integers(0, 4, last - first), rng.normal(size=(2 * k, k))
    texts = [[*rng.integers(1, last + 4, rng.integers(0, 40)).tolist(), 0] for _ in range(60)]
    ids = spark.createDataFrame([(bytearray(np.array(t, dtype=np.int32).tobytes()),) for t in texts], "ids binary").repartition(5)
    sides = np.zeros((last - first, 2 * k))
    for t in texts:
        for before, own in zip([0, *t], t, strict=False):
            if first <= own < last:
                sides[own - first, of[before]] += 1
            if first <= before < last:
                sides[before - first, k + of[own]] += 1
    found = class_lm.own_classes(ids, spark.sparkContext.broadcast(of), first, last, k, prior, ending, weigh)
    assert found.tolist() == ((sides + prior[ending]) @ weigh).argmax(axis=1).tolist()
