import random

import numpy as np

from quern.llm.quality import co_train, meta_features, score_quality, text_features, train

from .helpers import fold, frame, rows


def corpus(n=800):
    rng = random.Random(11)
    out, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(40, 120))]
        text = " ".join(w.capitalize() + "." if k % 9 == 0 else w for k, w in enumerate(words)) if good else "||| ".join(w.upper() + "!!" for w in words)
        source = f"s{(0 if good else 1) if rng.random() < 0.7 else 2}"
        out.append((i, text, "en", source, len(text)))
        if i % 10 < 3:
            labels.append((i, int(good)))
    return out, labels


def test_held_out_accuracy(spark):
    data, labels = corpus()
    docs = frame(spark, data=data)
    model = train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    found = score_quality(docs, model).collect()
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held} == {i for i, *_ in data if fold(i, 5) == 0}
    assert sum(r.predicted == (r.doc_id % 4 != 0) for r in held) >= 0.97 * len(held)


def test_views_teach_each_other():
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 600)
    text = rng.normal(y[:, None] * 2.0, 1, (600, 13))
    meta = np.column_stack([np.where(rng.random(600) < 0.9, y, 1 - y) + 1, np.full(600, 512), np.full(600, 576)])
    seen = np.where(np.arange(600) < 40, y, -1)
    model = co_train(text, meta, seen, np.arange(600) % 4 == 0)
    for score in model.views(text, meta):
        assert ((score >= 0.5) == y).mean() > 0.85


def test_features_of_odd_rows():
    assert all(np.isfinite(text_features(t)).all() for t in (None, "", " \n", "x", "漢字"))
    assert meta_features(None, None, None) != meta_features("a", "en", 5)
    assert meta_features("a", "en", -3) == meta_features("a", "en", 0)


def test_all_cases(spark):
    data, labels = corpus(200)
    known = spark.createDataFrame([*labels, (None, 1), (5, None), (6, 7)], "doc_id long, quality int")
    model = train(frame(spark, data=data + [(5000 + i, *r[1:]) for i, r in enumerate(rows())]), known)
    found = score_quality(frame(spark, extra=True), model).collect()
    assert len(found) == len(rows()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    assert score_quality(frame(spark, empty=True), model).count() == 0
    nothing = train(frame(spark, empty=True), known.limit(0))
    assert score_quality(frame(spark), nothing).count() == len(rows())
