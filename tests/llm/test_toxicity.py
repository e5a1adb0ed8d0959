import random

import numpy as np

from quern.llm.toxicity import Lookup, features_of, score_toxicity, train, train_nnpu, without_toxic

from .helpers import fold, frame, rows

RUDE = ["zounds", "dratted", "blighter", "scoundrel"]


def corpus(n=900):
    rng = random.Random(3)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    out, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 200))]
        toxic = i % 8 == 0
        if toxic:
            for _ in range(3 + len(words) // 40):
                words.insert(rng.randrange(len(words)), rng.choice(RUDE))
        elif i % 50 == 1:
            words += ["zoundsless"]  # shares beginnings with a rude word
        out.append((i, " ".join(words), "en", "s", None))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    return out, labels


def test_held_out_accuracy_and_pipeline_filter(spark):
    data, labels = corpus()
    docs, known = frame(spark, data=data), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = train(docs, known)
    found = {r.doc_id: r for r in score_toxicity(docs, model).collect()}
    assert len(found) == len(data)
    held = [r for r in found.values() if r.held_out]
    assert {r.doc_id for r in held} == {i for i, *_ in data if fold(i, 5) == 0}
    assert sum(r.predicted == (r.doc_id % 8 == 0) for r in held) >= 0.99 * len(held)
    kept = {r.doc_id for r in without_toxic(docs, model).collect()}
    assert kept == {i for i, r in found.items() if r.predicted == 0}
    again = {r.doc_id: r.score for r in score_toxicity(docs, train(docs.repartition(7), known.repartition(5))).collect()}
    assert all(abs(again[i] - r.score) < 1e-6 for i, r in found.items())


def test_labels_of_held_out_rows_teach_nothing(spark):
    data, labels = corpus(400)
    docs = frame(spark, data=data)
    scores = []
    for flip in (False, True):
        known = [(i, 1 - y if flip and fold(i, 5) == 0 else y) for i, y in labels]
        scores.append({r.doc_id: r.score for r in score_toxicity(docs, train(docs, spark.createDataFrame(known, "doc_id long, toxic int"))).collect()})
    assert scores[0] == scores[1]


def test_non_negative_risk_keeps_hidden_positives_apart():
    rng = np.random.default_rng(0)
    positive = [[0] + ([1] if rng.random() < 0.5 else []) for _ in range(60)]
    unlabelled = [[0, 2] if i % 10 == 0 else [2] for i in range(300)]
    w, b = train_nnpu(positive, unlabelled, 3, 0.1)
    assert w[0] + w[2] + b > 0 > w[2] + b
    w, b = train_nnpu([], unlabelled, 3, 0.1)
    assert not w.any() and abs(b - np.log(0.1 / 0.9)) < 1e-9


def test_features():
    assert features_of("!!Scoundrel's,".lower()) == ["scoundrel's$", "scou", "scoun", "scound", "scoundr"]
    assert features_of("12") == []
    names = ["zoun", "zoun 2", "zounds$", " n1", " n2", " n3", " n5", " s0.0025", " s0.005", " s0.01", " s0.02"]
    look = Lookup({f: i for i, f in enumerate(names)})
    named = lambda t: {names[i] for i in look(t)}
    assert named("zounds " + "word " * 299) == {"zoun", "zounds$", " n1", " s0.0025"}
    assert named("zoundsfoo, Zounds! " + "word " * 98) == {"zoun", "zoun 2", "zounds$", " n1", " n2", *names[7:]}
    assert look("nothing here") == look(None) == []


def test_all_cases(spark):
    data, labels = corpus(200)
    known = spark.createDataFrame([*labels, (None, 1), (4, None), (999_999, 1)], "doc_id long, toxic int")
    model = train(frame(spark, data=data + [(5000 + i, *r[1:]) for i, r in enumerate(rows())]), known)
    docs = frame(spark, extra=True)
    found = score_toxicity(docs, model).collect()
    assert len(found) == len(rows()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    assert without_toxic(docs, model).columns == docs.columns
    assert score_toxicity(frame(spark, empty=True), model).count() == 0
    nothing = train(frame(spark, empty=True), known.limit(0))
    assert all(r.predicted == 0 for r in score_toxicity(docs, nothing).collect())
