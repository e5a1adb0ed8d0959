import inspect
from collections import Counter, defaultdict

import pytest

from .helpers import SPACE, WORD, frame, rows
from .test_mixing import targets
from .test_near_dedup import brute as near_brute
from .test_packing import check as check_packing

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.01"


def plain(df):
    return [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect()]


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = plain(docs)
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = (before, before := plain(docs))
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    own, out = seen["toxicity"]
    gone = {r[0] for r in own} - {r[0] for r in out}
    # 45 positives to learn from here: two of 348 clean labelled documents are rejected; larger tables do better.
    assert gone and sum(labels.get(i) == 0 for i in gone) <= 0.01 * sum(y == 0 for y in labels.values()) and set(out) <= set(own)
    own, out = seen["exact dedup"]
    groups = defaultdict(list)
    for r in own:
        groups[SPACE.sub(" ", r[1] or "")].append(r[0])
    assert Counter(r[0] for r in out) == Counter(min(g) for g in groups.values()) and set(out) <= set(own)
    own, out = seen["near dedup"]
    assert {r[0] for r in out} == {i for i, (_, _, kept) in near_brute(own).items() if kept} and len(out) == len({r[0] for r in out})
    own, out = seen["source mixing"]
    words = lambda rows: sum(len(WORD.findall(r[1] or "")) for r in rows)
    by = defaultdict(list)
    for r in own:
        by[r[3]].append(r)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    for s, t in zip(names, targets([words(by[s]) for s in names], [(5.0, 2.0, 1.0)[k % 3] for k in range(len(names))]), strict=True):
        assert abs(words(r for r in out if r[3] == s) - t) <= max(len(WORD.findall(r[1] or "")) for r in by[s]) + 1
    assert all(n <= 2 for n in Counter(r[0] for r in out).values())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    n, least = check_packing(out, packed, 2048)
    assert n <= least * 1.05 + 1


def test_stages_stand_all_cases(spark):
    for data in (rows(), []):
        docs = frame(spark, extra=True, data=data)
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, SF).collect()


def test_shape():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "source mixing", "packing"]
    assert all(len(inspect.signature(f).parameters) == 3 for _, f in corpus_pipeline.STAGES)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
