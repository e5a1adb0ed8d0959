"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic documents count as labelled; everything else, labelled clean or not, is
unlabelled text that holds a share of toxic documents, the class prior. A linear model over
words and word beginnings, found once or more often, and if asked over how many of a text's words
have any of them, minimises the non-negative risk estimate

    prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive))

in numpy. Both training samples are bounded, chosen by a hash of the id, and written once; the prior is
counted over all labels that may be learned from, and features' documents over all texts that may.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, fold, mapped, written

#: Documented bounds: training rows of either kind, and features.
MAX_POSITIVE, MAX_UNLABELLED, MAX_FEATURES = 8_000, 24_000, 30_000
FOLDS = 5
#: A feature counts if so large a share of the rows that have it is estimated to be positive, and if that is so many standard deviations from chance.
MIN_SHARE, MIN_DEVIATIONS = 0.4, 5.0
#: Ends the name of a feature that a text has twice or more often; no word holds a space.
TWICE = " 2"
#: Least numbers, and least shares of all words, of words that have any known feature; each is a feature.
COUNTS, SHARES = (1, 2, 3, 5), (0.0025, 0.005, 0.01, 0.02)
TOTALS = [f" n{x}" for x in COUNTS] + [f" s{x}" for x in SHARES]
#: Tokens that a worker remembers.
CACHE = 150_000
EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")


def features_of(token: str) -> list[str]:
    """A token's word without what surrounds it, and the beginnings of that word."""
    word = EDGES.sub("", token)
    if not word:
        return []
    return [f"{word}$", *[word[:n] for n in range(4, min(7, len(word)) + 1)]]


class Lookup:
    """The known features of whole texts, with a memory of tokens that have any."""

    def __init__(self, known: dict[str, int]):
        self.known, self.seen, self.some = known, set(), {}
        self.base = {f.removesuffix(TWICE) for f in known}
        self.counts = [(x, known[f]) for x, f in zip(COUNTS, TOTALS, strict=False) if f in known]
        self.shares = [(x, known[f]) for x, f in zip(SHARES, TOTALS[len(COUNTS) :], strict=True) if f in known]

    def __call__(self, text: str | None) -> list[int]:
        words = (text or "").lower().split()
        tokens = set(words)
        if fresh := tokens - self.seen:
            if len(self.seen) > CACHE:
                self.seen, self.some, fresh = set(), {}, tokens
            for t in fresh:
                if own := [f for f in features_of(t) if f in self.base]:
                    self.some[t] = own
            self.seen |= fresh
        if not (hits := tokens & self.some.keys()):
            return []
        times: Counter[str] = Counter()
        n = 0
        for t, k in Counter(w for w in words if w in hits).items():
            n += k
            for f in self.some[t]:
                times[f] += k
        names = [*times, *(f + TWICE for f, k in times.items() if k > 1)]
        own = [self.known[f] for f in names if f in self.known]
        own += [i for x, i in self.counts if n >= x] + [i for x, i in self.shares if n >= x * len(words)]
        return sorted(own)


@dataclass
class Model:
    known: dict[str, int]
    weights: np.ndarray
    bias: float

    def score(self, own: list[int]) -> float:
        z = self.bias + float(self.weights[own].sum()) if own else self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train_nnpu(positive: list[list[int]], unlabelled: list[list[int]], n_features: int, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-4, beta: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk with the logistic loss, by Adam on whole samples.

    When the unlabelled part of the risk falls below -beta, the step goes up its own gradient, as it then
    only fits the positives hidden among the unlabelled.
    """
    if not positive or not unlabelled:
        return np.zeros(n_features), float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))

    def flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.array([i for r in rows for i in r], dtype=np.int64)

    (pr, pc), (ur, uc) = flat(positive), flat(unlabelled)
    w = np.zeros(n_features + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def back(rows: np.ndarray, cols: np.ndarray, g: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(cols, g[rows], n_features), g.sum())

    for step in range(1, steps + 1):
        zp = np.bincount(pr, w[pc], len(positive)) + w[-1]
        zu = np.bincount(ur, w[uc], len(unlabelled)) + w[-1]
        sp, su = sigmoid(zp), sigmoid(zu)
        rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        of_rest = back(ur, uc, su / len(su)) - back(pr, pc, prior * sp / len(sp))
        g = back(pr, pc, prior * (sp - 1) / len(sp)) + of_rest if rest >= -beta else -of_rest
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def telling(p, u, n_p: int, n_u: int, prior: float, root):
    """Of a feature that ``p`` of n_p positive and ``u`` of n_u unlabelled texts have: the share of those who have it that is estimated to be positive, and the deviations from chance. For columns and arrays."""
    in_p, in_u = (p + 0.5) / (n_p + 1), (u + 0.5) / (n_u + 1)
    spread = root((in_p * n_p + in_u * n_u) / float(n_p + n_u) / min(n_p, n_u))
    return prior * in_p / in_u, (in_p - in_u) / spread


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = FOLDS, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, max_features: int = MAX_FEATURES, totals: bool = False) -> Model:
    """Learn from rows outside fold 0. Labels come from ``labels`` only; rows without text or id teach nothing.

    ``totals``: how many of a text's words have any feature are features too.
    """
    may = labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").alias("y")).filter(F.col("id").isNotNull() & F.col("y").isNotNull() & (fold("id", folds) != 0))
    n, ones = may.agg(F.count("id"), F.coalesce(F.sum((F.col("y") == 1).cast("long")), F.lit(0))).first()
    prior = min(0.95, max(1e-3, ones / n)) if n else 1e-3
    by_hash = lambda df, k: df.orderBy(F.xxhash64("id", F.lit(7)), "id").limit(k)
    positive = by_hash(may.filter("y = 1").select("id").distinct(), max_positive).select("id", F.lit(True).alias("positive"))
    texts = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    some = by_hash(texts.select("id").filter(F.col("id").isNotNull() & (fold("id", folds) != 0)), max_unlabelled).select("id", F.lit(False).alias("positive"))
    chosen = positive.unionByName(some)  # at most max_positive + max_unlabelled ids, and so small enough to broadcast
    rows = written(texts.join(F.broadcast(chosen), "id").select("text", "positive"))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            by = {True: Counter(), False: Counter()}
            known: dict[str, list[str]] = {}
            for t, y in zip(batch["text"], batch["positive"], strict=True):
                once: set[str] = set()
                twice: set[str] = set()
                for token, k in Counter((t or "").lower().split()).items():
                    if (found := known.get(token)) is None:
                        found = known[token] = features_of(token)
                    twice.update(found if k > 1 else once.intersection(found))
                    once.update(found)
                by[bool(y)].update(once)
                by[bool(y)].update(f + TWICE for f in twice)
            for at, (y, c) in enumerate(by.items()):
                yield pd.DataFrame({"feature": list(c), "p": [x * (at == 0) for x in c.values()], "u": [x * (at == 1) for x in c.values()]})

    size = dict(rows.groupBy("positive").count().collect())
    n_p, n_u = size.get(True, 0), size.get(False, 0)
    if not n_p or not n_u:
        return Model({}, np.zeros(0), float(np.log(prior / (1 - prior))))
    sums = mapped(rows, counted, "feature string, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    # Features that tell the samples apart: a positive's share well above the unlabelled one's, beyond chance. The sample
    # only names candidates, by half of what is asked in the end; how many documents have them is then counted over all training rows.
    share, deviations = telling(F.col("p"), F.col("u"), n_p, n_u, prior, F.sqrt)
    likely = sums.filter((F.col("p") >= 5) & (share > MIN_SHARE / 2) & (deviations > MIN_DEVIATIONS / 2)).orderBy(deviations.desc(), "feature").limit(2 * max_features)
    candidates = likely.select("feature", "p").toArrow().to_pandas()  # at most 2 * max_features
    names = candidates["feature"].tolist()
    asked = docs.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(names)})
    everyone = texts.filter(F.col("id").isNotNull() & (fold("id", folds) != 0)).select("text")

    def recounted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        look, u, n = Lookup(asked.value), np.zeros(len(asked.value), np.int64), 0
        for batch in batches:
            n += len(batch)
            for t in batch["text"]:
                u[look(t)] += 1
        own = np.flatnonzero(u)
        yield pd.DataFrame({"i": [-1, *own], "u": [n, *u[own]]})

    known: dict[str, int] = {}
    if names:
        all_u = {r["i"]: r["u"] for r in mapped(everyone, recounted, "i int, u long").groupBy("i").agg(F.sum("u").alias("u")).collect()}  # a number for each candidate
        p, u = candidates["p"].to_numpy(np.float64), np.array([all_u.get(i, 0) for i in range(len(names))], np.float64)
        share, deviations = telling(p, u, n_p, all_u[-1], prior, np.sqrt)
        order = np.argsort(-deviations, kind="stable")
        names = [names[i] for i in order if share[i] > MIN_SHARE and deviations[i] > MIN_DEVIATIONS][:max_features]
        known = {f: i for i, f in enumerate([*names, *(TOTALS if totals else [])])} if names else {}
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def looked_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        look = Lookup(shared.value)
        for batch in batches:
            yield pd.DataFrame({"positive": batch["positive"], "own": [look(t) for t in batch["text"]]})

    found = mapped(rows, looked_up, "positive boolean, own array<int>").toArrow().to_pandas()  # a few numbers for each row of a bounded sample
    rows_of = lambda y: sorted(list(map(int, own)) for own in found.loc[found["positive"] == y, "own"])  # noqa: E731  sorted: rows come in any order
    weights, bias = train_nnpu(rows_of(True), rows_of(False), len(known), prior)
    return Model(known, weights, bias)


def score_toxicity(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", folds: int = FOLDS) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted (1 if score >= 0.5).

    A null text is scored as an empty one: by the bias alone. The score depends on nothing but the whole
    text, so repeated rows score alike. An empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[doc_id].dataType.simpleString()

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        look = Lookup(model.known)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": [model.score(look(t)) for t in batch["text"]]})

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return mapped(rows, scored, f"doc_id {kind}, score double").select("doc_id", (fold("doc_id", folds) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model doesn't predict to be toxic, with all their columns.

    A null text is judged as an empty one; repeated rows share their fate, and an empty table stays empty.
    """
    bounded(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        look = Lookup(model.known)
        for texts in batches:
            yield pd.Series([model.score(look(t)) for t in texts])

    return docs.filter(score(F.col(f"`{text}`")) < 0.5)
