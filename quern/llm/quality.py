"""Quality by co-training of a text view and a metadata view.

One classifier sees only what the text is made of, the other only the page's metadata. In each
round both label the unlabelled documents that they are surest of, and each learns those of the
other. In the end both are calibrated on labelled rows that neither has learned from, and their
calibrated log-odds are combined. Training samples are bounded and chosen by a hash of the id;
all documents are scored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold

#: Documented bounds of the training samples.
MAX_LABELLED, MAX_UNLABELLED = 20_000, 20_000
FOLDS, CALIBRATION_FOLD = 5, 1
ROUNDS, SHARE, SURE = 5, 0.04, 0.8
BINS = 16
SOURCES, LANGS, LENGTHS = 512, 64, 32

_BYTE = np.zeros((8, 256))
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:'\"()-", b"!?", b"|/\\<>{}[]=+_~^", b"%*$#&@", bytes(range(128, 256)))):
    _BYTE[_k, list(_chars)] = 1
N_TEXT = 13


def text_features(text: str | None) -> list[float]:
    """What a text is made of: shares of kinds of characters, lengths, and how much of it repeats."""
    raw = (text or "").encode("utf-8", "replace")
    words, lines = raw.split(), raw.split(b"\n")
    n, size = max(1, len(words)), max(1, len(raw))
    upper, lower, digit, stop, loud, markup, odd, wide = (_BYTE @ np.bincount(np.frombuffer(raw, np.uint8), minlength=256)).tolist()
    letters = max(1.0, upper + lower)
    return [upper / letters, digit / size, stop / n, loud / n, markup / n, odd / n, wide / size, size / n, math.log1p(len(words)), math.log1p(len(set(words))) / math.log1p(n), len(set(lines)) / len(lines), math.log1p(size / len(lines)), (upper + lower + wide) / size]


def meta_features(source: object, lang: object, n_chars: float | None) -> list[int]:
    """Cells of the metadata: source, language, length class; nulls have cells of their own."""
    of = lambda x, n: 0 if x is None else 1 + zlib.crc32(str(x).encode()) % (n - 1)
    length = LENGTHS - 1 if n_chars is None or n_chars != n_chars else min(LENGTHS - 2, int(2 * math.log2(1 + max(0, n_chars)) / 1.5))
    return [of(source, SOURCES), SOURCES + of(lang, LANGS), SOURCES + LANGS + length]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(cells: np.ndarray, y: np.ndarray, weight: np.ndarray, n: int, decay: float = 3e-4, steps: int = 250, rate: float = 0.1) -> np.ndarray:
    """Weights of one-hot cells and a bias (last), by Adam over the whole sample."""
    w = np.zeros(n + 1)
    share = np.clip((y * weight).sum() / weight.sum(), 0.01, 0.99)
    w[-1] = np.log(share / (1 - share))
    m, v = np.zeros_like(w), np.zeros_like(w)
    weight = weight / weight.sum()
    for step in range(1, steps + 1):
        g = (sigmoid(w[cells].sum(axis=1) + w[-1]) - y) * weight
        full = np.append(np.bincount(cells.ravel(), np.repeat(g, cells.shape[1]), n) + decay * w[:-1], g.sum())
        m, v = 0.9 * m + 0.1 * full, 0.999 * v + 0.001 * full * full
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def linear(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Logistic regression on a few columns by Newton's method; the bias is last. No rows: the columns' sum."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.append(np.ones(x.shape[1] - 1), 0.0)
    if len(np.unique(y)) < 2:
        return w
    keep = np.append(np.full(x.shape[1] - 1, ridge), 1e-6)
    for _ in range(steps):
        p = sigmoid(x @ w)
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (p - y) + keep * (w - np.append(np.ones(x.shape[1] - 1), 0)))
    return w


@dataclass
class CoModel:
    """Both views, their calibrations, and the weights that combine them."""

    edges: np.ndarray  # of the text features' bins
    text: np.ndarray
    meta: np.ndarray
    calibration: list[np.ndarray]
    combined: np.ndarray

    def views(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated log-odds of both views, and the combined score."""
        z = [self.text[cells_of(text, self.edges)].sum(axis=1) + self.text[-1], self.meta[meta].sum(axis=1) + self.meta[-1]]
        z = [c[0] * x + c[1] for c, x in zip(self.calibration, z, strict=True)]
        return sigmoid(z[0]), sigmoid(z[1]), sigmoid(np.column_stack(z) @ self.combined[:-1] + self.combined[-1])


def cells_of(text: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.column_stack([k * BINS + np.searchsorted(edges[k], text[:, k], side="right") for k in range(N_TEXT)])


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, calibrates: np.ndarray, rounds: int = ROUNDS, share: float = SHARE, sure: float = SURE) -> CoModel:
    """Train on rows whose y is 0 or 1, with pseudo-labels for those where it is -1; rows that calibrate are learned by neither view."""
    edges = np.quantile(text, np.arange(1, BINS) / BINS, axis=0).T if len(text) else np.zeros((N_TEXT, BINS - 1))
    views = [cells_of(text, edges) if len(text) else np.zeros((0, N_TEXT), np.int64), meta]
    sizes = [N_TEXT * BINS, SOURCES + LANGS + LENGTHS]
    calibrates = calibrates & (y >= 0)
    known = (y >= 0) & ~calibrates
    if len(np.unique(y[known])) < 2:
        return CoModel(edges, np.zeros(sizes[0] + 1), np.zeros(sizes[1] + 1), [np.array([1.0, 0.0])] * 2, np.array([1.0, 1.0, 0.0]))
    labels = [np.where(known, y, -1).astype(float) for _ in views]
    pool = y < 0
    prior = y[known].mean()

    def fit(k: int) -> np.ndarray:
        own = labels[k] >= 0
        return logistic(views[k][own], labels[k][own], np.where(known[own], 1.0, 0.5), sizes[k])

    weights = [fit(k) for k in range(2)]
    for _ in range(rounds):
        taken = np.zeros(len(y), dtype=bool)
        for k in range(2):
            p = sigmoid(weights[k][views[k]].sum(axis=1) + weights[k][-1])
            for label, mass in ((1, prior), (0, 1 - prior)):
                confidence = p if label else 1 - p
                own = np.flatnonzero(pool & (confidence >= sure))
                own = own[np.argsort(-confidence[own], kind="stable")][: max(1, int(share * mass * pool.sum()))]
                labels[1 - k][own] = label
                taken[own] = True
        if not taken.any():
            break
        pool &= ~taken
        weights = [fit(k) for k in range(2)]
    z = [weights[k][views[k][calibrates]].sum(axis=1) + weights[k][-1] for k in range(2)]
    calibration = [linear(x[:, None], y[calibrates]) for x in z]
    combined = linear(np.column_stack([c[0] * x + c[1] for c, x in zip(calibration, z, strict=True)]), y[calibrates])
    return CoModel(edges, *weights, calibration, combined)


def _columns(docs: DataFrame, doc_id: str, text: str, source: str, lang: str, n_chars: str) -> DataFrame:
    return docs.select(*[F.col(f"`{c}`").alias(n) for n, c in (("doc_id", doc_id), ("text", text), ("source", source), ("lang", lang), ("n_chars", n_chars))])


def _features(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    meta = [meta_features(s, g, None if pd.isna(n) else float(n)) for s, g, n in zip(batch["source"], batch["lang"], batch["n_chars"], strict=True)]
    return np.array([text_features(t) for t in batch["text"]]), np.array(meta, dtype=np.int64)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", n_chars: str = "n_chars", label: str = "quality", folds: int = FOLDS, max_labelled: int = MAX_LABELLED, max_unlabelled: int = MAX_UNLABELLED) -> CoModel:
    """Learn from rows outside fold 0; rows of ``labels`` without id or label teach nothing, of repeated ones the greater label counts."""
    rows = _columns(docs, doc_id, text, source, lang, n_chars)
    may = fold("doc_id", folds) != 0
    by_hash = lambda df, k: df.orderBy(F.xxhash64("doc_id", F.lit(4)), "doc_id").limit(k)
    known = labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & may).groupBy("doc_id").agg(F.max("y").alias("y"))
    some = by_hash(rows.select("doc_id").filter(F.col("doc_id").isNotNull() & may), max_unlabelled).select("doc_id", F.lit(-1).alias("y"))
    # At most max_labelled + max_unlabelled rows of two numbers: small enough to broadcast.
    chosen = by_hash(known, max_labelled).unionByName(some).groupBy("doc_id").agg(F.max("y").alias("y"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x, meta = _features(batch)
                yield pd.DataFrame({"id": batch["id"], "y": batch["y"], "calibrates": batch["calibrates"], "x": list(x), "meta": list(meta)})

    own = rows.join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").cast("string").alias("id"), "y", (fold("doc_id", folds) == CALIBRATION_FOLD).alias("calibrates"), "text", "source", "lang", "n_chars")
    found = own.mapInPandas(run, "id string, y int, calibrates boolean, x array<double>, meta array<long>").toArrow().to_pandas().sort_values("id", kind="stable")
    if not len(found):
        return co_train(np.zeros((0, N_TEXT)), np.zeros((0, 3), np.int64), np.zeros(0), np.zeros(0, bool))
    return co_train(np.stack(found["x"]), np.stack(found["meta"]), found["y"].to_numpy(), found["calibrates"].to_numpy())


def score_quality(docs: DataFrame, model: CoModel, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", n_chars: str = "n_chars", folds: int = FOLDS) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted (1 if score >= 0.5), text_score, meta_score.

    A null text counts as empty, null metadata are cells of their own; repeated rows score alike. An empty table
    gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                by_text, by_meta, both = shared.value.views(*_features(batch))
                yield pd.DataFrame({"doc_id": batch["doc_id"], "score": both, "text_score": by_text, "meta_score": by_meta})

    scored = _columns(docs, doc_id, text, source, lang, n_chars).mapInPandas(run, f"doc_id {kind}, score double, text_score double, meta_score double")
    return scored.select("doc_id", (fold("doc_id", folds) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "text_score", "meta_score")
