"""Brown class-based n-gram scoring.

Words go to classes by exchange: each item moves to the class that raises the likelihood of the
corpus' class bigrams most, until nothing moves. The items are the most frequent words, and for
all other words the groups that share an ending. Then each further frequent word moves, beside
these fixed classes, to the class in which its own neighbours are likeliest; only words rarer than
those, and unknown ones, keep the class of their ending. The model is
P(class | class before) * P(word | class), both smoothed.

All counts cover the whole training part. Texts are turned into word numbers once; the passes
after that read only the numbers. Frequent words' counts and classes are broadcast, a bounded
number of them; the others meet their counts in a join, so the vocabulary never has to fit
anywhere.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, written

FOLDS = 10
SMOOTHING = 0.1
#: Words that are items of their own, groups of endings, classes, and words whose counts and classes are broadcast.
ITEM_WORDS, ENDINGS, CLASSES, HEAD = 768, 256, 64, 200_000
#: Neighbours on either side that a word's ending counts as, beside the word's own.
PRIOR = 4.0
#: Pseudo-counts of the class unigram in a transition.
TRANSITION = 8.0
#: The end of a text; no word holds a space.
END = b" "
#: Entries of a counter or memory before it is emptied.
ROOM = 400_000
#: Word numbers counted at once, neighbours gathered before they are sent, words of a block, and map tasks that one first sum takes.
RUN, GATHERED, BLOCK, FAN_IN = 1 << 18, 1 << 21, 256, 256


def tokens_of(text: str | None) -> list[bytes]:
    """Words in lower-case ASCII letters between ASCII white space, then the end."""
    return [*(text or "").encode("utf-8", "replace").lower().split(), END]


class Items(dict):
    """Word to item: a number of its own, or that of its ending."""

    def __init__(self, words: list[bytes]):
        super().__init__((w, i) for i, w in enumerate(words))
        self.own, self.n = len(words), len(words) + ENDINGS

    def __missing__(self, word: bytes) -> int:
        found = self.own + zlib.crc32(word[-3:]) % ENDINGS
        if len(self) < ROOM and len(word) < 64:
            self[word] = found
        return found


def exchange(bigrams: np.ndarray, classes: int, sweeps: int = 20) -> np.ndarray:
    """The class of each item, by exchanging items as long as the class bigram likelihood rises."""
    n = len(bigrams)
    classes = max(1, min(classes, n))
    total = bigrams.sum(axis=0) + bigrams.sum(axis=1)
    order = np.argsort(-total, kind="stable")
    of = np.empty(n, dtype=np.int64)
    of[order] = np.arange(n) % classes
    onto = np.eye(classes)[of]
    to_class, from_class = bigrams @ onto, bigrams.T @ onto  # of items with classes after and before
    table = onto.T @ to_class
    f = lambda x: x * np.log(np.maximum(x, 1))
    for _ in range(sweeps):
        moved = 0
        for w in order:
            if not total[w]:
                continue
            k, same = of[w], bigrams[w, w]
            r, q = to_class[w].copy(), from_class[w].copy()
            r[k] -= same
            q[k] -= same
            table[k] -= r
            table[:, k] -= q
            table[k, k] -= same
            before = f(table)
            rows, columns = f(table + r) - before, f(table + q[:, None]) - before
            own = np.arange(classes)
            gain = rows.sum(axis=1) - rows[own, own] + columns.sum(axis=0) - columns[own, own] + f(table[own, own] + r + q + same) - before[own, own]
            out, into = table.sum(axis=1), table.sum(axis=0)
            gain -= f(out + r.sum() + same) - f(out) + f(into + q.sum() + same) - f(into)
            best = int(np.argmax(gain))
            if gain[best] <= gain[k] + 1e-9:
                best = k
            table[best] += r
            table[:, best] += q
            table[best, best] += same
            if best != k:
                moved += 1
                of[w] = best
                to_class[:, k] -= bigrams[:, w]
                to_class[:, best] += bigrams[:, w]
                from_class[:, k] -= bigrams[w]
                from_class[:, best] += bigrams[w]
        if moved <= n // 200:
            break
    return of


@dataclass
class ClassModel:
    """What the workers need. ``classes`` and ``known`` go by the number that ``Items`` gives a word."""

    words: list[bytes]
    classes: np.ndarray
    steps: np.ndarray  # log10 of transition over the class' emission denominator, by class before and class
    known: np.ndarray  # log10(count + smoothing); nan where the count is not broadcast
    tokens: int = 0
    vocabulary: int = 0

    @property
    def base_denominator(self) -> float:
        return float(np.log10(self.tokens + SMOOTHING * (self.vocabulary + 1)))


def most_frequent(counts: DataFrame, most: int) -> pd.DataFrame:
    """The words above the least frequency that ``most`` words or fewer reach, most frequent first; ties are in or out together."""
    level = F.when(F.col("n") < 1024, F.col("n")).otherwise(F.floor(F.log2("n") * 64) + 384).cast("long")  # a few thousand steps at any size
    steps = sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True)
    least, n = float("inf"), 0
    for step, more in steps:
        if (n := n + more) > most:
            break
        least = step
    if least == float("inf"):
        return pd.DataFrame({"word": [], "n": []})
    found = counts.filter(level >= least).toArrow().to_pandas()
    return found.sort_values(["n", "word"], ascending=[False, True], ignore_index=True)


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = FOLDS, item_words: int = ITEM_WORDS, classes: int = CLASSES, head: int = HEAD) -> tuple[ClassModel, DataFrame]:
    """Learn from all rows outside fold 0; the model, and the table of all words' counts (word, n)."""
    texts = docs.filter(fold(f"`{doc_id}`", folds) != 0).select(F.col(f"`{text}`").alias("text"))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: Counter[bytes] = Counter()
        out = lambda: pd.DataFrame({"word": list(own), "n": list(own.values())})
        for batch in batches:
            for t in batch["text"]:
                own.update(tokens_of(t))
                if len(own) > ROOM:
                    yield out()
                    own.clear()
        yield out()

    counts = written(texts.mapInPandas(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    tokens, vocabulary = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    top = most_frequent(counts, head)
    n_of = dict(zip(map(bytes, top["word"]), top["n"].tolist(), strict=True))
    words = [END, *[w for w in n_of if w != END]]
    own_items = min(len(words), item_words + 1)
    size = own_items + ENDINGS
    # The item of each number: its own, or its ending's.
    ending = np.array([own_items + zlib.crc32(w[-3:]) % ENDINGS for w in words], dtype=np.int64)
    item_of = np.concatenate([np.arange(own_items), ending[own_items:], own_items + np.arange(ENDINGS)])
    share = docs.sparkSession.sparkContext.broadcast
    shared, shared_items = share(words), share(item_of)

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = Items(shared.value)
        for batch in batches:
            yield pd.DataFrame({"ids": [np.fromiter(map(items.__getitem__, tokens_of(t)), dtype=np.int32).tobytes() for t in batch["text"]]})

    def grouped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = Items(shared.value)
        n = np.zeros(items.n, dtype=np.int64)
        for batch in batches:
            n += np.bincount([items[bytes(w)] for w in batch["word"]], minlength=items.n)
        some = np.flatnonzero(n)
        yield pd.DataFrame({"at": some, "n": n[some]})

    def counted_pairs(of, k: int) -> np.ndarray:
        """How often each of ``k`` kinds follows each, by the broadcast kind of each number."""

        def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            table = np.zeros(k * k, dtype=np.int64)
            for before, own in neighbours(batches):
                table += np.bincount(of.value[before] * k + of.value[own], minlength=k * k)
            some = np.flatnonzero(table)
            yield pd.DataFrame({"at": some, "n": table[some]})

        return summed(ids.mapInPandas(pairs, "at long, n long"), k * k).reshape(k, k)

    ids = written(texts.mapInPandas(numbered, "ids binary"))
    bigrams = counted_pairs(shared_items, size)
    of = exchange(bigrams, classes)
    k = int(of.max()) + 1
    onto = np.eye(k)[of]
    table = onto.T @ bigrams @ onto
    classes_of = of[item_of]
    if len(words) > own_items:
        transition, members = transitions(table)
        # What an item's ending has for neighbours, as shares of one; rows by item.
        sides = [x / np.maximum(x.sum(axis=1, keepdims=True), 1) for x in (bigrams.T @ onto, bigrams @ onto)]
        prior = PRIOR * np.concatenate(sides, axis=1)[own_items:]
        weigh = np.concatenate([np.log(transition), np.log(transition.T)]) - np.concatenate([np.tile(np.log(members + SMOOTHING), (k, 1)), np.zeros((k, k))])
        classes_of[own_items : len(words)] = own_classes(ids, share(classes_of), own_items, len(words), k, prior, ending[own_items:] - own_items, weigh)
        table = counted_pairs(share(classes_of), k)
    transition, members = transitions(table)
    distinct = np.bincount(classes_of, summed(counts.mapInPandas(grouped, "at long, n long"), len(classes_of)), k)
    steps = np.log10(transition) - np.log10(members + SMOOTHING * (distinct + 1))
    known = np.full(len(classes_of), np.nan)
    known[: len(words)] = [np.log10(n_of[w] + SMOOTHING) if w in n_of else np.nan for w in words]
    return ClassModel(words, classes_of, steps, known, int(tokens), int(vocabulary)), counts


def summed(found: DataFrame, size: int) -> np.ndarray:
    """Sums of ``n`` by ``at``, which is below ``size``: at most so many rows."""
    rows = found.groupBy("at").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    out = np.zeros(size)
    out[rows["at"].to_numpy(np.int64)] = rows["n"].to_numpy(np.float64)
    return out


def transitions(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(class | class before), smoothed by the class unigram, and the tokens of each class."""
    members = table.sum(axis=0)
    unigram = (members + SMOOTHING) / (members + SMOOTHING).sum()
    return (table + TRANSITION * unigram) / (table.sum(axis=1, keepdims=True) + TRANSITION), members


def neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of word numbers with the numbers before them. As every text ends with END, number 0, it also comes before every first word."""
    for batch in batches:
        flat = np.frombuffer(b"".join(batch["ids"]), dtype=np.int32)
        for at in range(0, len(flat), RUN):
            own = flat[at : at + RUN].astype(np.int64)
            yield np.concatenate([[flat[at - 1] if at else 0], own[:-1]]), own


def own_classes(ids: DataFrame, classes, first: int, last: int, k: int, prior: np.ndarray, ending: np.ndarray, weigh: np.ndarray) -> np.ndarray:
    """The class of each word number from ``first`` on and before ``last``: where its neighbours' classes, counted over all texts, are likeliest.

    ``prior`` has a row for each ending, ``ending`` the row of each word. Words are dealt to blocks in turn, so that each has frequent and rare ones. A block's counts are
    packed arrays, summed first for ``FAN_IN`` map tasks at a time and then as a whole.
    """
    blocks = -(-(last - first) // BLOCK)
    cells = BLOCK * 2 * k

    def packed(block: int, keys: np.ndarray, n: np.ndarray) -> tuple:
        return block, keys.astype(np.min_scalar_type(cells)).tobytes(), n.astype(np.min_scalar_type(n.max())).tobytes()

    def gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, kept, held = classes.value, [], 0

        def out() -> pd.DataFrame:
            keys, n = np.unique(np.concatenate(kept), return_counts=True)
            cuts = np.searchsorted(keys, np.arange(blocks + 1) * cells)
            return pd.DataFrame([packed(b, keys[i:j] - b * cells, n[i:j]) for b, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)) if i < j], columns=["block", "keys", "n"])

        def cell(word: np.ndarray, side: np.ndarray) -> np.ndarray:
            block, place = (word - first) % blocks, (word - first) // blocks
            return block * cells + place * 2 * k + side

        for before, own in neighbours(batches):
            for word, side in ((own, of[before]), (before, k + of[own])):
                some = (word >= first) & (word < last)
                kept.append(cell(word[some], side[some]))
                held += len(kept[-1])
            if held > GATHERED:
                yield out()
                kept, held = [], 0
        if held:
            yield out()

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, np.ndarray]]:
        """Counts by block, of a partition sorted by block; one block is held."""
        last_block, table = None, None
        for batch in batches:
            for block, keys, n in zip(batch["block"], batch["keys"], batch["n"], strict=True):
                if block != last_block:
                    if table is not None:
                        yield last_block, table
                    last_block, table = int(block), np.zeros(cells, dtype=np.int64)
                at = np.frombuffer(keys, np.min_scalar_type(cells))
                table[at] += np.frombuffer(n, f"u{len(n) // len(at)}").astype(np.int64)
        if table is not None:
            yield last_block, table

    def partly(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block, table in sums(batches):
            some = np.flatnonzero(table)
            yield pd.DataFrame([packed(block, some, table[some])], columns=["block", "keys", "n"])

    side = ids.sparkSession.sparkContext.broadcast((prior, ending, weigh))

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prior, ending, weigh = side.value
        for block, table in sums(batches):
            words = np.arange(block, last - first, blocks)
            best = ((table.reshape(BLOCK, 2 * k)[: len(words)] + prior[ending[words]]) @ weigh).argmax(axis=1)
            yield pd.DataFrame({"word": words, "class": best})

    schema = "block int, keys binary, n binary"
    found = ids.mapInPandas(gathered, schema).withColumn("part", F.floor(F.spark_partition_id() / FAN_IN))
    # Sorted by part and block: a change of either starts a new sum.
    found = found.repartition("block", "part").sortWithinPartitions("part", "block").select("block", "keys", "n").mapInPandas(partly, schema)
    found = found.repartition("block").sortWithinPartitions("block").mapInPandas(judged, "word long, class long").toArrow().to_pandas()  # a row for each word
    out = np.zeros(last - first, dtype=np.int64)
    out[found["word"].to_numpy(np.int64)] = found["class"].to_numpy(np.int64)
    return out


def score_lm(docs: DataFrame, model: ClassModel, counts: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = FOLDS) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Scores are log10 probabilities of whole texts with their end. Null and empty texts are an end alone.
    Words unseen in training keep the smoothing's share of their class. Repeated rows score alike; an empty
    training part gives every word the whole share; an empty table gives no rows. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[doc_id].dataType.simpleString()

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        items = Items(model.words)
        before = model.classes[0]
        for batch in batches:
            out = []
            for t in batch["text"]:
                own = tokens_of(t)
                at = np.fromiter(map(items.__getitem__, own), dtype=np.int64)
                classes, emitted = model.classes[at], model.known[at]
                steps = float(model.steps[np.concatenate([[before], classes[:-1]]), classes].sum())
                open_at = np.flatnonzero(np.isnan(emitted))
                rest = Counter(own[i] for i in open_at)
                out.append((len(own), steps, float(np.nansum(emitted)), len(own) - len(open_at), [{"word": w, "k": k} for w, k in rest.items()]))
            yield pd.DataFrame(out, columns=["n_tokens", "steps", "emitted", "n_known", "rest"]).assign(doc_id=batch["doc_id"].array, row=batch["row"].array)

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.monotonically_increasing_id().alias("row"))
    # Written, as row numbers must be the same wherever they are read again.
    seen = written(rows.mapInPandas(first, f"doc_id {kind}, row long, n_tokens long, steps double, emitted double, n_known long, rest array<struct<word: binary, k: long>>"))
    # What isn't broadcast: (row, word, times) meets the counts by word; only sums go back to the rows.
    rest = seen.select("row", F.explode("rest").alias("x")).select("row", "x.word", "x.k").join(counts, "word", "left")
    rest = rest.select("row", (F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + SMOOTHING)).alias("emitted"), F.when(F.col("n").isNull(), 0).otherwise(F.col("k")).alias("n_known"))
    sums = rest.groupBy("row").agg(F.sum("emitted").alias("more"), F.sum("n_known").alias("more_known"))
    both = seen.drop("rest").join(sums, "row", "left").select("doc_id", "n_tokens", "steps", (F.col("emitted") + F.coalesce("more", F.lit(0.0))).alias("emitted"), (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"))
    score = F.col("steps") + F.col("emitted")
    return both.select(
        "doc_id", (fold("doc_id", folds) == 0).alias("held_out"), "n_tokens", F.col("n_known").cast("long").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("emitted") - F.col("n_tokens") * F.lit(model.base_denominator)).alias("base_score"), score.alias("score"), F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"),
    )
