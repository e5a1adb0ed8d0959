"""Best-fit packing of token pieces after dominance reduction.

There are at most ``capacity`` different piece lengths, so the whole packing problem is their
histogram, however many documents there are. The driver solves it on counts: lengths that a
small set provably dominates (Martello and Toth) are fixed for good, the rest is packed by
best-fit decreasing, both many sequences at a time. Pieces then look up their place by their
rank among the pieces of their length; ranks come from counts by bucket, so that no task
ever holds all pieces of one length.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, written

CAPACITY = 2048
#: Pieces for each bucket in which ranks are counted.
BUCKET_ROWS = 2_000
#: Words whose ids a worker remembers.
CACHE_WORDS = 150_000


class WordIds(dict):
    """Ids by word: those of a text are those of its white-space separated words, as the tokenizer drops white space.

    A word's ids are in turn those of its runs of letters, of its digits and of what is between. Runs go through
    a byte-pair encoder over the same vocabulary in which the end of a word is a byte that no UTF-8 text has;
    other scripts than Latin, where lower case and normal forms can depend on neighbours, and special tokens
    go through the tokenizer itself. Words are remembered for a while.
    """

    END = b"\xff"

    def __init__(self, path: str, room: int = CACHE_WORDS):
        import json

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.older: dict[bytes, bytes] = {}
        self.room = room
        self.runs_of = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
        of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        suffix = model["end_of_word_suffix"]
        ranks = {}
        for token, i in model["vocab"].items():
            if not token.startswith("<|"):
                end = token.endswith(suffix)
                ranks[bytes(of[c] for c in (token[: -len(suffix)] if end else token)) + self.END * end] = i
        # Merges have ids in the order of their ranks, those with the end of a word first.
        self.encode = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece

    def __missing__(self, word: bytes) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = self.fresh(word)
        if len(word) < 64:
            self[word] = found
        return found

    def fresh(self, word: bytes) -> bytes:
        lower = word.lower()
        core = lower.rstrip(b".,;:!?%&*#$\"|)-")
        if core.isalpha():  # of bytes: ASCII letters only
            runs = [core, lower[len(core) :]] if len(core) < len(lower) else [core]
        else:
            own = word.decode()
            if "<|" in own or (not own.isascii() and max(own) > "\u024f"):
                return np.array(self.tokenizer.encode(own, add_special_tokens=False).ids, "<u4").tobytes()
            runs = [r.encode() for r in self.runs_of(own.lower())]
        ids = self.encode(runs[0] + self.END) if runs else []
        for r in runs[1:]:
            ids = ids + self.encode(r + self.END)
        return struct.pack(f"<{len(ids)}I", *ids)

    def texts(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text, then id 0, as little-endian unsigned 32-bit numbers."""
        of = self.__getitem__
        for t in texts:
            if len(self) > self.room:
                self.older = dict(self)
                self.clear()
            yield b"".join([*map(of, (t or "").encode("utf-8", "replace").split()), b"\0\0\0\0"])


@cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. A null text counts as empty: its only id is 0."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = word_ids(tokenizer_path)
        for batch in batches:
            out = []
            for doc, ids in zip(batch["doc_id"], words.texts(batch["text"]), strict=True):
                for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[a : a + 4 * capacity]
                    out.append((doc, k, a // 4, len(own) // 4, zlib.crc32(own)))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return mapped(rows, cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


# Sequences are (lengths, how many of them) pairs; all sequences of a pair hold those lengths in that order.
Layout = list[tuple[tuple[int, ...], int]]


def reduced(counts: np.ndarray, capacity: int) -> tuple[Layout, np.ndarray]:
    """Fix the sets that dominate, by the tests of Martello and Toth's reduction; what is left to pack.

    With j the longest piece looked at, and k the most others that fit beside it: k = 0 fixes {j}. Else
    the longest j* that fits beside j is fixed with it if k = 1, if they fill the sequence, or if k = 2 and
    no pair that fits is longer than j*; a pair goes with j if k = 2 and its longer half is as long as j*
    and no other pair fits between.
    """
    left = counts.astype(np.int64).copy()
    fixed: Layout = []

    def fix(*lengths: int) -> bool:
        need = Counter(lengths)
        n = min(int(left[x]) // k for x, k in need.items())
        if n:
            fixed.append((tuple(lengths), n))
            for x, k in need.items():
                left[x] -= n * k
        return n > 0

    def longest(room: int, less: dict[int, int]) -> int:
        """The longest piece of at most ``room``, besides those in ``less``; 0: none."""
        for x in range(min(room, capacity), 0, -1):
            if left[x] - less.get(x, 0) > 0:
                return x
        return 0

    for j in range(capacity, 0, -1):
        while left[j] > 0:
            room, k, seen = capacity - j, 0, 0
            for x in np.flatnonzero(left):
                n = int(left[x]) - (x == j)
                take = min(n, (room - seen) // int(x), 3 - k)
                if n > take and take < 3 - k and (room - seen) // int(x) <= take:
                    k += take
                    break
                k, seen = k + take, seen + take * int(x)
                if k >= 3:
                    break
            best = longest(room, {j: 1})
            if k == 0 or not best:
                fix(j)
                continue
            if k == 1 or j + best == capacity:
                if fix(j, best):
                    continue
                break
            if k == 2:
                pair = (0, 0)
                for a in np.flatnonzero(left)[::-1]:
                    a = int(a)
                    if a < room and left[a] - (a == j) > 0 and (b := longest(min(a, room - a), Counter((j, a)))) and a + b > sum(pair):
                        pair = (a, b)
                if best >= sum(pair):
                    if fix(j, best):
                        continue
                elif best == pair[0] and not left[pair[1] + 1 : pair[0]].any() and fix(j, *pair):
                    continue
            break
    return fixed, left


def best_fit(counts: np.ndarray, capacity: int) -> Layout:
    """Best-fit decreasing, all pieces of a length at a time: each goes where the least room stays that holds it."""
    rooms: dict[int, list[list]] = {}
    for length in range(capacity, 0, -1):
        n = int(counts[length])
        for room in sorted(r for r in rooms if r >= length):
            while n and rooms.get(room):
                lengths, m = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                each = room // length
                full, rest = min(m, n // each), 0
                n -= full * each
                if full < m and n:
                    rest, n = n, 0
                for put, own in ((each, full), (rest, 1 if rest else 0), (0, m - full - (1 if rest else 0))):
                    if own:
                        rooms.setdefault(room - put * length, []).append([lengths + (length,) * put, own])
                if full < m:
                    break
        each = capacity // length
        if n // each:
            rooms.setdefault(capacity - each * length, []).append([(length,) * each, n // each])
        if n % each:
            rooms.setdefault(capacity - n % each * length, []).append([(length,) * (n % each), 1])
    return [(lengths, m) for found in rooms.values() for lengths, m in found]


def layout(counts: np.ndarray, capacity: int = CAPACITY) -> Layout:
    """All sequences for a histogram of piece lengths."""
    fixed, left = reduced(counts, capacity)
    return fixed + best_fit(left, capacity)


def slots(found: Layout) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length the rank intervals: their first rank, first sequence, places in a sequence, and where these begin in the list of offsets."""
    by: dict[int, list[list[int]]] = {}
    base = 0
    for lengths, m in found:
        at = 0
        own: dict[int, list[int]] = {}
        for x in lengths:
            own.setdefault(x, []).append(at)
            at += x
        for x, offsets in own.items():
            by.setdefault(x, []).append([base, m, offsets])
        base += m
    out = {}
    for x, rows in by.items():
        places = np.array([len(r[2]) for r in rows])
        ends = np.cumsum(places * np.array([r[1] for r in rows]))
        out[x] = (np.concatenate([[0], ends[:-1]]), np.array([r[0] for r in rows]), places, np.concatenate([[0], np.cumsum(places)[:-1]]), np.concatenate([r[2] for r in rows]))
    return out


def best_fit_packing(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every row of the input is packed, repeated rows as often as they come; null and empty texts are one
    piece of one id. Ties in length are placed by a hash of the id, so runs agree. An empty table gives
    no rows; other columns are ignored.
    """
    cut = written(pieces(docs, tokenizer_path, capacity, doc_id, text))
    buckets = max(1, cut.count() // bucket_rows)
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    by = written(cut.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in by.groupBy("length").agg(F.sum("n")).collect():  # at most ``capacity`` rows
        counts[length] = n
    shared = docs.sparkSession.sparkContext.broadcast(slots(layout(counts, capacity)))
    before = by.select("length", "bucket", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.join(before, ["length", "bucket"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.row_number().over(own) - 1).alias("rank"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for length, part in batch.groupby("length", sort=False):
                first, sequence, places, at, offsets = shared.value[length]
                rank = part["rank"].to_numpy()
                i = np.searchsorted(first, rank, side="right") - 1
                r = rank - first[i]
                out.append(part.drop(columns="rank").assign(sequence_id=sequence[i] + r // places[i], offset=offsets[at[i] + r % places[i]]))
            if out:
                yield pd.concat(out)

    kind = docs.schema[doc_id].dataType.simpleString()
    return mapped(ranked, place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
