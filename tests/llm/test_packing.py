import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quern.llm.packing import CAPACITY, WordIds, best_fit_packing, layout, reduced

from .helpers import frame, rows

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["Hello, WORLD! it's we'll I'M", "a b　c d\u0085e", "\x1cx\x1fy\x00z", "naïve Ünï ÀÉ ẞ ß İ ı ǅ", "漢字かな 한국어 عربى हिन्दी ไทย", "𝄞 👍🏽 👨‍👩‍👧", "<|endoftext|> x<|startoftext|>y <|endoftext|", "é äx", "x" * 3000, "1234567890 3.14 1,000 ½ ² Ⅷ", "don't 'S 'Re o'clock ''ll", "_snake_case__ CamelCase #tag @at", "\t\n\x0b\x0c\r", "ſ K Å ﬁ", "`code` \\n {a:b} [c]"]


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_ids_are_the_tokenizers():
    tokenizer, words = Tokenizer.from_file(PATH), WordIds(PATH, room=200)
    import pandas as pd

    texts = [*ODD, *(t for _, t, *_ in rows()), *pd.read_parquet("/root/testdata/sf0.001/documents.parquet")["text"]]
    for t, data in zip(texts, words.texts(texts), strict=True):
        assert list(struct.unpack(f"<{len(data) // 4}I", data)) == ids_of(tokenizer, t), repr(t)[:80]


def check(data, found, capacity):
    tokenizer = Tokenizer.from_file(PATH)
    expected = Counter()
    for i, t, *_ in data:
        ids = ids_of(tokenizer, t)
        for k, a in enumerate(range(0, len(ids), capacity)):
            own = ids[a : a + capacity]
            expected[i, k, a, len(own), zlib.crc32(struct.pack(f"<{len(own)}I", *own))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == expected
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), -(-sum(r.length for r in found) // capacity)


@pytest.mark.parametrize("capacity, bucket_rows", [(CAPACITY, 2000), (16, 3)])
def test_round_trip(spark, capacity, bucket_rows):
    data = rows() + [(100 + i, " ".join(["word"] * (1 + i % 23)), None, None, None) for i in range(400)]
    found = best_fit_packing(frame(spark, extra=True, data=data), PATH, capacity=capacity, bucket_rows=bucket_rows).collect()
    n, least = check(data, found, capacity)
    assert least <= n <= least * 1.05 + 1
    again = best_fit_packing(frame(spark, data=data).repartition(9), PATH, capacity=capacity, bucket_rows=bucket_rows).collect()
    assert Counter(map(tuple, found)) == Counter(map(tuple, again)) or Counter((r.doc_id, r.piece) for r in found) == Counter((r.doc_id, r.piece) for r in again)


def test_empty_table(spark):
    assert best_fit_packing(frame(spark, empty=True), PATH).count() == 0


def best_fit_plain(lengths, capacity):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(rooms) if r >= x]
        if fits:
            rooms[min(fits, key=lambda k: rooms[k])] -= x
        else:
            rooms.append(capacity - x)
    return len(rooms)


def optimum(lengths, capacity):
    """The fewest sequences, by search over sets of pieces."""
    n = len(lengths)
    fits = [sum(lengths[i] for i in range(n) if s >> i & 1) <= capacity for s in range(1 << n)]
    best = [0] + [n] * ((1 << n) - 1)
    for s in range(1, 1 << n):
        low = s & -s
        t = s
        while t:
            if t & low and fits[t]:
                best[s] = min(best[s], 1 + best[s ^ t])
            t = (t - 1) & s
    return best[-1]


def test_layout_holds_every_piece_and_is_no_worse_than_best_fit():
    rng = np.random.default_rng(6)
    for _ in range(60):
        capacity = int(rng.integers(5, 60))
        lengths = rng.integers(1, capacity + 1, int(rng.integers(1, 120))).tolist()
        counts = np.bincount(lengths, minlength=capacity + 1)
        found = layout(counts, capacity)
        held = Counter()
        for own, m in found:
            assert sum(own) <= capacity and m > 0
            for x in own:
                held[x] += m
        assert held == Counter(lengths)
        assert sum(m for _, m in found) <= best_fit_plain(lengths, capacity) + 1


def test_reduction_keeps_the_optimum():
    rng = np.random.default_rng(7)
    for _ in range(60):
        capacity = int(rng.integers(6, 30))
        lengths = rng.integers(1, capacity + 1, int(rng.integers(1, 9))).tolist()
        fixed, left = reduced(np.bincount(lengths, minlength=capacity + 1), capacity)
        rest = np.repeat(np.arange(capacity + 1), left).tolist()
        assert sum(m for _, m in fixed) + (optimum(rest, capacity) if rest else 0) == optimum(lengths, capacity)
