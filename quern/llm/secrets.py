"""Secret scan: three fixed patterns, and strings that a primed compressor finds new.

A candidate is a long string shortly after a sensitive word. Zstandard is primed with a
dictionary of ordinary identifiers and the text around the candidate; the bytes that the
candidate adds are its novelty. Ordinary names and repeated words cost few bytes, random keys
almost what zstandard needs for random characters of their alphabet, and those are reported.
Strings without digits or without letters, and those that zstandard codes by characters'
frequency, must also be as new to pairs of characters as random ones, as words are not.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs of hex digits are maximal, so asking for 24 finds just those of 24 or more.
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_WORDS = ("passw", "secret", "token", "api")

SENSITIVE = re.compile(r"passw(?:or)?d|passphrase|pwd|secret|token|api_?key|apikey|private_?key|access_?key|auth(?:orization)?\b|bearer|credential|signature", re.ASCII | re.IGNORECASE)
SENSITIVE_PARTS = ("passw", "passphrase", "pwd", "secret", "token", "api", "private", "access", "auth", "bearer", "credential", "signature")
LEAST = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=.~-]{{{LEAST},}}")
#: Characters after a sensitive word in which a candidate may start, and those around it that prime the compressor.
REACH, AROUND = 64, 1024
#: Added bytes from which on a candidate is new, as a share of what random characters of its alphabet need.
NOVELTY = 0.8
#: Bits by pairs of characters from which on a candidate is no word, as a share of those that random characters need at least
#: (words have about 0.9, random letters 2, random digits 3 and more), and different characters that it must then have.
PAIRS, DIFFERENT = 1.25, 5
#: Zstandard stores fewer characters as they are. Alphabets count as having ten characters at least. Longer random strings cost as much a character.
STORED, LEAST_ALPHABET, LEVEL_FROM = 64, 10, 4096
#: Pseudo-counts of single characters in the counts of pairs.
BACK = 10.0
#: Identifiers and phrases of ordinary code and configuration.
IDENTIFIERS = b" ".join(
    f"{a}{b} {a.lower()}_{b.lower()} {a.lower()}-{b.lower()}".encode()
    for a in "Access Api App Auth Base Cache Client Cloud Config Content Cookie Data Database Default Device Encryption Environment Event File Http Internal Key Local Message Network Password Private Project Public Request Response Secret Security Server Service Session Storage System Token User".split()
    for b in "Address Builder Certificate Connection Context Controller Factory Handler Identifier Index Instance Interface Library Location Manager Name Number Parameter Path Policy Processor Provider Reference Register Repository Resource Signature String Timeout Update Value Version".split()
) + b" https://www.example.com/index.html?query=value&page=123 0123456789 1234567890 2024-01-01T00:00:00Z abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0000000000000000 xxxxxxxxxxxxxxxx "


def coded(data: bytes, **primed) -> int:
    """Bytes that ``data`` takes beyond an empty frame."""
    import zstandard

    compressor = zstandard.ZstdCompressor(level=9, write_checksum=False, write_content_size=False, write_dict_id=False, **primed)
    return len(compressor.compress(data)) - len(compressor.compress(b""))


def alphabet(candidate: bytes) -> int:
    return max(LEAST_ALPHABET, len(set(candidate)))


@cache
def random_size(letters: int, n: int) -> float:
    """Bytes that ``n`` random characters of so many letters take without a dictionary."""
    if n < STORED:
        return float(n)
    if n > LEVEL_FROM:
        return random_size(letters, LEVEL_FROM) * n / LEVEL_FROM
    return float(coded(bytes(random.Random(letters).choices(range(letters), k=n))))


def novelty(candidate: bytes, around: bytes, identifiers: bytes = IDENTIFIERS) -> float:
    """Bytes that a candidate adds to a compressor primed with identifiers and the text around it, by those that random characters of its alphabet need."""
    import zstandard

    primed = zstandard.ZstdCompressionDict(identifiers + around, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return coded(candidate, dict_data=primed) / max(1.0, random_size(alphabet(candidate), len(candidate)))


#: Letters of either case, digits, and one symbol for the rest.
_SYMBOLS = np.full(256, 36, dtype=np.int64)
_SYMBOLS[[*range(97, 123)]] = _SYMBOLS[[*range(65, 91)]] = np.arange(26)
_SYMBOLS[[*range(48, 58)]] = np.arange(26, 36)


def pair_counts(data: bytes) -> np.ndarray:
    own = _SYMBOLS[np.frombuffer(data, dtype=np.uint8)]
    return np.bincount(own[:-1] * 37 + own[1:], minlength=37 * 37).reshape(37, 37)


def pair_novelty(candidate: bytes, known: np.ndarray) -> float:
    """Bits of a candidate's characters, each after the one before, under the counts ``known``; by those of random hex digits, or letters, digits and others as far as it has them."""
    own = pair_counts(candidate)
    each = (known.sum(axis=0) + 1) / (known.sum() + 37)
    bits = -np.log2((known + BACK * each) / (known.sum(axis=1, keepdims=True) + BACK))
    has = own.sum(axis=0) + own.sum(axis=1) > 0
    letters = 26 if has[6:26].any() else 6 if has[:6].any() else 0
    return float((own * bits).sum() / (len(candidate) - 1) / np.log2(max(LEAST_ALPHABET, letters + 10 * has[26:36].any() + has[36])))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, unordered."""
    out = []
    lower = text.lower()  # only tells whether a search can succeed; offsets come from the text itself
    if any(w in lower for w in ASSIGN_WORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def is_new(candidate: bytes, around: bytes, pairs: np.ndarray, threshold: float, identifiers: bytes) -> bool:
    if novelty(candidate, around, identifiers) < threshold:
        return False
    if len(candidate) < STORED and any(c in b"0123456789" for c in candidate) and candidate.upper() != candidate.lower():
        return True
    return len(set(candidate)) >= DIFFERENT and pair_novelty(candidate, pairs) >= PAIRS


def novel_spans(text: str, taken: list[tuple[int, int, str]], threshold: float = NOVELTY, identifiers: bytes = IDENTIFIERS) -> list[tuple[int, int, str]]:
    """Further spans: strings after a sensitive word, not in ``taken``, that don't compress."""
    lower = text.lower()
    if not any(w in lower for w in SENSITIVE_PARTS):
        return []
    taken = sorted(x[:2] for x in taken)
    out: list[tuple[int, int, str]] = []
    done, at, pairs = 0, 0, None
    for word in SENSITIVE.finditer(text):
        last = word.end() + REACH
        b = max(done, word.end())
        # Only starts are searched for, and only within reach; a candidate is then taken to its own end.
        while b <= last and (start := CANDIDATE.search(text, b, last + LEAST)):
            a, b = CANDIDATE.match(text, start.start()).span()
            done = b
            while at < len(taken) and taken[at][1] <= a:
                at += 1
            own = text[a:b]
            if at < len(taken) and taken[at][0] < b:
                continue
            if pairs is None:  # of the text without its candidates, or a text full of keys would make keys ordinary
                pairs = pair_counts(identifiers) + pair_counts(CANDIDATE.sub(" ", text).encode("utf-8", "replace"))
            around = (text[max(0, a - AROUND) : a] + text[b : b + AROUND]).encode("utf-8", "replace")
            # As a whole, and in pieces where it is long: a key may be one part of it.
            parts = [own, *(own[min(k, len(own) - AROUND) :][:AROUND] for k in range(0, len(own), AROUND))] if len(own) > AROUND else [own]
            if not any(is_new(x.encode(), around, pairs, threshold, identifiers) for x in parts):
                continue
            out.append((a, b, "novel"))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]))))


def secret_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = NOVELTY, identifiers: bytes = IDENTIFIERS) -> DataFrame:
    """One row per input row: doc_id, spans (array of start, end, kind, value), ordered by start and kind.

    Offsets are code points, ends exclusive. A null text counts as empty, and empty texts have no spans.
    Repeated rows are reported each for itself, other columns are ignored; an empty table gives no rows.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for t in batch["text"]:
                t = t or ""
                base = base_spans(t)
                spans = sorted(base + novel_spans(t, base, threshold, identifiers), key=lambda x: (x[0], KINDS.index(x[2])))
                found.append([{"start": a, "end": b, "kind": k, "value": t[a:b]} for a, b, k in spans])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "spans": found})

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInPandas(scan, f"doc_id {kind}, spans array<struct<start int, end int, kind string, value string>>")


def redacted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", mask: str = "[secret]", **how) -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mask``; overlapping spans become one.

    Null and empty texts stay as they are, and so does an empty table; other columns are kept.
    """

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if not t:
                return t
            base, out, at = base_spans(t), [], 0
            for a, b, _ in sorted(base + novel_spans(t, base, **how)):
                if b > at:
                    out += [t[at:a], mask] if a >= at else []
                    at = b
            return "".join([*out, t[at:]])

        return texts.map(one)

    return docs.withColumn(text, clean(F.col(f"`{text}`")))


def span_digest(found: DataFrame) -> DataFrame:
    """The counts and digests of ``secret_scan``'s spans."""
    base = F.filter("spans", lambda x: x["kind"] != "novel")
    as_text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(as_text(base).cast("binary"), 256).alias("base_sha256"), as_text("spans").alias("spans"), n("novel"))
