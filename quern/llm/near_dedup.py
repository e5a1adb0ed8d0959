"""Near-duplicate documents by SetSketch registers over word shingles.

1. Each document's set of shingles becomes 64-bit hashes; documents with equal sets are one class. Sets are
   compared by these hashes from here on: two different shingles share one with probability 5e-20, so that
   a link is decided wrongly only where many of a pair's shingles happen to.
2. A class' sketch has registers of exponentially spaced, truncated minima: for each register the
   smallest of its shingles' exponential values, as a power of ``BASE``. Bands of registers are keys.
3. Classes that share a key with the key's smallest class are candidates of one family; families
   are the connected components of these stars, so no bucket's pairs are ever listed.
4. A family's members meet in blocks with a few common pivots; members with a common key share a block
   where it has room, and blocks are bounded in members and in bytes. In a block, register counts
   (larger, smaller, equal) give each pair's similarity by maximum likelihood; pairs that may reach the
   threshold are confirmed on full sets, unless already linked through others.
5. Large families have many blocks. Blocks with members that aren't yet linked to their family's largest
   part meet the blocks that share a band key with these, so that no candidate pair stays undecided.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fits, groups, hubs, mapped, spread_join, written
from .components import Union, components

SHINGLE, PERCENT = 5, 85
#: A pair at the threshold shares no key with probability (1 - 0.85 ** ROWS) ** BANDS = 7e-7.
BANDS, ROWS = 30, 6
REGISTERS = BANDS * ROWS
#: Neighbouring register values differ by this factor of the minimum.
BASE = 1.001
#: Members of a block, and pivots that a family's blocks share.
BLOCK, WIDE_BLOCK, PIVOTS = 64, 512, 4
#: Pairs whose likelihood at the threshold is lower than the greatest by more than this are not confirmed (5 standard deviations).
SLACK = 12.5
#: Most bytes of full sets in a block, as far as whole sets allow.
BLOCK_BYTES = 8 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTES = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_PLACES = _rng.integers(1, 2**63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_XOR = _rng.integers(0, 2**32, REGISTERS, dtype=np.uint32)
_MUL = _rng.integers(0, 2**32, REGISTERS, dtype=np.uint32) | np.uint32(1)
_BANDS = _rng.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_STEP = 0x9E3779B97F4A7C15
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
#: Bytes hashed at once.
SLICE = 1 << 21
_powers: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, SLICE + 1)
        inverse = pow(_STEP, -1, 1 << 64)
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)]), dtype=np.uint64) for x in (_STEP, inverse)]
    return _powers


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of ``data`` between ASCII white space, and where they start."""
    raw = np.frombuffer(data, dtype=np.uint8)
    space = _SPACES[raw]
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):  # slices of whole words, so that sums of one slice are all that is held
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + SLICE, side="right")))
        a, b = int(starts[at]), int(ends[to - 1])
        up, down = _powers_to(b - a + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[raw[a:b]] * up[: b - a], dtype=np.uint64)])
        s = starts[at:to] - a
        out[at:to] = mixed((sums[ends[at:to] - a] - sums[s]) * down[s])
        at = to
    return out, starts


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    raw = [(t or "").encode("utf-8", "replace").lower() for t in texts]
    offsets = np.cumsum([0, *(len(r) + 1 for r in raw)])
    words, starts = word_hashes(b" ".join(raw))
    firsts = np.searchsorted(starts, offsets)
    n = len(words) - SHINGLE + 1
    all_ = mixed(sum(words[k : n + k] * _PLACES[k] for k in range(SHINGLE))) if n > 0 else np.zeros(0, np.uint64)
    for a, b in zip(firsts, firsts[1:], strict=False):
        if b - a >= SHINGLE:
            yield np.unique(all_[a : b - SHINGLE + 1])
        elif b > a:  # fewer words: the whole sequence, apart from all longer ones
            yield mixed((words[a:b] * _PLACES[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def registers_of(own: np.ndarray) -> np.ndarray:
    """The sketch of a set of hashes; registers of united sets are the greater of theirs."""
    high = (own >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, dtype=np.uint32)
    for a in range(0, len(high), 256):
        np.minimum(least, ((high[a : a + 256, None] ^ _XOR) * _MUL).min(axis=0), out=least)
    exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2**32)
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, 65535).astype(np.uint16)


def band_keys(registers: np.ndarray) -> np.ndarray:
    parts = registers.reshape(BANDS, ROWS).astype(np.uint64)
    return mixed((parts * _BANDS).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(_STEP)).view(np.int64)


def likely(larger: np.ndarray, smaller: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether pairs may reach the threshold: their register counts' likelihood there against the greatest over all similarities."""
    u = n_a / (n_a + n_b)
    v = 1 - u
    equal = REGISTERS - larger - smaller
    most = np.minimum(u / v, v / u)
    p_b = lambda x: -np.log1p(-np.clip(x, 1e-9, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def fit(j: np.ndarray) -> np.ndarray:
        above, below = p_b(u - v * j), p_b(v - u * j)
        return larger * np.log(above) + smaller * np.log(below) + equal * np.log(np.clip(1 - above - below, 1e-9, 1))

    at = fit(np.minimum(threshold, most))
    best, where = at.copy(), np.full(len(at), threshold)
    for share in np.linspace(0, 1, 33):
        now = fit(most * share)
        where = np.where(now > best, most * share, where)
        best = np.maximum(best, now)
    return (where >= threshold) | (best - at <= SLACK)


def links(sets: list[np.ndarray], registers: np.ndarray, percent: int, known: Union, some: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what is similar, confirmed on full sets; none between members that ``known`` has linked.

    some: marks members of which each pair must hold one at least.
    """
    n = np.array([len(s) for s in sets], dtype=np.float64)
    pairs = []
    for i in range(len(sets) - 1):
        j = np.arange(i + 1, len(sets))
        if some is not None and not some[i]:
            j = j[some[j]]
        j = j[100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])]
        if not n[i] or not len(j):
            continue
        larger = (registers[i] > registers[j]).sum(axis=1)
        smaller = (registers[i] < registers[j]).sum(axis=1)
        ok = likely(larger, smaller, np.full(len(j), n[i]), n[j], percent / 100)
        pairs += zip((larger + smaller)[ok].tolist(), [i] * int(ok.sum()), j[ok].tolist(), strict=True)
    out = []
    for _, i, j in sorted(pairs):  # the most similar first, so that few others need be confirmed
        if known.root(i) != known.root(j):
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                known.join(i, j)
                out.append((i, j))
    return out


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the text), n_shingles, digest of the set, registers (both null for empty sets) of ``docs`` (doc_id, key, text)."""
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", "key"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                out = []
                for own in shingle_sets(list(part["text"])):
                    out.append((len(own), hashlib.blake2b(own.tobytes(), digest_size=16).digest(), registers_of(own).tobytes()) if len(own) else (0, None, None))
                yield pd.DataFrame(out, columns=["n_shingles", "digest", "registers"]).assign(doc_id=part["doc_id"].array, key=part["key"].array)

    return mapped(docs, run, f"{kinds}, n_shingles long, digest binary, registers binary")


def band_table(classes: DataFrame) -> DataFrame:
    """key, id of the bands that two or more classes share."""
    kind = classes.schema["id"].dataType.simpleString()

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = [band_keys(np.frombuffer(r, np.uint16)) for r in batch["registers"]]
            yield pd.DataFrame({"key": np.concatenate(keys), "id": batch["id"].repeat(BANDS).array}) if keys else pd.DataFrame({"key": [], "id": []})

    return written(mapped(classes.select("id", "registers"), keyed, f"key long, id {kind}"))


def families(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes connected by shared band keys (id, family, lead, crowd), and the shared keys of each (key, id); classes that share none are left out.

    ``lead`` is one of a class' shared keys, ``crowd`` how many classes have that key.
    """
    keys = band_table(classes)
    heads = written(keys.groupBy("key").agg(F.min("id").alias("head"), F.count_distinct("id").alias("n")).filter("n > 1"))
    shared = written(spread_join(keys, heads, ["key"], hubs(heads, ["key"]), "id"))
    found = components(shared.filter("id != head").select(F.col("id").alias("a"), F.col("head").alias("b")))
    leads = shared.groupBy("id").agg(F.min_by("key", F.struct(-F.col("n"), "key")).alias("lead"), F.max("n").alias("crowd"))
    return found.join(leads, "id").select("id", F.col("component").alias("family"), "lead", "crowd"), shared.select("key", "id")


def confirmed(tiles: DataFrame, percent: int, kind: str) -> DataFrame:
    """Links (a, b) inside each tile (family, x, y); ``own`` marks the members of which a pair must hold one, ``part`` what is linked already."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for tile in groups(batches, ["family", "x", "y"]):
            tile = tile.drop_duplicates("id") if tile["part"].isna().all() else tile.sort_values("own", ascending=False, kind="stable").drop_duplicates("id")
            ids = tile["id"].tolist()
            sets = [np.frombuffer(s, np.uint64) for s in tile["hashes"]]
            known = Union(len(ids))
            if tile["part"].notna().any():
                firsts: dict = {}
                for k, p in enumerate(tile["part"].tolist()):
                    known.join(firsts.setdefault(p, k), k)
            found = links(sets, np.stack([np.frombuffer(r, np.uint16) for r in tile["registers"]]), percent, known, tile["own"].to_numpy(bool))
            if found:
                yield pd.DataFrame({"a": [ids[i] for i, _ in found], "b": [ids[j] for _, j in found]})

    n = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tiles.select("family", "x", "y", "id", "hashes", "registers", "own", "part").repartition(n, "family", "x", "y").sortWithinPartitions("family", "x", "y")
    return mapped(dealt, run, f"a {kind}, b {kind}")


def linked(docs: DataFrame, members: DataFrame, shared: DataFrame, percent: int, block: int, wide_block: int) -> DataFrame:
    """Links that connect exactly what the pairs of similar members of each family connect.

    ``members``: id, doc_id, key, n_shingles, family, lead, crowd; ``shared``: key, id.
    """
    kind = members.schema["id"].dataType.simpleString()

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                sets = list(shingle_sets(list(part["text"])))
                yield part.drop(columns="text").assign(hashes=[s.tobytes() for s in sets], registers=[registers_of(s).tobytes() for s in sets])

    sizes = members.groupBy("family").agg(F.count(F.lit(1)).alias("size"), F.sum(8 * F.col("n_shingles")).alias("bytes"))
    blocks = lambda n: F.ceil(F.greatest(F.col("size") / n, F.col("bytes") / BLOCK_BYTES)).cast("int")
    placed = written(members.join(sizes, "family").withColumns({"blocks": blocks(block), "wide": blocks(wide_block), "each": F.col("bytes") / F.col("size")}).drop("n_shingles", "size", "bytes"))
    side = placed.withColumnsRenamed({"doc_id": "own_id", "key": "own_key"})
    texts = docs.join(F.broadcast(side) if fits(side) else side, (F.col("doc_id") == F.col("own_id")) & (F.col("key") == F.col("own_key")))
    # Repeated rows are one member.
    texts = texts.select("id", "family", "lead", "crowd", "each", "blocks", "wide", "text").dropDuplicates(["id"])
    full = written(mapped(texts, hashed, f"id {kind}, family {kind}, lead long, crowd long, each double, blocks int, wide int, hashes binary, registers binary"))

    def dealt(n: str, most: int) -> Column:
        """A block among ``n``: members with a common lead share one, unless they are too many for it."""
        parts = F.greatest(F.lit(1), F.ceil(F.greatest(F.col("crowd") / most, F.col("crowd") * F.col("each") / BLOCK_BYTES))).cast("long")
        return F.pmod(F.xxhash64("lead", F.pmod(F.xxhash64("id"), parts)), F.col(n)).cast("int")

    large = full.filter("blocks > 1")
    pivots = large.groupBy("family", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(PIVOTS)).alias("slot")).agg(F.min("id").alias("id"))
    spread = large.join(pivots.select("family", "id"), ["family", "id"]).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    fixed = [F.lit(0).alias("y"), F.lit(True).alias("own"), F.lit(None).cast(kind).alias("part")]
    base = ["family", "x", "id", "hashes", "registers"]
    first = written(confirmed(full.withColumn("x", dealt("blocks", block)).select(*base, *fixed).unionByName(spread.select(*base, *fixed)), percent, kind))
    if not large.limit(1).count():
        return first
    parts = components(first)
    now = large.join(parts, "id", "left").withColumn("part", F.coalesce("component", "id")).drop("component")
    shares = now.groupBy("family", "part").agg(F.count(F.lit(1)).alias("n"))
    main = shares.groupBy("family").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    now = written(now.join(main, "family").withColumn("rest", F.col("part") != F.col("main")).withColumn("b", dealt("wide", wide_block)))
    # Only blocks with a band key in common meet: a rest member of the one and any member of the other.
    places = written(shared.join(now.select("id", "family", "b", "rest"), "id").groupBy("family", "key", "b").agg(F.max("rest").alias("rest")))
    tiles = written(places.filter("rest").select("family", "key", F.col("b").alias("x")).join(places.select("family", "key", F.col("b").alias("y")), ["family", "key"]).select("family", "x", "y").distinct())
    rest = now.filter("rest").withColumn("x", F.col("b")).join(tiles, ["family", "x"]).withColumn("own", F.lit(True))
    others = now.withColumn("y", F.col("b")).join(tiles, ["family", "y"]).withColumn("own", F.lit(False))
    columns = [*base, "y", "own", "part"]
    return first.unionByName(written(confirmed(rest.select(columns).unionByName(others.select(columns)), percent, kind)))


def _found(docs: DataFrame, percent: int, block: int, wide_block: int) -> DataFrame:
    """doc_id, key, n_shingles, component_id, kept of each row of ``docs`` (doc_id, key, text)."""
    seen = written(sketched(docs))
    some = seen.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    # A class is a set of shingles; rows that share an id but not a text are in different classes.
    one = F.min(F.struct("doc_id", "key")).alias("one")
    classes = written(some.groupBy(F.col("digest").alias("id")).agg(one, F.first("registers").alias("registers"), F.first("n_shingles").alias("n_shingles"), F.count(F.lit(1)).alias("n")))
    found, shared = families(classes)
    members = written(classes.select("id", "one.doc_id", "one.key", "n_shingles").join(found, "id"))
    parts = components(linked(docs, members, shared, percent, block, wide_block))
    named = classes.select("id", F.col("one.doc_id").alias("least"), "n").join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("classes"))
    # Components with very many classes are spread as well.
    sized = written(least)
    of_class = spread_join(named.select("id", "component", "n"), sized.select("component", "component_id"), ["component"], hubs(sized, ["component"], "classes"), "id")
    of_class = written(of_class.select(F.col("id").alias("digest"), "component_id", "n"))
    joined = spread_join(seen.select("doc_id", "key", "n_shingles", "digest"), of_class.drop("n"), ["digest"], hubs(of_class, ["digest"]), "doc_id", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    return joined.select("doc_id", "key", "n_shingles", own).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> list[Column]:
    """A row's id, its text, and a key of the text, which tells rows that share an id apart."""
    own = F.col(f"`{text}`")
    return [F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(own).alias("key"), own.alias("text")]


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, block: int = BLOCK, wide_block: int = WIDE_BLOCK) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * shared >= percent * united shingles. Null and empty texts have no
    shingles and are linked with nothing. Rows without an id are not compared: their component is null and they
    are kept. Repeated rows carry the same result, all of them; rows that share an id but not a text are
    judged each by its own. An empty table gives no rows; other columns are ignored.
    """
    return _found(docs.select(*_keyed(docs, doc_id, text)), percent, block, wide_block).drop("key")


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, block: int = BLOCK, wide_block: int = WIDE_BLOCK) -> DataFrame:
    """The rows of ``docs`` that ``near_dedup`` keeps, with all their columns; of rows equal in id and text one stays.

    Null and empty texts and rows without an id stay; an empty table stays empty.
    """
    rows = docs.select(F.struct("*").alias("row"), *_keyed(docs, doc_id, text)[:2])
    found = written(_found(docs.select(*_keyed(docs, doc_id, text)), percent, block, wide_block))
    # Keys and ids in structs of their own, which no column of ``docs`` can clash with.
    gone = written(found.filter(~F.col("kept")).select(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key")).distinct())
    kept = rows.join(F.broadcast(gone) if fits(gone) else gone, (F.col("doc_id") == F.col("gone_id")) & (F.col("key") == F.col("gone_key")), "left_anti")
    again = written(found.filter("kept").groupBy(F.col("doc_id").alias("again_id"), F.col("key").alias("again_key")).count().filter("count > 1").drop("count"))
    if not again.limit(1).count():
        return kept.select("row.*")
    side = F.broadcast(again) if fits(again) else again
    same = F.col("doc_id").eqNullSafe(F.col("again_id")) & (F.col("key") == F.col("again_key"))
    return kept.join(side, same, "left_anti").select("row.*").unionByName(kept.join(side, same, "left_semi").groupBy("doc_id", "key").agg(F.first("row").alias("row")).select("row.*"))
