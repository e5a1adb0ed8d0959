"""Documents with everything an operator must stand, and plain versions of shared rules."""

import re
import zlib

SPACE = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i % 977} filler{i % 31}" for i in range(60_000))

#: Columns that operators might use inside.
EXTRA = {c: "x" for c in ("id", "row", "key", "n", "p", "size", "spans", "digest", "keep_id", "kept", "component", "score", "label", "bucket", "hashes", "copies", "_dropped", "_again", "_row", "gone_id", "gone_key", "again_id", "again_key", "doc", "taken", "salt", "salts", "lead", "family", "component_id", "name", "n_links", "b", "x")}


def rows():
    texts = ["", None, "one two", "one \t two", "one two ", "a b c d e f g h", "A B C D E F G H", " \n ", "naïve café – 漢字 𝄞 text", LONG, LONG + " end", "password: hunter22secret", "x" * 5000]
    out = [(i, t, "en", f"s{i % 3}" if i % 4 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*out, out[2], out[2], (None, "row without id", None, None, None), (None, "row without id", None, None, None), (40, "one two", None, "s1", 7)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, extra=False, empty=False, data=None):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([] if empty else rows() if data is None else data, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit(v) for c, v in EXTRA.items()}) if extra else df


def fold(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def components(nodes, links):
    up = {x: x for x in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}
