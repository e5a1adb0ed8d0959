"""Sorted runs as segments: records in wire format, in blocks that may be compressed.

A block is a whole number of records, so blocks are decoded each for itself. A compressed block starts with
its raw and its compressed length, both unsigned 32-bit big-endian numbers. The last block of a
partition ends with the end-of-run mark.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator, Sequence
from itertools import groupby
from urllib.parse import quote, urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.lzo import lzo1x_compress, lzo1x_decompress
from quern.functions.wire import END_OF_RUN, RecordStream, decode_records, encode_record, encode_vint
from quern.operators.exchange import sorted_partitions
from quern.sources.batches import mapped

BLOCK_BYTES = 256 * 1024
#: Bytes of a run file that are read at a time.
PIECE_BYTES = 4 << 20
CODECS = ("none", "snappy", "lz4", "zlib", "lzo1x")
_END = encode_vint(END_OF_RUN) * 2
_HEADER = struct.Struct(">II")
SEGMENT = "part int, block int, records long, raw_length long, part_length long, data binary"


def compress(data: bytes, codec: str) -> bytes:
    if codec == "none":
        return data
    if codec == "zlib":
        packed = zlib.compress(data)
    elif codec == "lzo1x":
        packed = lzo1x_compress(data)
    elif codec in ("snappy", "lz4"):
        import pyarrow as pa

        packed = pa.compress(data, codec="lz4_raw" if codec == "lz4" else codec, asbytes=True)
    else:
        raise ValueError(f"codec {codec!r} is not one of {CODECS}")
    return _HEADER.pack(len(data), len(packed)) + packed


def decompress(data: bytes, codec: str) -> bytes:
    """All blocks of ``data``, one after the other."""
    if codec == "none":
        return data
    if codec not in CODECS:
        raise ValueError(f"codec {codec!r} is not one of {CODECS}")
    out, at = [], 0
    while at < len(data):
        if at + _HEADER.size > len(data):
            raise ValueError("the segment ends inside a block's header")
        raw, packed = _HEADER.unpack_from(data, at)
        own = data[at + _HEADER.size : at + _HEADER.size + packed]
        if len(own) < packed:
            raise ValueError("the segment ends inside a block")
        if codec == "zlib":
            out.append(zlib.decompress(own))
        elif codec == "lzo1x":
            out.append(lzo1x_decompress(own, raw))
        else:
            import pyarrow as pa

            out.append(pa.decompress(own, decompressed_size=raw, codec="lz4_raw" if codec == "lz4" else codec, asbytes=True))
        if len(out[-1]) != raw:
            raise ValueError("a block's length is not what its header says")
        at += _HEADER.size + packed
    return b"".join(out)


def encode_segments(records: DataFrame, key: str = "key", value: str = "value", n: int | None = None, partitioner: str = "range", codec: str = "none", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The sorted segments of a table of binary keys and values, a row for each block; nulls count as empty.

    A record of any length has room: one above ``block_bytes`` is a block of its own.
    """
    own = records.select(*[F.coalesce(F.col(f"`{c}`").cast("binary"), F.lit(b"")).alias(a) for c, a in ((key, "key"), (value, "value"))])
    dealt = sorted_partitions(own, ["key"], n, partitioner).withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, block, held, size = None, 0, [], 0

        def out(end: bytes = b"") -> pd.DataFrame:
            raw = b"".join([*held, end])
            packed = compress(raw, codec)
            return pd.DataFrame({"part": [part], "block": [block], "records": [len(held)], "raw_length": [len(raw)], "part_length": [len(packed)], "data": [packed]})

        for batch in batches:
            for p, k, v in zip(batch["part"], batch["key"], batch["value"], strict=True):
                part = p
                record = encode_record(bytes(k), bytes(v))
                if held and size + len(record) > block_bytes:
                    yield out()
                    block, held, size = block + 1, [], 0
                held.append(record)
                size += len(record)
        if part is not None:
            yield out(_END)

    return mapped(dealt, run, SEGMENT)


def decode_segments(segments: DataFrame, codec: str = "none", data: str = "data") -> DataFrame:
    """part, block, key, value of every record; blocks need no order."""
    own = segments.select("part", "block", F.col(f"`{data}`").alias("data"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, b, d in zip(batch["part"], batch["block"], batch["data"], strict=True):
                if found := list(decode_records(decompress(bytes(d), codec))):
                    yield pd.DataFrame({"part": p, "block": b, "key": [k for k, _ in found], "value": [v for _, v in found]})

    return mapped(own, run, "part int, block int, key binary, value binary")


class BlockStream:
    """Decompressed blocks of a file that comes in pieces cut anywhere: only the block that is still incomplete is held."""

    def __init__(self, codec: str) -> None:
        self.codec, self.held = codec, []
        self.size, self.need = 0, 0

    def feed(self, piece: bytes) -> Iterator[bytes]:
        """The blocks that the piece completes, one at a time; take them all before the next piece."""
        if self.codec == "none":
            yield piece
            return
        self.held.append(piece)
        self.size += len(piece)
        if self.size < self.need:
            return
        data, at, self.need = b"".join(self.held), 0, 0
        while at + _HEADER.size <= len(data):
            end = at + _HEADER.size + _HEADER.unpack_from(data, at)[1]
            if end > len(data):
                self.need = end - at
                break
            yield decompress(data[at:end], self.codec)
            at = end
        self.held, self.size = [data[at:]], len(data) - at

    def close(self) -> None:
        decompress(b"".join(self.held), self.codec)  # refuses what is left of a block


def run_records(pieces: Iterable[bytes], codec: str = "none") -> Iterator[list[tuple[bytes, bytes]]]:
    """The records of one run file that comes in pieces, in lists of about a block: neither the file nor its records are held whole."""
    blocks, records = BlockStream(codec), RecordStream()
    for piece in pieces:
        for raw in blocks.feed(piece):
            for at in range(0, len(raw), BLOCK_BYTES):
                if found := records.feed(raw[at : at + BLOCK_BYTES]):
                    yield found
        if codec == "none" and records.ended:
            break
    blocks.close()
    records.close()


def _python_opens(files: DataFrame) -> bool:
    """Whether Python finds the files as well as Spark does, by one of each store."""
    from pyarrow import fs

    for uri in {urlsplit(x)[:2]: x for x in files.inputFiles()}.values():
        try:
            system, name = fs.FileSystem.from_uri(uri)
            if not system.get_file_info(name).is_file:
                return False
        except (ValueError, OSError, NotImplementedError):  # a store that only Spark knows
            return False
    return True


def read_run_files(spark: SparkSession, paths: str | Sequence[str], codec: str = "none") -> DataFrame:
    """path, key, value of the records in run files, each of which a task reads from its beginning to its end.

    Python opens the files and reads some of a file at a time, so memory does not grow with them. Where it can't, as
    in stores that only Spark knows, Spark's reader takes a file into the executor's JVM (at most 2 GB, Spark's
    limit) and Python gets it in pieces.
    """
    if codec not in CODECS:
        raise ValueError(f"codec {codec!r} is not one of {CODECS}")
    files = spark.read.format("binaryFile").load(paths if isinstance(paths, str) else list(paths))
    schema = "path string, key binary, value binary"

    def rows(path: str, pieces: Iterable[bytes]) -> Iterator[pd.DataFrame]:
        for found in run_records(pieces, codec):
            yield pd.DataFrame({"path": path, "key": [k for k, _ in found], "value": [v for _, v in found]})

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for path in batch["path"]:
                system, name = fs.FileSystem.from_uri(quote(path, safe="/:@"))  # Spark's paths are not escaped
                with system.open_input_file(name) as file:
                    yield from rows(path, iter(lambda f=file: f.read(PIECE_BYTES), b""))

    def sliced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = 0

        def file_and_piece() -> Iterator[tuple[int, str, bytes]]:
            nonlocal number
            for batch in batches:
                for path, piece, data in zip(batch["path"], batch["piece"], batch["data"], strict=True):
                    number += piece == 0
                    yield number, path, bytes(data)

        for (_, path), pieces in groupby(file_and_piece(), key=lambda x: x[:2]):
            yield from rows(path, (data for _, _, data in pieces))

    if _python_opens(files):
        return mapped(files.select("path"), opened, schema)
    # Pieces stay in the task and in the order of their file.
    numbers = F.sequence(F.lit(0), F.floor((F.col("length") - 1) / PIECE_BYTES).cast("int"))
    cut = F.transform(numbers, lambda i: F.substr("content", i * PIECE_BYTES + 1, F.lit(PIECE_BYTES)))
    return mapped(files.filter("length > 0").select("path", F.posexplode(cut).alias("piece", "data")), sliced, schema)


def write_run_files(segments: DataFrame, path: str) -> DataFrame:
    """Write each partition's blocks, in their order, as the run file ``part-<number>.run`` of a folder that all executors reach.

    One row per file: path, part, records, bytes. A file has its name only once it is whole, so a task that is run
    again replaces what it wrote before. Blocks pass one at a time.
    """
    own = segments.select("part", "block", "records", "data")
    n = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(path)
        system.create_dir(folder, recursive=True)
        part = out = half = None
        records = size = 0

        def finished() -> pd.DataFrame:
            out.close()
            name = f"part-{part:05d}.run"
            system.move(half, f"{folder}/{name}")
            return pd.DataFrame({"path": [f"{path.rstrip('/')}/{name}"], "part": [part], "records": [records], "bytes": [size]})

        for batch in batches:
            for p, k, data in zip(batch["part"], batch["records"], batch["data"], strict=True):
                if p != part:
                    if out is not None:
                        yield finished()
                    part, records, size, half = int(p), 0, 0, f"{folder}/.{uuid.uuid4().hex}"
                    out = system.open_output_stream(half)
                out.write(data)
                records, size = records + int(k), size + len(data)
        if out is not None:
            yield finished()

    return mapped(own.repartition(n, "part").sortWithinPartitions("part", "block"), run, "path string, part int, records long, bytes long")


def file_chunks(files: DataFrame, chunk: int) -> DataFrame:
    """The ranged reads that fetch whole files (path, bytes): path, chunk, offset, length."""
    some = files.filter("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / chunk).cast("long"))).alias("chunk"))
    at = F.col("chunk") * F.lit(chunk)
    return some.select("path", "chunk", at.alias("offset"), F.least(F.lit(chunk).cast("long"), F.col("bytes") - at).alias("length"))


def read_ranges(requests: DataFrame) -> DataFrame:
    """``requests`` (path, offset, length and others) with ``data``: the bytes of that range, fewer where the file ends; nothing else of the file is read."""
    names = requests.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for path, rows in batch.groupby("path", sort=False):
                system, name = fs.FileSystem.from_uri(path)
                with system.open_input_file(name) as file:
                    for i in range(len(rows)):
                        row = rows.iloc[i : i + 1]
                        yield row.assign(data=[file.read_at(int(row["length"].iloc[0]), int(row["offset"].iloc[0]))])[[*names, "data"]]

    kinds = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in requests.schema)
    return requests.mapInPandas(run, f"{kinds}, data binary")


def decode_chunks(chunks: DataFrame) -> DataFrame:
    """path, key, value of the records of uncompressed runs that come in chunks (path, chunk, data), cut anywhere.

    Each file's chunks pass in their order, one at a time; a record that is split over chunks is stitched.
    """
    n = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, stream = None, RecordStream()
        for batch in batches:
            for path, data in zip(batch["path"], batch["data"], strict=True):
                if path != last:
                    stream.close()
                    last, stream = path, RecordStream()
                if found := stream.feed(bytes(data)):
                    yield pd.DataFrame({"path": path, "key": [k for k, _ in found], "value": [v for _, v in found]})
        stream.close()

    return mapped(chunks.select("path", "chunk", "data").repartition(n, "path").sortWithinPartitions("path", "chunk"), run, "path string, key binary, value binary")
