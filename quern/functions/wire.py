"""The variable-length integers and records of sorted run files.

A number from -112 to 127 is one byte. Any other has a tag byte (-113 to -120: so many bytes of a number
that isn't negative, -121 to -128: of one that is, complemented) and one to eight big-endian bytes.
A record is key length, value length, key, value; two lengths of -1 end a run.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the format.
ONE_BYTE_LEAST, ONE_BYTE_MOST, TAG_POSITIVE, TAG_NEGATIVE, END_OF_RUN = -112, 127, -112, -120, -1


def vint_size(x: Column) -> Column:
    """Bytes of the encoded number, as an expression."""
    x = x.cast("long")
    bits = F.length(F.bin(F.when(x < 0, F.bitwise_not(x)).otherwise(x)))
    return F.when(x.between(ONE_BYTE_LEAST, ONE_BYTE_MOST), F.lit(1)).otherwise(F.floor((bits + 7) / 8) + 1).cast("int")


def record_size(key_bytes: Column, value_bytes: Column) -> Column:
    """Bytes of a record whose key and value have so many."""
    return (vint_size(key_bytes) + vint_size(value_bytes) + key_bytes + value_bytes).cast("long")


def encode_vint(x: int) -> bytes:
    if ONE_BYTE_LEAST <= x <= ONE_BYTE_MOST:
        return x.to_bytes(1, "big", signed=True)
    tag = TAG_POSITIVE
    if x < 0:
        x, tag = ~x, TAG_NEGATIVE
    n = max(1, (x.bit_length() + 7) // 8)
    return (tag - n).to_bytes(1, "big", signed=True) + x.to_bytes(n, "big")


def decode_vint(data: bytes, at: int) -> tuple[int, int]:
    """The number at a place, and the place after it."""
    first = int.from_bytes(data[at : at + 1], "big", signed=True)
    if at >= len(data):
        raise ValueError("the run ends inside a number")
    if first >= ONE_BYTE_LEAST:
        return first, at + 1
    n = TAG_NEGATIVE - first if first < TAG_NEGATIVE else TAG_POSITIVE - first
    if at + 1 + n > len(data):
        raise ValueError("the run ends inside a number")
    x = int.from_bytes(data[at + 1 : at + 1 + n], "big")
    return (~x if first < TAG_NEGATIVE else x), at + 1 + n


def encode_record(key: bytes, value: bytes) -> bytes:
    return b"".join((encode_vint(len(key)), encode_vint(len(value)), key, value))


def decode_records(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """The records up to the end of the run, or of the data where whole records end there."""
    at = 0
    while at < len(data):
        k, at = decode_vint(data, at)
        v, at = decode_vint(data, at)
        if k == v == END_OF_RUN:
            return
        if k < 0 or v < 0 or at + k + v > len(data):
            raise ValueError("the run ends inside a record")
        yield data[at : at + k], data[at + k : at + k + v]
        at += k + v


class RecordStream:
    """Records from a run that comes in pieces cut anywhere: only the record that is still incomplete is held."""

    def __init__(self) -> None:
        self.held: list[bytes] = []
        self.size, self.need, self.ended = 0, 0, False

    def feed(self, piece: bytes) -> list[tuple[bytes, bytes]]:
        """The records that the piece completes; what follows the end of the run is ignored."""
        out: list[tuple[bytes, bytes]] = []
        if self.ended:
            return out
        self.held.append(piece)
        self.size += len(piece)
        if self.size < self.need:  # pieces of a long record are joined once
            return out
        data, at, self.need = b"".join(self.held), 0, 0
        while at < len(data):
            try:
                k, a = decode_vint(data, at)
                v, a = decode_vint(data, a)
            except ValueError:  # the lengths themselves are cut
                break
            if k == v == END_OF_RUN:
                self.ended = True
                break
            if k < 0 or v < 0:
                raise ValueError("a record has a negative length")
            if a + k + v > len(data):
                self.need = a + k + v - at
                break
            out.append((data[a : a + k], data[a + k : a + k + v]))
            at = a + k + v
        self.held = [] if self.ended else [data[at:]]
        self.size = sum(map(len, self.held))
        return out

    def close(self) -> None:
        if self.size:
            raise ValueError("the run ends inside a record")
