"""The LZO1X block format: a decoder for all of its instructions, and an encoder that any decoder reads.

A block is a run of instructions that copy literals from the input or earlier output; an instruction's two
lowest distance bits tell how many literals, up to three, follow it.
"""

from __future__ import annotations

#: Fixed values of the format: first bytes from which on the block starts with literals, the distances that
#: the instructions' offsets begin at, and the end of a block.
FIRST_LITERALS, NEAR_AFTER_LITERALS, FAR = 17, 2049, 16384
END = b"\x11\x00\x00"
#: Matches that the encoder looks for: their least length, and how far back.
LEAST, REACH = 4, 16384


def lzo1x_decompress(data: bytes, size: int | None = None) -> bytes:
    """The block's content; ``size``, if given, is what it must come to."""
    out = bytearray()
    at = 0

    def byte() -> int:
        nonlocal at
        if at >= len(data):
            raise ValueError("the block ends inside an instruction")
        at += 1
        return data[at - 1]

    def longer(n: int, mask: int) -> int:
        """A length that goes on in further bytes where its bits in the instruction are 0."""
        if n:
            return n
        total = mask
        while not (b := byte()):
            total += 255
        return total + b

    def literals(n: int) -> None:
        nonlocal at
        if at + n > len(data):
            raise ValueError("the block ends inside its literals")
        out.extend(data[at : at + n])
        at += n

    def match(distance: int, n: int) -> None:
        if distance > len(out):
            raise ValueError("a match begins before the block")
        start = len(out) - distance
        while n > 0:  # what is copied may be what is being written
            part = out[start : start + min(n, len(out) - start)]
            out.extend(part)
            start, n = start + len(part), n - len(part)

    state = 0  # literals that came last: 0 to 3 after a match, 4 for a run of them
    if data and data[0] > FIRST_LITERALS:
        n = byte() - FIRST_LITERALS
        literals(n)
        state = min(n, 4)
    while True:
        op = byte()
        if op >= 64:
            n = 5 + (op >> 5 & 3) if op >= 128 else 3 + (op >> 5 & 1)
            match((byte() << 3) + (op >> 2 & 7) + 1, n)
            state = op & 3
        elif op >= 32:
            n = 2 + longer(op & 31, 31)
            low = byte()
            match((byte() << 6) + (low >> 2) + 1, n)
            state = low & 3
        elif op >= 16:
            n = 2 + longer(op & 7, 7)
            low = byte()
            distance = FAR + ((op & 8) << 11) + (byte() << 6) + (low >> 2)
            if distance == FAR:
                break
            match(distance, n)
            state = low & 3
        elif state == 0:
            literals(3 + longer(op, 15))
            state = 4
            continue
        else:
            distance = (byte() << 2) + (op >> 2)
            match(distance + (NEAR_AFTER_LITERALS if state == 4 else 1), 3 if state == 4 else 2)
            state = op & 3
        literals(state)
    if at != len(data) or size is not None and len(out) != size:
        raise ValueError("the block's length is not what it says")
    return bytes(out)


def lzo1x_compress(data: bytes) -> bytes:
    """A valid block: greedy matches of four bytes or more within the last 16 kB, and literals between them."""
    out = bytearray()
    seen: dict[bytes, int] = {}
    at = start = 0

    def number(n: int, most: int) -> bytes:
        """A length's bits in the instruction (0: goes on) and its further bytes."""
        if n <= most:
            return bytes([n])
        n -= most
        return bytes([0]) + bytes((n - 1) // 255) + bytes([(n - 1) % 255 + 1])

    def put(run: bytes) -> None:
        if not run:
            return
        if not out and len(run) <= 238:
            out.append(FIRST_LITERALS + len(run))
        elif out and len(run) < 4:
            out[-2] |= len(run)  # told by the match before
        else:
            out.extend(number(len(run) - 3, 15))
        out.extend(run)

    while at < len(data):
        key = data[at : at + LEAST]
        before = seen.get(key, -1)
        seen[key] = at
        # A block can't begin with a match, nor with fewer than four literals told by one.
        if len(key) < LEAST or before < 0 or at - before > REACH or not out and at == start:
            at += 1
            continue
        n = LEAST
        while at + n < len(data) and data[before + n] == data[at + n]:
            n += 1
        put(data[start:at])
        length, distance = number(n - 2, 31), at - before - 1
        out.append(32 | length[0])
        out.extend(length[1:])
        out.extend(bytes([(distance & 63) << 2, distance >> 6]))
        at += n
        start = at
    put(data[start:])
    return bytes(out) + END
