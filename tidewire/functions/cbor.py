"""The small part of CBOR (RFC 8949) that records need, both ways."""

from __future__ import annotations

import struct


def head(major: int, n: int) -> bytes:
    for info, size, code in ((24, 1, ">B"), (25, 2, ">H"), (26, 4, ">I"), (27, 8, ">Q")):
        if info == 24 and n < 24:
            return bytes([major << 5 | n])
        if n < 1 << 8 * size:
            return bytes([major << 5 | info]) + struct.pack(code, n)
    raise OverflowError(n)


def encode(value) -> bytes:
    if value is None:
        return b"\xf6"
    if value is True or value is False:
        return b"\xf5" if value else b"\xf4"
    if isinstance(value, int):
        return head(0, value) if value >= 0 else head(1, -1 - value)
    if isinstance(value, float):
        return b"\xfb" + struct.pack(">d", value)
    if isinstance(value, (bytes, bytearray)):
        return head(2, len(value)) + bytes(value)
    if isinstance(value, str):
        text = value.encode()
        return head(3, len(text)) + text
    if isinstance(value, (list, tuple)):
        return head(4, len(value)) + b"".join(map(encode, value))
    if isinstance(value, dict):
        return head(5, len(value)) + b"".join(encode(k) + encode(v) for k, v in value.items())
    raise TypeError(f"no CBOR for {type(value).__name__}")


class CutOff(ValueError):
    """The data ends within an item."""


#: Stands for the end of an item of unknown length.
BREAK = object()


def decode(data: bytes, at: int = 0):
    """(item, position after it); CutOff where the data ends too soon."""
    if at >= len(data):
        raise CutOff("no item")
    major, info = data[at] >> 5, data[at] & 31
    at += 1
    if info < 24 or info == 31:
        n = info
    elif info < 28:
        size = 1 << info - 24
        if at + size > len(data):
            raise CutOff("cut off")
        n = int.from_bytes(data[at : at + size], "big")
        at += size
    else:
        raise ValueError("reserved")
    open_end = info == 31
    if major in (0, 1):
        return (n if major == 0 else -1 - n), at
    if major in (2, 3) and not open_end:
        if at + n > len(data):
            raise CutOff("cut off")
        raw = data[at : at + n]
        return (raw if major == 2 else raw.decode()), at + n
    if major in (2, 3):
        parts = []
        while (part := decode(data, at))[0] is not BREAK:
            parts.append(part[0])
            at = part[1]
        return (b"" if major == 2 else "").join(parts), part[1]
    if major in (4, 5):
        items, left = [], n * (major - 3)
        while open_end or left:
            item, at = decode(data, at)
            if item is BREAK:
                break
            items.append(item)
            left -= 1
        return (items if major == 4 else dict(zip(items[::2], items[1::2]))), at
    if major == 6:
        return decode(data, at)
    if open_end:
        return BREAK, at
    if info in (25, 26, 27):
        return struct.unpack({25: ">e", 26: ">f", 27: ">d"}[info], n.to_bytes(1 << info - 24, "big"))[0], at
    return {20: False, 21: True, 22: None, 23: None}.get(n, n), at


def items(data: bytes):
    at = 0
    while at < len(data):
        item, at = decode(data, at)
        yield item


def stream_items(read, block: int = 1 << 20):
    """Items of what ``read(n)`` gives, holding little more than one item and one block.

    An item that goes past the bytes at hand is begun again with twice as many, so that even one of many blocks takes time by its length.
    """
    data, at, size = b"", 0, block
    while True:
        try:
            item, at = decode(data, at)
        except CutOff:
            more = read(size)
            if not more:
                if at < len(data):
                    raise
                return
            data, at, size = data[at:] + more, 0, size * 2
        else:
            size = block
            yield item
