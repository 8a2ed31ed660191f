"""Capture filters, in the usual expression language, as a predicate.

    port 53 and (udp or ip6) and not host 192.0.2.1

``host``, ``net``, ``port`` and ``portrange`` may be led by a protocol and by ``src``, ``dst``,
``src or dst``, ``src and dst``; a value alone is of the last one's kind (``port 53 or 853``).
``udp``, ``tcp``, ``icmp``, ``icmp6``, ``ip``, ``ip6``, ``ip proto n``, ``less n`` and ``greater n``
(of the length on the wire, ``net_len``) are known too; ``domain`` is port 53. ``not`` binds
first; ``and`` and ``or`` are equals and go from left to right. An empty filter takes everything.
A packet without ports or addresses (a fragment, a broken one) has none of those asked for, so
that ``not port 53`` takes it.

``parse`` gives the filter as a tree; ``capture_filter`` makes a column of it, ``array_filter``
a mask over arrays of header fields, for readers that test frames before they take them apart.
"""

from __future__ import annotations

import ipaddress
import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: IANA protocol numbers.
PROTOCOLS = {"udp": 17, "tcp": 6, "icmp": 1, "icmp6": 58}
VERSIONS = {"ip": 4, "ip6": 6}
PORTS = {"domain": 53}
KINDS = ("host", "net", "port", "portrange", "proto")
EITHER = ("or", ("src", "dst"))


def parse(text: str) -> tuple:
    """The filter as a tree of ("and" | "or", a, b), ("not", a) and tests."""
    names = {"!": "not", "&&": "and", "||": "or"}
    words = [names.get(w, w) for w in re.findall(r"[()]|!|&&|\|\||[^\s()!&|]+", text.lower())]
    before: list = [None]

    def take(expected: str | None = None) -> str:
        if not words or expected and words[0] != expected:
            raise ValueError(f"filter {text!r}: {expected or 'more'} expected at {' '.join(words[:3]) or 'its end'}")
        return words.pop(0)

    def whole() -> tuple:
        left = one()
        while words and words[0] in ("and", "or"):
            left = (take(), left, one())
        return left

    def one() -> tuple:
        if words and words[0] == "not":
            take()
            return ("not", one())
        if words and words[0] == "(":
            take()
            inner = whole()
            take(")")
            return inner
        return primitive()

    def primitive() -> tuple:
        if words and words[0] in ("less", "greater"):
            word, n = take(), int(take())
            return ("len", 0, n) if word == "less" else ("len", n, 1 << 62)
        protocol = take() if words and words[0] in (*PROTOCOLS, *VERSIONS) else None
        sides = None
        if words and words[0] in EITHER[1]:
            sides = ("or", (take(),))
            if words[:1] in (["and"], ["or"]) and words[1:2] in (["src"], ["dst"]) and words[1] != sides[1][0]:
                sides = (take(), EITHER[1])
                take()
        kind = take() if words and words[0] in KINDS else None
        if protocol and not sides and not kind and (not words or words[0] in ("and", "or", ")")):
            return of_protocol(protocol)
        if protocol or sides or kind:
            before[0] = (protocol, sides or EITHER, kind or "host")
        elif words and before[0] is None and not re.match(r"[0-9a-f:.]+(/\d+)?$", words[0]):
            raise ValueError(f"filter {text!r}: {words[0]!r} is not known")
        protocol, sides, kind = before[0] or (None, EITHER, "host")
        found = test(sides, kind, take())
        return ("and", of_protocol(protocol), found) if protocol else found

    def of_protocol(name: str) -> tuple:
        return ("version", VERSIONS[name]) if name in VERSIONS else ("proto", PROTOCOLS[name])

    def test(sides: tuple, kind: str, value: str) -> tuple:
        if kind == "proto":
            return ("proto", PROTOCOLS[value] if value in PROTOCOLS else int(value))
        if kind in ("port", "portrange"):
            first, _, last = value.partition("-") if kind == "portrange" else (value, "", "")
            n = PORTS[first] if first in PORTS else int(first)
            return ("port", sides, n, int(last) if last else n)
        if kind == "net" and words and words[0] == "mask":
            take()
            value = f"{value}/{take()}"
        net = ipaddress.ip_network(value, strict=False)
        return ("net", sides, net.version, int(net.network_address), int(net.broadcast_address))

    if not words:
        return ("all",)
    out = whole()
    if words:
        raise ValueError(f"filter {text!r}: {' '.join(words)!r} is left over")
    return out


def capture_filter(text: str) -> Column:
    return _column(parse(text))


def _column(tree: tuple) -> Column:
    kind = tree[0]
    if kind == "all":
        return F.lit(True)
    if kind == "not":
        return ~_column(tree[1])
    if kind in ("and", "or"):
        a, b = _column(tree[1]), _column(tree[2])
        return a & b if kind == "and" else a | b
    if kind == "version":
        found = F.col("net_ipv") == tree[1]
    elif kind == "proto":
        found = F.col("net_proto") == tree[1]
    elif kind == "len":
        found = F.col("net_len").between(tree[1], tree[2])
    elif kind == "port":
        found = _of_sides(tree[1], lambda s: F.col(f"{s}_port").between(tree[2], tree[3]))
    else:
        _, sides, version, low, high = tree
        found = _of_sides(sides, lambda s: (F.col("net_ipv") == version) & _address(F.col(f"{s}_addr"), version, low, high))
    return F.coalesce(found, F.lit(False))


def _of_sides(sides: tuple, test):
    """``test`` of either side or of both; one that can't be told is none."""
    out = None
    for side in sides[1]:
        found = test(side)
        found = F.coalesce(found, F.lit(False)) if isinstance(found, Column) else found
        out = found if out is None else out & found if sides[0] == "and" else out | found
    return out


def _address(text: Column, version: int, low: int, high: int) -> Column:
    if low == high:
        return text == ipaddress.ip_address(low if version == 4 else low.to_bytes(16)).compressed
    return ipv4_number(text).between(low, high) if version == 4 else ipv6_digits(text).between(f"{low:032x}", f"{high:032x}")


def array_filter(tree: tuple, fields: dict) -> np.ndarray:
    """The filter over arrays: version and proto (0 if there is none), net_len, and for each side ports (-1 if there is none) and addresses.

    ``src`` and ``dst`` are the addresses' upper and lower 64 bits; those of version 4 are all in the lower.
    """
    kind = tree[0]
    if kind == "all":
        return np.ones(len(fields["version"]), dtype=bool)
    if kind == "not":
        return ~array_filter(tree[1], fields)
    if kind in ("and", "or"):
        a, b = (array_filter(t, fields) for t in tree[1:])
        return a & b if kind == "and" else a | b
    if kind in ("version", "proto"):
        return fields[kind] == tree[1]
    if kind == "len":
        return (fields["net_len"] >= tree[1]) & (fields["net_len"] <= tree[2])
    if kind == "port":
        return _of_sides(tree[1], lambda s: (fields[f"{s}_port"] >= tree[2]) & (fields[f"{s}_port"] <= tree[3]))
    _, sides, version, low, high = tree
    (l1, l0), (h1, h0) = (divmod(x, 1 << 64) for x in (low, high))

    def inside(side):
        upper, lower = fields[side]
        above = (upper > np.uint64(l1)) | (upper == np.uint64(l1)) & (lower >= np.uint64(l0))
        return above & ((upper < np.uint64(h1)) | (upper == np.uint64(h1)) & (lower <= np.uint64(h0)))

    return (fields["version"] == version) & _of_sides(sides, inside)


def ipv4_number(text: Column) -> Column:
    parts = F.split(text, r"\.")
    return sum((F.try_element_at(parts, F.lit(i + 1)).try_cast("long") * 256 ** (3 - i) for i in range(1, 4)), F.try_element_at(parts, F.lit(1)).try_cast("long") * 256**3)


def ipv6_digits(text: Column) -> Column:
    """All 32 hexadecimal digits of an address, whose order is that of the addresses."""
    quad = F.split(F.regexp_extract(text, r"[^:]*$", 0), r"\.")
    tail = F.format_string("%02x%02x:%02x%02x", *[F.try_element_at(quad, F.lit(i)).try_cast("int") for i in range(1, 5)])
    plain = F.when(text.contains("."), F.concat(F.regexp_extract(text, r"^.*:", 0), tail)).otherwise(F.lower(text))
    halves = F.split(plain, "::")
    left, right = (F.filter(F.split(F.coalesce(F.try_element_at(halves, F.lit(i)), F.lit("")), ":"), lambda x: x != "") for i in (1, 2))
    zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(left) - F.size(right)))
    return F.when(text.isNotNull(), F.array_join(F.transform(F.concat(left, zeros, right), lambda x: F.lpad(x, 4, "0")), ""))
