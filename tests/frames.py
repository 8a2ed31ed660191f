"""A plain reading of one captured frame, against which the reader is held."""

import ipaddress
import struct

from tidewire.sources.pcap import COOKED, ETHERNET, FRAMES, ICMP, ICMP6, LOOP, NULL, RAW, TCP, UDP  # noqa: F401


def network_bytes(link: int, frame: bytes) -> bytes:
    """The IP packet of a frame, or b""."""
    if link in (RAW, 12, 14):
        return frame
    if link in (NULL, LOOP):
        return frame[4:]
    at = 12 if link == ETHERNET else 14
    while frame[at : at + 2] in (b"\x81\x00", b"\x88\xa8"):
        at += 4
    return frame[at + 2 :] if frame[at : at + 2] in (b"\x08\x00", b"\x86\xdd") else b""


def dissect(link: int, frame: bytes, wire_len: int) -> dict:
    """Addresses, ports, lengths and payload of a frame, and the first reason to drop it.

    ``dns_len`` is the payload's length on the wire, with the length prefix of
    TCP; ``payload`` is what was captured of it.
    """
    out = dict.fromkeys(c.split()[0] for c in FRAMES.split(", ")) | {"net_len": wire_len, "udp_sum": 0, "raw": frame}
    ip = network_bytes(link, frame)
    version = ip[0] >> 4 if ip else 0
    if version == 4 and len(ip) >= 20:
        head, total, proto, ttl = (ip[0] & 15) * 4, struct.unpack(">H", ip[2:4])[0], ip[9], ip[8]
        src, dst = ip[12:16], ip[16:20]
        fragment = struct.unpack(">H", ip[6:8])[0] & 0x3FFF
    elif version == 6 and len(ip) >= 40:
        head, total, proto, ttl = 40, 40 + struct.unpack(">H", ip[4:6])[0], ip[6], ip[7]
        src, dst, fragment = ip[8:24], ip[24:40], 0
        while proto in (0, 43, 44, 60) and len(ip) >= head + 8:
            if proto == 44:
                fragment |= struct.unpack(">H", ip[head + 2 : head + 4])[0] & 0xFFF9
            proto, head = ip[head], head + (8 if proto == 44 else (ip[head + 1] + 1) * 8)
    else:
        return out | {"drop_reason": "network"}
    out |= {"net_ipv": version, "net_proto": proto, "net_ttl": ttl, "src_addr": ipaddress.ip_address(src).compressed, "dst_addr": ipaddress.ip_address(dst).compressed}
    if fragment:
        return out | {"drop_reason": "fragmented"}
    segment, wire = ip[head:total], total - head
    if proto in (TCP, UDP) and len(segment) >= 4:
        out["src_port"], out["dst_port"] = struct.unpack(">HH", segment[:4])
    if proto == TCP:
        if len(segment) < 20:
            return out | {"drop_reason": "network"}
        if segment[13] & 3:
            return out | {"drop_reason": "transport"}
        skip = (segment[12] >> 4) * 4
        payload, wire = segment[skip:], wire - skip
        if wire < 2 or len(payload) < 2:
            return out | {"drop_reason": "network"}
        if struct.unpack(">H", payload[:2])[0] + 2 != wire:
            return out | {"drop_reason": "transport"}
    elif proto == UDP:
        if len(segment) < 8:
            return out | {"drop_reason": "network"}
        out["udp_sum"] = struct.unpack(">H", segment[6:8])[0]
        payload, wire = segment[8:], wire - 8
    elif proto in (ICMP, ICMP6):
        out["src_port"] = out["dst_port"] = 0
        payload, wire = segment[8:], wire - 8
    else:
        return out | {"drop_reason": "transport"}
    return out | {"dns_len": wire, "payload": payload}
