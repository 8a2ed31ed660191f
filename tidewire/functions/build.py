"""DNS messages and frames from packet columns, the inverse of the decoder."""

from __future__ import annotations

import ipaddress
import struct

import pyarrow as pa
from pyspark.sql import DataFrame

from .wire import DAU, DHU, N3U, NSID, OPT, SUBNET


def name_bytes(text: str) -> bytes:
    """Wire form of a presentation name without escapes."""
    return b"".join(bytes([len(x)]) + x.encode() for x in text.rstrip(".").split(".") if x) + b"\0"


def message(dns_id: int, flags: int, qname: str, qtype: int, qclass: int, opt: dict | None = None, tail: bytes = b"") -> bytes:
    """A message with one question and, with ``opt``, an OPT record."""
    out = struct.pack(">HHHHHH", dns_id, flags, 1, 0, 0, int(opt is not None)) + name_bytes(qname) + struct.pack(">HH", qtype, qclass)
    if opt is not None:
        data = b""
        for code, key in ((NSID, "nsid"), (DAU, "dau"), (DHU, "dhu"), (N3U, "n3u")):
            if opt.get(key) is not None:
                data += struct.pack(">HH", code, len(opt[key])) + bytes(opt[key])
        if opt.get("subnet") is not None:
            value = subnet_bytes(opt["subnet"])
            data += struct.pack(">HH", SUBNET, len(value)) + value
        for code in filter(None, (opt.get("other") or "").split(",")):
            data += struct.pack(">HH", int(code), 0)
        out += b"\0" + struct.pack(">HHIH", OPT, opt["udp"], opt["ext_rcode"] << 24 | opt["ver"] << 16 | bool(opt["do"]) << 15, len(data)) + data
    return out + tail


def subnet_bytes(text: str) -> bytes:
    """Wire form of "family,address/length,scope"."""
    family, net, scope = text.split(",")
    address, length = net.split("/")
    kept = ipaddress.ip_address(address).packed[: -(-int(length) // 8)]
    return struct.pack(">HBB", 1 if family == "4" else 2, int(length), int(scope)) + kept


def ip_packet(src: str, sport: int, dst: str, dport: int, proto: int, payload: bytes, ttl: int = 64, checksum: int = 0) -> bytes:
    """UDP datagram, or TCP data segment led by the message's length, in an IPv4 or IPv6 packet."""
    if proto == 6:
        body = struct.pack(">HHIIBBHHH", sport, dport, 1, 1, 5 << 4, 0x18, 65535, 0, 0) + struct.pack(">H", len(payload)) + payload
    else:
        body = struct.pack(">HHHH", sport, dport, 8 + len(payload), checksum) + payload
    a, b = ipaddress.ip_address(src), ipaddress.ip_address(dst)
    if a.version == 6:
        return struct.pack(">IHBB", 6 << 28, len(body), proto, ttl) + a.packed + b.packed + body
    return struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(body), 0, 0, ttl, proto, 0) + a.packed + b.packed + body


def frames(packets: DataFrame) -> DataFrame:
    """(seq, ts_us, net_len, raw) of packets; those marked malformed get bytes after the last record and pose as requests."""
    names = ["src_addr", "src_port", "dst_addr", "dst_port", "net_proto", "net_ttl", "udp_sum", "is_response", "dns_id", "flags_word", "qname", "qtype", "qclass", "opt", "drop_reason"]

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.select(names).to_pylist():
                bad = r["drop_reason"] is not None
                flags = r["flags_word"] & 0x7FFF | (0x8000 if r["is_response"] and not bad else 0)
                m = message(r["dns_id"], flags, r["qname"], r["qtype"], r["qclass"], r["opt"], b"\x01" if bad else b"")
                out.append(ip_packet(r["src_addr"], r["src_port"], r["dst_addr"], r["dst_port"], r["net_proto"], m, r["net_ttl"], r["udp_sum"]))
            yield pa.RecordBatch.from_arrays([batch.column("seq"), batch.column("ts_us"), pa.array([len(x) for x in out], pa.int32()), pa.array(out, pa.binary())], ["seq", "ts_us", "net_len", "raw"])

    return packets.select("seq", "ts_us", *names).mapInArrow(run, "seq long, ts_us long, net_len int, raw binary")
