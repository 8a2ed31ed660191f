"""Packet and record schemas."""

from __future__ import annotations

#: Rows of a packet table; ``seq`` is the order of capture and decides matching.
PACKET = """
    seq long, ts_us long, src_addr string, src_port int, dst_addr string, dst_port int, net_ipv int, net_proto int,
    net_len int, net_ttl int, udp_sum int, dns_len int, payload binary, is_response boolean, dns_id int, flags_word int,
    qname string, qtype int, qclass int, ancount int, nscount int, arcount int,
    opt struct<ver: int, udp: int, do: boolean, ext_rcode: int, dau: array<int>, dhu: array<int>, n3u: array<int>, nsid: binary, other: string, subnet: string>,
    drop_reason string
"""
#: The output record's fields by flag, in the order of its columns.
FIELDS = {
    "time": ["time"], "delay_us": ["delay_us"], "req_dns_len": ["req_dns_len"], "resp_dns_len": ["resp_dns_len"],
    "req_net_len": ["req_net_len"], "resp_net_len": ["resp_net_len"], "client_addr": ["client_addr"], "client_port": ["client_port"],
    "server_addr": ["server_addr"], "server_port": ["server_port"], "net_proto": ["net_proto"], "net_ipv": ["net_ipv"],
    "net_ttl": ["net_ttl"], "req_udp_sum": ["req_udp_sum"], "id": ["id"], "qtype": ["qtype"], "qclass": ["qclass"],
    "opcode": ["opcode"], "rcode": ["rcode"],
    "flags": ["resp_aa", "resp_tc", "req_rd", "resp_ra", "req_z", "resp_ad", "req_cd"],
    "qname": ["qname"], "rr_counts": ["resp_ancount", "resp_arcount", "resp_nscount"],
    "edns": ["req_edns_ver", "req_edns_udp", "req_edns_do", "resp_edns_rcode", "req_edns_ping", "req_edns_dau", "req_edns_dhu", "req_edns_n3u",
             "resp_edns_nsid", "edns_client_subnet", "edns_other"],
}
#: Written to CSV only: the binary form leaves it out.
CSV_ONLY = {"req_edns_ping"}
#: Fixed value: seven columns that identify a question and its answer.
KEY = ["net_ipv", "net_proto", "dns_id", "client_addr", "client_port", "server_addr", "server_port"]


def columns(flags=None, cbor: bool = False) -> list[str]:
    """Record columns of the chosen flags (default all), always in the record's order."""
    chosen = FIELDS.keys() if flags is None else set(flags)
    unknown = set(chosen) - FIELDS.keys()
    if unknown:
        raise ValueError(f"unknown fields: {', '.join(sorted(unknown))}")
    return [c for flag, names in FIELDS.items() if flag in chosen for c in names if not (cbor and c in CSV_ONLY)]
