"""The output record: pairs to named columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import domain_name, flag, label_count, opcode, rcode, seconds
from ..plans.schema import columns

NO_OPT = "struct<ver: int, udp: int, do: boolean, ext_rcode: int, dau: array<int>, dhu: array<int>, n3u: array<int>, nsid: binary, other: string, subnet: string>"


def record_columns(has_opt: bool) -> dict[str, Column]:
    """Every column of the record. "any" is the request's value, or the lone response's."""
    req, resp = (lambda c: F.col(f"req.{c}")), (lambda c: F.col(f"resp.{c}"))
    any_ = lambda c: F.when(F.col("req").isNotNull(), req(c)).otherwise(resp(c))
    req_opt = (lambda c: req(f"opt.{c}")) if has_opt else (lambda c: F.lit(None).cast(NO_OPT)[c])
    resp_opt = (lambda c: resp(f"opt.{c}")) if has_opt else (lambda c: F.lit(None).cast(NO_OPT)[c])
    q, r = req("flags_word"), resp("flags_word")
    ttl = any_("net_ttl")
    return {
        "time": seconds(F.col("ts_us")),
        "delay_us": resp("ts_us") - req("ts_us"),
        "req_dns_len": req("dns_len"), "resp_dns_len": resp("dns_len"), "req_net_len": req("net_len"), "resp_net_len": resp("net_len"),
        "client_addr": any_("client_addr"), "client_port": any_("client_port"), "server_addr": any_("server_addr"), "server_port": any_("server_port"),
        "net_proto": any_("net_proto"), "net_ipv": any_("net_ipv"), "net_ttl": F.when(ttl != 0, ttl),
        "req_udp_sum": F.when(req("net_proto") == 17, req("udp_sum")),
        "id": any_("dns_id"), "qtype": any_("qtype"), "qclass": any_("qclass"), "opcode": opcode(any_("flags_word")), "rcode": rcode(r),
        "resp_aa": flag(r, "aa"), "resp_tc": flag(r, "tc"), "req_rd": flag(q, "rd"), "resp_ra": flag(r, "ra"), "req_z": flag(q, "z"), "resp_ad": flag(r, "ad"), "req_cd": flag(q, "cd"),
        "qname": any_("qname"),
        "resp_ancount": resp("ancount"), "resp_arcount": resp("arcount"), "resp_nscount": resp("nscount"),
        "req_edns_ver": req_opt("ver"), "req_edns_udp": req_opt("udp"), "req_edns_do": req_opt("do"), "resp_edns_rcode": resp_opt("ext_rcode"),
        "req_edns_ping": F.lit(None).cast("boolean"),
        "req_edns_dau": req_opt("dau"), "req_edns_dhu": req_opt("dhu"), "req_edns_n3u": req_opt("n3u"), "resp_edns_nsid": resp_opt("nsid"),
        "edns_client_subnet": F.coalesce(resp_opt("subnet"), req_opt("subnet")), "edns_other": F.coalesce(req_opt("other"), resp_opt("other")),
    }


def project(pairs: DataFrame, flags=None, cbor: bool = False, keep=("seq", "ts_us")) -> DataFrame:
    """The record's columns of the chosen flags, led by ``keep``. What isn't chosen is never computed."""
    struct = next(f.dataType for f in pairs.schema if f.name == "req")
    made = record_columns("opt" in struct.names)
    return pairs.select(*keep, *[made[c].alias(c) for c in columns(flags, cbor)])


def time_parts(us: Column) -> dict[str, Column]:
    day = F.timestamp_micros(us)
    return {"unixtime": F.floor(us / 1_000_000), "time": F.floor(us / 1000), "year": F.year(day), "month": F.month(day), "day": F.dayofmonth(day)}


def warehouse(records: DataFrame) -> DataFrame:
    """The downstream table's columns, derived from full records."""
    c = F.col
    number = lambda flagged: c(flagged).cast("int")
    parts = time_parts(c("ts_us"))
    return records.select(
        "seq", *[e.alias(n) for n, e in parts.items()], c("delay_us").alias("time_micro"),
        c("req_net_len").alias("len"), c("resp_net_len").alias("res_len"), c("req_dns_len").alias("dns_len"), c("resp_dns_len").alias("dns_res_len"),
        c("client_addr").alias("src"), c("client_port").alias("srcp"), c("server_addr").alias("dst"), c("server_port").alias("dstp"),
        c("net_ttl").alias("ttl"), c("net_ipv").alias("ipv"), c("net_proto").alias("prot"), c("req_udp_sum").alias("udp_sum"),
        "id", "qname", domain_name(c("qname")).alias("domainname"), label_count(c("qname")).alias("labels"),
        number("resp_aa").alias("aa"), number("resp_tc").alias("tc"), number("req_rd").alias("rd"), number("resp_ra").alias("ra"), number("req_z").alias("z"),
        number("resp_ad").alias("ad"), number("req_cd").alias("cd"), c("resp_ancount").alias("ancount"), c("resp_arcount").alias("arcount"), c("resp_nscount").alias("nscount"),
        c("qname").isNotNull().cast("int").alias("qdcount"), "opcode", "rcode", "qtype", "qclass",
        c("req_edns_udp").alias("edns_udp"), c("req_edns_ver").alias("edns_version"), number("req_edns_do").alias("edns_do"),
    )
