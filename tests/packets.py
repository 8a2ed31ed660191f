"""Small packet tables for tests."""

SCHEMA = "seq long, ts_us long, src_addr string, src_port int, dst_addr string, dst_port int, net_ipv int, net_proto int, dns_id int, is_response boolean, qname string, drop_reason string"


def packet(seq, kind, sec, dns_id=7, qname="a.", client=("10.0.0.1", 1000), server=("192.0.2.53", 53), proto=17, ipv=4, swap=True, drop=None):
    a, b = (server, client) if kind == "A" and swap else (client, server)
    return (seq, round(sec * 1e6), a[0], a[1], b[0], b[1], ipv, proto, dns_id, kind == "A", qname, drop)


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def seqs(pairs):
    rows = pairs.select("req.seq", "resp.seq").toDF("q", "a").collect()
    return sorted(((r["q"], r["a"]) for r in rows), key=repr)
