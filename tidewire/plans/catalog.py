"""Registered queries over ``events`` seen as packets, and their DuckDB twins.

Integers are cast to bigint on both sides, so that schemas agree.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import build, scalar, wire
from ..functions.filters import capture_filter
from ..operators import arrival, dump, stats
from ..operators.match import match, match_fold
from ..operators.project import project, time_parts, warehouse
from ..sinks import cbor, csv
from ..sources import pcap
from ..sources.events import from_wire, packets, to_wire
from ..streaming.match import flush_row, match_stream
from .schema import columns
from .session import shared_folder

#: Matching window for the events, which are hours apart, and the length of a time slice.
WINDOW = 10_800_000_000
SLICE = 16 * WINDOW
PERIOD = 86_400
SOME = ["delay_us", "req_net_len", "id", "qname", "edns"]

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: wide(f(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def wide(df: DataFrame) -> DataFrame:
    """Integers as bigint; lists as text and bytes as hexadecimal digits."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        elif kind.startswith("array"):
            c = F.array_join(c.cast("array<string>"), ",")
        elif kind == "binary":
            c = F.hex(c)
        out.append(c.alias(name))
    return df.select(*out)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match(packets(spark, sf_dir), WINDOW, slice_us=SLICE)


# ---------------------------------------------------------------- SQL pieces

PACKETS = """
p AS (
  SELECT event_id AS seq, epoch_us(ts) AS ts_us, event_type IN ('click', 'purchase') AS is_response,
    CASE WHEN event_type = 'signup' THEN 'malformed' END AS drop_reason,
    CASE WHEN user_id % 3 = 0 THEN 6 ELSE 4 END AS net_ipv, CASE WHEN user_id % 12 = 0 THEN 6 ELSE 17 END AS net_proto,
    CASE WHEN user_id % 3 = 0 THEN '2001:db8::' || lower(to_hex(user_id)) ELSE '10.0.' || (user_id // 256) || '.' || (user_id % 256) END AS client_addr,
    1024 + user_id % 50000 AS client_port,
    CASE WHEN user_id % 3 = 0 THEN '2001:db8::53' ELSE '192.0.2.53' END AS server_addr, 53 AS server_port,
    CAST(floor(value) AS BIGINT) % 65 AS net_ttl, (event_id * 7) % 65536 AS udp_sum, (user_id * 7919) % 65536 AS dns_id, (event_id * 40503) % 65536 AS flags_word,
    17 + event_id % 480 AS dns_len, 59 + event_id % 480 AS net_len,
    'q' || (CAST(json_extract_string(props, '$.k') AS INT) % 8) || '.example.' AS qname, 1 + event_id % 16 AS qtype, 1 AS qclass,
    event_id % 5 AS ancount, event_id % 3 AS nscount, event_id % 4 AS arcount, event_id % 4 <> 0 AS has_opt,
    CASE WHEN event_id % 4 <> 0 AND event_id % 9 = 0 THEN '10,65001' END AS other, CASE WHEN event_id % 4 <> 0 AND event_id % 13 = 0 THEN '4,10.' || (user_id % 200) || '.0.0/16,0' END AS subnet
  FROM events)"""


def matching(key: str = "") -> str:
    keys = "net_ipv, net_proto, dns_id, client_addr, client_port, server_addr, server_port" + key
    return f"""{PACKETS},
s AS (SELECT *, sum(CASE WHEN is_response THEN -1 ELSE 1 END) OVER (PARTITION BY {keys} ORDER BY seq ROWS UNBOUNDED PRECEDING) AS s FROM p WHERE drop_reason IS NULL),
d AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY {keys} ORDER BY seq ROWS UNBOUNDED PRECEDING)) AS depth FROM s),
l AS (SELECT *, CASE WHEN is_response THEN coalesce(lag(depth) OVER (PARTITION BY {keys} ORDER BY seq), 0) ELSE depth END AS lvl FROM d),
n AS (SELECT *, lead(seq) OVER w AS next_seq, lead(is_response) OVER w AS next_response, lead(ts_us) OVER w AS next_ts,
        lag(is_response) OVER w AS before_response, lag(ts_us) OVER w AS before_ts FROM l WINDOW w AS (PARTITION BY {keys}, lvl ORDER BY seq)),
m AS (SELECT seq, ts_us, CASE WHEN NOT is_response THEN seq END AS req_seq,
        CASE WHEN is_response THEN seq WHEN next_response AND next_ts - ts_us < {WINDOW} THEN next_seq END AS resp_seq
      FROM n WHERE NOT (is_response AND lvl > 0 AND before_response = FALSE AND ts_us - before_ts < {WINDOW}))"""


PAIRS = matching() + """,
r AS (SELECT m.*, q.ts_us AS q_ts, a.ts_us AS a_ts, q.dns_len AS q_dns_len, a.dns_len AS a_dns_len, q.net_len AS q_net_len, a.net_len AS a_net_len,
    q.flags_word AS qf, a.flags_word AS af, q.net_proto AS q_proto, q.udp_sum AS q_sum, a.ancount, a.nscount, a.arcount,
    q.has_opt AS q_opt, a.has_opt AS a_opt, q.other AS q_other, a.other AS a_other, q.subnet AS q_subnet, a.subnet AS a_subnet, o.client_addr, o.client_port, o.server_addr, o.server_port, o.net_proto, o.net_ipv, o.net_ttl,
    o.dns_id, o.qtype, o.qclass, o.flags_word, o.qname
  FROM m LEFT JOIN p q ON q.seq = m.req_seq LEFT JOIN p a ON a.seq = m.resp_seq JOIN p o ON o.seq = m.seq)"""

#: SQL of each record column over r.
RECORD = {
    "time": "ts_us / 1e6", "delay_us": "CAST(a_ts - q_ts AS BIGINT)",
    "req_dns_len": "q_dns_len", "resp_dns_len": "a_dns_len", "req_net_len": "q_net_len", "resp_net_len": "a_net_len",
    "client_addr": "client_addr", "client_port": "client_port", "server_addr": "server_addr", "server_port": "CAST(server_port AS BIGINT)",
    "net_proto": "CAST(net_proto AS BIGINT)", "net_ipv": "CAST(net_ipv AS BIGINT)", "net_ttl": "CASE WHEN net_ttl <> 0 THEN net_ttl END",
    "req_udp_sum": "CASE WHEN q_proto = 17 THEN q_sum END", "id": "dns_id", "qtype": "qtype", "qclass": "CAST(qclass AS BIGINT)",
    "opcode": "(flags_word // 2048) % 16", "rcode": "af % 16",
    "resp_aa": "(af // 1024) % 2 = 1", "resp_tc": "(af // 512) % 2 = 1", "req_rd": "(qf // 256) % 2 = 1", "resp_ra": "(af // 128) % 2 = 1",
    "req_z": "(qf // 64) % 2 = 1", "resp_ad": "(af // 32) % 2 = 1", "req_cd": "(qf // 16) % 2 = 1",
    "qname": "qname", "resp_ancount": "ancount", "resp_arcount": "arcount", "resp_nscount": "nscount",
    "req_edns_ver": "CASE WHEN q_opt THEN CAST(0 AS BIGINT) END", "req_edns_udp": "CASE WHEN q_opt THEN 512 + req_seq % 3584 END", "req_edns_do": "CASE WHEN q_opt THEN req_seq % 2 = 1 END",
    "resp_edns_rcode": "CASE WHEN a_opt THEN resp_seq % 3 END", "req_edns_ping": "CAST(NULL AS BOOLEAN)",
    "req_edns_dau": "CASE WHEN q_opt AND req_seq % 5 = 0 THEN '5,7,8' END", "req_edns_dhu": "CASE WHEN q_opt AND req_seq % 7 = 0 THEN '1,2' END", "req_edns_n3u": "CASE WHEN q_opt AND req_seq % 11 = 0 THEN '1' END",
    "resp_edns_nsid": "CASE WHEN a_opt AND resp_seq % 3 = 0 THEN hex('ns,' || (resp_seq % 4)) END",
    "edns_client_subnet": "coalesce(a_subnet, q_subnet)", "edns_other": "coalesce(q_other, a_other)",
}


def record_sql(flags=None, cbor_form: bool = False) -> str:
    listed = ", ".join(f"{RECORD[c]} AS {c}" for c in columns(flags, cbor_form))
    return f"WITH {PAIRS} SELECT seq, ts_us, {listed} FROM r"


# ------------------------------------------------------------------- queries

SCAN = "seq, ts_us, client_addr, client_port, server_addr, CAST(server_port AS BIGINT) AS server_port, CAST(net_ipv AS BIGINT) AS net_ipv, CAST(net_proto AS BIGINT) AS net_proto, dns_id, qname"
SCANNED = ["seq", "ts_us", "client_addr", "client_port", "server_addr", "server_port", "net_ipv", "net_proto", "dns_id", "qname"]


@query(f"""WITH {PACKETS} SELECT seq, ts_us, CASE WHEN is_response THEN server_addr ELSE client_addr END AS src_addr, CASE WHEN is_response THEN server_port ELSE client_port END AS src_port,
CASE WHEN is_response THEN client_addr ELSE server_addr END AS dst_addr, CASE WHEN is_response THEN client_port ELSE server_port END AS dst_port,
CAST(net_ipv AS BIGINT) AS net_ipv, CAST(net_proto AS BIGINT) AS net_proto, net_len, net_ttl, udp_sum, dns_len, is_response, dns_id, flags_word, qname, qtype, drop_reason FROM p""")
def scan_packets(spark, sf_dir):
    return packets(spark, sf_dir).select(
        "seq", "ts_us", "src_addr", "src_port", "dst_addr", "dst_port", "net_ipv", "net_proto", "net_len", "net_ttl", "udp_sum", "dns_len", "is_response", "dns_id", "flags_word", "qname", "qtype", "drop_reason"
    )


@query(f"WITH {PACKETS} SELECT {SCAN} FROM p")
def direction_normalise(spark, sf_dir):
    return scalar.directed(packets(spark, sf_dir)).select(*SCANNED)


@query(f"WITH {PACKETS} SELECT {SCAN} FROM p WHERE client_port = 1124 OR server_port = 1124")
def filter_port(spark, sf_dir):
    return scalar.directed(packets(spark, sf_dir).filter(capture_filter("port 1124"))).select(*SCANNED)


@query(f"WITH {PACKETS} SELECT {SCAN} FROM p WHERE regexp_matches(client_addr, '^2001:db8::[67][0-9a-f]$')")
def filter_net6(spark, sf_dir):
    return scalar.directed(packets(spark, sf_dir).filter(capture_filter("net 2001:db8::60/123"))).select(*SCANNED)


@query(f"WITH {PACKETS} SELECT {SCAN} FROM p WHERE (client_port = 1124 OR net_proto = 17) AND net_ipv = 6 AND net_len BETWEEN 100 AND 400")
def filter_left_to_right(spark, sf_dir):
    """``and`` and ``or`` without brackets are equals."""
    wanted = capture_filter("src or dst port 1124 or udp and ip6 and greater 100 and not greater 401")
    return scalar.directed(packets(spark, sf_dir).filter(wanted)).select(*SCANNED)


@query(f"WITH {PACKETS} SELECT {SCAN} FROM p WHERE net_proto = 17")
def filter_proto_udp(spark, sf_dir):
    return scalar.directed(packets(spark, sf_dir).filter(capture_filter("udp"))).select(*SCANNED)


@query(f"""WITH {PACKETS} SELECT {SCAN} FROM p WHERE NOT is_response AND net_ipv = 4 AND client_addr LIKE '10.0.1.%'
OR is_response AND net_proto = 6 AND NOT client_addr = '2001:db8::c'""")
def filter_expression(spark, sf_dir):
    wanted = capture_filter("src net 10.0.1.0/24 or (tcp and src port 53 and not dst host 2001:db8::c)")
    return scalar.directed(packets(spark, sf_dir).filter(wanted)).select(*SCANNED)


@query(f"""WITH {PACKETS} SELECT ts_us, CAST(net_ipv AS BIGINT) AS net_ipv, CAST(net_proto AS BIGINT) AS net_proto, CAST(40 AS BIGINT) AS captured,
CASE WHEN net_ipv = 4 AND net_proto = 17 THEN CAST(12 AS BIGINT) END AS payload_bytes, CASE WHEN net_ipv <> 4 OR net_proto <> 17 THEN 'network' END AS reason FROM p""")
def snap_length(spark, sf_dir):
    """Capture files read with 40 bytes a packet: that leaves 12 of a message over IPv4 and UDP, and cuts into all other headers."""
    folder = shared_folder(spark, "capture")
    pcap.write(framed(packets(spark, sf_dir)), folder)
    return pcap.read(spark, folder, snaplen=40).select("ts_us", "net_ipv", "net_proto", F.length("raw").alias("captured"), F.length("payload").alias("payload_bytes"), F.col("drop_reason").alias("reason"))


@query(f"WITH {PACKETS} SELECT coalesce(drop_reason, 'valid') AS drop_reason, count(*) AS packets, CAST(sum(net_len) AS BIGINT) AS bytes FROM p GROUP BY 1")
def drop_reasons(spark, sf_dir):
    return stats.drop_counts(packets(spark, sf_dir))


def seqs(found: DataFrame) -> DataFrame:
    return found.select("seq", "ts_us", F.col("req.seq").alias("req_seq"), F.col("resp.seq").alias("resp_seq"))


@query(f"WITH {matching()} SELECT m.req_seq, m.resp_seq, a.ts_us - q.ts_us AS delay_us, q.client_addr, q.dns_id, q.qname FROM m JOIN p q ON q.seq = m.req_seq JOIN p a ON a.seq = m.resp_seq")
def match_pairs(spark, sf_dir):
    both = pairs(spark, sf_dir).filter("req is not null and resp is not null")
    return both.select(F.col("req.seq").alias("req_seq"), F.col("resp.seq").alias("resp_seq"), (F.col("resp.ts_us") - F.col("req.ts_us")).alias("delay_us"), "req.client_addr", "req.dns_id", "req.qname")


@query(f"WITH {matching()} SELECT * FROM m")
def match_outer_all(spark, sf_dir):
    return seqs(pairs(spark, sf_dir))


@query(f"WITH {matching()} SELECT * FROM m")
def match_unsliced(spark, sf_dir):
    return seqs(match(packets(spark, sf_dir), WINDOW))


@query(f"WITH {matching()} SELECT seq, ts_us FROM m WHERE resp_seq IS NULL")
def match_request_only(spark, sf_dir):
    return pairs(spark, sf_dir).filter("resp is null").select("seq", "ts_us")


@query(f"WITH {matching()} SELECT seq, ts_us FROM m WHERE req_seq IS NULL")
def match_response_only(spark, sf_dir):
    return pairs(spark, sf_dir).filter("req is null").select("seq", "ts_us")


@query(f"WITH {matching()} SELECT q.net_proto::BIGINT AS net_proto, count(*) AS pairs, min(a.ts_us - q.ts_us) AS least, max(a.ts_us - q.ts_us) AS most FROM m JOIN p q ON q.seq = m.req_seq JOIN p a ON a.seq = m.resp_seq GROUP BY 1")
def match_delay(spark, sf_dir):
    delay = F.col("resp.ts_us") - F.col("req.ts_us")
    both = pairs(spark, sf_dir).filter("req is not null and resp is not null")
    return both.groupBy(F.col("req.net_proto").alias("net_proto")).agg(F.count("*").alias("pairs"), F.min(delay).alias("least"), F.max(delay).alias("most"))


@query(f"WITH {matching(', qname')} SELECT * FROM m")
def match_qname_simple(spark, sf_dir):
    return seqs(match(packets(spark, sf_dir), WINDOW, match_qname=True, slice_us=SLICE))


@query(f"WITH {matching(', qname')} SELECT * FROM m")
def match_qname_fold(spark, sf_dir):
    return seqs(match_fold(packets(spark, sf_dir), WINDOW, slice_us=SLICE))


def disordered(packets: DataFrame) -> DataFrame:
    """One packet in seven is up to 14 hours older than its place tells."""
    behind = F.when(F.col("seq") % 7 == 0, (F.col("seq") * 7919 % 50_000) * 1_000_000).otherwise(0)
    return packets.withColumn("ts_us", F.col("ts_us") - behind)


BEHIND = "SELECT * REPLACE (ts_us - CASE WHEN seq % 7 = 0 THEN (seq * 7919 % 50000) * 1000000 ELSE 0 END AS ts_us) FROM p WHERE drop_reason IS NULL"
KEYS = "net_ipv, net_proto, dns_id, client_addr, client_port, server_addr, server_port"
#: Rounds of verdicts in the SQL twin; the library goes on until nothing changes.
ROUNDS = 8


def arrival_sql() -> str:
    so_far = "OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING)"
    parts = [f"""{PACKETS}, o AS ({BEHIND}),
s AS (SELECT *, sum(CASE WHEN is_response THEN -1 ELSE 1 END) OVER (PARTITION BY {KEYS} ORDER BY seq ROWS UNBOUNDED PRECEDING) AS s FROM o),
d AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY {KEYS} ORDER BY seq ROWS UNBOUNDED PRECEDING)) AS depth FROM s),
l AS (SELECT *, CASE WHEN is_response THEN coalesce(lag(depth) OVER (PARTITION BY {KEYS} ORDER BY seq), 0) ELSE depth END AS lvl FROM d),
b AS (SELECT *, lag(seq) OVER w AS before_seq, lag(is_response) OVER w AS before_response FROM l WINDOW w AS (PARTITION BY {KEYS}, lvl ORDER BY seq)),
t AS (SELECT seq, ts_us, is_response, max(ts_us) {so_far} AS c, CASE WHEN is_response AND lvl > 0 AND NOT before_response THEN before_seq END AS req FROM b),
late0 AS (SELECT seq FROM t WHERE FALSE)"""]
    for k in range(ROUNDS):
        parts.append(f"""w{k} AS (SELECT t.seq, max(CASE WHEN NOT is_response OR req IS NULL OR x.seq IS NOT NULL THEN ts_us END) OVER (ORDER BY t.seq ROWS UNBOUNDED PRECEDING) AS p FROM t LEFT JOIN late{k} x ON x.seq = t.seq),
late{k + 1} AS (SELECT t.seq FROM t JOIN w{k} w ON w.seq = t.req WHERE t.c >= w.p + {WINDOW})""")
    pairs = f"pr AS (SELECT seq AS resp_seq, req AS req_seq FROM t WHERE req IS NOT NULL AND seq NOT IN (SELECT seq FROM late{ROUNDS}))"
    return f"""WITH {", ".join(parts)}, {pairs}
SELECT t.seq, t.ts_us, CASE WHEN NOT t.is_response THEN t.seq END AS req_seq, CASE WHEN t.is_response THEN t.seq ELSE pr.resp_seq END AS resp_seq
FROM t LEFT JOIN pr ON pr.req_seq = t.seq WHERE t.seq NOT IN (SELECT resp_seq FROM pr)"""


@query(f"WITH {PACKETS}, o AS ({BEHIND}) SELECT seq, ts_us, max(ts_us) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS clock_us FROM o")
def arrival_clock(spark, sf_dir):
    return arrival.clock(disordered(packets(spark, sf_dir)))


@query(arrival_sql())
def match_arrival(spark, sf_dir):
    """Packets out of order, matched by the clock of arrival."""
    return seqs(match(disordered(packets(spark, sf_dir)), WINDOW, strict_arrival=True))


#: A window in which more requests wait than one response looks at.
LONG = 40 * WINDOW


def crowded(packets: DataFrame) -> DataFrame:
    """Packets of 16 keys; one response in three asks by the root, which any name answers."""
    r = F.col("is_response")
    sides = {"src_addr": ("192.0.2.53", "10.0.0.1"), "dst_addr": ("10.0.0.1", "192.0.2.53"), "src_port": (53, 1000), "dst_port": (1000, 53)}
    same = {c: F.when(r, a).otherwise(b) for c, (a, b) in sides.items()} | {"net_ipv": F.lit(4), "net_proto": F.lit(17), "dns_id": F.col("dns_id") % 16}
    return packets.withColumns(same | {"qname": F.when(r & (F.col("seq") % 3 == 0), ".").otherwise(F.col("qname"))})


@query(f"""WITH RECURSIVE {PACKETS},
g AS (SELECT seq, ts_us, is_response, dns_id % 16 AS grp, CASE WHEN is_response AND seq % 3 = 0 THEN '.' ELSE qname END AS qname, row_number() OVER (PARTITION BY dns_id % 16 ORDER BY seq) AS k FROM p WHERE drop_reason IS NULL),
f AS (
  SELECT grp, k, seq, ts_us, is_response, CAST(NULL AS BIGINT) AS taken, CASE WHEN is_response THEN [] ELSE [{{'s': seq, 't': ts_us, 'q': qname}}] END AS pend FROM g WHERE k = 1
  UNION ALL
  SELECT grp, k, seq, ts_us, is_response, taken, CASE WHEN is_response THEN list_filter(alive, lambda x: x.s IS DISTINCT FROM taken) ELSE list_append(alive, {{'s': seq, 't': ts_us, 'q': qname}}) END FROM (
    SELECT *, CASE WHEN is_response THEN list_filter(alive[-33:], lambda x: qname = '.' OR x.q = qname)[-1].s END AS taken FROM (
      SELECT g.*, list_filter(f.pend, lambda x: g.ts_us - x.t < {LONG}) AS alive FROM f JOIN g ON g.grp = f.grp AND g.k = f.k + 1)))
SELECT f.seq, f.ts_us, CASE WHEN NOT f.is_response THEN f.seq END AS req_seq, CASE WHEN f.is_response THEN f.seq ELSE a.seq END AS resp_seq
FROM f LEFT JOIN f a ON a.taken = f.seq WHERE f.taken IS NULL""")
def match_wildcards(spark, sf_dir):
    """Names with the root as wildcard, and keys with more pending requests than one response looks at."""
    return seqs(match_fold(crowded(packets(spark, sf_dir)), LONG))


FLAGS = ["opcode", "rcode", "resp_aa", "resp_tc", "req_rd", "resp_ra", "req_z", "resp_ad", "req_cd"]


@query(f"WITH {PAIRS} SELECT seq, {', '.join(f'{RECORD[c]} AS {c}' for c in FLAGS)} FROM r")
def flags_decode(spark, sf_dir):
    return project(pairs(spark, sf_dir), ["opcode", "rcode", "flags"], keep=["seq"])


@query(f"WITH {PAIRS} SELECT seq, ancount AS resp_ancount, arcount AS resp_arcount, nscount AS resp_nscount FROM r")
def rr_counts(spark, sf_dir):
    return project(pairs(spark, sf_dir), ["rr_counts"], keep=["seq"])


@query(record_sql())
def project_all(spark, sf_dir):
    return project(pairs(spark, sf_dir))


@query(record_sql(cbor_form=True))
def project_binary_form(spark, sf_dir):
    return project(pairs(spark, sf_dir), cbor=True)


@query(record_sql(SOME))
def project_some(spark, sf_dir):
    return project(pairs(spark, sf_dir), SOME)


@query(f"WITH {PAIRS} SELECT seq, {RECORD['net_ttl']} AS net_ttl FROM r")
def ttl_null_if_zero(spark, sf_dir):
    return project(pairs(spark, sf_dir), ["net_ttl"], keep=["seq"])


@query(f"WITH {PAIRS} SELECT seq, {RECORD['req_udp_sum']} AS req_udp_sum FROM r")
def udp_sum_rule(spark, sf_dir):
    return project(pairs(spark, sf_dir), ["req_udp_sum"], keep=["seq"])


def csv_sql(flags, separator: str) -> str:
    texts = []
    for c in columns(flags):
        e = RECORD[c]
        if c == "time":
            e = "(ts_us // 1000000) || '.' || lpad((ts_us % 1000000)::VARCHAR, 6, '0')"
        elif c.startswith(("resp_a", "resp_t", "resp_r", "req_rd", "req_z", "req_cd", "req_edns_do", "req_edns_ping")) and not c.endswith("count"):
            e = f"coalesce(CAST(CAST({e} AS INT) AS VARCHAR), '')"
        elif c.startswith(("req_edns_d", "req_edns_n")):
            joined = f"replace({e}, ',', '\\,')" if separator == "," else e
            e = f"coalesce({joined}, '\\N')"
        elif c == "resp_edns_nsid":
            plain = "CASE WHEN a_opt AND resp_seq % 3 = 0 THEN 'ns,' || (resp_seq % 4) END"
            e = f"coalesce(replace({plain}, ',', '\\,'), '\\N')" if separator == "," else f"coalesce({plain}, '\\N')"
        elif c in ("edns_client_subnet", "edns_other") and separator == ",":
            e = f"coalesce(replace({e}, ',', '\\,'), '\\N')"
        elif c in ("qname", "client_addr", "server_addr", "edns_client_subnet", "edns_other"):
            e = f"coalesce({e}, '\\N')"
        else:
            e = f"coalesce(CAST({e} AS VARCHAR), '')"
        texts.append(e)
    return f"WITH {PAIRS} SELECT seq, concat_ws('{separator}', {', '.join(texts)}) AS line FROM r"


@query(csv_sql(None, ","))
def csv_lines(spark, sf_dir):
    return csv.lines(project(pairs(spark, sf_dir))).select("seq", "line")


@query(csv_sql(SOME, "|"))
def csv_lines_some(spark, sf_dir):
    return csv.lines(project(pairs(spark, sf_dir), SOME), SOME, "|").select("seq", "line")


@query(f"""WITH {PACKETS} SELECT seq, replace(replace(replace(replace(qname || chr(92) || seq || chr(10) || ',', chr(92), chr(92) || chr(92)), chr(0), chr(92) || '0'), chr(10), chr(92) || 'n'), ',', chr(92) || ',') AS escaped FROM p""")
def csv_escape(spark, sf_dir):
    text = F.concat("qname", F.lit("\\"), F.col("seq").cast("string"), F.lit("\n,"))
    return packets(spark, sf_dir).select("seq", scalar.escape(text, ",").alias("escaped"))


@query(f"WITH {PACKETS} SELECT seq, CASE WHEN seq % 5 = 0 AND has_opt THEN '5\\,7\\,8' END AS comma, CASE WHEN seq % 5 = 0 AND has_opt THEN '5,7,8' END AS bar FROM p")
def list_format(spark, sf_dir):
    return packets(spark, sf_dir).select("seq", scalar.number_list(F.col("opt.dau"), ",").alias("comma"), scalar.number_list(F.col("opt.dau"), "|").alias("bar"))


@query(f"WITH {PACKETS} SELECT DISTINCT qname, CAST(len(string_split(rtrim(qname, '.'), '.')) AS BIGINT) AS labels FROM p")
def qname_labels(spark, sf_dir):
    return packets(spark, sf_dir).select("qname", scalar.label_count(F.col("qname")).alias("labels")).distinct()


@query(f"WITH {PACKETS} SELECT seq, rtrim(qname, '.') AS domainname FROM p")
def qname_domainname(spark, sf_dir):
    return packets(spark, sf_dir).select("seq", scalar.domain_name(F.col("qname")).alias("domainname"))


TIMES = "ts_us // 1000000 AS unixtime, ts_us // 1000 AS time, year(make_timestamp(ts_us)) AS year, month(make_timestamp(ts_us)) AS month, day(make_timestamp(ts_us)) AS day"


@query(f"WITH {PACKETS} SELECT seq, {TIMES} FROM p")
def time_parts_of_packets(spark, sf_dir):
    return packets(spark, sf_dir).select("seq", *[e.alias(n) for n, e in time_parts(F.col("ts_us")).items()])


@query(f"WITH {PACKETS} SELECT seq, strftime(make_timestamp(ts_us), 'out-%Y%m%d-%H%M%S.csv') AS path FROM p")
def file_names(spark, sf_dir):
    return packets(spark, sf_dir).select("seq", scalar.strftime(F.col("ts_us"), "out-%Y%m%d-%H%M%S.csv").alias("path"))


@query(f"""WITH {PAIRS} SELECT seq, {TIMES}, CAST(a_ts - q_ts AS BIGINT) AS time_micro, q_net_len AS len, a_net_len AS res_len, q_dns_len AS dns_len, a_dns_len AS dns_res_len,
client_addr AS src, client_port AS srcp, server_addr AS dst, CAST(server_port AS BIGINT) AS dstp, {RECORD['net_ttl']} AS ttl, CAST(net_ipv AS BIGINT) AS ipv, CAST(net_proto AS BIGINT) AS prot,
{RECORD['req_udp_sum']} AS udp_sum, dns_id AS id, qname, rtrim(qname, '.') AS domainname, CAST(2 AS BIGINT) AS labels,
{', '.join(f'CAST({RECORD[c]} AS BIGINT) AS {c.split("_")[1]}' for c in ('resp_aa', 'resp_tc', 'req_rd', 'resp_ra', 'req_z', 'resp_ad', 'req_cd'))},
ancount, arcount, nscount, CAST(1 AS BIGINT) AS qdcount, {RECORD['opcode']} AS opcode, {RECORD['rcode']} AS rcode, qtype, CAST(qclass AS BIGINT) AS qclass,
{RECORD['req_edns_udp']} AS edns_udp, {RECORD['req_edns_ver']} AS edns_version, CAST({RECORD['req_edns_do']} AS BIGINT) AS edns_do FROM r""")
def warehouse_layer(spark, sf_dir):
    return warehouse(project(pairs(spark, sf_dir)))


RATES = "CASE WHEN {span} > 0 THEN count(*) / {span} END AS packets_per_sec, CASE WHEN {span} > 0 THEN CAST(sum(net_len) AS BIGINT) / {span} END AS bytes_per_sec"
INPUT = "count(*) AS packets, CAST(sum(net_len) AS BIGINT) AS bytes, count(drop_reason) AS dropped"


@query(f"WITH {PACKETS} SELECT {INPUT}, {RATES.format(span='((max(ts_us) - min(ts_us)) / 1e6)')} FROM p")
def stats_totals(spark, sf_dir):
    return stats.input_totals(packets(spark, sf_dir))


@query(f"WITH {PACKETS} SELECT ts_us - ts_us % {PERIOD * 10**6} AS period_us, {INPUT}, {RATES.format(span=f'{PERIOD}.0::DOUBLE')} FROM p GROUP BY 1")
def stats_per_period(spark, sf_dir):
    return stats.input_per_period(packets(spark, sf_dir), PERIOD)


OUTPUT = "count(*) AS items, count(*) FILTER (resp_seq IS NULL) AS request_only, count(*) FILTER (req_seq IS NULL) AS response_only"


@query(f"WITH {matching()} SELECT {OUTPUT} FROM m")
def output_totals(spark, sf_dir):
    return stats.output_totals(pairs(spark, sf_dir))


@query(f"WITH {matching()} SELECT ts_us - ts_us % {PERIOD * 10**6} AS file_us, {OUTPUT} FROM m GROUP BY 1")
def rotation_window(spark, sf_dir):
    return stats.output_per_file(pairs(spark, sf_dir), PERIOD)


@query(f"""WITH RECURSIVE {matching()}, cl AS (SELECT *, max(ts_us) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS c FROM m),
o AS (SELECT min(c) AS opened_us FROM cl UNION ALL SELECT min(cl.c) FROM o JOIN cl ON cl.c > o.opened_us + {PERIOD * 10**6} HAVING min(cl.c) IS NOT NULL),
x AS (SELECT cl.*, o.opened_us FROM cl ASOF JOIN o ON cl.c >= o.opened_us)
SELECT opened_us, {OUTPUT} FROM x GROUP BY 1""")
def rotation_greedy(spark, sf_dir):
    """Files that each open when the one before is more than a period old."""
    return stats.output_per_opening(pairs(spark, sf_dir), PERIOD)


@query(f"""WITH {matching()},
f AS (SELECT ts_us - ts_us % 3600000000 AS frame_us, count(*) AS packets, CAST(sum(net_len) AS BIGINT) AS bytes, count(*) FILTER (NOT is_response) AS requests FROM p WHERE drop_reason IS NULL GROUP BY 1),
g AS (SELECT ts_us - ts_us % 3600000000 AS frame_us, count(*) FILTER (req_seq IS NOT NULL AND resp_seq IS NOT NULL) AS matched, count(*) FILTER (req_seq IS NULL) AS unmatched_responses FROM m GROUP BY 1)
SELECT frame_us, coalesce(packets, 0) AS packets, coalesce(bytes, 0) AS bytes, coalesce(requests, 0) AS requests, coalesce(matched, 0) AS matched, coalesce(unmatched_responses, 0) AS unmatched_responses
FROM f FULL JOIN g USING (frame_us)""")
def frame_stats(spark, sf_dir):
    p = packets(spark, sf_dir)
    return stats.frame_stats(p, match(p, WINDOW, slice_us=SLICE), 3_600_000_000)


RATE = 0.02
#: The token bucket packet by packet: one recursion step for each place in a file.
BUCKET = f"""WITH RECURSIVE {PACKETS},
d AS (SELECT seq, ts_us, net_len AS size, ts_us - ts_us % {PERIOD * 10**6} AS file_us, row_number() OVER (PARTITION BY ts_us - ts_us % {PERIOD * 10**6} ORDER BY seq) AS k FROM p WHERE drop_reason IS NOT NULL),
b AS (
  SELECT seq, file_us, ts_us, size, k, TRUE AS admitted, {RATE} * {dump.BURST}::DOUBLE - size AS left_, ts_us AS clock FROM d WHERE k = 1
  UNION ALL
  SELECT seq, file_us, ts_us, size, k, t >= 0, t - CASE WHEN t >= 0 THEN size ELSE 0 END, greatest(clock, ts_us) FROM (
    SELECT d.*, b.clock, CASE WHEN d.ts_us > b.clock THEN least({RATE} * {dump.BURST}::DOUBLE, b.left_ + {RATE}::DOUBLE * (d.ts_us - b.clock) / 1e6) ELSE b.left_ END AS t
    FROM b JOIN d ON d.file_us = b.file_us AND d.k = b.k + 1))"""


@query(f"{BUCKET} SELECT seq, file_us, ts_us, size, admitted FROM b")
def dump_rate_limit(spark, sf_dir):
    return dump.limited(dump.invalid(packets(spark, sf_dir)), RATE, PERIOD)


@query(f"{BUCKET} SELECT file_us, count(*) FILTER (admitted) AS dumped, CAST(coalesce(sum(size) FILTER (admitted), 0) AS BIGINT) AS dumped_bytes, count(*) FILTER (NOT admitted) AS skipped FROM b GROUP BY 1")
def dump_stats(spark, sf_dir):
    return stats.dump_stats(dump.limited(dump.invalid(packets(spark, sf_dir)), RATE, PERIOD))


def framed(rows: DataFrame) -> DataFrame:
    """Frames of the table's packets, whose clients have addresses of the wire there."""
    return build.frames(rows.withColumns({c: to_wire(F.col(c)) for c in ("src_addr", "dst_addr")}))


#: Columns that come back from a capture file as they went in.
WIRE = "ts_us, CASE WHEN is_response THEN server_addr WHEN client_addr = '2001:db8::0' THEN '2001:db8::' ELSE client_addr END AS src_addr, CASE WHEN is_response THEN client_port ELSE 53 END AS dst_port, CAST(net_ipv AS BIGINT) AS net_ipv, CAST(net_proto AS BIGINT) AS net_proto, net_ttl, CASE WHEN net_proto = 17 THEN udp_sum ELSE 0 END AS udp_sum, is_response, dns_id, qname, qtype, CAST(qclass AS BIGINT) AS qclass, CASE WHEN has_opt THEN 512 + seq % 3584 END AS edns_udp, CASE WHEN has_opt AND seq % 5 = 0 THEN '5,7,8' END AS edns_dau, subnet AS edns_subnet, other AS edns_other"


@query(f"WITH {PACKETS} SELECT {WIRE} FROM p WHERE drop_reason IS NULL")
def capture_round_trip(spark, sf_dir):
    """Packets to capture files, read back and decoded."""
    folder = shared_folder(spark, "capture")
    pcap.write(framed(packets(spark, sf_dir)), folder, "gzip")
    return on_the_wire(pcap.read(spark, folder))


def on_the_wire(frames: DataFrame) -> DataFrame:
    back = wire.decode(frames).filter("drop_reason is null")
    edns = [F.col(f"opt.{c}").alias(f"edns_{c}") for c in ("udp", "dau", "subnet", "other")]
    return back.select("ts_us", from_wire(F.col("src_addr")).alias("src_addr"), "dst_port", "net_ipv", "net_proto", "net_ttl", "udp_sum", "is_response", "dns_id", "qname", "qtype", "qclass", *edns)


@query(f"WITH {PACKETS} SELECT {WIRE} FROM p WHERE drop_reason IS NULL")
def capture_parts(spark, sf_dir):
    """Plain capture files, read in parts of 256 KB."""
    folder = shared_folder(spark, "capture")
    pcap.write(framed(packets(spark, sf_dir)), folder)
    return on_the_wire(pcap.read(spark, folder, split_bytes=1 << 18))


@query(f"""WITH {PACKETS} SELECT {WIRE} FROM p WHERE drop_reason IS NULL AND (net_proto = 17 OR net_ipv = 6)
AND (client_addr IN ('10.0.0.100', '10.0.0.101', '10.0.0.102', '10.0.0.103') OR client_port BETWEEN 1030 AND 1090)""")
def capture_filtered(spark, sf_dir):
    """A filter that the reader tests on header bytes; equals from left to right."""
    folder = shared_folder(spark, "capture")
    pcap.write(framed(packets(spark, sf_dir)), folder)
    return on_the_wire(pcap.read(spark, folder, filter="udp or ip6 and (net 10.0.0.100/30 or portrange 1030-1090)"))


@query(f"WITH {PACKETS} SELECT coalesce(drop_reason, 'valid') AS drop_reason, count(*) AS packets FROM p GROUP BY 1")
def capture_drop_reasons(spark, sf_dir):
    folder = shared_folder(spark, "capture")
    pcap.write(framed(packets(spark, sf_dir)), folder)
    return stats.drop_counts(wire.decode(pcap.read(spark, folder))).drop("bytes")


def spoiled(frames: DataFrame) -> DataFrame:
    """Frames of which some have a fault that the reader or decoder drops them for, by ``seq`` modulo 8."""
    at = lambda k: F.substring("raw", k + 1, 1)
    v4, kind = F.hex(at(0)) == "45", F.pmod("seq", F.lit(8))
    # TCP is used over IPv6 alone; its header begins at byte 40.
    tcp = ~v4 & (F.hex(at(6)) == "06")

    def put(k: int, digits: str):
        new = F.unhex(F.lit(digits))
        return F.concat(F.substring("raw", 1, k), new, F.expr(f"substring(raw, {k + 1 + len(digits) // 2})"))

    # Too short for an IP header; a fragment; another protocol; SYN; a short TCP header; a wrong length prefix; a request whose records go past it.
    raw = F.when(kind == 0, F.substring("raw", 1, 15)).when(v4 & (kind == 1), put(6, "2000")).when(kind == 2, F.when(v4, put(9, "84")).otherwise(put(6, "84")))
    raw = raw.when(tcp & (kind == 3), put(53, "02")).when(tcp & (kind == 4), F.substring("raw", 1, 50)).when(tcp & (kind == 5), put(60, "0005"))
    raw = raw.when(v4 & (kind == 6), put(38, "0009"))
    return frames.withColumn("raw", raw.otherwise(F.col("raw")))


@query(f"""WITH {PACKETS}, s AS (SELECT CASE WHEN seq % 8 = 0 THEN 'network' WHEN net_ipv = 4 AND seq % 8 = 1 THEN 'fragmented' WHEN seq % 8 = 2 THEN 'transport'
  WHEN net_proto = 6 AND seq % 8 = 3 THEN 'transport' WHEN net_proto = 6 AND seq % 8 = 4 THEN 'network' WHEN net_proto = 6 AND seq % 8 = 5 THEN 'transport'
  WHEN net_ipv = 4 AND seq % 8 = 6 AND NOT is_response THEN 'malformed' ELSE coalesce(drop_reason, 'valid') END AS drop_reason,
  CASE WHEN seq % 8 > 5 THEN 6 WHEN seq % 8 > 2 AND net_proto <> 6 THEN 9 ELSE seq % 8 END AS fault, ts_us FROM p)
SELECT drop_reason, fault, count(*) AS packets, min(ts_us) AS first_us, max(ts_us) AS last_us FROM s GROUP BY 1, 2""")
def capture_faults(spark, sf_dir):
    """Every reason to drop a packet, from capture files with such packets, by the kind of fault (9: none)."""
    folder = shared_folder(spark, "capture")
    made = packets(spark, sf_dir)
    pcap.write(spoiled(framed(made.repartitionByRange("seq").sortWithinPartitions("seq"))), folder)
    fault = F.when(F.col("seq") % 8 > 5, 6).when((F.col("seq") % 8 > 2) & (F.col("net_proto") != 6), 9).otherwise(F.col("seq") % 8)
    # A frame is known by its time; among those of one time, by its place, as files are written and read in the order of ``seq``.
    nth = F.row_number().over(Window.partitionBy("ts_us").orderBy("seq")).alias("nth")
    read = wire.decode(pcap.read(spark, folder)).select("ts_us", nth, "drop_reason").join(made.select("ts_us", nth, fault.alias("fault")), ["ts_us", "nth"])
    return read.groupBy(F.coalesce("drop_reason", F.lit("valid")).alias("drop_reason"), "fault").agg(F.count("*").alias("packets"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))


@query(f"WITH {PACKETS} SELECT ts_us, drop_reason FROM p WHERE drop_reason IS NOT NULL OR client_port <> 1124 AND server_port <> 1124")
def filter_not_port(spark, sf_dir):
    """Packets without ports pass a negated filter."""
    rows = packets(spark, sf_dir)
    bare = [F.when(F.col("drop_reason").isNull(), F.col(c)).alias(c) if c.endswith("_port") else F.col(c) for c in rows.columns]
    return rows.select(*bare).filter(capture_filter("not port 1124")).select("ts_us", "drop_reason")


@query(f"WITH {PAIRS} SELECT seq, delay_us, q_net_len AS req_net_len, qname FROM (SELECT *, CAST(a_ts - q_ts AS BIGINT) AS delay_us FROM r)")
def cbor_round_trip(spark, sf_dir):
    """Records to CBOR files and back; the reader gives JSON items, the first of each file its names."""
    folder, flags = shared_folder(spark, "cbor"), ["id", "delay_us", "req_net_len", "qname"]
    records = project(pairs(spark, sf_dir), flags).withColumn("id", F.col("seq"))
    cbor.write(records, folder, flags)
    items = cbor.read(spark, folder).filter("number > 0").select(F.from_json("item", "array<string>").alias("v"))
    at = {c: F.col("v")[k] for k, c in enumerate(columns(flags, cbor=True))}
    return items.select(at["id"].cast("long").alias("seq"), at["delay_us"].cast("long").alias("delay_us"), at["req_net_len"].cast("long").alias("req_net_len"), at["qname"].alias("qname"))


@query(f"WITH {PAIRS} SELECT CAST(seq AS VARCHAR) AS id, coalesce(CAST(CAST(a_ts - q_ts AS BIGINT) AS VARCHAR), '') AS delay_us, qname FROM r")
def csv_files(spark, sf_dir):
    """Records written by period with headers, read back as text columns."""
    folder, flags = shared_folder(spark, "csv"), ["id", "delay_us", "qname"]
    csv.write(project(pairs(spark, sf_dir), flags).withColumn("id", F.col("seq").cast("int")), folder, flags, period_sec=PERIOD, compression="gzip")
    return csv.read(spark, folder, flags).select("id", "delay_us", "qname")


#: Bytes that need an escape, look like one, or are no text, in hexadecimal.
AWKWARD = "5C6E0D0A005C5C2C5C3080FFC35C"


@query(f"WITH {PAIRS} SELECT CAST(seq AS VARCHAR) AS id, '{AWKWARD}' || upper(lpad(to_hex(seq % 256), 2, '0')) AS resp_edns_nsid, coalesce(a_subnet, q_subnet) AS edns_client_subnet FROM r")
def csv_bytes(spark, sf_dir):
    """Every byte in a value, and those that escapes are made of, written and read back."""
    folder, flags = shared_folder(spark, "csv"), ["id", "edns"]
    awkward = F.unhex(F.concat(F.lit(AWKWARD), F.lpad(F.hex(F.col("seq") % 256), 2, "0")))
    csv.write(project(pairs(spark, sf_dir), flags).withColumns({"id": F.col("seq").cast("int"), "resp_edns_nsid": awkward}), folder, flags)
    return csv.read(spark, folder, flags).select("id", "resp_edns_nsid", "edns_client_subnet")


def streamed(packets: DataFrame, watermark: str = "60 days") -> DataFrame:
    """The stateful matcher over ``packets`` as a file stream, and once more over the row that ends the stream."""
    spark = packets.sparkSession
    source, sink, state = (shared_folder(spark, f"stream-{x}") for x in ("in", "out", "state"))
    packets.write.parquet(source)
    schema = spark.read.parquet(source).schema
    last = spark.read.parquet(source).agg(F.max("ts_us")).first()[0]
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        found = match_stream(spark.readStream.schema(schema).parquet(source), WINDOW, watermark=watermark)
        for end in (False, True):
            if end and last is not None:
                flush_row(spark, schema, last, WINDOW, watermark).write.mode("append").parquet(source)
            job = found.writeStream.format("parquet").option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start(sink)
            job.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before) if before else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return spark.read.schema(found.schema).parquet(sink)


@query(f"WITH {matching()} SELECT req_seq, resp_seq FROM m WHERE req_seq IS NOT NULL AND resp_seq IS NOT NULL")
def match_streaming(spark, sf_dir):
    """What the stream pairs; ``match_streaming_all`` has the lone rows too."""
    return streamed(packets(spark, sf_dir)).filter("req_seq is not null and resp_seq is not null").select("req_seq", "resp_seq")


@query(f"WITH {matching()} SELECT * FROM m")
def match_streaming_all(spark, sf_dir):
    """All rows of the stream: pairs, lone requests and lone responses."""
    return streamed(packets(spark, sf_dir)).select("seq", "ts_us", "req_seq", "resp_seq")


def captured(spark: SparkSession, rows: DataFrame, steps: int, delay_us: int = 86_400_000_000) -> DataFrame:
    """The stateful matcher over a folder into which the packets' capture files come in ``steps``, with a restart at each.

    The watermark's delay is ``delay_us``, or the most that a packet lies behind an earlier one: what is further behind would be dropped.
    """
    behind = arrival.clock(rows).agg(F.max(F.col("clock_us") - F.col("ts_us"))).first()[0] or 0
    delay_us = max(delay_us, behind + 1_000_000)
    watermark = f"{-(-delay_us // 1000)} milliseconds"
    stage, folder, sink, state = (shared_folder(spark, f"stream-{x}").removeprefix("file://") for x in ("stage", "in", "out", "state"))
    ordered = rows.repartitionByRange(max(2 * steps, int(spark.conf.get("spark.sql.shuffle.partitions"))), "seq").sortWithinPartitions("seq")
    pcap.write(framed(ordered), stage)
    os.makedirs(folder)
    files = sorted(f for f in os.listdir(stage) if f.startswith("part-")) if os.path.isdir(stage) else []
    last = rows.agg(F.max("ts_us")).first()[0] or 0
    # Two late packets, each in a file of its own: one moves the watermark, the next batch lets all timers fire.
    facts = {"src_addr": "192.0.2.1", "dst_addr": "192.0.2.53", "src_port": 1, "dst_port": 53, "net_proto": 17, "net_ttl": 1, "udp_sum": 0, "is_response": False, "dns_id": 1, "flags_word": 0, "qname": "end.", "qtype": 1, "qclass": 1}
    wanted = {f.name: f for f in rows.schema}
    for k in (1, 2):
        late = last + k * (delay_us + 13_600_000_000 + WINDOW)
        end = spark.range(1).select(*[F.lit({**facts, "seq": k, "ts_us": late}.get(n)).cast(f.dataType).alias(n) for n, f in wanted.items()])
        pcap.write(build.frames(end), f"{stage}/end{k}")
    each = -(-len(files) // steps)
    parts = [files[k : k + each] for k in range(0, len(files), each)] if files else []
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for names in [*parts, "end1", "end2"]:
            if isinstance(names, str):
                part = next(f for f in os.listdir(f"{stage}/{names}") if f.startswith("part-"))
                os.replace(f"{stage}/{names}/{part}", f"{folder}/z-{names}.pcap")
            else:
                for f in names:
                    os.replace(f"{stage}/{f}", f"{folder}/{f}")
            found = match_stream(wire.decode(pcap.read_stream(spark, folder, settle=0)), WINDOW, watermark=watermark)
            job = found.writeStream.format("parquet").option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start(sink)
            job.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before) if before else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return spark.read.schema(found.schema).parquet(sink).filter(F.col("ts_us") <= last)


@query(f"""WITH {matching()} SELECT m.ts_us, m.req_seq IS NOT NULL AS asked, m.resp_seq IS NOT NULL AS answered, a.ts_us - q.ts_us AS delay_us
FROM m LEFT JOIN p q ON q.seq = m.req_seq LEFT JOIN p a ON a.seq = m.resp_seq""")
def match_capture_stream(spark, sf_dir):
    """Capture files of a growing folder as a stream, restarted in the middle; requests expire as it goes on."""
    found = captured(spark, packets(spark, sf_dir), steps=2)
    return found.select("ts_us", F.col("req_seq").isNotNull().alias("asked"), F.col("resp_seq").isNotNull().alias("answered"), "delay_us")
