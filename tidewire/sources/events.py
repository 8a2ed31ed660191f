"""Packets derived from the ``events`` table, column by column.

The table names clients by their user: 10.0.(user div 256).(user mod 256), or
2001:db8::(user in hexadecimal digits). From user 65,536 on these texts aren't IP
addresses. Frames hold 10.0.0.0 + user and 2001:db8:: + user, of which the texts
below 65,536 are the usual ones; ``to_wire`` and ``from_wire`` go there and back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One packet for each event, in the order of event_id; sign-ups stand for malformed packets."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    user, event = F.col("user_id"), F.col("event_id")
    v6, response = user % 3 == 0, F.col("event_type").isin("click", "purchase")
    client = F.when(v6, F.concat(F.lit("2001:db8::"), F.lower(F.hex("user_id")))).otherwise(F.concat(F.lit("10.0."), F.expr("user_id div 256").cast("string"), F.lit("."), (user % 256).cast("string")))
    server, port, dns = F.when(v6, F.lit("2001:db8::53")).otherwise(F.lit("192.0.2.53")), (1024 + user % 50000).cast("int"), F.lit(53)
    length = 17 + event % 480
    return e.select(
        event.alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        F.when(response, server).otherwise(client).alias("src_addr"), F.when(response, dns).otherwise(port).alias("src_port"),
        F.when(response, client).otherwise(server).alias("dst_addr"), F.when(response, port).otherwise(dns).alias("dst_port"),
        F.when(v6, 6).otherwise(4).alias("net_ipv"), F.when(user % 12 == 0, 6).otherwise(17).alias("net_proto"),
        (42 + length).cast("int").alias("net_len"), (F.floor("value").cast("int") % 65).alias("net_ttl"), ((event * 7) % 65536).cast("int").alias("udp_sum"),
        length.cast("int").alias("dns_len"), response.alias("is_response"), ((user * 7919) % 65536).cast("int").alias("dns_id"), ((event * 40503) % 65536).cast("int").alias("flags_word"),
        F.concat(F.lit("q"), (F.get_json_object("props", "$.k").cast("int") % 8).cast("string"), F.lit(".example.")).alias("qname"),
        (1 + event % 16).cast("int").alias("qtype"), F.lit(1).alias("qclass"),
        (event % 5).cast("int").alias("ancount"), (event % 3).cast("int").alias("nscount"), (event % 4).cast("int").alias("arcount"),
        F.when(event % 4 != 0, F.struct(
            F.lit(0).alias("ver"), (512 + event % 3584).cast("int").alias("udp"), (event % 2 == 1).alias("do"), (event % 3).cast("int").alias("ext_rcode"),
            F.when(event % 5 == 0, F.array(F.lit(5), F.lit(7), F.lit(8))).alias("dau"), F.when(event % 7 == 0, F.array(F.lit(1), F.lit(2))).alias("dhu"), F.when(event % 11 == 0, F.array(F.lit(1))).alias("n3u"),
            F.when(event % 3 == 0, F.concat(F.lit("ns,"), (event % 4).cast("string")).cast("binary")).alias("nsid"),
            F.when(event % 9 == 0, F.lit("10,65001")).alias("other"),
            F.when(event % 13 == 0, F.concat(F.lit("4,10."), (user % 200).cast("string"), F.lit(".0.0/16,0"))).alias("subnet"),
        )).alias("opt"),
        F.when(F.col("event_type") == "signup", "malformed").alias("drop_reason"),
    )


def to_wire(address: Column) -> Column:
    """The address in a frame for one of the table's, of users below 2**31 (2**32 by version 6); other texts stay as they are."""
    third, last = (F.regexp_extract(address, r"^10\.0\.(\d{1,7})\.(\d{1,3})$", k) for k in (1, 2))
    n = third.try_cast("long")
    octets = [(10 + F.shiftright(n, 16)).cast("string"), (F.shiftright(n, 8) % 256).cast("string"), (n % 256).cast("string"), last]
    high, low = (F.regexp_extract(address, r"^2001:db8::([0-9a-f]{1,4})([0-9a-f]{4})$", k) for k in (1, 2))
    return F.when(n.between(256, 2**23 - 1), F.concat_ws(".", *octets)).when(high != "", F.concat(F.lit("2001:db8::"), high, F.lit(":"), low)).otherwise(address)


def from_wire(address: Column) -> Column:
    """The table's text of an address that was read from a frame; those of servers stay as they are."""
    octets = [F.regexp_extract(address, r"^(\d+)\.(\d+)\.(\d+)\.(\d+)$", k).try_cast("long") for k in range(1, 5)]
    third = F.shiftleft(octets[0] - 10, 16) + F.shiftleft(octets[1], 8) + octets[2]
    high, low = (F.regexp_extract(address, "^2001:db8::([0-9a-f]{1,4}):([0-9a-f]{1,4})$", k) for k in (1, 2))
    v4 = F.concat(F.lit("10.0."), third.cast("string"), F.lit("."), octets[3].cast("string"))
    return F.when(octets[0].between(10, 137), v4).when(high != "", F.concat(F.lit("2001:db8::"), high, F.lpad(low, 4, "0"))).otherwise(address)
