"""Queries over copies of ``events`` with shifted keys: users past 65,535, many packets of one time, times that begin again."""

import ipaddress

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewire.plans import catalog
from tidewire.sources.events import from_wire, to_wire

from .oracle import compare

#: What the first user of a copy is.
FIRST = (0, 65_500, 5_000_000)


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    folder = tmp_path_factory.mktemp("copies")
    copy = " UNION ALL ".join(f"SELECT event_id + {k * 1000} AS event_id, ts, user_id + {first} AS user_id, event_type, value, props FROM read_parquet('/root/testdata/sf0.001/events.parquet')" for k, first in enumerate(FIRST))
    duckdb.connect().execute(f"COPY (SELECT * FROM ({copy}) ORDER BY event_id) TO '{folder}/events.parquet' (FORMAT parquet)")
    return str(folder)


def check(spark, name, folder):
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{folder}/events.parquet')")
    compare(spark, con, catalog.QUERIES[name], catalog.ORACLE_SQL[name], folder)


@pytest.mark.parametrize("name", ["capture_drop_reasons", "capture_filtered", "capture_parts", "capture_round_trip", "snap_length"])
def test_users_past_the_table_notation(spark, copies, name):
    check(spark, name, copies)


def test_addresses_there_and_back(spark):
    users = [0, 1, 83, 255, 256, 65_535, 65_536, 65_537, 84_204, 1_048_576, 2**24 - 1, 2**24, 2**31 - 1]
    texts = [(u, f"10.0.{u // 256}.{u % 256}", f"2001:db8::{u:x}") for u in users]
    there = [to_wire(F.col(c)).alias(c) for c in ("v4", "v6")]
    wire = spark.createDataFrame(texts, "user long, v4 string, v6 string").select("user", *there).collect()
    read = [(r["user"], *(ipaddress.ip_address(r[c]) for c in ("v4", "v6"))) for r in wire]
    assert [(int(a) - (10 << 24), int(b) - (0x20010DB8 << 96)) for _, a, b in read] == [(u, u) for u in users]
    back = spark.createDataFrame([(u, a.compressed, b.compressed) for u, a, b in read], "user long, v4 string, v6 string")
    got = [tuple(r) for r in back.select("user", *[from_wire(F.col(c)).alias(c) for c in ("v4", "v6")]).collect()]
    assert got == [(0, "10.0.0.0", "2001:db8::"), *texts[1:]]
    others = [("192.0.2.53",), ("2001:db8::53",), ("10.0.8388608.0",), (None,), ("x",)]
    assert [tuple(r) for r in spark.createDataFrame(others, "a string").select(to_wire(F.col("a"))).collect()] == others
    assert [tuple(r) for r in spark.createDataFrame(others, "a string").select(from_wire(F.col("a"))).collect()] == others


def test_frames_of_one_time_are_told_apart(spark, copies):
    check(spark, "capture_faults", copies)


def test_later_copies_are_not_late_for_the_stream(spark, copies):
    check(spark, "match_capture_stream", copies)
