import gzip
import json
import os
import random
import struct
import time

import pytest
from pyspark.sql import functions as F

from tidewire.functions import build
from tidewire.functions.wire import decode
from tidewire.operators.match import match
from tidewire.sources import pcap
from tidewire.streaming.match import match_stream

from .test_wire import capture, ip, query

W = 5_000_000


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def chain(n, sec=10):
    """Bytes that look like ``n`` records without data."""
    return struct.pack("<IIII", sec, 1, 0, 0) * n


def tricky(seed, n=300):
    """Records of all sizes; some hold bytes like records that lead right to the next true one."""
    r = random.Random(seed)
    out = []
    for k in range(n):
        data = r.randbytes(r.choice([0, 1, 40, 200, 1500]))
        if r.random() < 0.3:
            after = r.randrange(0, 60)
            data = r.randbytes(r.randrange(30)) + chain(r.randrange(1, 12)) + struct.pack("<IIII", 12, 5, after, after) + r.randbytes(after)
        out.append((10 + k // 50, k % 1_000_000, ip(query(tail=data)) if r.random() < 0.5 else data))
    return out


@pytest.mark.parametrize("split", [700, 4096])
def test_any_split_gives_the_same_rows(spark, tmp_path, split):
    a, b = capture(tmp_path / "a.pcap", tricky(1, 120)), capture(tmp_path / "b.pcap", tricky(2, 40))
    c = capture(tmp_path / "c.pcap.gz", tricky(3, 20), opener=gzip.open)
    with open(b, "ab") as f:
        # The last record is cut.
        f.write(struct.pack("<IIII", 99, 0, 500, 500) + b"x" * 77)
    path = f"{a},{b},{c}"
    whole = pcap.read(spark, path)
    assert whole.count() == 180 and whole.rdd.getNumPartitions() == 3
    parts = pcap.read(spark, path, split_bytes=split)
    assert parts.rdd.getNumPartitions() > 3
    assert rows_of(parts) == rows_of(whole)


def test_wrong_guesses_are_found(spark, tmp_path):
    r = random.Random(5)
    records = [(10, k, r.randbytes(20) + chain(9) + struct.pack("<IIII", 12, 5, 8, 8) + b"12345678") for k in range(40)]
    path = capture(tmp_path / "a.pcap", records)
    size, true = os.path.getsize(path), [pcap.HEADER + k * (16 + 188) for k in range(40)]
    low = true[3] + 16 + 10
    assert pcap.walk(path, None, low, low + 1000)[0] not in true
    begins = pcap.spans(spark, [path], low)
    assert set(begins[0]) <= set(true) and len(begins[0]) == -(-size // low)
    assert rows_of(pcap.read(spark, path, split_bytes=low)) == rows_of(pcap.read(spark, path))


def test_later_file_that_is_no_capture_ends_the_list(spark, tmp_path):
    a, b = capture(tmp_path / "a.pcap", [(1, 0, ip(query()))]), capture(tmp_path / "c.pcap", [(2, 0, ip(query()))])
    (tmp_path / "b.pcap").write_bytes(b"something else, longer than a header")
    assert [r["ts_us"] for r in pcap.read(spark, str(tmp_path)).collect()] == [1_000_000]
    assert [r["ts_us"] for r in pcap.read(spark, f"{a},{tmp_path}/missing,{b}").collect()] == [1_000_000]
    with pytest.raises(ValueError):
        pcap.read(spark, f"{tmp_path}/b.pcap,{a}")


def test_filters_reach_the_reader(spark, tmp_path):
    packets = [build.ip_packet("10.0.0.1", 1000 + k, "192.0.2.53", 53 if k % 3 else 99, 17 if k % 2 else 6, query()) for k in range(60)]
    path = capture(tmp_path / "a.pcap", [(10, k, p) for k, p in enumerate(packets)])
    plain = pcap.read(spark, path)
    wanted = "net_proto = 17 and dst_port in (53, 54) and src_port >= 1010 and net_len is not null"
    want = rows_of(plain.filter(wanted))
    assert rows_of(pcap.read(spark, path, filter="udp dst port 53 and src portrange 1010-9999")) == want and len(want) == 17
    before = spark.conf.get(pcap.PUSHES, "false")
    spark.conf.set(pcap.PUSHES, "true")
    try:
        pushed = pcap.read(spark, path).filter(wanted)
        plan = pushed._jdf.queryExecution().executedPlan().toString()
        assert "+- Filter" not in plan and "*(1) Filter" not in plan, plan
        assert rows_of(pushed) == want
        both = pcap.read(spark, path).filter("net_proto = 17 and src_addr = '10.0.0.1' and length(raw) > 5")
        assert both.count() == 30
    finally:
        spark.conf.set(pcap.PUSHES, before)


# ------------------------------------------------------------------ streams


def traffic(seed, n=240):
    """Frames of a few clients, requests and answers, in order of time."""
    r = random.Random(seed)
    out, ts = [], 1_000_000_000
    for _ in range(n):
        ts += r.randrange(2_000_000)
        client, answer = r.randrange(4), r.random() < 0.5
        ends = (f"10.0.0.{client}", 5000, "192.0.2.53", 53)
        m = build.message(client, 0x8180 if answer else 0x0100, "a.", 1, 1)
        out.append((*divmod(ts, 1_000_000), build.ip_packet(*(ends[2:] + ends[:2] if answer else ends), 17, m)))
    return out


def start(frames, folder, tmp, state="state", **options):
    found = match_stream(decode(frames), W, **options)
    return found.writeStream.format("parquet").option("path", f"{tmp}/{folder}").option("checkpointLocation", f"{tmp}/{state}").trigger(availableNow=True).start()


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def test_stream_of_a_growing_folder(spark, tmp_path, rocks):
    """Files come, grow and follow each other; the stream is stopped and started between; all rows are those of the batch."""
    folder = tmp_path / "captures"
    folder.mkdir()
    frames = traffic(3)
    end = [(9_000_000, 0, build.ip_packet("10.0.0.99", 1, "192.0.2.53", 53, 17, build.message(1, 0x0100, "a.", 1, 1)))]
    capture(folder / "a.pcap", frames[:50])
    capture(folder / "b.pcap", frames[50:80])
    (folder / "b.txt").write_bytes(b"no capture at all, but it lies there")

    def run():
        stream = pcap.read_stream(spark, str(folder), settle=0)
        start(stream, "out", tmp_path, watermark="1 second").awaitTermination()

    run()
    seen = spark.read.parquet(f"{tmp_path}/out").count()
    with open(folder / "b.pcap", "ab") as f:
        # Two records more, and half of a third.
        for sec, part, raw in frames[80:82]:
            f.write(struct.pack("<IIII", sec, part, len(raw), len(raw)) + raw)
        sec, part, raw = frames[82]
        f.write(struct.pack("<IIII", sec, part, len(raw), len(raw)) + raw[:9])
    run()
    with open(folder / "b.pcap", "ab") as f:
        f.write(frames[82][2][9:])
    capture(folder / "c.pcap.gz", frames[83:150], opener=gzip.open)
    run()
    capture(folder / "d.pcap", frames[150:])
    capture(folder / "e.pcap", end)
    run()
    # Timers fire in the batch after the one that moved the watermark.
    capture(folder / "f.pcap", [(9_000_001, *end[0][1:])])
    run()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert 0 < seen < got.count()
    batch = match(decode(pcap.read(spark, ",".join(f"{folder}/{c}" for c in ("a.pcap", "b.pcap", "c.pcap.gz", "d.pcap", "e.pcap")))), W)
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    last = F.col("ts_us") < 9_000_000_000_000
    want = batch.filter(last).select("ts_us", F.col("req.ts_us").alias("asked"), F.col("resp.ts_us").alias("answered"))
    ours = got.filter(last).select("ts_us", F.when(F.col("req_seq").isNotNull(), F.col("ts_us")).alias("asked"), F.when(F.col("resp_seq").isNotNull(), F.col("ts_us") + F.coalesce("delay_us", F.lit(0))).alias("answered"))
    assert set(key(ours)) ^ set(key(want)) == set() and key(ours) == key(want)


def test_offsets(tmp_path):
    (tmp_path / "new.pcap").write_bytes(b"")
    stream = pcap.CaptureStream({"path": str(tmp_path), "settle": "0"})
    assert stream.latestOffset() == stream.initialOffset() == {"name": "", "at": 24}
    records = traffic(1, 10)
    a = capture(tmp_path / "a.pcap", records)
    first = stream.latestOffset()
    assert first == {"name": "a.pcap", "at": os.path.getsize(a)}
    gz = capture(tmp_path / "b.pcap.gz", records, opener=gzip.open)
    slow = pcap.CaptureStream({"path": str(tmp_path), "settle": "1000"})
    os.utime(gz, (time.time(), time.time()))
    # A later name is there: it is finished, however young.
    assert slow.latestOffset() == {"name": "b.pcap.gz", "at": -1}
    os.unlink(tmp_path / "new.pcap")
    assert slow.latestOffset() == first
    parts = stream.partitions(first, {"name": "b.pcap.gz", "at": -1})
    assert [(p.number, p.path, p.start, p.stop) for p in parts] == [(0, a, first["at"], None), (1, gz, 24, None)]
    assert stream.partitions({"name": "b.pcap.gz", "at": -1}, {"name": "b.pcap.gz", "at": -1}) == []
    json.dumps(first)
