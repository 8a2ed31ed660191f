import io
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from tidewire.functions import cbor as codec
from tidewire.functions import scalar
from tidewire.operators import dump
from tidewire.operators.match import match
from tidewire.operators.project import project
from tidewire.plans.config import Config, number, parse
from tidewire.plans.schema import FIELDS, columns
from tidewire.sinks import cbor, csv
from tidewire.sources.events import packets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def records(spark):
    return project(match(packets(spark, SF), 10_800_000_000)).cache()


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text,separator,expected", [("a,b", ",", "a\\,b"), ("a\\b", ",", "a\\\\b"), ("a\nb", "|", "a\\nb"), ("a\0b", ",", "a\\0b"), ("a\tb", "\t", "a\\011b"), (None, ",", None)])
def test_escape(spark, text, separator, expected):
    assert value(spark, scalar.escape(F.lit(text).cast("string"), separator)) == expected


def test_lists_times_and_booleans(spark):
    numbers = F.array(F.lit(5), F.lit(7), F.lit(8))
    assert value(spark, scalar.number_list(numbers, ",")) == "5\\,7\\,8"
    assert value(spark, scalar.number_list(numbers, "|")) == "5,7,8"
    assert value(spark, scalar.time_text(F.lit(1528416000000042))) == "1528416000.000042"
    assert value(spark, scalar.micros(F.lit(1.9999999))) == 1999999
    assert value(spark, scalar.strftime(F.lit(0), "at'%Y-%j %H%%")) == "at'1970-001 00%"
    assert value(spark, scalar.rotation_due(F.lit(0), F.lit(10_000_000), 10)) is False
    assert value(spark, scalar.domain_name(F.lit("a.b.cz."))) == "b.cz"
    assert value(spark, scalar.label_count(F.lit("."))) == 0


def test_column_counts():
    assert len(FIELDS) == 23 and len(columns()) == 41 and len(columns(cbor=True)) == 40
    assert columns(["qname", "time"]) == ["time", "qname"]
    with pytest.raises(ValueError):
        columns(["nothing"])


def test_only_chosen_columns_are_computed(spark):
    some = project(match(packets(spark, SF), 1_000_000), ["qname"])
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    assert some.columns == ["seq", "ts_us", "qname"] and "nsid" not in plan.split("Window")[0]


CONFIGS = {
    "all": ("csv", None, ",", True, None), "all packed": ("csv", None, ",", True, "gzip"),
    "some": ("csv", ["delay_us", "req_net_len", "id", "qname", "edns"], "|", True, None), "names": ("csv", None, "|", False, None),
    "binary": ("cbor", None, None, True, None), "binary packed": ("cbor", None, None, True, "gzip"),
    "binary some": ("cbor", ["delay_us", "req_net_len", "qname"], None, True, None),
}


@pytest.mark.parametrize("name", CONFIGS)
def test_outputs(spark, records, tmp_path, name):
    kind, flags, separator, header, compression = CONFIGS[name]
    out, n = str(tmp_path / "out"), records.count()
    if kind == "cbor":
        cbor.write(records, out, flags, compression or "none")
        items = cbor.read(spark, out)
        assert items.filter("number > 0").count() == n
        assert {tuple(__import__("json").loads(r["item"])) for r in items.filter("number = 0").collect()} == {tuple(columns(flags, cbor=True))}
        return
    csv.write(records, out, flags, separator, header, compression=compression)
    back = csv.read(spark, out, flags, separator, header)
    assert back.columns == columns(flags) and back.count() == n
    if "id" in back.columns:
        assert back.agg(F.sum(F.col("id").cast("long"))).first()[0] == records.agg(F.sum("id")).first()[0]
    if flags is None:
        ids = {(r["qname"], r["resp_edns_nsid"]) for r in back.select("qname", "resp_edns_nsid").collect()}
        assert ids == {(r["qname"], r["resp_edns_nsid"]) for r in records.select("qname", "resp_edns_nsid").collect()}


@pytest.mark.parametrize("separator", [",", "|", "\t", "§", ";"])
def test_any_bytes_come_back(spark, records, tmp_path, separator):
    r = random.Random(6)
    pieces = [b"\\", b"\\n", b"\n", b"\r", b"\0", b"0", b"\\0", b"11", separator.encode(), b"\xff", b"\xc3", "é".encode(), b"N", b" "]
    if separator == "\t":
        # Of NUL and two digits the format itself makes the escape of a tab.
        pieces.remove(b"11")
    made = [b"".join(r.choice(pieces) for _ in range(r.randrange(12))) for _ in range(300)] + [bytes(range(256)), b"\\N", b"\\" * 1001, None]
    nsid = spark.createDataFrame([(k, v) for k, v in enumerate(made)], "seq long, resp_edns_nsid binary")
    names = spark.createDataFrame([(k, f"a\\{k % 128:03o}b.", "4,10.0.0.0/8,0" if k % 2 else None) for k in range(len(made))], "seq long, qname string, edns_client_subnet string")
    base = records.limit(1).drop("seq", "resp_edns_nsid", "qname", "edns_client_subnet")
    rows = nsid.join(names, "seq").crossJoin(base)
    csv.write(rows, str(tmp_path / "out"), ["qname", "edns"], separator)
    back = csv.read(spark, str(tmp_path / "out"), ["qname", "edns"], separator)
    key = lambda df: sorted(((r["qname"], r["resp_edns_nsid"] and bytes(r["resp_edns_nsid"]), r["edns_client_subnet"]) for r in df.collect()), key=repr)
    assert key(back) == key(rows)


def test_nothing_is_written_of_nothing(spark, records, tmp_path):
    csv.write(records.limit(0), str(tmp_path / "a"))
    cbor.write(records.limit(0), str(tmp_path / "b"))
    assert not os.listdir(tmp_path)


def test_periods_have_headers(spark, records, tmp_path):
    csv.write(records, str(tmp_path / "out"), ["id"], period_sec=86_400, header_path=str(tmp_path / "head"))
    folders = [f for f in os.listdir(tmp_path / "out") if f.startswith("period=")]
    files = [p for f in folders for p in (tmp_path / "out" / f).glob("part-*.txt")]
    assert len(folders) == records.select(scalar.rotation_start(F.col("ts_us"), 86_400)).distinct().count() == len(files)
    assert all(p.read_text().startswith("id\n") for p in files)
    assert spark.read.text(str(tmp_path / "head")).first()[0] == "id"


@pytest.mark.parametrize("item", [0, 23, 24, 255, 256, 65536, 2**40, -1, -500, 1.5, "é", b"\0\1", None, True, False, [], [1, [2, "x"]], {"a": 1}])
def test_cbor_values(item):
    assert codec.decode(codec.encode(item)) == (item, len(codec.encode(item)))


@pytest.mark.parametrize("block", [1, 2, 7, 1 << 20])
def test_cbor_from_pieces(block):
    """Items that end anywhere in what is read at a time; a cut last one is an error."""
    values = [1, "é" * 50, [1, [b"x" * 300, None]], {"a": [2.5]}, 2**40, b"", []]
    data = b"".join(map(codec.encode, values)) + bytes.fromhex("9f01ff7f61616162ff")
    assert list(codec.stream_items(io.BytesIO(data).read, block)) == [*values, [1], "ab"]
    with pytest.raises(ValueError):
        list(codec.stream_items(io.BytesIO(data[:-1]).read, block))


def test_cbor_of_others():
    assert list(codec.items(bytes.fromhex("9f01ff" "7f6161 6162ff" "f93c00" "c11864"))) == [[1], "ab", 1.0, 100]
    with pytest.raises(ValueError):
        codec.decode(b"\x19\x01")


def test_config():
    c = parse("Collector {\nmatch_window 2.5\ncsv_fields :reset qname id\ncsv_separator |\ndump_rate_limit 10K\n}")
    assert (c.match_window, c.csv_fields, c.csv_separator, c.dump_rate_limit) == (2.5, ["qname", "id"], "|", 10240)
    assert Config().output_fields == list(FIELDS) and number("2k") == 2000 and number("1h") == 3600
    for bad in ("csv_separator .", "csv_separator x", "max_queue_len 0", "output_type xml", "csv_fields :reset", "nothing 1", "dump_compress_level 10"):
        with pytest.raises(ValueError):
            parse(bad)


def test_token_bucket(spark):
    rows = [(1, 0, 600), (2, 0, 600), (3, 0, 600), (4, 2_000_000, 600), (5, 3_000_000, 10), (6, 700_000_000, 600)]
    got = dump.limited(spark.createDataFrame(rows, "seq long, ts_us long, net_len int"), 100, 600)
    assert [r["admitted"] for r in got.orderBy("seq").collect()] == [True, True, False, True, False, True]
    assert dump.limited(spark.createDataFrame(rows, "seq long, ts_us long, net_len int"), 0).filter("admitted").count() == 6


def test_token_bucket_against_a_loop(spark):
    r = random.Random(8)
    rows, ts = [], 0
    for seq in range(600):
        ts += r.choice([0, 1_000, 900_000, 5_000_000]) - r.choice([0, 0, 500])
        rows.append((seq, max(ts, 0), r.randrange(20, 900)))
    want, state = {}, {}
    for seq, ts, size in rows:
        tokens, clock = state.get(ts // 60_000_000, (300 * dump.BURST, ts))
        if ts > clock:
            tokens, clock = min(300 * dump.BURST, tokens + 300 * (ts - clock) / 1e6), ts
        want[seq] = tokens >= 0
        state[ts // 60_000_000] = tokens - size * want[seq], clock
    got = dump.limited(spark.createDataFrame(rows, "seq long, ts_us long, net_len int").repartition(5), 300, 60).collect()
    assert {r["seq"]: r["admitted"] for r in got} == want and len(set(want.values())) == 2


def test_files_open_when_the_one_before_is_too_old(spark, records, tmp_path):
    csv.write(records, str(tmp_path / "out"), ["id"], period_sec=100_000, greedy=True)
    opened, want = None, set()
    for r in records.orderBy("seq").select("ts_us").collect():
        if opened is None or opened < r["ts_us"] - 100_000 * 10**6:
            opened = r["ts_us"]
            want.add(time.strftime("period=%Y%m%d-%H%M%S", time.gmtime(opened // 10**6)))
    assert {f for f in os.listdir(tmp_path / "out") if f.startswith("period=")} == want and len(want) > 5


def test_long_periods_go_in_parts(spark, records, tmp_path, monkeypatch):
    monkeypatch.setattr(csv, "FILE_SEQS", 50)
    csv.write(records, str(tmp_path / "out"), ["id"], period_sec=86_400)
    assert csv.read(spark, str(tmp_path / "out"), ["id"]).count() == records.count()
    assert all(p.read_text().startswith("id\n") for p in (tmp_path / "out").rglob("part-*.txt"))


def test_command_line(spark, tmp_path):
    from tidewire import cli
    from tidewire.functions import build

    from .test_wire import ADDR, capture, ip, query

    answer = build.ip_packet(*ADDR[2:], *ADDR[:2], 17, build.message(1, 0x8180, "www.example.", 1, 1))
    a = capture(tmp_path / "x.pcap", [(1, 0, ip(query())), (1, 500, answer), (2, 0, b"\0" * 30)])
    config = parse(f"csv_fields :reset delay_us qname\ninput_filter 'port 53'\ndump_path_fmt {tmp_path}/dump")
    cli.run(spark, [a], str(tmp_path / "out"), config)
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["500,www.example.", "delay_us,qname"]
    for bad in ([], ["-i", "folder", "file"]):
        with pytest.raises(SystemExit):
            cli.arguments(bad)


def test_standard_output(spark, tmp_path, capfdbinary):
    from tidewire import cli

    from .test_wire import capture, ip, query

    a = capture(tmp_path / "x.pcap", [(k, 0, ip(query())) for k in range(3)])
    cli.run(spark, [a], "-", parse("csv_fields :reset time qname"))
    assert capfdbinary.readouterr().out == b"time,qname\n" + b"".join(f"{k}.000000,www.example.\n".encode() for k in range(3))
    with pytest.raises(ValueError):
        cli.run(spark, [a], str(tmp_path / "out"), parse("output_pipe_cmd rot13"))


def test_following_a_folder(spark, tmp_path):
    """Records of files that come while the stream runs; a request without an answer comes out by itself."""
    from tidewire import cli
    from tidewire.functions import build

    from .test_wire import ADDR, capture, ip, query

    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder = tmp_path / "in"
    folder.mkdir()
    opt = {"ver": 0, "udp": 1232, "do": True, "ext_rcode": 0, "nsid": b"x,\xff"}
    answer = build.ip_packet(*ADDR[2:], *ADDR[:2], 17, build.message(1, 0x8180, "www.example.", 1, 1, opt))
    capture(folder / "a.pcap", [(1, 0, ip(query())), (1, 500, answer), (2, 0, ip(query(opt=opt)))])
    config = parse("match_window 2\ncsv_fields :reset time delay_us qname edns")
    job = cli.follow(spark, str(folder), str(tmp_path / "out"), config, settle=0)

    def rows(n):
        end, got = time.time() + 90, []
        while len(got) < n and time.time() < end:
            time.sleep(0.5)
            done = [str(p) for p in (tmp_path / "out").glob("batch=*") if (p / "_SUCCESS").exists()]
            got = sorted(tuple(r) for p in done for r in csv.read(spark, p, config.csv_fields).select("time", "delay_us", "qname", "resp_edns_nsid", "req_edns_udp").collect())
        return [(t, d, q, v and bytes(v), u) for t, d, q, v, u in got]

    try:
        pair, lone = ("1.000000", "500", "www.example.", b"x,\xff", ""), ("2.000000", "", "www.example.", None, "1232")
        assert rows(2) == [pair, lone]
        capture(folder / "b.pcap", [(9, 0, answer)])
        assert rows(3) == [pair, lone, ("9.000000", "", "www.example.", b"x,\xff", "")]
    finally:
        job.stop()
        spark.conf.unset(name)
