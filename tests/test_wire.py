import gzip
import random
import struct

import pyarrow as pa
import pytest

from tidewire.functions import build, wire
from tidewire.functions.filters import capture_filter
from tidewire.sources import pcap

from .frames import dissect as plain_dissect

ADDR = ("10.0.0.1", 1000, "192.0.2.53", 53)


def ip(payload, proto=17, **kw):
    return build.ip_packet(*ADDR, proto, payload, **kw)


def query(**kw):
    return build.message(1, 0x0100, "www.example.", 1, 1, **kw)


def taken_apart(frames, link=pcap.RAW, snaplen=-1, filter=""):
    """Rows of the reader for frames in one block."""
    data, found = b"", []
    for k, frame in enumerate(frames):
        found.append((k, 0, len(frame), len(data), len(frame)))
        data += frame
    return pcap._batch(data, found, link, snaplen, pcap.parse(filter), []).to_pylist()


def dissect(frame, link=pcap.RAW):
    return taken_apart([b"\x45" * 3, frame, b"\xff" * 70], link)[1]


def patched(frame, at, data):
    return frame[:at] + data + frame[at + len(data) :]


DROPS = {
    "no ip": (b"\x00" * 10, "network"),
    "cut ip": (ip(query())[:15], "network"),
    "more fragments": (patched(ip(query()), 6, b"\x20\x00"), "fragmented"),
    "offset": (patched(ip(query()), 6, b"\x00\x10"), "fragmented"),
    "syn": (patched(ip(query(), 6), 33, b"\x02"), "transport"),
    "fin": (patched(ip(query(), 6), 33, b"\x11"), "transport"),
    "wrong prefix": (patched(ip(query(), 6), 40, b"\x00\x05"), "transport"),
    "sctp": (patched(ip(query()), 9, bytes([132])), "transport"),
}


@pytest.mark.parametrize("name", DROPS)
def test_drop_reasons(name):
    frame, reason = DROPS[name]
    assert dissect(frame)["drop_reason"] == reason


def test_valid_frames():
    q = query()
    udp, tcp = dissect(ip(q, checksum=99)), dissect(ip(q, 6))
    assert udp["drop_reason"] is None and udp["payload"] == q and udp["udp_sum"] == 99 and udp["dns_len"] == len(q)
    assert tcp["drop_reason"] is None and tcp["dns_len"] == len(q) + 2 and tcp["payload"][2:] == q
    v6 = dissect(build.ip_packet("2001:db8:0:0::1", 5, "2001:db8::53", 53, 17, q))
    assert (v6["src_addr"], v6["net_ipv"]) == ("2001:db8::1", 6)
    ether = b"\0" * 12 + b"\x81\x00\x00\x05\x08\x00" + ip(q)
    assert dissect(ether, pcap.ETHERNET)["payload"] == q
    icmp = patched(ip(q), 9, b"\x01")
    assert dissect(icmp)["drop_reason"] is None and dissect(icmp)["payload"] == q


def noise(seed, n=1500):
    """Frames of all kinds with spoiled bytes, cut anywhere, under random link headers."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        proto = r.choice([17, 17, 6, 1, 58, 132])
        src, dst = r.choice([("10.0.0.1", "192.0.2.53"), ("2001:db8::1", "fe80::53"), ("::", "::ffff:1.2.3.4")])
        raw = build.ip_packet(src, r.randrange(65536), dst, 53, proto, query()[: r.choice([99, 0, 1, 5])], r.randrange(256), r.randrange(65536))
        if raw[0] >> 4 == 6 and r.random() < 0.4:
            # An extension header, or a fragment's.
            kind = r.choice([0, 43, 44, 60])
            extra = bytes([raw[6], 0]) + (struct.pack(">H", r.choice([0, 1, 8, 9])) if kind == 44 else bytes(2)) + bytes(4)
            raw = raw[:4] + struct.pack(">H", len(raw) - 40 + 8) + bytes([kind]) + raw[7:40] + extra + raw[40:]
        for _ in range(r.randrange(3)):
            k = r.randrange(len(raw))
            raw = raw[:k] + bytes([r.choice([0, 2, 6, 8, 17, 44, 69, 96, 255, r.randrange(256)])]) + raw[k + 1 :]
        out.append(raw[: r.choice([len(raw), len(raw), r.randrange(len(raw) + 1)])])
    return out


LINKS = {pcap.RAW: b"", pcap.NULL: b"\2\0\0\0", pcap.ETHERNET: b"\1" * 12, pcap.COOKED: b"\2" * 14}


@pytest.mark.parametrize("link", LINKS)
def test_rows_of_blocks(link):
    r = random.Random(link)
    frames = []
    for raw in noise(link):
        kind = b"\x86\xdd" if raw[:1] and raw[0] >> 4 == 6 else b"\x08\x00"
        tags = b"".join(r.choice([b"\x81\0", b"\x88\xa8"]) + b"\0\5" for _ in range(r.choice([0, 0, 1, 2, 3])))
        frame = LINKS[link] + (tags + r.choice([kind, kind, kind, b"\x08\x06"]) if link in (pcap.ETHERNET, pcap.COOKED) else b"") + raw
        frames.append(frame[: r.choice([len(frame)] * 9 + [r.randrange(len(frame) + 1)])])
    for snaplen in (-1, 45):
        for got, frame in zip(taken_apart(frames, link, snaplen), frames):
            kept = frame[:snaplen] if snaplen > 0 else frame
            want = plain_dissect(link, kept, len(frame) - (14 if link == pcap.ETHERNET else 0)) | {"seq": got["seq"], "ts_us": 0}
            assert got == want, frame.hex()


def test_filters_on_blocks_and_columns(spark):
    """A filter on header bytes takes the same frames as on columns."""
    frames = noise(77, 600)
    rows = taken_apart(frames)
    table = spark.createDataFrame(rows, pcap.FRAMES)
    filters = [
        "", "port 53", "udp", "ip6 and not port 53", "port 53 or udp and host 10.0.0.1", "udp and host 10.0.0.1 or port 53", "not (tcp or ip6)", "src net 10.0.0.0/8 or dst net fe80::/10",
        "src or dst port 53", "src and dst net ::/0", "portrange 0-30000", "less 60", "greater 70 and tcp", "dst host ::ffff:1.2.3.4", "tcp dst port 53", "icmp6 or icmp", "ip proto 17 and src net 10.0.0.0 mask 255.255.0.0",
        "port 53 or 99 or host 10.0.0.1 or 192.0.2.53",
    ]
    for text in filters:
        want = sorted(r["seq"] for r in table.filter(capture_filter(text)).select("seq").collect())
        assert [r["seq"] for r in taken_apart(frames, filter=text)] == want, text
    assert len(taken_apart(frames, filter="port 53 or udp and host 10.0.0.1")) < len(taken_apart(frames, filter="port 53 or (udp and host 10.0.0.1)"))


def test_names():
    assert wire.name_text([b"a", b"b c"]) == "a.b\\040c."
    assert wire.name_text([]) == "."
    m = b"\0" * 12 + b"\x03www\xc0\x12" + b"\x07example\x00"
    with pytest.raises(ValueError):
        wire.read_name(m, 12)
    back = b"\0" * 12 + b"\x07example\x00" + b"\x03www\xc0\x0c"
    assert wire.read_name(back, 21) == ([b"www", b"example"], 27)
    with pytest.raises(ValueError):
        wire.read_name(b"\xc0\x00", 0)


def test_edns():
    opt = {"ver": 0, "udp": 4096, "do": True, "ext_rcode": 1, "dau": [5, 7, 8, 10, 13], "dhu": None, "n3u": [1], "nsid": b"x,y"}
    m = query(opt=opt)
    q = wire.parse_question(m)
    got = wire.parse_opt(m, q[3])
    assert q[:3] == ("www.example.", 1, 1)
    assert got["ok"] and {k: got[k] for k in ("udp", "do", "ext_rcode", "dau", "dhu", "nsid")} == {"udp": 4096, "do": True, "ext_rcode": 1, "dau": [5, 7, 8, 10, 13], "dhu": None, "nsid": b"x,y"}
    plain = query()
    assert wire.parse_opt(plain, wire.parse_question(plain)[3])["ver"] is None
    assert not wire.parse_opt(plain + b"\1", wire.parse_question(plain)[3])["ok"]
    assert wire.subnet_text(struct.pack(">HBB", 1, 24, 0) + b"\x0a\x01\x02") == "4,10.1.2.0/24,0"
    assert wire.parse_question(b"short") is None and wire.parse_question(None) is None


def some_messages(seed, n=1500):
    """Messages with and without records, compressed names, odd labels and spoiled bytes."""
    r = random.Random(seed)
    out = [None, b"", b"\0" * 12]
    for _ in range(n):
        opt = {"ver": r.randrange(2), "udp": 512, "do": r.random() < 0.5, "ext_rcode": 1, "dau": [5, 7], "nsid": r.choice([None, b"x\0"]), "other": r.choice([None, "10"]), "subnet": r.choice([None, "6,2001:db8::/32,0"])}
        m = build.message(r.randrange(65536), r.randrange(65536), r.choice(["www.example.", ".", "a.", "x" * 63 + ".y_-9.", "b." * 100, "q!.é."]), r.randrange(300), 1, r.choice([None, opt]))
        if r.random() < 0.3:
            # An answer whose name points back to the question.
            m = m[:6] + struct.pack(">H", 1) + m[8:] + b"\xc0\x0c" + struct.pack(">HHIH", 1, 1, 60, 4) + b"\1\2\3\4"
        for _ in range(r.choice([0, 0, 1, 2])):
            k = r.randrange(len(m))
            m = m[:k] + bytes([r.choice([0, 1, 3, 64, 192, 255, r.randrange(256)])]) + m[k + 1 :]
        out.append(m[: r.choice([len(m), len(m), len(m), r.randrange(len(m) + 1)])] + r.choice([b"", b"", b"\0"]))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_messages_of_a_batch(seed):
    made = some_messages(seed)
    batch = pa.array([b"??", *made], pa.binary()).slice(1)
    seen = set()
    for m, got in zip(made, wire.Messages(batch).columns().to_pylist()):
        word = lambda k: None if m is None or len(m) < k + 2 else struct.unpack(">H", m[k : k + 2])[0]  # noqa: B023, E731
        assert [got[c] for c in ("dns_id", "flags_word", "ancount", "nscount", "arcount")] == [word(k) for k in (0, 2, 6, 8, 10)]
        q = wire.parse_question(m)
        assert (got["qname"], got["qtype"], got["qclass"]) == (q[:3] if q else (None,) * 3), m
        opt = wire.parse_opt(m, q and q[3])
        assert got["ok"] == opt.pop("ok"), m
        assert got["opt"] == (opt if opt["ver"] is not None else None), m
        seen.add((q is None, got["ok"], got["opt"] is None))
    assert len(seen) >= 4


def capture(path, frames, magic=0xA1B2C3D4, order="<", link=pcap.RAW, opener=open):
    with opener(path, "wb") as f:
        f.write(struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, link))
        for sec, part, frame in frames:
            f.write(struct.pack(order + "IIII", sec, part, len(frame), len(frame)) + frame)
    return str(path)


def test_files_in_order(spark, tmp_path):
    response = build.message(1, 0x8180, "www.example.", 1, 1)
    a = capture(tmp_path / "b.pcap", [(10, 5, ip(query())), (11, 7, ip(query(tail=b"junk")))])
    b = capture(tmp_path / "a.pcap.gz", [(12, 9_000, build.ip_packet(*ADDR[2:], *ADDR[:2], 17, response + b"junk"))], 0xA1B23C4D, ">", opener=gzip.open)
    rows = wire.decode(pcap.read(spark, f"{a},{b}")).orderBy("seq").collect()
    assert [r["ts_us"] for r in rows] == [10_000_005, 11_000_007, 12_000_009]
    assert [r["drop_reason"] for r in rows] == [None, "malformed", None]
    assert [r["is_response"] for r in rows] == [False, False, True]
    assert rows[0]["qname"] == "www.example." and rows[0]["opt"] is None
    cut = wire.decode(pcap.read(spark, a, snaplen=40)).collect()
    assert cut[0]["dns_len"] == rows[0]["dns_len"] and len(cut[0]["payload"]) == 12


def test_invalid_go_to_a_capture_file(spark, tmp_path):
    a = capture(tmp_path / "x.pcap", [(1, 0, ip(query())), (2, 0, b"\0" * 30)])
    frames = pcap.read(spark, a)
    out = str(tmp_path / "dump")
    for compression in ("none", "gzip", "bz2", "xz"):
        pcap.write(frames.filter("drop_reason is not null"), f"{out}-{compression}", compression)
        back = pcap.read(spark, f"{out}-{compression}").collect()
        assert [(r["ts_us"], bytes(r["raw"])) for r in back] == [(2_000_000, b"\0" * 30)]
