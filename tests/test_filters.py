import ipaddress
import random

import pytest

from tidewire.functions.filters import capture_filter, ipv6_digits, parse


def some_addresses(n: int) -> list[str]:
    rng = random.Random(5)
    fixed = ["::", "::1", "2001:db8::", "2001:db8::ff", "2001:db9::1", "fe80::1:0:0:2", "::ffff:192.0.2.1", "64:ff9b::198.51.100.7"]
    # Few bits, so that groups of zeros stand anywhere.
    return fixed + [ipaddress.IPv6Address(rng.getrandbits(128) & rng.getrandbits(128) & rng.getrandbits(128) & rng.getrandbits(128)).compressed for _ in range(n)]


def test_digits_of_addresses(spark):
    rows = spark.createDataFrame([(a,) for a in some_addresses(200)], "a string")
    for r in rows.select("a", ipv6_digits(rows["a"]).alias("digits")).collect():
        assert r["digits"] == f"{int(ipaddress.IPv6Address(r['a'])):032x}", r["a"]


def test_net_of_either_version(spark):
    packets = [(6, a, "2001:db8::9") for a in some_addresses(50)] + [(4, "192.0.2.7", "198.51.100.1"), (None, None, None), (6, None, None)]
    rows = spark.createDataFrame(packets, "net_ipv int, src_addr string, dst_addr string")
    for text in ("src net 2001:db8::/32", "src net ::/1", "src net 8000::/1", "src net 192.0.2.0/24", "net ::ffff:0:0/96"):
        net = ipaddress.ip_network(text.split()[-1])
        sides = (1,) if text.startswith("src") else (1, 2)
        expected = [p for p in packets if any(p[k] and ipaddress.ip_address(p[k]) in net for k in sides)]
        key = str
        assert sorted(map(tuple, rows.filter(capture_filter(text)).collect()), key=key) == sorted(expected, key=key), text
        others = rows.filter(capture_filter(f"not {text}")).count()
        assert others == len(packets) - len(expected), text


def test_and_or_from_left_to_right():
    assert parse("port 1 or udp and tcp") == ("and", ("or", parse("port 1"), parse("udp")), parse("tcp"))
    assert parse("port 1 && (udp || !tcp)") == ("and", parse("port 1"), ("or", parse("udp"), ("not", parse("tcp"))))
    assert parse("not udp and tcp") == ("and", ("not", parse("udp")), parse("tcp"))


def test_values_of_the_last_kind():
    assert parse("tcp src port 1 or 2") == ("or", parse("tcp src port 1"), parse("tcp src port 2"))
    assert parse("10.0.0.1") == parse("host 10.0.0.1") == parse("src or dst host 10.0.0.1")
    assert parse("port domain or 5") == ("or", parse("port 53"), parse("port 5"))


@pytest.mark.parametrize("text", ["port", "udp udp", "(udp", "udp)", "frame 5", "port 53 udp", "net 10.0.0.0/40", "and udp", "vlan"])
def test_broken_filters(text):
    with pytest.raises(ValueError):
        parse(text)
