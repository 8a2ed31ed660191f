"""The clock of arrival against a plain loop over packets."""

import random

import pytest
from pyspark.sql import functions as F

from tidewire.operators import arrival
from tidewire.operators.match import match

from .packets import packet as p
from .packets import table

W = 5_000_000


def looped(packets):
    """(request, response) pairs and lone rows of one world: a clock, a queue in order of arrival, pending requests by key."""
    clock, waited, pending, out = None, None, {}, []
    for seq, ts, key, response in packets:
        clock = ts if clock is None else max(clock, ts)
        stack = pending.setdefault(key, [])
        while stack and clock >= stack[0][1] + W:
            out.append((stack.pop(0)[0], None))
        if response and stack:
            out.append((stack.pop()[0], seq))
            continue
        waited = ts if waited is None else max(waited, ts)
        if response:
            out.append((None, seq))
        else:
            stack.append((seq, waited))
    return out + [(q[0], None) for s in pending.values() for q in s]


def world(seed, n):
    """Packets of few keys whose times jump back and forth."""
    r = random.Random(seed)
    ts, out = 100_000_000, []
    for seq in range(n):
        ts += r.choice([0, 500_000, 2_000_000, 6_000_000])
        at = ts - r.choice([0, 0, 0, 1_000_000, 4_000_000, 9_000_000, 30_000_000])
        out.append((seq, max(at, 0), r.randrange(3), r.random() < 0.5))
    return out


def test_a_thousand_disordered_cases(spark):
    """Each case in its own span of seq and time, far after the one before, so that one job decides all."""
    rows, want, plain = [], [], 0
    for case in range(1000):
        base = case * 100
        found = [(base + s, case * 10_000_000_000 + t, k, a) for s, t, k, a in world(case, 24)]
        rows += [p(s, "A" if a else "R", 0, dns_id=1000 + case * 3 + k)[:1] + (t,) + p(s, "A" if a else "R", 0, dns_id=1000 + case * 3 + k)[2:] for s, t, k, a in found]
        want += looped(found)
    packets = table(spark, rows)
    seqs = lambda df: sorted(((r["q"], r["a"]) for r in df.select(F.col("req.seq").alias("q"), F.col("resp.seq").alias("a")).collect()), key=repr)
    assert seqs(match(packets, W, strict_arrival=True)) == sorted(want, key=repr)
    assert seqs(match(packets, W)) != sorted(want, key=repr)


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_clock(spark, ranges):
    rows = world(5, 300)
    packets = table(spark, [(s, t, *p(s, "A" if a else "R", 0)[2:]) for s, t, _, a in rows])
    got = {r["seq"]: r["clock_us"] for r in arrival.clock(packets, ranges).collect()}
    best, want = 0, {}
    for s, t, *_ in rows:
        best = max(best, t)
        want[s] = best
    assert got == want
    assert arrival.clock(packets.limit(0), ranges).count() == 0
