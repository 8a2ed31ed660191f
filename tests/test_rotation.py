"""Files that open one after another, against a plain loop."""

import random

import pytest

from tidewire.operators.rotation import greedy

PERIOD = 60


def looped(rows):
    opened, out = None, []
    for seq, ts in rows:
        if opened is None or opened < ts - PERIOD * 1_000_000:
            opened = ts
        out.append((seq, ts, opened))
    return out


def times(seed, n, steps, back):
    r = random.Random(seed)
    ts, out = 1_600_000_000_000_000, []
    for seq in range(n):
        ts += r.choice(steps)
        out.append((seq * 3, ts - r.choice([0, 0, back])))
    return out


DENSE, SPARSE = [0, 1_000_000, 7_000_001], [0, 20_000_000, 61_000_000, 60_000_000, 900_000_000]


@pytest.mark.parametrize("case", [(1, 400, DENSE, 0, 1), (2, 400, DENSE, 0, 7), (3, 400, SPARSE, 0, 16), (4, 300, DENSE, 200_000_000, 5), (5, 60, SPARSE, 50_000_000, 40), (6, 300, [0], 0, 6)])
def test_plain_loop(spark, case):
    seed, n, steps, back, ranges = case
    rows = times(seed, n, steps, back)
    got = greedy(spark.createDataFrame(rows, "seq long, ts_us long").repartition(3), PERIOD, ranges)
    assert sorted(map(tuple, got.collect())) == looped(rows)


def test_nothing(spark):
    assert greedy(spark.createDataFrame([], "seq long, ts_us long"), PERIOD, 4).count() == 0
