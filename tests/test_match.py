import random

import pandas as pd
import pytest

from tidewire.operators.match import fold, match, match_fold

from .packets import packet as p
from .packets import seqs, table

W = 5_000_000

CASES = {
    "newer answer": ([p(1, "R", 0), p(2, "A", 1)], [(1, 2)]),
    "newest wins": ([p(1, "R", 0), p(2, "R", 1), p(3, "A", 2)], [(2, 3), (1, None)]),
    "nested": ([p(1, "R", 0), p(2, "R", 1), p(3, "A", 2), p(4, "A", 3)], [(2, 3), (1, 4)]),
    "single use": ([p(1, "R", 0), p(2, "A", 1), p(3, "A", 2)], [(1, 2), (None, 3)]),
    "no look-ahead": ([p(1, "A", 0), p(2, "R", 1)], [(None, 1), (2, None)]),
    "just inside": ([p(1, "R", 0), p(2, "A", 4.999999)], [(1, 2)]),
    "on the border": ([p(1, "R", 0), p(2, "A", 5)], [(1, None), (None, 2)]),
    "outside": ([p(1, "R", 0), p(2, "A", 5.000001)], [(1, None), (None, 2)]),
    "expired below": ([p(1, "R", 0), p(2, "R", 4), p(3, "A", 6), p(4, "A", 6.5)], [(2, 3), (1, None), (None, 4)]),
    "other id": ([p(1, "R", 0), p(2, "A", 1, dns_id=8)], [(1, None), (None, 2)]),
    "other port": ([p(1, "R", 0), p(2, "A", 1, client=("10.0.0.1", 1001))], [(1, None), (None, 2)]),
    "other client": ([p(1, "R", 0), p(2, "A", 1, client=("10.0.0.2", 1000))], [(1, None), (None, 2)]),
    "other server": ([p(1, "R", 0), p(2, "A", 1, server=("192.0.2.54", 53))], [(1, None), (None, 2)]),
    "other protocol": ([p(1, "R", 0), p(2, "A", 1, proto=6)], [(1, None), (None, 2)]),
    "other family": ([p(1, "R", 0), p(2, "A", 1, ipv=6)], [(1, None), (None, 2)]),
    "not swapped": ([p(1, "R", 0), p(2, "A", 1, swap=False)], [(1, None), (None, 2)]),
    "negative delay": ([p(1, "R", 10), p(2, "A", 9.9)], [(1, 2)]),
    "two keys": ([p(1, "R", 0), p(2, "R", 1, dns_id=8), p(3, "A", 2, dns_id=8), p(4, "A", 3)], [(1, 4), (2, 3)]),
    "dropped packets": ([p(1, "R", 0), p(2, "R", 1, drop="malformed"), p(3, "A", 2)], [(1, 3)]),
    "empty": ([], []),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    rows, expected = CASES[name]
    t = table(spark, rows)
    assert seqs(match(t, W)) == sorted(expected, key=repr)
    assert seqs(match_fold(t, W, match_qname=False)) == sorted(expected, key=repr)


NAMES = {
    "by name": ([p(1, "R", 0, qname="a."), p(2, "R", 1, qname="b."), p(3, "A", 2, qname="a.")], [(1, 3), (2, None)]),
    "root answers any": ([p(1, "R", 0, qname="a."), p(2, "R", 1, qname="b."), p(3, "A", 2, qname=".")], [(2, 3), (1, None)]),
    "root asks none": ([p(1, "R", 0, qname="."), p(2, "A", 1, qname="a.")], [(1, None), (None, 2)]),
}


@pytest.mark.parametrize("name", NAMES)
def test_names(spark, name):
    rows, expected = NAMES[name]
    assert seqs(match_fold(table(spark, rows), W)) == sorted(expected, key=repr)


@pytest.mark.parametrize("others,found", [(32, True), (33, False)])
def test_search_cap(spark, others, found):
    rows = [p(1, "R", 0)] + [p(2 + k, "R", 0.01 * k, qname="b.") for k in range(others)] + [p(99, "A", 1)]
    assert ((1, 99) in seqs(match_fold(table(spark, rows), W))) == found


def test_oldest(spark):
    rows = [p(1, "R", 0), p(2, "R", 1), p(3, "A", 2)]
    assert (1, 3) in seqs(match(table(spark, rows), W, pick="oldest"))


def random_rows(seed, n, keys=3, step=2.0):
    r, t, rows = random.Random(seed), 0.0, []
    for seq in range(n):
        t += r.choice([0, 0.1, step, r.random() * step])
        rows.append(p(seq, r.choice("RRA") if r.random() < 0.8 else "A", t, dns_id=r.randrange(keys), qname=r.choice(["a.", "b."])))
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_windows_equal_fold_and_slices(spark, seed):
    t = table(spark, random_rows(seed, 400)).cache()
    plain = seqs(match(t, W))
    assert plain == seqs(match_fold(t, W, match_qname=False))
    assert plain == seqs(match(t, W, slice_us=W))
    assert plain == seqs(match(t, W, slice_us=3 * W))
    assert seqs(match(t, W, match_qname=True)) == seqs(match_fold(t, W, slice_us=2 * W))


def test_many_random_folds():
    """The window algorithm, written plainly, against the fold."""
    for seed in range(300):
        rows = pd.DataFrame(random_rows(seed, 40, keys=1), columns=[c.split()[0] for c in "seq,ts_us,a,b,c,d,e,f,g,is_response,qname,h".split(",")])
        partner = fold(rows, W, False)
        levels, depth, found = {}, 0, {}
        for i, (resp, ts) in enumerate(zip(rows["is_response"], rows["ts_us"])):
            if not resp:
                depth += 1
                levels[depth] = i
            elif depth:
                j = levels[depth]
                depth -= 1
                if ts - rows["ts_us"][j] < W:
                    found[i] = j
        assert found == {i: j for i, j in enumerate(partner) if j >= 0 and rows["is_response"][i]}
