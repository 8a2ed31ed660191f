"""The stream's matcher by groups of keys: calls to the state don't grow with requests or keys."""

from types import SimpleNamespace

import pandas as pd
import pytest

from tidewire.streaming import match as stream

W = 4_000_000


class Handle:
    """A group's value and timers, and how often they were called."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.calls, self.value = self.calls + 1, None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)


@pytest.fixture
def group():
    handle = Handle()
    one = stream.matcher(W, False, None)
    one.init(handle)
    return handle, one


def rows(*packets):
    return pd.DataFrame([(f"k{k}" if k is not None else None, s, t, r, "a.") for k, s, t, r in packets], columns=["key", "seq", "ts_us", "is_response", "qname"])


def put(one, *parts):
    return [tuple(None if pd.isna(v) else int(v) for v in r) for f in one.handleInputRows((0,), iter(parts), None) for r in f.itertuples(index=False)]


def fire(one, handle, ms):
    out = []
    for t in sorted(t for t in handle.timers if t <= ms):
        at = SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
        out += [int(s) for f in one.handleExpiredTimer((0,), at, SimpleNamespace(getExpiryTimeInMs=lambda t=t: t)) for s in f["seq"]]
        handle.timers.discard(t)
    return out


def test_few_calls_for_many_requests_and_keys(group):
    handle, one = group
    # 200 keys, each with 20 requests that answers take at once and one that waits.
    packets = [(k, 1000 * n + 2 * k + r, 1_000_000 + 1000 * n, bool(r)) for k in range(200) for n in range(20) for r in (0, 1)]
    packets += [(k, 10**6 + k, 1_100_000 + k * 1000, False) for k in range(200)]
    assert len(put(one, rows(*packets[:5000]), rows(*packets[5000:]))) == 4000
    assert handle.calls == 3 and len(handle.timers) == 1


def test_timers_go_from_one_request_to_the_next(group):
    handle, one = group
    assert put(one, rows((1, 2, 2_000_000, False), (2, 1, 1_000_000, False), (1, 5, 3_000_000, False), (None, 0, 9, False))) == []
    assert fire(one, handle, 5_000) == [] and fire(one, handle, 5_001) == [1]
    # The newest of a key goes first, over batches; the other leaves by its timer.
    assert put(one, rows((1, 6, 4_000_000, True))) == [(5, 3_000_000, 5, 6, 1_000_000)]
    assert fire(one, handle, 6_001) == [2] and handle.value is None and not handle.timers
    assert put(one, rows((3, 2**60 + 1, 7_000_000, True))) == [(2**60 + 1, 7_000_000, None, 2**60 + 1, None)]
