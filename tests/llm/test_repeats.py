import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidewire.llm.repeats import Repeats, anchors, common, intervals, maximal_repeats, remove_repeats

from .data import ODD, empty, table, texts


def brute(docs, wide):
    data = [(t or "").encode() for t in docs]
    seen = Counter(d[i : i + wide] for d in data for i in range(len(d) - wide + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), dtype=bool)
        for i in range(len(d) - wide + 1):
            if seen[d[i : i + wide]] > 1:
                gone[i : i + wide] = True
        kept = np.frombuffer(d, dtype=np.uint8)[~gone].tobytes()
        runs = int(np.count_nonzero(np.diff(np.concatenate(([0], gone.astype(int)))) == 1))
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("wide,gram,hot", [(200, 32, 2000), (200, 32, 1), (24, 8, 2000), (24, 8, 1)])
def test_brute_force(spark, wide, gram, hot):
    docs = texts(4, 30) + ODD + ["ab" * 200, "xab" * 90 + "c", "é" * 150]
    got = remove_repeats(table(spark, docs), wide=wide, gram=gram, hot=hot).collect()
    want = brute(docs, wide)
    assert len(got) == len(docs)
    for r in got:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]]


def test_groups_hold_all_occurrences(spark):
    docs = texts(5, 20)
    held = Repeats(table(spark, docs).coalesce(1), wide=40, gram=12)
    ids = {r["__rid"]: docs[r["doc_id"]].encode() for r in held.texts.select("__rid", "doc_id").collect()}
    groups = defaultdict(list)
    for r in held.groups().collect():
        groups[r["anchor"], r["grp"], r["n_bytes"]].append((r["rid"], r["start"]))
    strings = defaultdict(set)
    for (_, grp, n), members in groups.items():
        same = defaultdict(set)
        for rid, start in members:
            same[ids[rid][start : start + n]].add((rid, start))
        if grp >= 0:
            assert len(same) == 1
        for text, places in same.items():
            strings[text] |= places
    for text, places in strings.items():
        every = {(rid, i) for rid, d in ids.items() for i in range(len(d)) if d.startswith(text, i)}
        assert places == every and len(every) > 1


@pytest.mark.parametrize("wide,gram", [(40, 12), (200, 32)])
def test_groups_of_hot_anchors(spark, wide, gram):
    """Groups are the same whichever way an anchor is resolved."""
    r = random.Random(8)
    passage = texts(6, 4)[-4][:260]
    docs = texts(5, 20) + [f"{r.random()} {passage[r.randrange(9):-1 - r.randrange(9)]} {r.random()}" for _ in range(40)] + ["ab" * 200, "xab" * 90 + "c"]
    found = []
    for hot in (2000, 1):
        groups = defaultdict(set)
        held = Repeats(table(spark, docs).coalesce(1), wide=wide, gram=gram, hot=hot)
        ids = {x["__rid"]: x["doc_id"] for x in held.texts.select("__rid", "doc_id").collect()}
        for x in held.groups().collect():
            groups[x["anchor"], x["grp"], x["n_bytes"]].add((ids[x["rid"]], x["start"]))
        found.append(Counter((anchor, n, frozenset(members)) for (anchor, grp, n), members in groups.items() if grp >= 0))
    assert found[0] == found[1] and len(found[0]) > 20


def test_anchors_follow_content():
    r = random.Random(2)
    a = bytes(r.randrange(97, 100) for _ in range(3000))
    b = b"prefix" * 7 + a[500:1500] + b"suffix" * 9
    kinds = []
    for text in (a, b):
        h, _, lo, at, hi = anchors(text, 100, 16)
        kinds.append({text[p : p + 100]: (int(h[k]), int(at[k] - p)) for k in range(len(h)) for p in range(lo[k], hi[k] + 1)})
        assert [int(x) for k in range(len(h)) for x in range(lo[k], hi[k] + 1)] == list(range(len(text) - 99))
    both = kinds[0].keys() & kinds[1].keys()
    assert len(both) >= 900 and all(kinds[0][s] == kinds[1][s] for s in both)


def test_intervals_and_repeats():
    assert sorted(intervals([2, 1, 1, 3])) == [(1, 0, 4), (2, 0, 1), (3, 3, 4)]
    assert common(b"abcd", b"abxd") == 2 and common(b"abc", b"abcde") == 3 and common(b"", b"a") == 0
    found = sorted((left, right, sorted(m)) for left, right, m in maximal_repeats([b"xxAByy", b"zxAByz", b"xxAByz"], [2, 2, 2], 3))
    assert found == [(1, 3, [0, 1, 2]), (1, 4, [1, 2]), (2, 3, [0, 2])]


def test_rows(spark):
    clash = table(spark, ["q" * 300, "q" * 300, None], [1, 1, None]).selectExpr("*", "1 as rid", "'k' as kept", "2 as n_bytes")
    rows = remove_repeats(clash).collect()
    assert sorted((r["n_bytes"], r["n_removed"]) for r in rows) == [(0, 0), (300, 300), (300, 300)]
    assert remove_repeats(empty(spark)).count() == 0
    text = Repeats(table(spark, ["ü" * 150 + "end"] * 2)).removed(text_to="text").collect()
    assert {r["text"] for r in text} == {""} or all("�" not in r["text"] for r in text)
