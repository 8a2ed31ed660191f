import random

import numpy as np
import pyarrow as pa
import pytest

from tidewire.llm import near_dup
from tidewire.llm.components import components
from tidewire.llm.near_dup import folded, may_link, near_duplicates, shingle_sets, sketch

from .data import ODD, empty, table, texts


def brute(docs):
    sets = []
    for t in docs:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset([tuple(w)]) if w else frozenset())
    parent = list(range(len(docs)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                x, y = sorted((top(i), top(j)))
                parent[y] = x
    return [(len(s), top(i)) for i, s in enumerate(sets)]


def check(spark, docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(table(spark, docs)).collect()}
    assert got == dict(enumerate(brute(docs)))


@pytest.mark.parametrize("seed", range(2))
def test_brute_force(spark, seed):
    check(spark, texts(seed) + ODD)


def test_chain_and_large_family(spark, monkeypatch):
    """A drifting family: neighbours link, the ends don't; dealt out in small parts, with later rounds."""
    r = random.Random(3)
    words = [f"v{k}" for k in range(60)]
    docs = []
    for k in range(90):
        docs.append(" ".join(words))
        words[r.randrange(60)] = f"n{k}"
    monkeypatch.setattr(near_dup, "STAR", 7)
    monkeypatch.setattr(near_dup, "STARS", 1)
    monkeypatch.setattr(near_dup, "BLOCK", 9)  # keys go in several blocks
    check(spark, docs)


def test_sketches_bound_the_difference():
    """Sketches of any two sets, folded to the shorter one, never differ in more bits than the sets have shingles apart."""
    r = np.random.default_rng(2)
    whole = r.integers(0, 2**64, 6000, dtype=np.uint64)
    for n, m, shared in ((5, 4, 4), (300, 280, 250), (900, 1100, 880), (3000, 2900, 0), (4000, 5000, 4000)):
        a, b = whole[:n], whole[n - shared : n - shared + m]
        one, two = sorted((sketch(a), sketch(b)), key=len)
        x, y = (np.frombuffer(s, np.uint64)[None] for s in (one, two))
        apart = int(np.bitwise_count(x ^ folded(y, x.shape[1])).sum())
        assert apart <= n + m - 2 * shared and may_link(n + m - 2 * shared, n + m, 80) == (100 * shared >= 80 * (n + m - shared))
        got = next(near_dup._possible(80)(iter([tuple(map(pa.array, ([sketch(a)], [sketch(b)], [n], [m])))])))
        assert got.to_pylist() == [may_link(apart, n + m, 80)]


def test_forest_joins_what_can_be_joined():
    r = np.random.default_rng(3)
    base = r.integers(0, 2**64, 100, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[r.random(100) < 0.93], r.integers(0, 2**64, r.integers(1, 14), dtype=np.uint64)])) for _ in range(60)]
    n, sketches = np.array([len(s) for s in sets]), [sketch(s) for s in sets]
    nodes, labels = np.arange(60) + 1000, np.arange(60) // 3

    def top(parent, x):
        while parent[x] != x:
            x = parent[x]
        return x

    for side in (None, np.arange(60) % 2):
        for failed in ({}, {k: [1000 + j for j in range(60)] for k in range(0, 60, 7)}):
            parent, links = {k: k for k in range(20)}, 0
            for i in range(60):
                for j in range(60):
                    a, b = (int.from_bytes(folded(np.frombuffer(sketches[k], np.uint64)[None], 4).tobytes(), "little") for k in (i, j))
                    asked = i not in failed and j not in failed and (side is None or side[i] != side[j])
                    if asked and may_link((a ^ b).bit_count(), n[i] + n[j], 80) and len(sketches[i]) == len(sketches[j]) == 32:
                        x, y = top(parent, labels[i]), top(parent, labels[j])
                        parent[max(x, y)] = min(x, y)
            both = failed | {j: [1000 + i for i in failed] for j in range(60) if j not in failed} if failed else {}
            got = {k: k for k in range(20)}
            small = [k for k in range(60) if len(sketches[k]) == 32]
            pairs = list(near_dup.forest(nodes[small], labels[small], None if side is None else side[small], n[small], [sketches[k] for k in small], {small.index(k): v for k, v in both.items() if k in small}, 80))
            for a, b in pairs:
                x, y = top(got, labels[a - 1000]), top(got, labels[b - 1000])
                assert x != y
                got[max(x, y)] = min(x, y)
            assert [top(got, k) for k in range(20)] == [top(parent, k) for k in range(20)]


def test_rows(spark):
    rows = near_duplicates(table(spark, ["one two three", "one two three", "one two three", None, "solo"], [5, 5, 3, None, 9])).orderBy("rid").collect()
    assert [(r["doc_id"], r["component_id"], r["kept"]) for r in rows] == [(5, 3, False), (5, 3, False), (3, 3, True), (None, None, True), (9, 9, True)]
    assert [r["first"] for r in rows] == [False, False, True, True, True]
    assert near_duplicates(empty(spark)).count() == 0
    clash = table(spark, ["a b", "a b"]).selectExpr("*", "1 as rid", "'x' as signature", "2 as component")
    assert near_duplicates(clash).filter("kept").count() == 1


def test_guarantee(spark):
    """Signatures that differ in 2 * CHUNKS - 1 symbols or fewer share a key."""
    r = random.Random(1)
    base = [r.randrange(2**16) for _ in range(near_dup.SYMBOLS)]
    rows = [(0, base)]
    for k in range(1, 300):
        other = list(base)
        for s in r.sample(range(near_dup.SYMBOLS), 2 * near_dup.CHUNKS - 1):
            other[s] ^= 1 + r.randrange(2**16 - 1)
        rows.append((k, other))
    signs = spark.createDataFrame([(k, b"".join(x.to_bytes(2, "little") for x in v)) for k, v in rows], "node long, signature binary")
    keys = signs.mapInArrow(near_dup._keys, "key long, node long")
    own = keys.filter("node = 0").select("key")
    assert keys.join(own, "key").filter("node > 0").select("node").distinct().count() == 299


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 60) if k % 20] + [(100, 101), (103, 102), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: (k - 1) // 20 * 20 + 1 for k in range(1, 61)}, 100: 100, 101: 100, 102: 102, 103: 102}


def test_sets():
    assert [len(s) for s in shingle_sets([b"", b"a", b"A a", b"a b a b", b"x\x0by\x0cz"])] == [0, 1, 1, 2, 2]
