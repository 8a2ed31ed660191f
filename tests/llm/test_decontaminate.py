import hashlib
import random

import pytest

from tidewire.llm.decontaminate import Automaton, decontaminate, words_of

from .data import ODD, empty, sentence, table

ITEMS = "item_id string, text string"


def brute(text, items, window=13):
    w = words_of(text)
    hit, found = set(), set()
    for i, t in items:
        x = words_of(t)
        size = min(window, len(x))
        windows = {tuple(x[k : k + size]) for k in range(len(x) - size + 1)} if x else set()
        for k in range(len(w) - size + 1):
            if x and tuple(w[k : k + size]) in windows:
                hit.update(range(k, k + size))
                found.add(i)
    ids = sorted(i for i in found if i is not None)
    return (len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))


def case(seed):
    r = random.Random(seed)
    items = [(str(k), sentence(r, r.randrange(1, 30), 4)) for k in range(25)] + [("x", None), (None, "w1 w2 w3"), ("y", "..."), ("d1", "w0 w1 w0 w1"), ("d2", "W0, w1 w0-w1")]
    docs = [sentence(r, r.randrange(0, 60), 4) for _ in range(80)]
    long = sentence(random.Random(9), 40, 1000)
    items.append(("long", long))
    docs += [f"{sentence(r, 5, 1000)} {' '.join(long.split()[k : k + n])} {sentence(r, 300, 1000)}" for k, n in ((0, 40), (3, 13), (3, 12), (20, 20))]
    return docs + ODD, items


@pytest.mark.parametrize("seed", range(3))
def test_brute_force(spark, seed):
    docs, items = case(seed)
    bench = spark.createDataFrame(items, ITEMS)
    for block in (200_000, 60):
        got = decontaminate(table(spark, docs), bench, block_words=block).collect()
        assert len(got) == len(docs)
        for r in got:
            assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == brute(docs[r["doc_id"]], items)


def test_empty_tables_and_clashing_columns(spark):
    bench = spark.createDataFrame([("a", "w1 w2")], ITEMS)
    assert decontaminate(empty(spark), bench).count() == 0
    none = decontaminate(table(spark, ["w1 w2"]), spark.createDataFrame([], ITEMS)).first()
    assert (none["n_hit"], none["contaminated"]) == (0, False)
    clash = table(spark, ["w1 w2 w3", "w1 w2 w3"], [1, 1]).selectExpr("*", "'x' as spans", "1 as n_hit")
    rows = decontaminate(clash, bench).collect()
    assert [(r["n_hit"], [(s["first"], s["past"]) for s in r["spans"]], r["items"]) for r in rows] == [(2, [(0, 2)], ["a"])] * 2


def test_automaton_knows_all_substrings():
    r = random.Random(5)
    items = [(str(k), sentence(r, 12, 3).encode().split()) for k in range(6)]
    a = Automaton(items, window=3)
    for _, words in items:
        state = 0
        for w in words:
            state = a.next[state][a.vocabulary[w]]
    spans, found = a.scan(items[2][1])
    assert "2" in {a.ids[k] for k in found} and spans[-1] == (0, 12)


def test_spans_are_cut(spark):
    """Passages over the length limit go wherever they are, whole short items from contaminated rows alone."""
    item = [f"q{k}" for k in range(30)]
    around = [f"z{k}" for k in range(2000)]
    bench = spark.createDataFrame([("a", " ".join(item)), ("b", "tiny item")], ITEMS)
    docs = [
        f"{' '.join(around[:900])} É, {' '.join(item).upper()}; {' '.join(around[900:])}",
        f"{' '.join(around)} {' '.join(item[4:16])} end",  # one word less than a window
        f"{' '.join(around)} tiny, item end",
        "start tiny, item end",
        None,
        f"{' '.join(item)}",
        f"{' '.join(around)} {' '.join(item[:13])} x {' '.join(item[17:])}",
    ]
    want = [(False, f"{' '.join(around[:900])} É, ; {' '.join(around[900:])}"), (False, docs[1]), (False, docs[2]), (True, "start  end"), (False, None), (True, ""), (False, f"{' '.join(around)}  x ")]
    for block in (200_000, 2):
        got = decontaminate(table(spark, docs), bench, block_words=block, text_to="text").collect()
        assert [(r["contaminated"], r["text"]) for r in sorted(got, key=lambda r: r["doc_id"])] == want
