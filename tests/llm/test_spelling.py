import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidewire.llm import common, queries, spelling

from .data import ODD, SF, empty, table


def brute_words(rows, least_chars=7, least_count=2):
    """n of each word of (doc_id, text) rows."""
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= least_chars and c >= least_count}


def near(a, b):
    """Whether one edit leads from a to b."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def brute(n, ratio=10):
    around = defaultdict(list)
    # Near words agree in one half, give or take a place: that makes the loop short, not the test.
    halves = defaultdict(set)
    for w in n:
        for key in ((0, w[:3]), (1, w[-3:])):
            halves[key].add(w)
    for w in n:
        for v in halves[0, w[:3]] | halves[1, w[-3:]]:
            if near(w, v):
                around[w].append(v)
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in around.items()}
    form = {w: best[w] for w in best if n[best[w]] >= ratio * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n[w], len(around[w]), n[form[w]] if w in form else None) for w in n}


def result(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def typo(r, word, letters):
    k = r.randrange(len(word) + 1)
    kind = r.randrange(3)
    return word[:k] + (r.choice(letters) if kind else "") + word[k + (kind != 1) :]


def texts(seed, words=30, n=80, letters="abé"):
    """Texts of few words, and many with a slip or two; chains of forms too."""
    r = random.Random(seed)
    base = ["".join(r.choice(letters) for _ in range(r.randrange(6, 12))) for _ in range(words)]
    slips = [typo(r, w, letters) for w in base for _ in range(4)]
    slips += [typo(r, w, letters) for w in slips]
    common_words = [w for w in base[:6] for _ in range(60)]
    return [" ".join(r.choice(r.choice([base, slips, common_words])) for _ in range(60)) for _ in range(n)]


@pytest.mark.parametrize("group", [50_000, 3])
def test_brute_force(spark, group):
    docs = texts(group) + ODD + ["ÀÉPRIORI Apriori×÷ " * 9]
    expected = brute(brute_words(enumerate(docs)))
    assert any(f for f, *_ in expected.values())
    assert result(spelling.variants(table(spark, docs), group=group)) == expected


def test_hot_groups_with_a_share(spark, monkeypatch):
    monkeypatch.setattr(common, "SHARE", 50)
    docs = texts(5)
    assert result(spelling.variants(table(spark, docs), group=2)) == brute(brute_words(enumerate(docs)))


def test_chain_of_forms_and_ties(spark):
    docs = ["abcdefgh " * 2000, "abcdefgx " * 150, "abcdefyx " * 12, "abcdezyx " * 2 + "qqqqqqq " * 2 + "qqqqqqa " * 20 + "qqqqqqb " * 20]
    rows = list(zip([None, None, None, None], docs))
    expected = brute(brute_words(rows))
    assert expected["abcdefyx"][:2] == ("abcdefgx", "abcdefgh")
    assert expected["qqqqqqq"][0] == "qqqqqqa"
    assert result(spelling.variants(table(spark, docs, [None] * 4))) == expected


def test_long_words(spark):
    long = "ab" * 3000
    docs = [f"{long} {long[:-1]} {long[:1500]}x{long[1500:]} {long[1:]} x{long[1:]}"] * 3
    expected = brute(brute_words(enumerate(docs)))
    assert expected[long][3] >= 3
    assert result(spelling.variants(table(spark, docs))) == expected


def test_empty_and_clashing(spark):
    assert result(spelling.variants(empty(spark))) == {}
    assert result(spelling.variants(table(spark, [None, "", "short words"]))) == {}
    docs = texts(7, n=20)
    clash = table(spark, docs).selectExpr("*", "1 as word", "'x' as n", "2 as key", "3 as h", "4 as run", "5 as size")
    assert result(spelling.variants(clash)) == brute(brute_words(enumerate(docs)))


def test_pairs_of_a_list():
    r = random.Random(3)
    words = sorted({"".join(r.choice("ab") for _ in range(r.randrange(1, 8))).encode() for _ in range(150)})
    i, j = spelling.near_pairs(words, np.array([0, len(words)]), 0)
    assert sorted(zip(i.tolist(), j.tolist())) == [(a, b) for a in range(len(words)) for b in range(len(words)) if near(words[a], words[b])]


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert result(queries.QUERIES["op11_spelling_variants"](spark, SF)) == brute(brute_words(rows))
