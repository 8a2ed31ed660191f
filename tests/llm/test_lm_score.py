import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from tidewire.llm import lm_score
from tidewire.llm.lm_score import lm_scores, ngram_scores
from tidewire.llm.queries import ORACLE_SQL, QUERIES

from ..oracle import compare, connect
from .data import ODD, SF, empty, sentence, table, texts


def brute(docs):
    words = [re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower()) for t in docs]
    uni = Counter(w for x in words for w in x)
    bi = Counter(p for x in words for p in zip(x, x[1:]))
    n = sum(uni.values())
    out = []
    for x in words:
        s = math.log(uni[x[0]] / n) if x else 0.0
        for p in zip(x, x[1:]):
            s += math.log(bi[p] / uni[p[0]])
        out.append((len(x), round(s, 6)))
    return out


def check(spark, docs, **kw):
    got = lm_scores(table(spark, docs).repartition(3), **kw).collect()
    want = brute(docs)
    assert len(got) == len(docs)
    for r in got:
        assert (r["n_words"], round(r["score"], 6)) == want[r["doc_id"]]


def test_brute_force(spark):
    r = random.Random(2)
    docs = texts(1) + ODD + ["Über straße ÜBER x1 X1", sentence(r, 20_000, 900), "pair word " * 5000]
    check(spark, docs)
    check(spark, docs, heavy=10_000)  # all first words are dealt out by both words
    check(spark, docs, heavy=1)  # none is


def test_twin(spark):
    compare(spark, connect(SF), QUERIES["op2_lm_score"], ORACLE_SQL["op2_lm_score"], SF)


def test_repeated_rows_and_null_ids(spark):
    got = lm_scores(table(spark, ["a b", "a b", None], [1, 1, None])).collect()
    assert sorted((str(r["doc_id"]), r["n_words"]) for r in got) == [("1", 2), ("1", 2), ("None", 0)]
    assert lm_scores(empty(spark)).count() == 0


def test_small_chunks(monkeypatch):
    """Rows of many small chunks and packs hold the same bigrams as one."""

    def grams(docs):
        batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(docs)), pa.int64()), "text": docs})
        found = Counter()
        for out in lm_score._grams(np.zeros(0, np.int64), np.zeros(0, np.int64), 3)([batch]):
            for row in out.to_pylist():
                begin = 0
                for first, second, end in zip(row["firsts"], row["seconds"], row["ends"]):
                    found.update((first, second, row["base"] + t) for t in row["texts"][begin:end])
                    begin = end
        return found

    monkeypatch.setattr(lm_score, "TaskContext", type("Task", (), {"get": lambda: type("T", (), {"partitionId": lambda self: 0})()}))
    docs = texts(3) + ODD
    whole = grams(docs)
    monkeypatch.setattr(lm_score, "CHUNK", 500)
    monkeypatch.setattr(lm_score, "CHUNK_ROWS", 7)
    monkeypatch.setattr(lm_score, "SLICE", 4)
    assert grams(docs) == whole and sum(whole.values()) > 1000


def test_the_bounded_words(spark):
    table_ = spark.createDataFrame([(k, k) for k in range(1, 101)], "word long, f long")
    words, _ = lm_score._bounded(table_, 5050, 60)
    assert words.tolist() == list(range(85, 101)) and len(words) < 60


def brute_ngrams(docs, order, least, corpus=None):
    split = lambda docs: [re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower()) for t in docs]
    words, counted = split(docs), split(docs if corpus is None else corpus)
    f = Counter(tuple(x[i : i + k]) for x in counted for k in range(1, order + 1) for i in range(len(x) - k + 1))
    n = f[()] = sum(map(len, counted)) or 1

    def s(gram):
        if not gram:
            return math.log(1 / n)
        if f[gram] >= (least if len(gram) > 1 else 1):
            return math.log(f[gram] / f[gram[:-1]])
        return math.log(0.4) + s(gram[1:])

    grams = [[tuple(x[max(0, i - order + 1) : i + 1]) for i in range(len(x))] for x in words]
    backed = lambda g: f[g] < (least if len(g) > 1 else 1)
    return [(len(x), sum(map(backed, x)), round(sum(map(s, x)), 6)) for x in grams]


def ngrams_are_brute(spark, docs, order, least, corpus=None):
    counted = None if corpus is None else table(spark, corpus).repartition(2)
    got = ngram_scores(table(spark, docs).repartition(3), order, least=least, corpus=counted).collect()
    want = brute_ngrams(docs, order, least, corpus)
    assert len(got) == len(docs)
    assert all((r["n_words"], r["n_backed"], round(r["score"], 6)) == want[r["doc_id"]] for r in got)
    return want


def test_any_order(spark):
    docs = texts(1) + ODD + ["Über straße ÜBER x1 X1"]
    for order, least in ((3, 1), (3, 2), (4, 3), (2, 2)):
        ngrams_are_brute(spark, docs, order, least)
    assert [(a, b) for a, _, b in brute_ngrams(docs, 2, 1)] == brute(docs)
    assert ngram_scores(empty(spark)).count() == 0


def test_under_another_corpus(spark, monkeypatch):
    r = random.Random(4)
    docs, corpus = texts(5, 20) + ODD + ["never seen words", "pair word " * 300], texts(6, 40) + ["pair word pair", None]
    want = ngrams_are_brute(spark, docs, 3, 1, corpus)
    assert sum(b for _, b, _ in want) > 100 and any(b < n for n, b, _ in want)
    monkeypatch.setattr(lm_score, "SHARE", 1)  # no count is broadcast
    ngrams_are_brute(spark, docs, 2, 2, corpus)
    monkeypatch.setattr(lm_score, "SHARE", 10**9)  # all are
    ngrams_are_brute(spark, [*docs, sentence(r, 5000, 90)], 2, 1, corpus)
    monkeypatch.setattr(lm_score, "CHUNK", 300)
    ngrams_are_brute(spark, docs, 2, 1, corpus)
    rows = ngram_scores(table(spark, ["a b"]), corpus=empty(spark)).collect()
    assert [(r["n_words"], r["n_backed"]) for r in rows] == [(2, 2)]
    assert ngram_scores(empty(spark), corpus=table(spark, ["a b"])).count() == 0


def test_held_out_twin(spark):
    compare(spark, connect(SF), QUERIES["lm_held_out"], ORACLE_SQL["lm_held_out"], SF)
    assert QUERIES["lm_held_out"](spark, SF).filter("n_backed > 0 and n_backed < n_words").count() > 0
