import hashlib
import random
from collections import defaultdict

import pytest

from tidewire.llm import common, line_dedup, queries

from ..oracle import compare, connect
from .data import ODD, SF, empty, table

BLANKS = " \t\n\x0b\f\r"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, least_chars=20, least_docs=3):
    """(doc_id, lines, dropped, text) of (doc_id, text) rows."""
    key = lambda line: lower(line.strip(BLANKS))
    held = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            held[key(line)].add(-1 if i is None else i)
    gone = {k: max(ids) for k, ids in held.items() if len(k) >= least_chars and len(ids) >= least_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if gone.get(key(x), -1) <= (-1 if i is None else i)]
        out.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out, key=repr)


def result(docs, **limits):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in line_dedup.dedup_lines(docs, **limits).collect()), key=repr)


COMMON = ["  Subscribe to our newsletter today", "subscribe TO our newsletter today\t", "ÉCOLE supérieure de la ville", "école supérieure de la ville", "short line", "x" * 20, "x" * 19, ""]


def documents(seed, n=60):
    r = random.Random(seed)
    return ["\n".join(r.choice(COMMON) if r.random() < 0.5 else f"line {r.randrange(40)} of its own, so to speak" for _ in range(r.randrange(1, 12))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_brute_force(spark, seed):
    texts = documents(seed) + ODD
    assert result(table(spark, texts)) == brute(list(enumerate(texts)))


def test_keys_that_are_not_hot(spark, monkeypatch):
    monkeypatch.setattr(common, "SHARE", 7)
    texts = documents(9)
    assert result(table(spark, texts)) == brute(list(enumerate(texts)))


def test_repeated_and_missing_ids(spark):
    same = "a line that all of them have\nown"
    rows = [(1, same), (1, same), (1, "a line that all of them have"), (None, same), (None, same), (2, same), (2, "other\n" + same)]
    docs = table(spark, [t for _, t in rows], [i for i, _ in rows])
    assert result(docs) == brute(rows)
    # Two ids alone, however many rows: nothing goes.
    assert all(n == 0 for _, _, n, _ in result(docs.filter("doc_id is not null")))


def test_long_text_and_all_lines_gone(spark):
    long = "\n".join(["the very same line again and again"] * 30_000 + ["end"])
    assert result(table(spark, [long, long, "the very same line again and again", long])) == brute(list(enumerate([long, long, "the very same line again and again", long])))


def test_empty_and_clashing(spark):
    assert result(empty(spark)) == []
    texts = documents(4)
    docs = table(spark, texts).selectExpr("*", "1 as key", "'a' as at", "2 as cut", "3 as h", "4 as rows", "5 as lines", "6 as text_id")
    assert result(docs) == brute(list(enumerate(texts)))


def test_query(spark):
    compare(spark, connect(SF), queries.QUERIES["op12_line_dedup"], queries.ORACLE_SQL["op12_line_dedup"], SF)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in queries.QUERIES["op12_line_dedup"](spark, SF).collect())
    assert got == sorted((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute(docs))
    assert sum(d for _, _, d, _ in got) > 0


def test_native(spark):
    plan = queries.QUERIES["op12_line_dedup"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
