import random
import time
import zlib

from tidewire.llm import toxicity
from tidewire.llm.toxicity import folded_words, matcher, score

from .data import ODD, empty, table

LABELS = "doc_id long, quality int, toxic int"


def test_folding_and_phrases():
    assert folded_words("Y0u ID10T, m0r0n 2024 іdiot sc@m $$$ 3 a-b") == ["you", "idiot", "moron", "2024", "idiot", "scam", "3", "a", "b"]
    find = matcher({"trash": 2.0, "tra": 1.0, "clown": 3.0})
    assert find("trash travel clown trash can".split()) == {1: 2.0, 7: 1.0, 14: 3.0}
    assert find([]) == {}
    assert matcher({"trash": 2.0}, ("nice trash",))("trash nice trash".split()) == {1: 2.0}


def test_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    known = docs.join(labels.select("doc_id", "toxic"), "doc_id").drop("toxic")
    out = score(known.select("doc_id", "text"), docs, labels)
    rows = out.join(labels, "doc_id").select("doc_id", "held_out", "score", "predicted", "toxic").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    tested = [r for r in rows if r["held_out"]]
    assert len(tested) > 500 and sum(r["predicted"] == r["toxic"] for r in tested) / len(tested) > 0.97
    assert sum(r["predicted"] for r in tested if not r["toxic"]) / len(tested) < 0.01


def test_held_out_labels_are_not_read(spark):
    texts = [f"{'bad word here' if k % 2 else 'fine word here'} number {k}" for k in range(60)]
    docs = table(spark, texts)
    rows = [(k, 1, k % 2) for k in range(60)]
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in rows]
    a, b = ([r["score"] for r in score(docs, docs, spark.createDataFrame(x, LABELS)).orderBy("doc_id").collect()] for x in (rows, turned))
    assert a == b and a[1] > 0.5 > a[0]


def test_odd_rows(spark):
    docs = table(spark, ODD)
    labels = spark.createDataFrame([(3, 1, 1), (3, 1, 1), (None, 1, 1), (6, 1, None), (1, 0, 0)], LABELS)
    out = score(docs.selectExpr("*", "1 as weight", "2 as score", "3 as n_words"), docs, labels).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    none = score(docs, docs, spark.createDataFrame([], LABELS)).collect()
    assert all(r["score"] == 0 and r["predicted"] == 0 for r in none)
    assert score(empty(spark), docs, labels).count() == 0


def test_lexicon_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "PATTERNS", 1)
    docs = table(spark, [f"{'badone badtwo' if k % 2 else 'fine'} {k}" for k in range(80)])
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(80)], LABELS)
    assert len(toxicity.learn_lexicon(toxicity.training_rows(docs, labels))) == 1


def brute(text, lexicon, exceptions):
    """Hits word by word, phrases by plain comparison."""
    words = folded_words(text)
    spared = set()
    for phrase in exceptions:
        p = phrase.split()
        for k in range(len(words) - len(p) + 1):
            if words[k : k + len(p)] == p:
                spared.update(range(k, k + len(p)))
    weights = [max((w for p, w in lexicon.items() if x.startswith(p)), default=None) for x in words]
    hits = [w for k, w in enumerate(weights) if w is not None and k not in spared]
    return len(words), len(hits), round(sum(hits), 9)


def test_brute_force(spark):
    r = random.Random(4)
    stems = ["id", "idi", "idiot", "moron", "tra", "trash", "clown"]
    lexicon = {s: r.random() * 3 for s in stems}
    exceptions = ("trash can", "class clown", "very big idiot", "idiot idiot")
    vocabulary = [*stems, "idiotic", "1d10t", "m0r0n", "can", "class", "very", "big", "other", "travel", "іdiot", "-"]
    docs = [" ".join(r.choice(vocabulary) for _ in range(r.randrange(40))) for _ in range(150)] + ODD + [" ".join(r.choice(vocabulary) for _ in range(20_000))]
    got = toxicity.measure(table(spark, docs), lexicon, exceptions).collect()
    assert len(got) == len(docs)
    assert all((g["n_words"], g["n_hits"], round(g["weight"], 9)) == brute(docs[g["doc_id"]], lexicon, exceptions) for g in got)


def test_learned_exceptions(spark):
    """A word that insults everywhere but beside one other word."""
    docs = [f"you clown number {k}" if k % 2 else f"class clown number {k}" if k % 4 else f"fine day number {k}" for k in range(240)]
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(240)], LABELS)
    rows = toxicity.training_rows(table(spark, docs), labels)
    learned = toxicity.learn_exceptions(rows, {"clown": 2.0})
    assert "class clown" in learned and not any(p.startswith("you") for p in learned)
    assert toxicity.learn_exceptions(rows, {}) == ()


def test_long_text_of_hits_and_exceptions():
    """Work by the length of a text, with the result of looking at every span."""
    find = toxicity.matcher({"trash": 2.0, "can": 1.0, "idiot": 3.0}, ("trash can", "idiot idiot"))
    words = ["trash", "can", "idiot", "x"] * 50_000
    start = time.perf_counter()
    found = find(words)
    assert set(found.values()) == {3.0} and len(found) == 50_000
    assert find(["idiot"] * 3) == {} and set(find("can trash can trash idiot".split()).values()) == {1.0, 2.0, 3.0}
    assert time.perf_counter() - start < 20
