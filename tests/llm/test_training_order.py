import numpy as np
import pytest

from tidewire.llm import training_order as order
from tidewire.llm.pieces import read_model
from tidewire.llm.queries import RANKS, TOKENIZERS

from .data import ODD, empty, table, texts


@pytest.fixture(scope="module")
def ranks():
    return read_model(f"{TOKENIZERS}/{RANKS}")


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 100, 1000, 4097])
def test_permutation(n):
    a, b = order.permute(np.arange(n), n, 1), order.permute(np.arange(n), n, 2)
    assert sorted(a.tolist()) == list(range(n))
    assert n < 64 or (a != b).any()
    assert order.permute(np.arange(n)[::-1], n, 1).tolist() == a[::-1].tolist()


def test_tokens_are_the_encoders(ranks):
    t = order.load(ranks)
    for text in [*texts(6, 10), *filter(None, ODD), "a  b\n\n c\t d  ", "I'll don't 12ab ,. x", "\x1c \x1d a b"]:
        assert np.frombuffer(t.encode(text), "<u2").tolist() == t.encoding.encode_ordinary(text)


def test_all_tokens_in_all_slots(spark, ranks):
    docs = texts(7, 20) + ODD
    t = order.load(ranks)
    rows = table(spark, docs).coalesce(1)
    shards = order.materialise(rows, ranks, key=5, length=16, records=10).orderBy("shard").collect()
    stream = b"".join(t.encode(d) + t.end for d in docs if d)
    total = -(-len(stream) // 32)
    assert [s["first_slot"] for s in shards] == list(range(0, total, 10)) and sum(s["n_records"] for s in shards) == total
    assert all(len(s["payload"]) == s["n_records"] * s["stride"] for s in shards)
    laid = b"".join(bytes(s["payload"]) for s in shards)
    slots = order.permute(np.arange(total), total, 5)
    padded = stream + t.end * ((total * 32 - len(stream)) // 2)
    assert all(laid[s * 32 : s * 32 + 32] == padded[k * 32 : k * 32 + 32] for k, s in enumerate(slots))
    assert {d for s in shards for d in s["doc_ids"]} == {k for k, d in enumerate(docs) if d}


def test_resume_and_files(spark, ranks, tmp_path):
    shards = order.materialise(table(spark, texts(8, 20)).repartition(3), ranks, key=9, length=16, records=10).cache()
    every = {r["slot"]: r["tokens"] for r in order.read_slots(shards, 0, 10**9).collect()}
    part = {r["slot"]: r["tokens"] for r in order.read_slots(shards, 17, 25).collect()}
    assert sorted(part) == list(range(17, 42)) and all(every[k] == v for k, v in part.items())
    files = order.export_files(shards, f"file://{tmp_path}/out").collect()
    again = order.export_files(shards, f"file://{tmp_path}/out").collect()
    assert sorted(files) == sorted(again)
    whole = b"".join(open(f["path"].removeprefix("file://"), "rb").read() for f in sorted(files, key=lambda f: f["shard"]))
    assert np.frombuffer(whole, "<u2").reshape(-1, 16)[20].tolist() == every[20]


def test_empty(spark, ranks):
    assert order.materialise(empty(spark), ranks, key=1).count() == 0
    assert order.materialise(table(spark, [None, ""]), ranks, key=1).count() == 0
    clash = table(spark, ["a b", "a b"], [None, None]).selectExpr("*", "1 as slot", "2 as part")
    assert order.materialise(clash, ranks, key=1).first()["doc_ids"] == []
