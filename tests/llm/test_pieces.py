import random
import struct

import numpy as np
import pytest

from tidewire.llm import pieces
from tidewire.llm.queries import PIECE_MODEL, TOKENIZERS, round_trip

from .data import ODD, empty, table, texts


@pytest.fixture(scope="module")
def proto():
    return pieces.read_model(f"{TOKENIZERS}/{PIECE_MODEL}")


def best(score, unknown, text):
    """Highest score of any segmentation, by plain dynamic programming."""
    value = [0.0] + [float("-inf")] * len(text)
    for end in range(1, len(text) + 1):
        for size in range(1, min(16, end) + 1):
            if text[end - size : end] in score:
                value[end] = max(value[end], value[end - size] + score[text[end - size : end]])
        if text[end - 1] not in score:
            value[end] = max(value[end], value[end - 1] + unknown)
    return value[-1]


def test_best_and_back(spark, proto):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
    score = {sp.id_to_piece(i): -np.log(1000 - sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    r = random.Random(1)
    docs = texts(9, 15) + ODD + ["a  b\n c €😀 ", "▁x ▁", "\n\n", " ", "foo.bar,baz... (x) #y"] + ["".join(r.choice("ab ,.\n€é▁😀xth") for _ in range(200)) for _ in range(20)]
    out = pieces.decode(pieces.encode(table(spark, docs), proto), proto).collect()
    assert len(out) == len(docs)
    for row in out:
        text = docs[row["doc_id"]] or ""
        assert row["decoded"] == text.replace("▁", " ")
        if text:
            assert row["score"] == pytest.approx(best(score, pieces.load(proto).unknown, "▁" + text.replace(" ", "▁")))
        else:
            assert row["ids"] == [] and row["score"] == 0
        assert sp.decode(row["ids"]) == row["decoded"]


def varint(n):
    return bytes([n & 127 | 128]) + varint(n >> 7) if n > 127 else bytes([n])


def field(number, value):
    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    return varint(number << 3 | 5) + struct.pack("<f", value) if isinstance(value, float) else varint(number << 3) + varint(value)


def serialised(scores, kind=1):
    """A model file: unknown, byte pieces and ``scores``; nothing normalised but white space to marks."""
    pieces_ = [("<unk>", 0.0, 2), *[(f"<0x{b:02X}>", 0.0, 6) for b in range(256)], *[(p, s, 1) for p, s in scores.items()]]
    out = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, s, k in pieces_)
    trainer = field(3, kind) + field(35, 1) + field(40, 0)
    return out + field(2, trainer) + field(3, field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1))


def test_ids_of_a_unigram_model(spark):
    """Ids and round trip as the library has them."""
    import sentencepiece

    r = random.Random(7)
    scores = {c: -8 - r.random() for c in "▁abcdef é"[:7]}
    while len(scores) < 300:
        p = "".join(r.choice("abcdef") for _ in range(r.randrange(2, 6)))
        scores.setdefault("▁" * (r.random() < 0.3) + p, -2 - 6 * r.random())
    proto = serialised({p: s for p, s in scores.items() if p != " "})
    assert pieces.model_type(proto) == pieces.UNIGRAM
    sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
    docs = ["".join(r.choice("abcdefabcdef  é\n😀") for _ in range(r.randrange(1, 400))) for _ in range(60)] + ["fade a bed", " ", "x", *[d for d in ODD if d]]
    docs += ["".join(r.choice("abcdef ") for _ in range(100_000))]
    rows = pieces.decode(pieces.encode(table(spark, docs), proto), proto).collect()
    assert len(rows) == len(docs)
    for row in rows:
        text = docs[row["doc_id"]]
        # The library sums in single precision, which tells in the end on very long texts.
        assert row["decoded"] == text and (len(text) > 50_000 or row["ids"] == sp.encode(text))


def test_kinds_of_models(proto):
    assert pieces.model_type(proto) == pieces.BPE
    with pytest.raises(ValueError):
        pieces.Model(serialised({"a": -1.0}, kind=4))
    # Ranks as they are would cut words to bits.
    model = pieces.Model(proto)
    assert [model.text[i] for i in np.frombuffer(model.encode("The quick brown fox"), np.int32)] == [b" The", b" quick", b" brown", b" f", b"ox"]


def test_full_word_store(proto, monkeypatch):
    model = pieces.Model(proto)
    docs = texts(10, 10)
    plain = [model.encode(d) for d in docs]
    monkeypatch.setattr(pieces, "KEPT_WORDS", 0)
    assert [pieces.Model(proto).encode(d) for d in docs] == plain


def test_cuts_are_safe():
    assert pieces.cuts(["▁a", "b,", "a▁b"]).findall("x y") == ["x y"]
    assert pieces.cuts(["▁a", "ab"]).findall(" ab, c") == [" ab", ",", " c"]
    assert pieces.cuts(["b,"]).findall(" ab, c.") == [" ab,", " c", "."]


def test_rows(spark, proto):
    assert pieces.encode(empty(spark), proto).count() == 0
    clash = table(spark, ["a", None], [1, None]).selectExpr("*", "'x' as ids", "'y' as score", "'z' as decoded")
    rows = pieces.decode(pieces.encode(clash, proto), proto).collect()
    assert sorted(r["decoded"] for r in rows) == ["", "a"]
    assert round_trip(table(spark, ODD)).filter("not round_trip").count() == 0
    assert pieces.load(proto).decode(np.zeros(0, dtype=np.int64), np.array([0, 0])) == ["", ""]
