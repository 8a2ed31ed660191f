import hashlib
import io
import tarfile
import zlib

from tidewire.llm import media
from tidewire.llm.media import decode_png, encode_png, media_features, pad, read_headers, read_payloads, store

from .data import ODD, empty, table, texts


def test_exact_round_trip(spark):
    docs = ODD + texts(11, 10)
    rows = media_features(table(spark, docs).repartition(3)).collect()
    assert len(rows) == len(docs)
    for r in rows:
        data = (docs[r["doc_id"]] or "").encode()
        payload = data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
        png = encode_png(payload)
        assert r["n_bytes"] == len(data) and r["payload_bytes"] == len(payload) and decode_png(png) == payload
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
        assert (r["media_bytes"], r["media_sha256"]) == (len(png), hashlib.sha256(png).hexdigest())
        assert (r["media_width"], r["media_height"]) == (576, len(payload) // 576)
    same = [r for r in rows if docs[r["doc_id"]] == "same text here again"]
    assert len({(r["feature"], r["media_sha256"]) for r in same}) == 1


def test_shards_are_tar_files(spark, monkeypatch):
    monkeypatch.setattr(media, "SHARD_ROWS", 7)
    docs = [f"text {k % 5}" for k in range(20)]
    index, folder = store(table(spark, docs).coalesce(1))
    rows = index.collect()
    assert len({r["shard"] for r in rows}) == 3
    for name in {r["shard"] for r in rows}:
        with open(f"{folder.removeprefix('file://')}/{name}", "rb") as file:
            data = file.read()
        with tarfile.open(fileobj=io.BytesIO(data)) as tar:
            members = {m.name: m for m in tar.getmembers()}
        own = [r for r in rows if r["shard"] == name]
        assert len(members) == len({r["digest"] for r in own})  # a payload is stored once
        for r in own:
            m = members[f"{r['digest']}.png"]
            assert (m.offset_data, m.size) == (r["offset"], r["length"])
            assert decode_png(data[r["offset"] : r["offset"] + r["length"]]) == pad(docs[r["doc_id"]].encode())
    heads = read_headers(index, folder)
    assert {r["media_height"] for r in heads.collect()} == {1} and "lang" in heads.columns


def test_odd_tables(spark):
    assert media_features(empty(spark)).count() == 0
    clash = table(spark, ["a", "a"], [None, None]).selectExpr("*", "'x' as shard", "1 as offset", "'y' as feature")
    index, folder = store(clash)
    assert read_payloads(index, folder).select("feature").distinct().count() == 1
