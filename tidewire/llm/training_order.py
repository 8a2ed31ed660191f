"""Token-ID output in training order.

Texts become token ids (byte-level BPE) and each task's documents, an end mark
after each, are cut into sequences of ``LENGTH`` ids. Sequences are numbered
without gaps; a keyed Feistel network with cycle-walking permutes the numbers
into slots. Range partitions of the slots then lay out shards: fixed-stride
records, slot after slot, so a reader finds slot s in shard s div SHARD_RECORDS
at byte (s mod SHARD_RECORDS) * stride and resumes anywhere.

Null and empty texts have no tokens and no end mark. The last sequence of a
task is filled up with end marks. Repeated rows are all written. An empty table
gives no shard. Only doc_id and the text are used, whatever else the table has.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix, width

LENGTH = 512
SHARD_RECORDS = 1024
ROUNDS = 6
#: Segments that a worker keeps; past that it keeps no new ones.
KEPT_SEGMENTS = 400_000
#: Fixed value: the vocabulary's own split of a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Unicode white space, as PATTERN's \s. No token goes on from other characters
#: into white space, so a text's tokens are those of white space with what follows.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SEGMENT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")

SEQUENCES = "part int, number long, n_tokens int, tokens binary, doc_ids array<long>"
SHARDS = "shard long, first_slot long, n_records int, stride int, payload binary, payload_sha256 string, doc_ids array<long>"


class Tokenizer:
    def __init__(self, ranks: bytes):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.end = np.uint16(len(table)).tobytes()
        if len(table) >= 2**16:
            raise ValueError("ids are stored in two bytes each")
        self.kept: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """Ids as little-endian two-byte numbers."""
        segments = SEGMENT.findall(text)
        found = list(map(self.kept.get, segments))
        if None in found:
            plain = self.encoding.encode_ordinary
            keep = len(self.kept) < KEPT_SEGMENTS
            for k, ids in enumerate(found):
                if ids is None:
                    found[k] = np.array(plain(segments[k]), "<u2").tobytes()
                    if keep:
                        self.kept[segments[k]] = found[k]
        return b"".join(found)


_TOKENIZERS: dict[str, Tokenizer] = {}


def load(ranks: bytes) -> Tokenizer:
    key = hashlib.sha256(ranks).hexdigest()
    if key not in _TOKENIZERS:
        _TOKENIZERS[key] = Tokenizer(ranks)
    return _TOKENIZERS[key]


def sequences(docs: DataFrame, ranks: bytes, text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(part, number, n_tokens, tokens, doc_ids): the tasks' sequences, numbered within the task."""

    def run(batches):
        tokenizer, part = load(ranks), TaskContext.get().partitionId()
        size, number = 2 * length, 0
        stream, ids, rows = bytearray(), [], []

        def table():
            n, t, d = zip(*rows)
            first = number - len(rows)
            columns = [pa.array([part] * len(rows), pa.int32()), pa.array(range(first, number), pa.int64()), pa.array(n, pa.int32()), pa.array(t, pa.binary()), pa.array(d, pa.list_(pa.int64()))]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, ["part", "number", "n_tokens", "tokens", "doc_ids"])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column(text_col)):
                text = text.as_py()
                if not text:
                    continue
                ids.append(doc)
                stream += tokenizer.encode(text)
                stream += tokenizer.end
                at = 0
                while len(stream) - at >= size:
                    rows.append((length, bytes(stream[at : at + size]), ids))
                    number, at = number + 1, at + size
                    ids = [doc] if len(stream) > at else []
                    if len(rows) >= 2000:
                        yield table()
                del stream[:at]
        if stream:
            rows.append((len(stream) // 2, bytes(stream) + tokenizer.end * (length - len(stream) // 2), ids))
            number += 1
        if rows:
            yield table()

    return docs.select("doc_id", text_col).mapInArrow(run, SEQUENCES)


def permute(number: np.ndarray, n: int, key: int) -> np.ndarray:
    """Slots of sequence numbers: a keyed permutation of range(n)."""
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    with np.errstate(over="ignore"):
        keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key % 2**64))
        out = number.astype(np.uint64)
        left = np.arange(len(out))
        while len(left):  # cycle-walking: go on from values outside the range
            x = out[left]
            a, b = x >> half, x & mask
            for k in keys:
                a, b = b, a ^ (mix(b + k) & mask)
            out[left] = (a << half) | b
            left = left[out[left] >= np.uint64(n)]
    return out.astype(np.int64)


def assign_slots(seqs: DataFrame, key: int) -> DataFrame:
    """Written sequences with their global ``slot``."""
    spark = seqs.sparkSession
    # One number for each task that wrote sequences: 16 bytes a task reach the driver.
    counts = sorted((r["part"], r["n"]) for r in seqs.groupBy("part").agg(F.count("*").alias("n")).toLocalIterator())
    offsets, total = [], 0
    for part, n in counts:
        offsets.append((part, total))
        total += n

    @F.pandas_udf("long")
    def slot(number: pd.Series) -> pd.Series:
        return pd.Series(permute(number.to_numpy(), total, key))

    numbered = seqs.join(F.broadcast(spark.createDataFrame(offsets, "part int, offset long")), "part")
    return numbered.withColumn("slot", slot(F.col("number") + F.col("offset"))).drop("offset")


def shards(slotted: DataFrame, records: int = SHARD_RECORDS) -> DataFrame:
    """One row for each shard, in slot order; the payload is its records end to end."""

    def run(batches):
        shard, held, docs, first = None, [], [], 0

        def row():
            payload = b"".join(held)
            ids = sorted({d for ids in docs for d in ids if d is not None})
            columns = [[shard], [first], [len(held)], [len(held[0])], [payload], [hashlib.sha256(payload).hexdigest()], [ids]]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in SHARDS.split(", ")])

        for batch in batches:
            for s, at, tokens, ids in zip(*(batch.column(c).to_pylist() for c in ("shard", "slot", "tokens", "doc_ids"))):
                if s != shard:
                    if held:
                        yield row()
                    shard, held, docs, first = s, [], [], at
                held.append(tokens)
                docs.append(ids)
        if held:
            yield row()

    rows = slotted.select(F.expr(f"slot div {int(records)}").alias("shard"), "slot", "tokens", "doc_ids")
    return rows.repartitionByRange(width(slotted.sparkSession), "shard").sortWithinPartitions("slot").mapInArrow(run, SHARDS)


def materialise(docs: DataFrame, ranks: bytes, key: int, text_col: str = "text", length: int = LENGTH, records: int = SHARD_RECORDS) -> DataFrame:
    """Tokenise, permute and lay out ``docs``; returns the shards."""
    held = materialize(sequences(docs, ranks, text_col, length), "sequences")
    return shards(assign_slots(held, key), records)


def read_slots(written: DataFrame, first: int, count: int) -> DataFrame:
    """(slot, tokens array<int>) of a slot range from written shards; other shards are skipped by their bounds."""
    hit = written.filter((F.col("first_slot") < first + count) & (F.col("first_slot") + F.col("n_records") > first))

    def run(batches):
        for batch in batches:
            for start, n, stride, payload in zip(*(batch.column(c).to_pylist() for c in ("first_slot", "n_records", "stride", "payload"))):
                a, b = max(first, start), min(first + count, start + n)
                ids = np.frombuffer(payload, "<u2", (b - a) * stride // 2, (a - start) * stride).reshape(b - a, -1)
                yield pa.RecordBatch.from_arrays([pa.array(range(a, b), pa.int64()), pa.array(ids.astype(np.int32).tolist(), pa.list_(pa.int32()))], ["slot", "tokens"])

    return hit.select("first_slot", "n_records", "stride", "payload").mapInArrow(run, "slot long, tokens array<int>")


def export_files(written: DataFrame, folder: str) -> DataFrame:
    """Write each shard as a file ``shard-NNNNNNNN.bin`` below a folder that all executors share.

    A file appears under its name once it is whole; a task that runs again
    writes the same bytes. Returns (shard, path, n_bytes); nothing is written
    before an action.
    """

    def run(batches):
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for shard, payload in zip(batch.column("shard").to_pylist(), batch.column("payload").to_pylist()):
                name = f"shard-{shard:08d}.bin"
                with files.open_output_stream(f"{root}/.{name}.{attempt}") as out:
                    out.write(payload)
                files.move(f"{root}/.{name}.{attempt}", f"{root}/{name}")
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([f"{folder}/{name}"]), pa.array([len(payload)], pa.int64())], ["shard", "path", "n_bytes"])

    return written.select("shard", "payload").mapInArrow(run, "shard long, path string, n_bytes long")
