"""Media columns: content-addressed payloads in tar shards.

Texts become 8-bit greyscale images of 576 samples a row (PNG, lossless). Each
task appends its images to tar shards in the shared folder; a member is named
by the SHA-256 of its payload and stored once per shard. Rows carry shard,
digest, offset and length. A second job range-reads the members' headers alone
for the metadata columns, and the members themselves for payload features.

Null text: an empty payload, padded like any other. Empty table: no shard, no
row. Repeated rows: one result each, the same values. A shard closes after
``SHARD_BYTES`` or ``SHARD_ROWS``, so that copies never pile up in one task.
A task that runs again writes the same shard under the same name.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ..plans.session import shared_folder
from .common import extended, materialize, quoted, width

ROW = 576
SHARD_BYTES = 16_000_000
SHARD_ROWS = 8_000
#: PNG's fixed signature.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
TAR_BLOCK = 512
#: Signature and the whole IHDR chunk.
HEADER = 33

INDEX_SCHEMA = "shard string, digest string, offset long, length long, n_bytes long"
META_SCHEMA = "media_width int, media_height int, media_depth int"
PAYLOAD_SCHEMA = (
    "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string"
)


def pad(text: bytes) -> bytes:
    rows = max(1, -(-len(text) // ROW))
    return text + b"\xff" * (rows * ROW - len(text))


def encode_png(payload: bytes) -> bytes:
    rows = len(payload) // ROW
    lines = np.zeros((rows, ROW + 1), dtype=np.uint8)  # each line led by filter type 0
    lines[:, 1:] = np.frombuffer(payload, dtype=np.uint8).reshape(rows, ROW)
    out = [SIGNATURE]
    for kind, body in (
        (b"IHDR", struct.pack(">IIBBBBB", ROW, rows, 8, 0, 0, 0, 0)),
        (b"IDAT", zlib.compress(lines.tobytes(), 6)),
        (b"IEND", b""),
    ):
        out.append(struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body)))
    return b"".join(out)


def png_header(head: bytes) -> tuple[int, int, int]:
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a stored image")
    return struct.unpack(">IIB", head[16:25])


def decode_png(media: bytes) -> bytes:
    w, h, _ = png_header(media)
    at, body = 8, []
    while at < len(media):
        (n,) = struct.unpack(">I", media[at : at + 4])
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + data) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a chunk is damaged")
        if kind == b"IDAT":
            body.append(data)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(body)), dtype=np.uint8).reshape(h, w + 1)
    if lines[:, 0].any():
        raise ValueError("only filter type 0 is written here")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Rows, mean, spread and entropy of the samples."""
    counts = np.bincount(np.frombuffer(payload, dtype=np.uint8), minlength=256)
    n, values = counts.sum(), np.arange(256)
    mean = (counts * values).sum() / n
    var = (counts * (values - mean) ** 2).sum() / n
    p = counts[counts > 0] / n
    return f"rows={len(payload) // ROW};mean={mean:.4f};std={var**0.5:.4f};entropy={-(p * np.log2(p)).sum():.4f}"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _write_shards(folder: str, text_at: int):
    def run(batches):
        files, root = _filesystem(folder)
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        files.create_dir(root, recursive=True)
        buffer, members, rows, held, number = io.BytesIO(), {}, [], [], 0

        def close():
            """Give out the rows of the shard once its file is whole."""
            nonlocal buffer, members, rows, held, number
            if not rows:
                return None
            shard = f"{part:06d}-{number:06d}.tar"
            with files.open_output_stream(f"{root}/.{shard}.{attempt}") as out:
                out.write(buffer.getvalue() + b"\0" * (2 * TAR_BLOCK))
            files.move(f"{root}/.{shard}.{attempt}", f"{root}/{shard}")
            table = pa.Table.from_batches(held)
            digest, offset, length, size = zip(*rows)
            for name, values, kind in (
                ("shard", [shard] * len(rows), pa.string()), ("digest", digest, pa.string()),
                ("offset", offset, pa.int64()), ("length", length, pa.int64()), ("n_bytes", size, pa.int64()),
            ):
                table = table.append_column(name, pa.array(values, kind))
            buffer, members, rows, held, number = io.BytesIO(), {}, [], [], number + 1
            return table.to_batches()

        for batch in batches:
            texts, kept = batch.column(text_at), [i for i in range(batch.num_columns) if i != text_at]
            rest, begin = batch.select(kept), 0
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                text = b"" if text is None else text.encode()
                payload = pad(text)
                digest = hashlib.sha256(payload).hexdigest()
                if digest not in members:
                    media = encode_png(payload)
                    info = tarfile.TarInfo(f"{digest}.png")
                    info.size = len(media)
                    buffer.write(info.tobuf(tarfile.USTAR_FORMAT))
                    members[digest] = (buffer.tell(), len(media))
                    buffer.write(media + b"\0" * (-len(media) % TAR_BLOCK))
                rows.append((digest, *members[digest], len(text)))
                if buffer.tell() >= SHARD_BYTES or len(rows) >= SHARD_ROWS:
                    held.append(rest.slice(begin, i + 1 - begin))
                    begin = i + 1
                    yield from close()
            if begin < batch.num_rows:
                held.append(rest.slice(begin))
        yield from close() or ()

    return run


def store(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, str]:
    """Write every text into tar shards.

    Returns the index (all other columns of ``docs`` with shard, digest,
    offset, length and n_bytes; columns of ``docs`` with those names are left
    out) and the shards' folder.
    """
    folder = shared_folder(docs.sparkSession, "media")
    added = {c.split()[0] for c in INDEX_SCHEMA.split(", ")}
    docs = docs.select(*quoted(c for c in docs.columns if c == text_col or c not in added))
    schema = extended(docs, [c for c in docs.columns if c != text_col], INDEX_SCHEMA)
    index = docs.mapInArrow(_write_shards(folder, docs.columns.index(text_col)), schema)
    return materialize(index, "media-index"), folder


def _read(folder: str, whole: bool):
    def run(batches):
        files, root = _filesystem(folder)
        name, file, last, got = None, None, None, None
        for batch in batches:
            out = []
            for shard, digest, offset, length in zip(*(batch.column(c).to_pylist() for c in ("shard", "digest", "offset", "length"))):
                if shard != name:
                    if file:
                        file.close()
                    name, file, last = shard, files.open_input_file(f"{root}/{shard}"), None
                if offset != last:
                    last = offset
                    if not whole:
                        head = file.read_at(TAR_BLOCK + HEADER, offset - TAR_BLOCK)
                        if tarfile.TarInfo.frombuf(head[:TAR_BLOCK], "utf-8", "strict").name != f"{digest}.png":
                            raise ValueError(f"{shard} has no {digest} before {offset}")
                        got = png_header(head[TAR_BLOCK:])
                    else:
                        media = file.read_at(length, offset)
                        payload = decode_png(media)
                        got = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload))
                        if got[1] != digest:
                            raise ValueError(f"{shard}: the payload at {offset} is not {digest}")
                out.append(got)
            table = pa.Table.from_batches([batch])
            spec = (PAYLOAD_SCHEMA if whole else META_SCHEMA).split(", ")
            kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
            for k, column in enumerate(spec):
                n, kind = column.split()
                table = table.append_column(n, pa.array([x[k] for x in out], kinds[kind]))
            yield from table.to_batches()
        if file:
            file.close()

    return run


def _scan(index: DataFrame, folder: str, whole: bool) -> DataFrame:
    spec = PAYLOAD_SCHEMA if whole else META_SCHEMA
    added = {c.split()[0] for c in spec.split(", ")}
    index = index.select(*quoted(c for c in index.columns if c not in added))
    # One shard's rows meet in one task and are read in the order they lie.
    dealt = index.repartition(width(index.sparkSession), "shard").sortWithinPartitions("shard", "offset")
    return dealt.mapInArrow(_read(folder, whole), extended(index, index.columns, spec))


def read_headers(index: DataFrame, folder: str) -> DataFrame:
    """Fill the metadata columns from the members' headers, 545 bytes each."""
    return _scan(index, folder, whole=False)


def read_payloads(index: DataFrame, folder: str) -> DataFrame:
    """Read whole members back and fill the payload columns."""
    return _scan(index, folder, whole=True)


def media_features(docs: DataFrame) -> DataFrame:
    """Features of every text (doc_id, text); equal texts have equal values, wherever they are stored."""
    index, folder = store(docs.select("doc_id", "text"))
    return read_payloads(read_headers(index, folder), folder).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature",
        "media_width", "media_height",
    )
