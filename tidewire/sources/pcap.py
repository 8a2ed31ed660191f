"""Classic capture files: a Python data source ``pcap``, and a writer.

Reads microsecond and nanosecond files of either byte order, with Ethernet
(VLAN tags too), raw IP, loopback and Linux cooked frames, plain or compressed
(gzip, bz2, xz), in the order of their paths (or of the comma-separated list).
``seq`` is file number * 2**40 + the byte in the file where the record begins,
so it needs no count of records and is the same however files are split. A
later file that can't be opened as a capture ends the list; if the first one
can't, that is an error.

Options: ``path`` (comma-separated files or folders), ``snaplen`` (cuts the
captured bytes; lengths stay the original ones), ``filter`` (a capture filter,
tested on header bytes before a frame is taken apart), ``spans`` (where each
part of a file begins, see ``spans``). Comparisons of header columns with
values are pushed to the reader too, where the session allows it.

``spans`` cuts large plain files into parts of about ``split_bytes``. From any
byte a record's beginning is guessed by the chain of plausible headers behind
it; all parts are walked from their guesses at once, and a part's end must then
be the next one's guess. Where it isn't, that part is walked again from the
right beginning, so that the result is exact whatever the payloads hold.
"""

from __future__ import annotations

import bz2
import gzip
import ipaddress
import json
import lzma
import os
import struct
import warnings

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, WriterCommitMessage,
)

from ..functions.filters import array_filter, parse

#: Magic numbers (byte order, fractions of a second) and link types of capture files.
MAGIC = {b"\xa1\xb2\xc3\xd4": (">", 1), b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\x3c\x4d": (">", 1000), b"\x4d\x3c\xb2\xa1": ("<", 1000)}
ETHERNET, RAW, LOOP, COOKED, NULL = 1, 101, 108, 113, 0
TCP, UDP, ICMP, ICMP6 = 6, 17, 1, 58
HEADER = 24

FRAMES = (
    "seq long, ts_us long, src_addr string, src_port int, dst_addr string, dst_port int, net_ipv int, net_proto int, net_len int, "
    "net_ttl int, udp_sum int, dns_len int, payload binary, drop_reason string, raw binary"
)
KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
SCHEMA = pa.schema([(c.split()[0], KINDS[c.split()[1]]) for c in FRAMES.split(", ")])
#: Bytes that a task reads at a time, and of a part of a large file.
BLOCK = 8 << 20
SPLIT = 128 << 20
#: Records of a chain that make a guessed beginning plausible.
CHAIN = 6


# ------------------------------------------------------------ frames to rows


class Frames:
    """Header fields of many frames at once, as arrays; ``at`` are their first bytes in ``data``, ``size`` the captured lengths."""

    def __init__(self, data: np.ndarray, at: np.ndarray, size: np.ndarray, net_len: np.ndarray, link: int):
        self.data, self.at, self.size, self.net_len = data, at, size, net_len
        self._network(link)
        self._packet()

    def byte(self, k):
        return self.data[np.minimum(k, len(self.data) - 1)].astype(np.int64)

    def word(self, k):
        return self.byte(k) << 8 | self.byte(k + 1)

    def _network(self, link: int) -> None:
        """Where each frame's IP packet begins, and how many of its bytes are there."""
        end = self.at + self.size
        if link in (RAW, 12, 14):
            self.ip, known = self.at, True
        elif link in (NULL, LOOP):
            self.ip, known = self.at + 4, True
        else:
            kind = self.at + (12 if link == ETHERNET else 14)
            for _ in range(int(self.size.max(initial=0)) // 4 + 1):
                tag = np.isin(self.word(kind), (0x8100, 0x88A8)) & (kind + 2 <= end)
                if not tag.any():
                    break
                kind = kind + 4 * tag
            self.ip, known = kind + 2, np.isin(self.word(kind), (0x0800, 0x86DD)) & (kind + 2 <= end)
        self.there = np.where(known, np.maximum(end - self.ip, 0), 0)

    def _packet(self) -> None:
        ip, there = self.ip, self.there
        version = np.where(there > 0, self.byte(ip) >> 4, 0)
        v4, v6 = (version == 4) & (there >= 20), (version == 6) & (there >= 40)
        self.version = np.where(v4 | v6, version, 0)
        head = np.where(v4, (self.byte(ip) & 15) * 4, 40)
        total = np.where(v4, self.word(ip + 2), 40 + self.word(ip + 4))
        proto = np.where(v4, self.byte(ip + 9), self.byte(ip + 6))
        self.ttl = np.where(v4, self.byte(ip + 8), self.byte(ip + 7))
        fragment = np.where(v4, self.word(ip + 6) & 0x3FFF, 0)
        while (more := v6 & np.isin(proto, (0, 43, 44, 60)) & (there >= head + 8)).any():
            part = more & (proto == 44)
            fragment = np.where(part, fragment | self.word(ip + head + 2) & 0xFFF9, fragment)
            after = np.where(part, 8, (self.byte(ip + head + 1) + 1) * 8)
            proto, head = np.where(more, self.byte(ip + head), proto), np.where(more, head + after, head)
        self.proto = np.where(v4 | v6, proto, 0)
        self.fragment = (self.version > 0) & (fragment > 0)
        self.segment, self.wire = ip + head, total - head
        self.length = np.maximum(np.minimum(total, there) - head, 0)
        whole = (self.version > 0) & ~self.fragment
        ported = whole & np.isin(proto, (TCP, UDP)) & (self.length >= 4)
        icmp = whole & np.isin(proto, (ICMP, ICMP6))
        self.src_port, self.dst_port = (np.where(ported, self.word(self.segment + k), np.where(icmp, 0, -1)) for k in (0, 2))

    def addresses(self, side: str) -> tuple[np.ndarray, np.ndarray]:
        """Upper and lower 64 bits; addresses of version 4 are all in the lower."""
        v4 = self.version == 4
        at = self.ip + np.where(v4, 12, 8) + np.where(v4, 4, 16) * (side == "dst")
        octets = [self.byte(at + k).astype(np.uint64) for k in range(16)]

        def number(part):
            out = np.zeros(len(at), dtype=np.uint64)
            for o in part:
                out = out << np.uint64(8) | o
            return out

        return np.where(v4, np.uint64(0), number(octets[:8])), np.where(v4, number(octets[:4]), number(octets[8:]))

    def fields(self) -> dict:
        """What a capture filter asks for."""
        return {
            "version": self.version, "proto": self.proto, "net_len": self.net_len, "src_port": self.src_port, "dst_port": self.dst_port,
            "src": self.addresses("src"), "dst": self.addresses("dst"),
        }

    def body(self) -> tuple[np.ndarray, ...]:
        """Where the DNS message begins, its bytes there and on the wire, and the first reason to drop the frame ("" for none)."""
        tcp, udp = self.proto == TCP, self.proto == UDP
        icmp = np.isin(self.proto, (ICMP, ICMP6))
        skip = np.where(tcp, (self.byte(self.segment + 12) >> 4) * 4, 8)
        start, there, wire = self.segment + skip, np.maximum(self.length - skip, 0), self.wire - skip
        flags = self.byte(self.segment + 13) & 3
        reason = np.select(
            [
                self.version == 0, self.fragment, tcp & (self.length < 20), tcp & (flags > 0), tcp & ((wire < 2) | (there < 2)),
                tcp & (self.word(start) + 2 != wire), udp & (self.length < 8), ~(tcp | udp | icmp),
            ],
            ["network", "fragmented", "network", "transport", "network", "transport", "network", "transport"], "",
        )
        return start, there, wire, reason


def address_text(upper: np.ndarray, lower: np.ndarray, version: np.ndarray) -> pa.Array:
    """Text of addresses, each different one made once."""
    keys = np.empty((len(version), 17), dtype=np.uint8)
    keys[:, 0] = version
    keys[:, 1:9], keys[:, 9:] = (x.astype(">u8").view(np.uint8).reshape(-1, 8) for x in (upper, lower))
    coded = pa.FixedSizeBinaryArray.from_buffers(pa.binary(17), len(keys), [None, pa.py_buffer(keys)]).dictionary_encode()
    texts = [None if not k[0] else ipaddress.ip_address(k[13:] if k[0] == 4 else k[1:]).compressed for k in coded.dictionary.to_pylist()]
    return pa.array(texts, pa.string()).take(coded.indices)


def _slices(data: bytes, start: np.ndarray, size: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    ends = start + size
    if valid is None:
        return pa.array([data[a:b] for a, b in zip(start.tolist(), ends.tolist())], pa.binary())
    return pa.array([data[a:b] if ok else None for a, b, ok in zip(start.tolist(), ends.tolist(), valid.tolist())], pa.binary())


def _batch(data: bytes, found: list[tuple], link: int, snaplen: int, tree: tuple, pushed: list, number: int = 0) -> pa.RecordBatch:
    """Rows of the frames ``found`` (place in the file, ts_us, length on the wire, first byte, captured length) that pass the filters."""
    seq, ts, whole, at, size = np.array(found, dtype=np.int64).T.copy()
    seq |= number << 40
    size = np.minimum(size, snaplen) if snaplen > 0 else size
    octets = np.frombuffer(data, dtype=np.uint8)
    net_len = whole - (14 if link == ETHERNET else 0)
    frames = Frames(octets, at, size, net_len, link)
    keep = array_filter(tree, frames.fields()) if tree[0] != "all" else None
    if pushed:
        there = {"seq": seq, "ts_us": ts, "net_len": net_len, "net_ipv": frames.version, "net_proto": frames.proto, "src_port": frames.src_port, "dst_port": frames.dst_port}
        none = {"net_ipv": frames.version == 0, "net_proto": frames.version == 0, "src_port": frames.src_port < 0, "dst_port": frames.dst_port < 0}
        for test in pushed:
            passed = compare(test, there) & ~none.get(test.attribute[0], np.zeros(len(seq), dtype=bool))
            keep = passed if keep is None else keep & passed
    if keep is not None and not keep.all():
        seq, ts, at, size, net_len = seq[keep], ts[keep], at[keep], size[keep], net_len[keep]
        frames = Frames(octets, at, size, net_len, link)
    start, there, wire, reason = frames.body()
    good, is_ip = reason == "", frames.version > 0
    number = lambda values, valid=None: pa.array(values.astype(np.int32), pa.int32(), mask=None if valid is None else ~valid)
    sums = np.where((frames.proto == UDP) & ~frames.fragment & (frames.length >= 8), frames.word(frames.segment + 6), 0)
    columns = {
        "seq": pa.array(seq), "ts_us": pa.array(ts),
        "src_addr": address_text(*frames.addresses("src"), frames.version), "src_port": number(frames.src_port, frames.src_port >= 0),
        "dst_addr": address_text(*frames.addresses("dst"), frames.version), "dst_port": number(frames.dst_port, frames.dst_port >= 0),
        "net_ipv": number(frames.version, is_ip), "net_proto": number(frames.proto, is_ip), "net_len": number(net_len), "net_ttl": number(frames.ttl, is_ip),
        "udp_sum": number(sums), "dns_len": number(wire, good), "payload": _slices(data, start, there, good),
        "drop_reason": pa.array(reason.tolist(), pa.string(), mask=good), "raw": _slices(data, at, size),
    }
    return pa.RecordBatch.from_arrays([columns[n] for n in SCHEMA.names], schema=SCHEMA)


#: Columns whose comparisons with values the reader can do before frames are taken apart.
COMPARED = ("seq", "ts_us", "net_len", "net_ipv", "net_proto", "src_port", "dst_port")


def compare(test, arrays: dict) -> np.ndarray:
    values = arrays[test.attribute[0]]
    if isinstance(test, IsNotNull):
        return np.ones(len(values), dtype=bool)
    if isinstance(test, In):
        return np.isin(values, [v for v in test.value if v is not None])
    does = {EqualTo: np.equal, GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal}
    return does[type(test)](values, test.value)


# ------------------------------------------------------------ files to frames


def open_capture(path: str):
    with open(path, "rb") as file:
        head = file.read(6)
    return _opener(head)(path, "rb")


def _opener(head: bytes):
    return gzip.open if head[:2] == b"\x1f\x8b" else bz2.open if head[:3] == b"BZh" else lzma.open if head == b"\xfd7zXZ\0" else open


def is_plain(path: str) -> bool:
    with open(path, "rb") as file:
        return _opener(file.read(6)) is open


def file_header(head: bytes, path: str) -> tuple[str, int, int, int]:
    """Byte order, fractions of a microsecond, link type and largest captured length of a file."""
    if len(head) < HEADER or head[:4] not in MAGIC:
        raise ValueError(f"{path} is not a capture file")
    order, per_us = MAGIC[head[:4]]
    most, link = struct.unpack(order + "II", head[16:24])
    return order, per_us, link & 0xFFFF, most


def blocks(path: str, start: int = HEADER, stop: int | None = None):
    """(link, bytes, frames) of the records that begin in [start, stop); a cut last record is left out.

    ``frames`` are (place in the file, ts_us, length on the wire, first byte in ``bytes``, captured length).
    """
    with open_capture(path) as file:
        order, per_us, link, _ = file_header(file.read(HEADER), path)
        file.seek(start)
        head, rest, base = struct.Struct(order + "IIII"), b"", start
        # Not much is read beyond ``stop``.
        while more := file.read(BLOCK if stop is None else min(BLOCK, max(stop - base - len(rest), 1 << 16))):
            data, p, found = rest + more, 0, []
            while p + 16 <= len(data) and (stop is None or base + p < stop):
                sec, part, kept, whole = head.unpack_from(data, p)
                if p + 16 + kept > len(data):
                    break
                found.append((base + p, sec * 1_000_000 + part // per_us, whole, p + 16, kept))
                p += 16 + kept
            if found:
                yield link, data, found
            rest, base = data[p:], base + p
            if stop is not None and base >= stop:
                return


def list_files(path: str) -> list[str]:
    """Capture files in the given order; a folder gives its files by name."""
    out = []
    for p in filter(None, (x.strip() for x in path.split(","))):
        p = p.removeprefix("file://")
        out += sorted(os.path.join(p, f) for f in os.listdir(p) if not f.startswith((".", "_"))) if os.path.isdir(p) else [p]
    return out


def usable(files: list[str]) -> list[str]:
    """The files up to the first that can't be opened as a capture; the first of all has to be one."""
    for k, path in enumerate(files):
        try:
            with open_capture(path) as file:
                file_header(file.read(HEADER), path)
        except (OSError, EOFError, ValueError, lzma.LZMAError) as fault:
            if not k:
                raise
            warnings.warn(f"{path} and the files after it aren't read: {fault}", stacklevel=2)
            return files[:k]
    return files


# --------------------------------------------------- parts of a large file


def guess(data: bytes, order: str, per_us: int, most: int, first_sec: int, at_end: bool) -> int | None:
    """The first place in ``data`` from which headers follow each other plausibly; ``at_end``: the file ends with the data."""
    n = len(data) - 16
    if n < 0:
        return None
    octets = np.frombuffer(data, dtype=np.uint8)
    value = [octets[k : k + n + 1].astype(np.int64) for k in range(16)]

    def number(k):
        a, b, c, d = value[k : k + 4] if order == ">" else value[k : k + 4][::-1]
        return a << 24 | b << 16 | c << 8 | d

    sec, part, kept, whole = (number(k) for k in (0, 4, 8, 12))
    fits = (part < 1_000_000 * per_us) & (kept <= most) & (kept <= whole) & (np.abs(sec - first_sec) < 40 * 365 * 86400)
    follows = np.arange(n + 1) + 16 + kept
    for p in np.flatnonzero(fits).tolist():
        q, chain = p, 0
        while chain < CHAIN and q <= n and fits[q]:
            q, chain = int(follows[q]), chain + 1
        if chain == CHAIN or chain and (q > n and not at_end or at_end and q == len(data)):
            return p
    return None


def walk(path: str, start: int | None, low: int, high: int) -> tuple[int | None, int | None]:
    """The first record of a part and the first behind it (the file's size if there is none). Without ``start`` the first is guessed."""
    size = os.path.getsize(path)
    with open(path, "rb") as file:
        order, per_us, _, most = file_header(file.read(HEADER), path)
        sec = struct.unpack(order + "I", file.read(4))[0]
        most = max(most, 65535)
        if start is None:
            file.seek(low)
            data = file.read(min(high - low, most + 16) + 16 * CHAIN + 4096)
            found = guess(data, order, per_us, most, sec, low + len(data) == size)
            if found is None or low + found >= high:
                return None, None
            start = low + found
        head, at = struct.Struct(order + "IIII"), start
        while at < high:
            file.seek(at)
            data, p = file.read(BLOCK), 0
            while p + 16 <= len(data) and at + p < high:
                p += 16 + head.unpack_from(data, p)[2]
            if not p:
                return start, size
            at += p
    return start, min(at, size)


def spans(spark: SparkSession, files: list[str], split_bytes: int = SPLIT) -> dict[int, list[int]]:
    """For each large plain file (by number), the places where its parts begin.

    The files are walked once, by as many tasks as there are parts; what the driver holds is a list of parts.
    """
    parts = {}
    for k, path in enumerate(files):
        size = os.path.getsize(path)
        if size > split_bytes and is_plain(path):
            parts[k] = [(a, min(a + split_bytes, size)) for a in range(0, size, split_bytes)]
    known: dict[tuple[int, int], tuple] = {}
    asked = [(k, files[k], None if a else HEADER, a, b) for k, ranges in parts.items() for a, b in ranges]

    def run(batches):
        for batch in batches:
            rows = [(r["file"], r["low"], *walk(r["path"], r["start"], r["low"], r["high"])) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["file", "low", "first", "after"])

    while asked:
        todo = spark.createDataFrame(asked, "file long, path string, start long, low long, high long")
        done = todo.repartition(len(asked), "file", "low").mapInArrow(run, "file long, low long, first long, after long")
        known |= {(r["file"], r["low"]): (r["first"], r["after"]) for r in done.collect()}
        asked, begins = [], {}
        for k, ranges in parts.items():
            at, begins[k] = HEADER, []
            for low, high in ranges:
                if at >= high:
                    continue
                first, after = known[k, low]
                if first != at:
                    asked.append((k, files[k], at, low, high))
                    if after is None:
                        break
                begins[k].append(at)
                at = after
    return begins if parts else {}


# ------------------------------------------------------------ the data source


class CapturePartition(InputPartition):
    def __init__(self, number: int, path: str, start: int = HEADER, stop: int | None = None):
        self.number, self.path, self.start, self.stop = number, path, start, stop


def rows_of(partition: CapturePartition, snaplen: int, tree: tuple, pushed: list):
    for link, data, found in blocks(partition.path, partition.start, partition.stop):
        yield _batch(data, found, link, snaplen, tree, pushed, partition.number)


class CaptureReader(DataSourceReader):
    def __init__(self, options):
        self.files = list_files(options["path"])
        self.snaplen = int(options.get("snaplen", -1))
        self.tree = parse(options.get("filter", ""))
        self.spans = {int(k): v for k, v in json.loads(options.get("spans", "{}")).items()}
        self.pushed: list = []

    def partitions(self):
        out = []
        for k, path in enumerate(usable(self.files)):
            begins = self.spans.get(k) or [HEADER]
            out += [CapturePartition(k, path, a, b) for a, b in zip(begins, [*begins[1:], None])]
        return out

    def read(self, partition):
        yield from rows_of(partition, self.snaplen, self.tree, self.pushed)


class PushingReader(CaptureReader):
    """The reader where the session lets filters be pushed to Python sources."""

    def pushFilters(self, filters):
        known = (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, IsNotNull)
        for f in filters:
            if isinstance(f, known) and f.attribute[0] in COMPARED:
                self.pushed.append(f)
            else:
                yield f


class CaptureStream(DataSourceStreamReader):
    """Capture files of a folder that grows, in the order of their names.

    An offset is a file's name and a place in it: all files before it are read
    whole, and of it all that lies before the place. A plain file that still
    grows gives the records that are complete; a compressed one is taken when
    it is finished, that is when a file with a later name is there or when it
    hasn't changed for ``settle`` seconds (default 10). What isn't a capture file
    is left out. Files are numbered by
    their place among the folder's names, so those that were read have to stay.
    """

    def __init__(self, options):
        self.folder = options["path"].removeprefix("file://")
        self.snaplen, self.settle = int(options.get("snaplen", -1)), float(options.get("settle", 10))
        self.tree = parse(options.get("filter", ""))
        #: The last name and place found, from which a growing file is walked on.
        self.last = ("", HEADER)

    def initialOffset(self):
        return {"name": "", "at": HEADER}

    def latestOffset(self):
        import time

        names = [os.path.basename(p) for p in list_files(self.folder)]
        for name in reversed(names):
            path = os.path.join(self.folder, name)
            finished = name != names[-1] or time.time() - os.path.getmtime(path) >= self.settle
            try:
                if is_plain(path):
                    at = self.last[1] if self.last[0] == name else HEADER
                    if os.path.getsize(path) < HEADER:
                        continue
                    self.last = (name, complete(path, at))
                    return {"name": name, "at": self.last[1]}
            except (OSError, ValueError):
                continue
            if finished:
                return {"name": name, "at": -1}
        return self.initialOffset()

    def partitions(self, start, end):
        out = []
        for k, path in enumerate(list_files(self.folder)):
            name = os.path.basename(path)
            if not start["name"] <= name <= end["name"] or name == start["name"] and start["at"] < 0:
                continue
            low = start["at"] if name == start["name"] else HEADER
            high = end["at"] if name == end["name"] and end["at"] >= 0 else None
            if (high is None or low < high) and usable_alone(path):
                out.append(CapturePartition(k, path, low, high))
        return out

    def read(self, partition):
        yield from rows_of(partition, self.snaplen, self.tree, [])


def usable_alone(path: str) -> bool:
    try:
        return usable([path]) == [path]
    except (OSError, EOFError, ValueError, lzma.LZMAError):
        return False


def complete(path: str, at: int) -> int:
    """The place behind the last complete record, from the beginning of one."""
    size = os.path.getsize(path)
    with open(path, "rb") as file:
        order, *_ = file_header(file.read(HEADER), path)
        head = struct.Struct(order + "IIII")
        while at + 16 <= size:
            file.seek(at)
            data, p = file.read(BLOCK), 0
            while p + 16 <= len(data) and at + p + 16 + (kept := head.unpack_from(data, p)[2]) <= size:
                p += 16 + kept
            if not p:
                break
            at += p
    return at


class CaptureWriter(DataSourceWriter):
    """One capture file of raw IP packets for each partition, named on commit."""

    def __init__(self, options):
        self.path = options["path"].removeprefix("file://")
        self.compression, self.level = options.get("compression", "none"), int(options.get("level", 4))
        os.makedirs(self.path, exist_ok=True)

    def write(self, iterator):
        task = TaskContext.get()
        suffix = {"none": "", "gzip": ".gz", "bz2": ".bz2", "xz": ".xz"}[self.compression]
        name = f"part-{task.partitionId():05d}.pcap{suffix}"
        temporary = os.path.join(self.path, f"_{name}.{task.taskAttemptId()}")
        opener = {
            "none": lambda: open(temporary, "wb"), "gzip": lambda: gzip.open(temporary, "wb", self.level),
            "bz2": lambda: bz2.open(temporary, "wb", compresslevel=max(1, self.level)), "xz": lambda: lzma.open(temporary, "wb", preset=self.level),
        }[self.compression]
        n = 0
        with opener() as file:
            file.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 262144, RAW))
            for row in iterator:
                file.write(struct.pack("<IIII", *divmod(row["ts_us"], 1_000_000), len(row["raw"]), max(row["net_len"], len(row["raw"]))) + bytes(row["raw"]))
                n += 1
        return CaptureWritten(temporary if n else None, os.path.join(self.path, name))

    def commit(self, messages):
        for m in messages:
            if m and m.temporary:
                os.replace(m.temporary, m.final)

    def abort(self, messages):
        for m in messages:
            if m and m.temporary:
                os.unlink(m.temporary)


class CaptureWritten(WriterCommitMessage):
    def __init__(self, temporary, final):
        self.temporary, self.final = temporary, final


class CaptureSource(DataSource):
    @classmethod
    def name(cls):
        return "pcap"

    def schema(self):
        return FRAMES

    def reader(self, schema):
        return (PushingReader if self.options.get("push", "false") == "true" else CaptureReader)(self.options)

    def streamReader(self, schema):
        return CaptureStream(self.options)

    def writer(self, schema, overwrite):
        return CaptureWriter(self.options)


#: Spark's setting without which a Python source must not take filters.
PUSHES = "spark.sql.python.filterPushdown.enabled"


def read(spark: SparkSession, path: str, snaplen: int = -1, filter: str = "", split_bytes: int = SPLIT) -> DataFrame:
    """Frames of capture files; large plain files are read in parts of about ``split_bytes``."""
    spark.dataSource.register(CaptureSource)
    begins = spans(spark, usable(list_files(path)), split_bytes)
    push = spark.conf.get(PUSHES, "false")
    options = {"snaplen": snaplen, "filter": filter, "spans": json.dumps(begins), "push": push}
    return spark.read.format("pcap").options(**options).load(path)


def read_stream(spark: SparkSession, path: str, snaplen: int = -1, filter: str = "", settle: float = 10) -> DataFrame:
    """Frames of a folder's capture files as a stream; see ``CaptureStream``."""
    spark.dataSource.register(CaptureSource)
    return spark.readStream.format("pcap").options(snaplen=snaplen, filter=filter, settle=settle).load(path)


def write(frames: DataFrame, path: str, compression: str = "none", level: int = 4) -> None:
    """Write (ts_us, net_len, raw) rows; nothing is written where there are no rows."""
    frames.sparkSession.dataSource.register(CaptureSource)
    frames.select("ts_us", "net_len", "raw").write.format("pcap").option("compression", compression).option("level", level).mode("append").save(path)
