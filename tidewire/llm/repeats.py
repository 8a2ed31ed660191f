"""Repeated byte strings across and within documents.

A string of ``WIDTH`` bytes that starts at two places or more is a repeat. Each
place where such a string may start belongs to an anchor: the least-hashed
``GRAM``-byte string inside it (a minimizer). Equal strings have equal anchors
at equal offsets, so only anchors that occur more than once are compared: a
sparse generalised suffix array. The places of one anchor lie next to each
other in their text; the text around them is the anchor's *content*. Contents
that occur more than once are repeats as a whole. The distinct contents of one
anchor are sorted by what follows the anchor, the common prefixes of neighbours
are scanned with a stack (lcp-intervals), and within each interval what
precedes the anchor is sorted and scanned likewise. An interval whose members'
left extensions differ and whose right extensions differ is a maximal repeat;
it is given out with all of its members.

Copies never meet in one task: equal contents are counted by partial
aggregates. An anchor with more than ``HOT`` distinct contents is resolved by
hashes of its single strings, aggregated the same way, with the same result.
Its groups come from hashes too: a string is a maximal repeat if the bytes
before all its occurrences differ, and those behind them (an end differs from
everything). What precedes and what follows the anchor are first tested alone;
only ends that pass on both sides are combined.

Null text is an empty one. Texts shorter than ``WIDTH`` have no repeats.
Repeated rows are copies of each other. An empty table gives no row. Columns of
the table named like a result are replaced.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import shared_folder
from .common import BASE, BYTE_VALUE, INVERSE, extended, materialize, mix, powers, quoted, width

WIDTH, GRAM = 200, 32
#: Distinct contents of an anchor that one task sorts: some 40 MB.
HOT = 50_000
#: Places of a text that are looked at together.
BLOCK = 500_000

ROWS = "rid long, anchor long, content long, lo long, at long, hi long"
FOUND = "anchor long, content long, grp int, left long, right long"
RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


class Hashes:
    """Prefix sums of a block of bytes, for hashes of its substrings."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(BYTE_VALUE[data] * _up(n), out=self.total[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.total[ends] - self.total[starts]) * _down(len(self.total))[starts])


_POWERS: dict[int, np.ndarray] = {}


def _cached(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        _POWERS[base] = powers(base, max(n, 65_536))
    return _POWERS[base][:n]


def _up(n: int) -> np.ndarray:
    return _cached(BASE, n)


def _down(n: int) -> np.ndarray:
    return _cached(INVERSE, n)


def anchors(text: bytes, wide: int = WIDTH, gram: int = GRAM):
    """Arrays anchor, content, lo, at, hi: the places lo..hi belong to the anchor at ``at``."""
    data = np.frombuffer(text, dtype=np.uint8)
    parts = []
    with np.errstate(over="ignore"):
        for begin in range(0, len(data) - wide + 1, BLOCK):
            block = data[begin : begin + BLOCK + wide - 1]
            n, w = len(block), wide - gram + 1
            hashes = Hashes(block)
            i = np.arange(n - gram + 1)
            h = hashes.of(i, i + gram)
            # Order by hash, then by place: the leftmost of equal strings wins.
            key = (h & ~np.uint64(0xFFFFF)) | i.astype(np.uint64)
            rows = -(-len(key) // w)
            grid = np.full(rows * w, np.uint64(2**64 - 1))
            grid[: len(key)] = key
            grid = grid.reshape(rows, w)
            before = np.minimum.accumulate(grid, axis=1).ravel()
            after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
            places = n - wide + 1
            at = (np.minimum(after[:places], before[w - 1 : w - 1 + places]) & np.uint64(0xFFFFF)).astype(np.int64)
            lo = np.flatnonzero(np.diff(at, prepend=-1))
            hi = np.append(lo[1:], places) - 1
            at = at[lo]
            parts.append((h[at].view(np.int64), hashes.of(lo, hi + wide).view(np.int64), lo + begin, at + begin, hi + begin))
    if not parts:
        return [np.zeros(0, dtype=np.int64)] * 5
    return [np.concatenate(c) for c in zip(*parts)]


def _anchor_rows(wide: int, gram: int):
    names = [c.split()[0] for c in ROWS.split(", ")]

    def table(rows):
        columns = [np.concatenate(c) for c in zip(*rows)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for rid, text in zip(batch.column("__rid").to_pylist(), batch.column("__bytes")):
                text = text.as_py()
                if len(text) < wide:
                    continue
                found = anchors(text, wide, gram)
                rows.append((np.full(len(found[0]), rid), *found))
                size += len(found[0])
                if size > 50_000:
                    yield table(rows)
                    rows, size = [], 0
        if rows:
            yield table(rows)

    return run


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def intervals(lcp: list[int]):
    """(length, first, last) of the lcp-intervals of a sorted list; lcp[i] is that of items i and i + 1."""
    stack: list[tuple[int, int]] = []
    for i, length in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][0] > length:
            top, first = stack.pop()
            yield top, first, i
        if length >= 0 and (not stack or stack[-1][0] < length):
            stack.append((length, first))


def maximal_repeats(texts: list[bytes], at: list[int], wide: int = WIDTH):
    """(left, right, members): maximal repeats around the anchors of distinct texts.

    The members share the ``left`` bytes before and the ``right`` bytes from
    their anchors on, left + right >= wide, and no more on either side.
    """
    after = [t[a:] for t, a in zip(texts, at)]
    ahead = [t[:a][::-1] for t, a in zip(texts, at)]
    order = sorted(range(len(texts)), key=after.__getitem__)
    rank = {m: k for k, m in enumerate(order)}
    lcp = [common(after[a], after[b]) for a, b in zip(order, order[1:])]
    for right, i, j in intervals(lcp):
        left_most = max(len(ahead[order[k]]) for k in range(i, j + 1))
        if left_most + right < wide:
            continue
        inner = sorted(order[i : j + 1], key=ahead.__getitem__)
        lefts = [common(ahead[a], ahead[b]) for a, b in zip(inner, inner[1:])]
        for left, a, b in intervals(lefts):
            if left + right < wide:
                continue
            members = inner[a : b + 1]
            ranks = sorted(rank[m] for m in members)
            # If all members have more in common to the right, a deeper interval gives them out.
            if min(lcp[ranks[0] : ranks[-1]]) == right:
                yield left, right, members


def _contents(wide: int):
    """Cut the wanted contents out of their texts."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches):
        for batch in batches:
            out = []
            for text, wanted in zip(batch.column("__bytes"), batch.column("wanted")):
                text = text.as_py()
                out.extend((w["anchor"], w["content"], w["m"], w["at"] - w["lo"], text[w["lo"] : w["hi"] + wide]) for w in wanted.as_py())
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["anchor", "content", "m", "offset", "bytes"])
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["anchor", "content", "m", "offset", "bytes"])

    return run


def _compare(wide: int, reach: bool):
    """Members of the maximal repeats of each anchor; with ``reach``, only how far those of each content reach together."""

    def run(batches):
        now, keys, texts, offsets, out = None, [], [], [], []

        def close():
            found = maximal_repeats(texts, offsets, wide)
            if not reach:
                for g, (left, right, members) in enumerate(found):
                    out.extend((now, keys[m], g, left, right) for m in members)
                return
            far: dict[int, tuple[int, int]] = {}
            for left, right, members in found:
                for m in members:
                    a, b = far.get(m, (0, 0))
                    far[m] = (max(a, left), max(b, right))
            out.extend((now, keys[m], 0, left, right) for m, (left, right) in far.items())

        def table():
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            columns = list(zip(*out)) or [()] * 5
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in FOUND.split(", ")])

        for batch in batches:
            for anchor, content, offset, text in zip(*(batch.column(c).to_pylist() for c in ("anchor", "content", "offset", "bytes"))):
                if anchor != now:
                    if len(keys) > 1:
                        close()
                    now, keys, texts, offsets = anchor, [], [], []
                    if len(out) > 20_000:
                        yield table()
                keys.append(content)
                texts.append(text)
                offsets.append(offset)
        if len(keys) > 1:
            close()
        yield table()

    return run


def _strings(wide: int):
    """One row for each string of a hot anchor's contents, with 128 bits of hash."""

    def run(batches):
        for batch in batches:
            for anchor, content, offset, text in zip(*(batch.column(c).to_pylist() for c in ("anchor", "content", "offset", "bytes"))):
                data = np.frombuffer(text, dtype=np.uint8)
                n = len(data) - wide + 1
                i = np.arange(n)
                with np.errstate(over="ignore"):
                    one = Hashes(data).of(i, i + wide).view(np.int64)
                    two = Hashes(data[::-1]).of((len(data) - wide - i), (len(data) - i)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one), pa.array(two), pa.array(np.full(n, anchor)), pa.array(np.full(n, content)), pa.array(offset - i), pa.array(wide - offset + i)],
                    ["one", "two", "anchor", "content", "left", "right"],
                )

    return run


def _two(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of hash of each data[start:end], from both directions."""
    n = len(data)
    with np.errstate(over="ignore"):
        return Hashes(data).of(starts, ends).view(np.int64), Hashes(data[::-1]).of(n - ends, n - starts).view(np.int64)


def _beside(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The byte at each place; -1 outside."""
    return np.where((places >= 0) & (places < len(data)), data[np.clip(places, 0, len(data) - 1)].astype(np.int64), -1)


ENDS = "anchor long, content long, side int, size long, one long, two long, beside long"
PAIRS = "anchor long, content long, left long, right long, one long, two long, before long, behind long"


def _ends(wide: int):
    """For each content, what lies before (side 0) and after (side 1) its anchor, cut at every place where a repeat may end."""

    def run(batches):
        for batch in batches:
            for anchor, content, offset, text in zip(*(batch.column(c).to_pylist() for c in ("anchor", "content", "offset", "bytes"))):
                data = np.frombuffer(text, dtype=np.uint8)
                k = np.arange(len(data) - wide + 1)
                start = np.concatenate([k, np.full(len(k), offset)])
                past = np.concatenate([np.full(len(k), offset), k + wide])
                one, two = _two(data, start, past)
                near = np.concatenate([_beside(data, k - 1), _beside(data, k + wide)])
                n = len(start)
                columns = [np.full(n, anchor), np.full(n, content), np.repeat(np.array([0, 1], dtype=np.int32), len(k)), past - start, one, two, near]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in ENDS.split(", ")])

    return run


def _spans(wide: int):
    """Strings around the anchor from any of the ``lefts`` to any of the ``rights``."""

    def run(batches):
        for batch in batches:
            for anchor, content, offset, text, lefts, rights in zip(*(batch.column(c).to_pylist() for c in ("anchor", "content", "offset", "bytes", "lefts", "rights"))):
                data = np.frombuffer(text, dtype=np.uint8)
                left, right = (x.ravel() for x in np.meshgrid(np.array(lefts, dtype=np.int64), np.array(rights, dtype=np.int64)))
                left, right = left[left + right >= wide], right[left + right >= wide]
                one, two = _two(data, offset - left, offset + right)
                columns = [np.full(len(left), anchor), np.full(len(left), content), left, right, one, two, _beside(data, offset - left - 1), _beside(data, offset + right)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in PAIRS.split(", ")])

    return run


def _differ(column: str):
    """Whether a group can't be extended by the bytes of ``column``."""
    return (F.min(column) < 0) | (F.min(column) < F.max(column))


def hot_members(contents: DataFrame, wide: int) -> DataFrame:
    """(anchor, content, grp, left, right) of all maximal repeats, like ``_compare``, by partial aggregates alone."""
    ends = materialize(contents.mapInArrow(_ends(wide), ENDS), "ends")
    names = ["anchor", "side", "size", "one", "two"]
    branching = ends.groupBy(*names).agg(F.count("*").alias("c"), _differ("beside").alias("d")).filter("c > 1 and d").select(*names)
    sides = ends.join(branching, names).groupBy("anchor", "content").agg(
        F.collect_list(F.when(F.col("side") == 0, F.col("size"))).alias("lefts"), F.collect_list(F.when(F.col("side") == 1, F.col("size"))).alias("rights")
    )
    spans = materialize(contents.join(sides, ["anchor", "content"]).mapInArrow(_spans(wide), PAIRS), "spans")
    names = ["anchor", "left", "right", "one", "two"]
    maximal = spans.groupBy(*names).agg(F.count("*").alias("c"), (_differ("before") & _differ("behind")).alias("d")).filter("c > 1 and d").select(*names)
    grp = F.xxhash64("left", "right", "one", "two").bitwiseAND(F.lit(2**63 - 1))
    return spans.join(maximal, names).select("anchor", "content", grp.alias("grp"), "left", "right")


class Repeats:
    """The stages' tables. ``texts`` is bucketed by row, so that it moves once and joins in place after."""

    def __init__(self, docs: DataFrame, text_col: str = "text", wide: int = WIDTH, gram: int = GRAM, hot: int = HOT):
        spark = docs.sparkSession
        n, self.wide, self.gram, self.hot = width(spark), wide, gram, hot
        numbered = docs.withColumn("__rid", F.monotonically_increasing_id())
        name, path = f"repeats_{uuid.uuid4().hex}", shared_folder(spark, "repeats")
        numbered.repartition(n, "__rid").write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, "__rid").saveAsTable(name)
        self.texts = spark.table(name).withColumn("__bytes", F.encode(F.coalesce(text_col, F.lit("")), "UTF-8"))

        rows = self.texts.select("__rid", "__bytes").mapInArrow(_anchor_rows(wide, gram), ROWS)
        often = rows.groupBy("anchor").agg(F.count("*").alias("c"), F.min("content").alias("x"), F.max("content").alias("y")).filter("c > 1")
        # Written first, so that the join's sides are plain exchanges and skewed anchors can be split.
        often = materialize(often.select("anchor", (F.col("x") != F.col("y")).alias("several")), "anchors")
        #: Places of repeated anchors; ``several``: the anchor has more than one content.
        self.places = materialize(rows.join(often, "anchor"), "places")

        place = F.struct("rid", "lo", "at", "hi")
        kinds = self.places.filter("several").groupBy("anchor", "content").agg(F.count("*").alias("n"), F.min(place).alias("p"))
        kinds = materialize(kinds.select("anchor", "content", "n", "p.*"), "contents")
        many = kinds.groupBy("anchor").agg(F.count("*").alias("m"))
        wanted = kinds.join(many, "anchor").groupBy("rid").agg(F.collect_list(F.struct("anchor", "content", "m", "lo", "at", "hi")).alias("wanted"))
        cut = self.texts.select("__rid", "__bytes").join(wanted, F.col("__rid") == F.col("rid")).select("__bytes", "wanted")
        cut = materialize(cut.mapInArrow(_contents(wide), "anchor long, content long, m long, offset long, bytes binary"), "bytes")

        cold = cut.filter(F.col("m") <= hot).repartition(n, "anchor").sortWithinPartitions("anchor")
        self.cold = cold.select("anchor", "content", "offset", "bytes")
        cold_found = self.cold.mapInArrow(_compare(wide, reach=True), FOUND).select("anchor", "content", "left", "right")
        self.warm = cut.filter(F.col("m") > hot).select("anchor", "content", "offset", "bytes")
        strings = self.warm.mapInArrow(_strings(wide), "one long, two long, anchor long, content long, left long, right long")
        twice = strings.groupBy("one", "two").agg(F.count("*").alias("c")).filter("c > 1").select("one", "two")
        hot_found = strings.join(twice, ["one", "two"]).select("anchor", "content", "left", "right")
        whole = kinds.filter("n > 1").select("anchor", "content", (F.col("at") - F.col("lo")).alias("left"), (F.col("hi") + wide - F.col("at")).alias("right"))
        found = cold_found.union(hot_found).union(whole)
        # All found around one anchor overlap there, so their union is one range.
        reach = materialize(found.groupBy("anchor", "content").agg(F.max("left").alias("left"), F.max("right").alias("right")), "reach")
        several = self.places.filter("several").join(reach, ["anchor", "content"])
        #: (rid, first, past): byte ranges to remove; they overlap.
        self.ranges = self.places.filter("not several").select("rid", F.col("lo").alias("first"), (F.col("hi") + wide).alias("past")).union(
            several.select("rid", (F.col("at") - F.col("left")).alias("first"), (F.col("at") + F.col("right")).alias("past"))
        )

    def groups(self) -> DataFrame:
        """(anchor, grp, n_bytes, rid, start): maximal repeat groups with all their occurrences.

        Contents that repeat as a whole are groups with grp -1. The groups of hot
        anchors are numbered by hash.
        """
        whole = self.places.groupBy("anchor", "content").agg(F.count("*").alias("c")).filter("c > 1").select("anchor", "content")
        whole = self.places.join(whole, ["anchor", "content"]).select("anchor", F.lit(-1).alias("grp"), (F.col("hi") + self.wide - F.col("lo")).alias("n_bytes"), "rid", F.col("lo").alias("start"))
        found = self.cold.mapInArrow(_compare(self.wide, reach=False), FOUND)
        if not self.warm.isEmpty():
            found = found.union(hot_members(self.warm, self.wide))
        part = self.places.join(found, ["anchor", "content"])
        return whole.union(part.select("anchor", "grp", F.col("left") + F.col("right"), "rid", F.col("at") - F.col("left")))

    def removed(self, text_to: str | None = None) -> DataFrame:
        """The rows of ``docs`` with n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes left).

        With ``text_to``, that column gets the bytes left as text instead, without characters that were cut.
        """
        spans = self.ranges.groupBy(F.col("rid").alias("__other")).agg(F.collect_list(F.struct("first", "past")).alias("__spans"))
        joined = self.texts.join(spans, F.col("__rid") == F.col("__other"), "left").drop("__other", "__rid")
        names = [c.split()[0] for c in RESULT.split(", ")]
        result = RESULT.replace("kept binary", f"`{text_to}` string") if text_to else RESULT
        own = [n for n in joined.columns if n not in (*names[:4], text_to or names[4], "__spans", "__bytes")]
        return joined.select(*quoted(own), "__bytes", "__spans").mapInArrow(_remove(text_to), extended(joined, own, result))


def _cut(text: bytes, spans) -> tuple[bytes, int]:
    """The bytes outside the spans, and the number of maximal runs inside them."""
    if spans is None or not len(spans):
        return text, 0
    mark = np.zeros(len(text) + 1, dtype=np.int64)
    np.add.at(mark, spans.field("first").to_numpy(), 1)
    np.add.at(mark, spans.field("past").to_numpy(), -1)
    gone = np.cumsum(mark[:-1]) > 0
    runs = int(gone[0]) + int(np.count_nonzero(np.diff(gone.astype(np.int8)) == 1))
    return np.frombuffer(text, dtype=np.uint8)[~gone].tobytes(), runs


def _remove(text_to: str | None):
    names = [c.split()[0] for c in RESULT.split(", ")][:4] + [text_to or "kept"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string() if text_to else pa.binary()]

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                rows = []
                for text, spans in zip(batch.column("__bytes"), batch.column("__spans")):
                    text = text.as_py()
                    kept, runs = _cut(text, spans.values)
                    left = kept.decode("utf-8", "ignore") if text_to else kept
                    rows.append((len(text), len(text) - len(kept), runs, hashlib.sha256(kept).hexdigest(), left))
                own = [c for c in batch.schema.names if c not in ("__bytes", "__spans")]
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in own], *columns], [*own, *names])

    return run


def remove_repeats(docs: DataFrame, text_col: str = "text", wide: int = WIDTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    return Repeats(docs, text_col, wide, gram, hot).removed()
