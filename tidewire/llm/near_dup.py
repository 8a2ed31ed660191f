"""MinHash near-duplicates through a multi-index Hamming join.

A document's set holds its distinct shingles. Documents with equal sets are one
class; classes link if their sets' Jaccard similarity is 0.8 or more. Each class
has a signature of ``SYMBOLS`` b-bit MinHash symbols. The signature is cut into
``CHUNKS`` chunks. By the pigeonhole principle, signatures that differ in at
most 2 * CHUNKS - 1 symbols have a chunk with at most one difference, and such
classes share one of the chunk's keys, each of which leaves one symbol out. So
every pair under that distance is a candidate; a pair of similarity 0.8 goes
beyond it with a probability below 1e-4, and even then mostly shares a key (all
chunks must differ twice: 1.1e-6). Links are confirmed on the full sets.

Each class also has an odd sketch of its full set: as many bits as a few times
its shingles, each the parity of the shingles that fall on it. The number of
bits in which two sketches differ never exceeds the number of shingles that are
in one set alone, so a pair whose sketches differ in too many bits can't reach
the similarity; such pairs are left out before any text moves.

Within the classes of one key, links are sought from star centres first; what
those connect needs no pairs among itself. Keys that still hold several
components compare the sketches across these, in blocks that are dealt out, and
give a spanning forest of the pairs that may link: no more pairs than classes.
What is confirmed joins components, what isn't is not asked again (some more
pairs of the same classes are, instead), and this goes on until no pair that may
link two components is left. So no link that could
join components is lost and no group is expanded into all its pairs.

Sets of fewer than 4 shingles reach 0.8 only when equal, so those classes make
no candidates. Null and empty texts have no set and link with nothing. Repeated
rows link like copies. Rows without doc_id take part; their component is the
least id reachable, null if there is none. An empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, chunks, materialize, mix, span_hashes, width, with_row_id, word_spans
from .components import components

SHINGLE = 2
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Smallest set that can reach PERCENT with a different set.
LEAST_SET = 4
SYMBOLS, BITS, CHUNKS = 32, 16, 8
#: Candidates differ in at most so many symbols; beyond 2 * CHUNKS - 1 not all pairs are sought, but those met are confirmed.
FAR = 20
#: Texts that are confirmed against one copy of a centre; larger stars are dealt out in so many.
STAR = 1000
#: Centres of a key in the first star round.
STARS = 3
#: Rows that a task takes on with ease.
ROWS = 100_000
#: Bits of an odd sketch for each shingle, and of the smallest sketch.
SKETCH, LEAST_BITS = 2, 256
#: Members of a key, and bytes of their sketches, that are compared in one task; larger keys are dealt out.
BLOCK, BLOCK_BYTES = 8_192, 8_000_000

IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_MULTIPLIERS = np.random.default_rng(7).integers(0, 2**64, SYMBOLS, dtype=np.uint64) | np.uint64(1)

CLASSES = "rid long, doc_id long, text_key binary, n_shingles long, set_key binary, signature binary, sketch binary"


def shingle_sets(texts: list[bytes], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    out: list[np.ndarray] = []
    for a, b in chunks(texts):
        out.extend(_sets(texts[a:b], shingle))
    return out


def _sets(texts: list[bytes], shingle: int) -> list[np.ndarray]:
    data = np.frombuffer(b"\n".join(texts).lower() + b"\n", dtype=np.uint8)
    starts, ends = word_spans(data, IS_WORD)
    with np.errstate(over="ignore"):
        words = span_hashes(data, starts, ends)
        bounds = np.cumsum([0, *[len(t) + 1 for t in texts]])
        first = np.searchsorted(starts, bounds)
        sets = []
        for k in range(len(texts)):
            w = words[first[k] : first[k + 1]]
            n = len(w)
            size = min(n, shingle)
            if not n:
                sets.append(w)
                continue
            h = np.full(n - size + 1, np.uint64(size))
            for j in range(size):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w[j : n - size + 1 + j])
            sets.append(np.unique(h))
    return sets


def signature(values: np.ndarray) -> bytes:
    least = np.full(SYMBOLS, np.uint64(2**64 - 1))
    with np.errstate(over="ignore"):
        for i in range(0, len(values), 4096):
            np.minimum(least, (values[None, i : i + 4096] * _MULTIPLIERS[:, None]).min(axis=1), out=least)
        return (mix(least) & np.uint64(2**BITS - 1)).astype("<u2").tobytes()


def sketch(values: np.ndarray) -> bytes:
    """Parities of the values by their lowest bits."""
    bits = LEAST_BITS
    while bits < SKETCH * len(values):
        bits *= 2
    odd = np.bincount((values & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(sketches: np.ndarray, size: int) -> np.ndarray:
    """Rows of sketches (64-bit words) made as short as ``size``, by adding halves."""
    while sketches.shape[1] > size:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def may_link(apart, n_shingles, percent: int):
    """Whether sets of ``n_shingles`` together can link if ``apart`` or more shingles are in one of them alone."""
    return (100 + percent) * apart <= (100 - percent) * n_shingles


def _describe(shingle: int):
    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                sets = shingle_sets(as_bytes(batch.column("text")), shingle)
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                signs, sketches = ([f(s) if len(s) >= LEAST_SET else None for s in sets] for f in (signature, sketch))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("rid"), batch.column("doc_id"), batch.column("text_key"), pa.array([len(s) for s in sets], pa.int64()), *[pa.array(c, pa.binary()) for c in (keys, signs, sketches)]],
                    ["rid", "doc_id", "text_key", "n_shingles", "set_key", "signature", "sketch"],
                )

    return run


def _keys(batches):
    """Class and key for each chunk and each symbol of it left out."""
    per = SYMBOLS // CHUNKS
    for batch in batches:
        if not batch.num_rows:
            continue
        signs = np.frombuffer(b"".join(batch.column("signature").to_pylist()), "<u2").reshape(-1, CHUNKS, per).astype(np.int64)
        nodes = batch.column("node").to_numpy()
        for c in range(CHUNKS):
            for left in range(per):
                key = np.full(len(nodes), c * per + left, dtype=np.int64)
                for j in range(per):
                    if j != left:
                        key = (key << BITS) | signs[:, c, j]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(nodes)], ["key", "node"])


def _distance(a: str, b: str):
    """Number of differing symbols of two binary columns, natively."""
    symbol = lambda c, i: F.substring(F.col(c), 1 + 2 * i, 2)
    total = F.lit(0)
    for i in range(SYMBOLS):
        total = total + (symbol(a, i) != symbol(b, i)).cast("int")
    return total


def _confirm(shingle: int, percent: int):
    """Rows (part, centre, node, is_centre, text), the centre's first: gives the links to the centre."""

    def run(batches):
        now, base = None, None
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                sets = shingle_sets(as_bytes(batch.column("text")), shingle)
                linked = []
                for part, centre, node, s in zip(*(batch.column(c).to_pylist() for c in ("part", "centre", "node")), sets):
                    if node == centre:
                        now, base = (centre, part), s
                        continue
                    if now != (centre, part):
                        raise ValueError(f"the centre {centre} didn't come first")
                    both = len(np.intersect1d(base, s, assume_unique=True))
                    if 100 * both >= percent * (len(base) + len(s) - both):
                        linked.append((node, centre))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in linked], pa.int64()), pa.array([x[1] for x in linked], pa.int64())], ["a", "b"])

    return run


def confirm(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) among candidate pairs (node, centre). A star is dealt out, STAR nodes a part."""
    parts = F.ceil(F.col("n") / STAR).cast("int")
    sizes = pairs.groupBy("centre").agg(F.count("*").alias("n")).select("centre", parts.alias("parts"))
    members = pairs.join(sizes, "centre").select("centre", "node", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"))
    heads = sizes.select("centre", F.col("centre").alias("node"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    rows = texts.join(members.union(heads), "node")
    dealt = rows.repartition(width(pairs.sparkSession), "centre", "part")
    ordered = dealt.select("part", "centre", "node", "text", (F.col("node") != F.col("centre")).alias("later")).sortWithinPartitions("centre", "part", "later")
    return ordered.mapInArrow(_confirm(shingle, percent), "a long, b long")


def _possible(percent: int):
    """Whether the sketches of two classes leave room for a link."""

    def possible(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for first, second, n, m in columns:
            out = []
            for a, b, size in zip(first.to_pylist(), second.to_pylist(), (n.to_numpy() + m.to_numpy()).tolist()):
                a, b = sorted((a, b), key=len)
                x, y, bits = int.from_bytes(a, "little"), int.from_bytes(b, "little"), 8 * len(b)
                while bits > 8 * len(a):
                    bits //= 2
                    y = (y >> bits) ^ (y & ((1 << bits) - 1))
                out.append(may_link((x ^ y).bit_count(), size, percent))
            yield pa.array(out, pa.bool_())

    return possible


def forest(nodes: np.ndarray, labels: np.ndarray, side: np.ndarray | None, n: np.ndarray, sketches: list[bytes], failed: dict[int, list[int]], percent: int, more: int = 0):
    """Pairs (node, node) that may link different components, no more of them than join what they can join.

    With ``side``, only nodes of different sides are compared. ``failed`` has,
    for places in ``nodes``, nodes that are known not to link. ``more`` further
    pairs of each node are given out, the likeliest ones.
    """
    labels = np.unique(labels, return_inverse=True)[1]
    before = labels.copy()
    place = {v: k for k, v in enumerate(nodes.tolist())} if failed else {}
    size = np.array([len(x) for x in sketches])
    groups = {}
    for bytes_ in np.unique(size):
        at = np.flatnonzero(size == bytes_)
        groups[bytes_ // 8] = at, np.frombuffer(b"".join(sketches[k] for k in at), np.uint64).reshape(len(at), -1)
    for words, (at, own) in sorted(groups.items()):
        for other, (to, theirs) in sorted(groups.items()):
            if other < words or percent * other > 200 * words:  # sets that link differ less in size
                continue
            theirs = folded(theirs, words)
            step = max(1, 2_000_000 // theirs.size)
            for begin in range(0, len(at), step):
                some = at[begin : begin + step]
                apart = np.bitwise_count(own[begin : begin + step, None] ^ theirs[None]).sum(axis=2, dtype=np.int64)
                total = n[some, None] + n[None, to]
                good = may_link(apart, total, percent) & (before[some, None] != before[None, to])
                if side is not None:
                    good &= side[some, None] != side[None, to]
                for k, i in enumerate(some.tolist()):
                    for v in failed.get(i, ()):
                        if v in place:
                            good[k] &= to != place[v]
                if more:
                    for k in np.flatnonzero(good.any(axis=1)).tolist():
                        y = np.flatnonzero(good[k])
                        for j in to[y[np.argsort(apart[k, y] / total[k, y], kind="stable")[:more]]]:
                            yield int(nodes[some[k]]), int(nodes[j])
                x, y = np.nonzero(good & (labels[some, None] != labels[None, to]))
                # The likeliest first.
                for k in np.argsort(apart[x, y] / total[x, y], kind="stable").tolist():
                    i, j = some[x[k]], to[y[k]]
                    if labels[i] != labels[j]:
                        labels[labels == labels[j]] = labels[i]
                        yield int(nodes[i]), int(nodes[j])


def _forests(percent: int, more: int):
    """Forests of the groups (key, one, two): the members of blocks ``one`` and ``two`` of a key."""

    def run(batches):
        now, rows = None, []

        def close():
            nodes, labels, block, n, sketches, failed = zip(*rows)
            if len(set(labels)) < 2:
                return None
            side = np.array(block) if now[1] != now[2] else None
            gone = {k: f for k, f in enumerate(failed) if f}
            pairs = list(forest(np.array(nodes), np.array(labels), side, np.array(n), list(sketches), gone, percent, more))
            return pa.RecordBatch.from_arrays([pa.array([max(p) for p in pairs], pa.int64()), pa.array([min(p) for p in pairs], pa.int64())], ["node", "centre"])

        for batch in batches:
            for key, one, two, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "one", "two", "node", "component", "block", "n", "sketch", "failed"))):
                if (key, one, two) != now:
                    if rows and (out := close()):
                        yield out
                    now, rows = (key, one, two), []
                rows.append(row)
        if rows and (out := close()):
            yield out

    return run


def links(classes: DataFrame, texts: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(node, component) of the class graph, for the classes that have links; ``classes`` has node, text_key, signature, sketch and n, ``texts`` text_key and text."""
    keyed = classes.select("node", "signature").mapInArrow(_keys, "key long, node long")
    # Written first, so that the join's sides are plain exchanges and skewed keys can be split.
    shared = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "keys")
    buckets = materialize(keyed.join(shared, "key"), "buckets")
    nodes = buckets.select("node").distinct()
    wanted = materialize(classes.join(nodes, "node").select("node", "text_key", "signature", "sketch", "n"), "signatures")
    # Copies of a text come more than once; one does.
    texts = texts.join(wanted.select("node", "text_key"), "text_key").groupBy("text_key", "node").agg(F.first("text").alias("text"))
    texts = materialize(texts.select("node", "text"), "texts")
    n_rows = buckets.count()
    parts = max(8, min(width(classes.sparkSession), n_rows // ROWS + 1))
    fit = lambda df: df.coalesce(parts)

    def named(columns: list[str], node: str, mark: str) -> DataFrame:
        return wanted.select(F.col("node").alias(node), *[F.col(c).alias(c + mark) for c in columns])

    def reopened(members: DataFrame, labels: DataFrame) -> DataFrame:
        """Those members of keys that still hold several components."""
        now = fit(members.join(labels, "node", "left")).withColumn("component", F.coalesce("component", "node"))
        many = fit(now.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"))).filter("x < y").select("key")
        return materialize(fit(now.join(many, "key")).select("key", "node", "component"), "open")

    # Stars: centres by the order of nodes and by two hashes.
    orders = [F.struct((F.xxhash64("node", F.lit(k)) if k else F.col("node")).alias("o"), "node") for k in range(STARS)]
    centres = fit(buckets.groupBy("key").agg(F.array_distinct(F.array(*[F.min(o)["node"] for o in orders])).alias("c"))).select("key", F.explode("c").alias("centre"))
    pairs = buckets.join(centres, "key").filter("node != centre").select("node", "centre").distinct()
    near = _distance("signature_c", "signature_n") <= FAR
    pairs = pairs.join(named(["signature"], "centre", "_c"), "centre").join(named(["signature"], "node", "_n"), "node").filter(near).select("node", "centre")
    pairs = materialize(pairs, "near").join(named(["sketch", "n"], "centre", "_c"), "centre").join(named(["sketch", "n"], "node", "_n"), "node")
    possible = F.arrow_udf(_possible(percent), "boolean")
    pairs = materialize(pairs.filter(possible("sketch_c", "sketch_n", "n_c", "n_n")).select("node", "centre"), "pairs")
    labels = materialize(fit(components(confirm(pairs, texts, shingle, percent))), "labels")
    open_keys, failed, more = reopened(buckets, labels), None, 0
    while not open_keys.isEmpty():
        # Across components: a key's members in blocks, each with each.
        blocks = F.ceil(F.greatest(F.col("rows") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("int")
        members = open_keys.join(wanted.select("node", "n", "sketch"), "node")
        members = members.withColumn("failed", F.lit(None).cast("array<long>")) if failed is None else members.join(failed, "node", "left")
        members = materialize(members, "members")
        sizes = members.groupBy("key").agg(F.count("*").alias("rows"), F.sum(F.length("sketch")).alias("bytes")).select("key", blocks.alias("blocks"))
        dealt = members.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.withColumns({"one": F.least("block", "with"), "two": F.greatest("block", "with")}).drop("with", "blocks")
        groups = dealt.repartition(width(classes.sparkSession), "key", "one", "two").sortWithinPartitions("key", "one", "two")
        pairs = materialize(groups.mapInArrow(_forests(percent, more), "node long, centre long").distinct(), "pairs")
        if pairs.isEmpty():
            break
        found = materialize(confirm(pairs, texts, shingle, percent), "found")
        # Where the forest's pairs don't link, others may; more of them are asked each time.
        more = 16 * more or 16
        lost = pairs.join(found, (pairs["node"] == found["a"]) & (pairs["centre"] == found["b"]), "left_anti")
        lost = lost.union(lost.select("centre", "node")).groupBy("node").agg(F.collect_set("centre").alias("failed"))
        if failed is not None:
            lost = lost.union(failed).groupBy("node").agg(F.flatten(F.collect_list("failed")).alias("failed"))
        failed = materialize(fit(lost), "failed")
        if not found.isEmpty():
            labels = materialize(fit(components(found.union(labels.select(F.col("node").alias("a"), F.col("component").alias("b"))))), "labels")
            open_keys = reopened(open_keys.select("key", "node"), labels)
    return labels


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(rid, doc_id, text_key, n_shingles, class_id, group_id, component_id, kept, first) for each row of ``docs`` (doc_id, text).

    class_id stands for equal sets, group_id for a component of the graph; both
    are row ids and null without a set. ``first`` marks one row of each group,
    the least by (doc_id, row).
    """
    docs = docs.select("doc_id", "text", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("text_key"))
    described = materialize(with_row_id(docs, "rid").mapInArrow(_describe(shingle), CLASSES), "described")
    classes = described.filter("set_key is not null").groupBy("set_key").agg(F.min_by(F.struct("rid", "text_key", "signature", "sketch", "n_shingles"), "rid").alias("c"))
    classes = materialize(classes.select("set_key", F.col("c.rid").alias("node"), F.col("c.text_key").alias("text_key"), F.col("c.signature").alias("signature"), F.col("c.sketch").alias("sketch"), F.col("c.n_shingles").alias("n")), "classes")
    labels = links(classes.filter("signature is not null"), docs.select("text_key", "text"), shingle, percent)
    grouped = classes.select("set_key", "node")
    grouped = grouped.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = described.join(grouped, "set_key", "left").select("rid", "doc_id", "text_key", "n_shingles", F.col("node").alias("class_id"), F.coalesce("component", "rid").alias("group_id"))
    rows = materialize(rows, "members")
    least = rows.groupBy("group_id").agg(F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "rid")).alias("f"))
    out = rows.join(least.select("group_id", "component_id", F.col("f.rid").alias("f")), "group_id")
    return out.select("rid", "doc_id", "text_key", "n_shingles", "class_id", F.when(F.col("class_id").isNotNull(), F.col("group_id")).alias("group_id"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), (F.col("rid") == F.col("f")).alias("first"))
