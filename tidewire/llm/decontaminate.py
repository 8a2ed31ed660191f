"""Benchmark decontamination with a generalised suffix automaton.

The test items' words make one suffix automaton; each document's words stream
through it, and the longest matching length is tracked word by word. A word is
hit if it lies in an occurrence of a window: ``WINDOW`` consecutive item words,
or a whole shorter item.

Null text has no words and no hits; an item without words has no window. Items
with equal texts all count. Rows are judged one by one, so repeated rows get
equal results and empty tables give none.

With ``text_to`` the text comes back without the spans over a limit: those of
``window`` words or more, and all spans of a contaminated row (whole shorter
items are cut only there). A cut goes from a span's first to its last byte; what
surrounds it stays as it was, and isn't judged again.

The items travel to the tasks as one closure of at most ``BLOCK_WORDS`` words;
a larger benchmark goes in blocks whose spans are merged per document.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, with_row_id

WINDOW = 13
#: An automaton of this many words takes some 100 MB in a Python worker.
BLOCK_WORDS = 200_000
#: A document is contaminated if hit words * COVERAGE >= all its words.
COVERAGE = 20
#: bytes.lower() lowers A-Z alone, and UTF-8 has only bytes over 7F outside ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode().lower()) if text else []


class Automaton:
    """Suffix automaton of several word sequences."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window, self.vocabulary = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ids = [i for i, _ in items]
        ends: list[set[int]] = [set()]
        short: dict[int, list[int]] = {}
        for k, (_, words) in enumerate(items):
            last = 0
            for w in words:
                last = self._extend(last, self.vocabulary.setdefault(w, len(self.vocabulary)))
                while len(ends) < len(self.link):
                    ends.append(set())
                ends[last].add(k)
            if 0 < len(words) < window:
                short.setdefault(len(words), []).append(k)
        # A state's strings occur in an item if one of the states linking to it does.
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            ends[self.link[v]] |= ends[v]
        n = len(self.link)
        #: For each state, the items that hold its suffix of ``window`` words.
        self.full: list[frozenset[int]] = [frozenset()] * n
        #: For each state, (length, items) of the short items that end there.
        self.short: list[tuple[tuple[int, frozenset[int]], ...]] = [()] * n
        wholes: dict[int, dict[int, set[int]]] = {}
        for m, of in short.items():
            for k in of:
                state = 0
                for w in items[k][1]:
                    state = self.next[state][self.vocabulary[w]]
                wholes.setdefault(state, {}).setdefault(m, set()).add(k)
        for v in sorted(range(1, n), key=self.length.__getitem__):
            up = self.link[v]
            if self.length[up] >= window:
                self.full[v] = self.full[up]
            elif self.length[v] >= window:
                self.full[v] = frozenset(ends[v])
            own = tuple((m, frozenset(of)) for m, of in sorted(wholes.get(v, {}).items()))
            self.short[v] = self.short[up] + own
        self.least = min([window, *short])

    def _extend(self, last: int, w: int) -> int:
        follow, link, length = self.next, self.link, self.length
        if w in follow[last]:
            q = follow[last][w]
            return q if length[q] == length[last] + 1 else self._split(last, w, q)
        new = self._state({}, length[last] + 1)
        p = last
        while p >= 0 and w not in follow[p]:
            follow[p][w] = new
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            q = follow[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return new

    def _state(self, follow: dict[int, int], length: int) -> int:
        self.next.append(follow)
        self.link.append(0)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        copy = self._state(dict(self.next[q]), self.length[p] + 1)
        self.link[copy] = self.link[q]
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit word ranges (first, past the last; they may overlap) and the items met."""
        follow, link, length = self.next, self.link, self.length
        window, least, full, short = self.window, self.least, self.full, self.short
        state = n = 0
        spans, items = [], set()
        for i, w in enumerate(map(self.vocabulary.get, words)):
            if w is None:
                state = n = 0
                continue
            nxt = follow[state].get(w)
            while nxt is None and state:
                state = link[state]
                n = length[state]
                nxt = follow[state].get(w)
            if nxt is None:
                continue
            state = nxt
            n += 1
            if n >= least:
                if n >= window:
                    spans.append((i + 1 - n, i + 1))
                    items |= full[state]
                for m, of in short[state]:
                    if m <= n:
                        spans.append((i + 1 - m, i + 1))
                        items |= of
        return spans, items


def merge(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


RESULT = (
    "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
    "spans array<struct<first:long,past:long>>, items array<string>"
)
KINDS = {
    "n_words": pa.int64(), "n_hit": pa.int64(), "n_items": pa.int64(), "items_sha256": pa.string(), "contaminated": pa.bool_(),
    "spans": pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())])), "items": pa.list_(pa.string()),
}


def judge(n_words: int, spans, items) -> dict:
    spans, items = merge(spans), sorted(items)
    hit = sum(b - a for a, b in spans)
    return {
        "n_words": n_words, "n_hit": hit, "n_items": len(items),
        "items_sha256": hashlib.sha256(",".join(items).encode()).hexdigest(),
        "contaminated": hit > 0 and COVERAGE * hit >= n_words,
        "spans": [{"first": a, "past": b} for a, b in spans], "items": items,
    }


def cut(text: str | None, found: dict, window: int) -> str | None:
    """The text without the spans of ``found`` (a row of ``judge``) that exceed a limit."""
    gone = [s for s in found["spans"] if found["contaminated"] or s["past"] - s["first"] >= window]
    if not gone:
        return text
    data = text.encode()
    at = [m.span() for m in WORD.finditer(data.lower())]
    out, done = [], 0
    for s in gone:
        out.append(data[done : at[s["first"]][0]])
        done = at[s["past"] - 1][1]
    return b"".join([*out, data[done:]]).decode()


def _verdicts(rows: list[dict], texts: list[str | None] | None, window: int) -> list[pa.Array]:
    """Columns of ``KINDS``, and the texts that something was cut out of (null: nothing)."""
    left = [None] * len(rows)
    if texts is not None:
        for k, (t, r) in enumerate(zip(texts, rows)):
            if r["spans"] and (now := cut(t, r, window)) is not t:
                left[k] = now
    return [*[pa.array([r[name] for r in rows], kind) for name, kind in KINDS.items()], pa.array(left, pa.string())]


CUT = "__cut"
NAMES = [*KINDS, CUT]
#: Texts that are taken out of an Arrow batch together.
SLICE = 500


def _matcher(automaton: Automaton, with_cut: bool):
    ids = automaton.ids

    def match(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in texts:
            parts = []
            for at in range(0, max(len(array), 1), SLICE):
                some = array.slice(at, SLICE).to_pylist()
                rows = []
                for text in some:
                    words = words_of(text)
                    spans, items = automaton.scan(words)
                    rows.append(judge(len(words), spans, {ids[k] for k in items if ids[k] is not None}))
                parts.append(_verdicts(rows, some if with_cut else None, automaton.window))
            yield pa.StructArray.from_arrays([pa.concat_arrays(c) for c in zip(*parts)], NAMES)

    return match


def _combiner(with_cut: bool, window: int):
    def combine(inputs: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for counts, spans, items, texts in inputs:
            rows = []
            for n, parts, found in zip(counts.to_pylist(), spans.to_pylist(), items.to_pylist()):
                rows.append(judge(n, [(s["first"], s["past"]) for part in parts for s in part], {i for part in found for i in part}))
            yield pa.StructArray.from_arrays(_verdicts(rows, texts.to_pylist() if with_cut else None, window), NAMES)

    return combine


def _judged(docs: DataFrame, udf, inputs: list[str], text_col: str, text_to: str | None) -> DataFrame:
    """``docs`` with the columns of the UDF's struct. Only its inputs go to Python."""
    call = F.arrow_udf(udf, f"{RESULT}, {CUT} string").asNondeterministic()  # not called anew for each use of its fields
    own = [F.col(f"`{c}`") for c in docs.columns]
    docs = docs.select(*own, call(*[F.col(f"`{c}`") for c in inputs]).alias("__judged"))
    out = [c for c, n in zip(own, docs.columns) if n not in ("__n", "__spans", "__items") and n != text_to]
    out += [F.col(f"__judged.{n}").alias(n) for n in KINDS]
    return docs.select(*out, *([F.coalesce(f"__judged.{CUT}", F.col(f"`{text_col}`")).alias(text_to)] if text_to else []))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, text_to: str | None = None
) -> DataFrame:
    """All columns of ``docs`` with hit spans, items and the verdict for each row.

    Columns of ``docs`` named like a result are replaced. With ``text_to``, that
    column gets the text without the spans over a limit.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in KINDS])
    blocks, block, size = [], [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).toLocalIterator():
        words = words_of(row["t"])
        if words and block and size + len(words) > block_words:
            blocks.append(block)
            block, size = [], 0
        block.append((row["i"], words))
        size += len(words)
    blocks.append(block)
    if len(blocks) == 1:
        return _judged(docs, _matcher(Automaton(block, window), bool(text_to)), [text_col], text_col, text_to)
    held = materialize(with_row_id(docs), "decontaminate")
    found = None
    for block in blocks:
        part = _judged(held.select("__rid", text_col), _matcher(Automaton(block, window), False), [text_col], text_col, None)
        part = part.select("__rid", "n_words", "spans", "items")
        found = part if found is None else found.union(part)
    merged = found.groupBy("__rid").agg(
        F.max("n_words").alias("__n"), F.collect_list("spans").alias("__spans"), F.collect_list("items").alias("__items")
    )
    return _judged(held.join(merged, "__rid").drop("__rid"), _combiner(bool(text_to), window), ["__n", "__spans", "__items", text_col], text_col, text_to)
