"""Spelling variants: words of the corpus that are one edit apart, and the word that each stands for.

Words are maximal runs of Latin letters, A-Z lower-cased. By a rule of their
document and text (``counted``) one run in 31 loses a letter. Words of at least
``LEAST_CHARS`` code points and ``LEAST_COUNT`` occurrences make up the
vocabulary (LEAST_CHARS is 2 at least). Two words are near if one inserted, deleted or replaced code point
makes one of the other. A word's form is its most frequent near word (ties: the
first in code-point order) if that is ``RATIO`` times as frequent; its root is
the end of the chain of forms.

**Search.** A pair whose shorter word has ``c`` code points agrees either in
the first c // 2 or, if the edit lies there, in the last c - c // 2. So each
word goes to the groups of its prefix and of its suffix, once as the shorter
or equal word of a pair and once as the longer. A group's words are a sorted list, reversed for
suffixes. Every word of it is held against the list by the edit matrix, of
which three cells a row matter: the row of a prefix that adjoining words share
is computed once for all of them, and a range of the list whose shared prefix
is already more than one edit away is skipped. This runs for many words at
once, one level of prefixes after another.

A group of more than ``GROUP`` words isn't searched whole: its words go on to
groups of prefixes longer by one, and pairs that differ just there meet in
groups that lack this place, which hold an alphabet of words at most.

Null and empty texts have no words; texts and words of any length are taken
whole. A null doc_id counts as an empty text in the rule of lost letters.
Repeated rows count as often as they stand. Ties are in the order of code
points. An empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import ascii_lower, materialize, width

LEAST_CHARS, LEAST_COUNT, RATIO = 7, 2, 10
#: One run in so many loses a letter.
LOSES = 31
#: Words that are searched as one list; with more than SHARE of such groups, more.
GROUP = 50_000
#: Words that are held against their lists at a time.
AT_ONCE = 8_000
DEAL = ["back", "cls", "depth", "kind", "key"]


def counted(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the vocabulary of documents (doc_id, text) with the number of occurrences."""
    runs = F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(f"[a-zÀ-ÿ]{{{least_chars},}}"), F.lit(0))
    rows = docs.select("doc_id", F.explode(runs).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = F.pmod(F.col("h"), F.char_length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = rows.withColumn("h", h).select(F.when(F.col("h") % LOSES == 0, less).otherwise(F.col("run")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).filter((F.char_length("word") >= least_chars) & (F.col("n") >= least_count))


def deal(words: DataFrame, least_chars: int, group: int) -> DataFrame:
    """(back, cls, depth, kind, key, t, n): each word in the groups where it can meet near words.

    ``cls`` is the length of a pair's shorter word; ``t`` the word, reversed if
    ``back``; words of one key agree in the first ``depth`` code points of t.
    Groups of kind 1 and 2 are for pairs that differ just behind these.
    """
    n = F.char_length("word")
    rows = words.select("word", "n", F.explode(F.array(n, n - 1)).alias("cls")).filter(F.col("cls") >= least_chars)
    rows = rows.withColumn("back", F.explode(F.array(F.lit(False), F.lit(True))))
    half = F.floor(F.col("cls") / 2).cast("int")
    rows = rows.withColumns({"t": F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word")), "depth": F.when(F.col("back"), F.col("cls") - half).otherwise(half), "kind": F.lit(0)})
    rows = rows.withColumn("key", F.substring("t", F.lit(1), F.col("depth"))).select(*DEAL, "t", "n")
    done = None
    while True:
        sizes = materialize(rows.groupBy(*DEAL).agg(F.count("*").alias("size")).filter(F.col("size") > group), "sizes")
        if sizes.isEmpty():
            return rows if done is None else done.unionByName(rows)
        # Fewer than SHARE groups are larger than this.
        most = max(group, rows.count() // common.SHARE)
        marked = rows.join(F.broadcast(sizes.filter(F.col("size") > most)), DEAL, "left")
        cold = marked.filter("size is null").drop("size")
        done = cold if done is None else done.unionByName(cold)
        rows = materialize(_deeper(marked.filter("size is not null").drop("size")), "dealt")
        if rows.isEmpty():
            return done
        done = done.unionByName(rows.filter("kind > 0"))
        rows = rows.filter("kind = 0")


def _deeper(rows: DataFrame) -> DataFrame:
    """Hot rows by prefixes longer by one, and without the place behind their prefix."""
    d, same = F.col("depth"), F.char_length("t") == F.col("cls")
    longer = F.struct((d + 1).alias("depth"), F.lit(0).alias("kind"), F.substring("t", F.lit(1), d + 1).alias("key"))
    out = F.concat(F.substring("t", F.lit(1), d), F.lit("\x01"), F.substring("t", d + 2, F.char_length("t")))
    less = F.concat(F.substring("t", F.lit(1), d), F.substring("t", d + 2, F.char_length("t")))
    swap = F.struct(d.alias("depth"), F.lit(1).alias("kind"), out.alias("key"))
    gap = F.struct(d.alias("depth"), F.lit(2).alias("kind"), F.when(same, F.col("t")).otherwise(less).alias("key"))
    each = F.explode(F.when(same, F.array(longer, swap, gap)).otherwise(F.array(longer, gap)))
    return rows.select("back", "cls", "t", "n", each.alias("g")).select("back", "cls", "g.depth", "g.kind", "g.key", "t", "n")


def near_pairs(words: list[bytes], groups: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the words at a distance of one, both ways round.

    ``words`` are sorted within each group; ``groups`` has the first place of
    each and the number of words at its end. Words of a group agree in the
    first ``depth`` bytes.
    """
    size = np.array([len(w) for w in words], dtype=np.int64)
    start = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
    # A zero byte behind each word is what any place beyond its end reads.
    data = np.frombuffer(b"".join(w + b"\0" for w in words), dtype=np.uint8)

    def letters(k, at):
        return data[start[k] + np.minimum(at, size[k])]

    n, first = len(words), np.zeros(len(words), dtype=bool)
    first[groups[:-1]] = True
    level_bounds: list[np.ndarray] = []
    found_i, found_j = [], []
    every = np.arange(n)
    for begin in range(0, n, AT_ONCE):
        q = every[begin : begin + AT_ONCE]
        g = np.searchsorted(groups, q, side="right") - 1
        lo, hi = groups[g], groups[g + 1]
        low = np.full(len(q), 1 if depth else 9, dtype=np.int8)
        mid, high = np.zeros(len(q), dtype=np.int8), np.ones(len(q), dtype=np.int8)
        d = depth
        while len(q):
            if len(level_bounds) == d - depth:
                # Ranges of words that agree in one byte more.
                here = letters(every, d)
                first[1:] |= here[1:] != here[:-1]
                level_bounds.append(np.append(np.flatnonzero(first), n))
            bounds = level_bounds[d - depth]
            left, right = np.searchsorted(bounds, lo), np.searchsorted(bounds, hi)
            count = right - left
            up = np.repeat(np.arange(len(q)), count)
            child = np.repeat(left - (np.cumsum(count) - count), count) + np.arange(len(up))
            q, lo, hi, low, mid, high = q[up], bounds[child], bounds[child + 1], low[up], mid[up], high[up]
            c = letters(lo, d)
            over = size[q] - d
            end = c == 0
            if end.any():
                last = np.select([over == -1, over == 0, over == 1], [low, mid, high], 9)
                hit = end & (last == 1)
                found_i.append(q[hit])
                found_j.append(lo[hit])
            # Cells d, d + 1 and d + 2 of the next row, from cells d - 1, d and d + 1 of this one.
            a = np.minimum(mid + 1, low + (letters(q, d - 1) != c)) if d else mid + 1
            a = np.where(over < 0, 9, a)
            b = np.where(over < 1, 9, np.minimum(np.minimum(high + 1, mid + (letters(q, d) != c)), a + 1))
            e = np.where(over < 2, 9, np.minimum(high + (letters(q, d + 1) != c), b + 1))
            go = ~end & (np.minimum(np.minimum(a, b), e) <= 1)
            q, lo, hi = q[go], lo[go], hi[go]
            low, mid, high = (np.minimum(x[go], 9).astype(np.int8) for x in (a, b, e))
            d += 1
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *found_i]), np.concatenate([none, *found_j])


def _searched(back: bool, cls: int, depth: int, kind: int, words: list[bytes], counts: list[int], groups: list[int]):
    """(word, near, best_n, best) of words that have near ones among these groups, each pair in one of all groups alone."""
    out: dict[int, list] = {}
    half = cls // 2
    for i, j in zip(*(x.tolist() for x in near_pairs(words, np.array(groups), depth))):
        a, b = words[i], words[j]
        if len(a) + len(b) > 2 * cls + 1 or back and a[-half:] == b[-half:] or kind and a[depth : depth + 1] == b[depth : depth + 1]:
            continue
        best = (-counts[j], b[::-1] if back else b)
        seen = out.setdefault(i, [0, best])
        seen[0] += 1
        seen[1] = min(seen[1], best)
    return [((words[i][::-1] if back else words[i]).decode("latin-1"), near, -best[0], best[1].decode("latin-1")) for i, (near, best) in out.items()]


def near_words(words: DataFrame, least_chars: int = LEAST_CHARS, group: int = GROUP) -> DataFrame:
    """(word, n_near, best_n, best) of the words (word, n) that have near ones: how many, and the most frequent."""
    dealt = deal(words, least_chars, group)

    def run(batches):
        segment, rows, counts, groups, key = None, [], [], [0], None

        def search():
            # Words alone in their group have nobody to meet.
            ends = np.diff(np.array([*groups, len(rows)]))
            keep = np.repeat(ends > 1, ends)
            kept = [w for w, k in zip(rows, keep) if k]
            if not kept:
                return []
            sizes = ends[ends > 1]
            return _searched(*segment, kept, [c for c, k in zip(counts, keep) if k], [0, *np.cumsum(sizes).tolist()])

        for batch in batches:
            found = []
            for back, cls, depth, kind, k, t, n in zip(*(c.to_pylist() for c in batch.columns)):
                here = (back, cls, depth, kind)
                if here != segment or k != key:
                    if segment is not None and (here != segment or len(rows) >= AT_ONCE):
                        found += search()
                        rows, counts, groups = [], [], []
                    elif segment is None:
                        groups = []
                    groups.append(len(rows))
                    segment, key = here, k
                rows.append(t.encode("latin-1"))
                counts.append(n)
            if found:
                yield _table(found)
        if segment is not None and (found := search()):
            yield _table(found)

    parts = dealt.repartition(width(words.sparkSession), *DEAL).sortWithinPartitions(*DEAL, "t")
    near = parts.select(*DEAL, "t", "n").mapInArrow(run, "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return near.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.less")).alias("best_n"), "b.best")


def _table(found) -> pa.RecordBatch:
    kinds = {"word": pa.string(), "near": pa.int64(), "best_n": pa.int64(), "best": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds.values())], list(kinds))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): each round doubles the steps, of which there are as many at most as a count has digits."""
    at = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = materialize(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if at.filter("moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")


def variants(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, ratio: int = RATIO, group: int = GROUP) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the vocabulary of documents (doc_id, text)."""
    words = materialize(counted(docs, least_chars, least_count), "words")
    both = words.join(near_words(words, least_chars, group), "word", "left")
    has = F.col("best_n") >= ratio * F.col("n")
    both = materialize(both.select("word", F.when(has, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best_n")).alias("form_n")), "near")
    ends = roots(both.filter("form is not null"))
    return both.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
