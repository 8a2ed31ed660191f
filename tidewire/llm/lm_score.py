"""Stupid-backoff scores of documents under the corpus' own word n-grams.

    S(w2 | w1) = f(w1 w2) / f(w1)        if the bigram table holds w1 w2
               = BACKOFF * f(w2) / N     otherwise, and for a text's first word without BACKOFF

The tables count all n-grams of the corpus. Words are keyed by 64-bit hashes,
n-grams by those of their words. A document's score is the sum of ln S over its
words.

``lm_scores`` scores the corpus under its own bigrams. All of these are in the
table, so none backs off. The bigrams are exploded per task, one for each that a
chunk of texts holds with the texts that have it, and move once, partitioned by
the hash of their first word. There they are counted by windows over (first,
second) and (first), which are the two count tables joined to each row, exploded
to texts, and summed per text. On the way, the bigrams of a chunk that go to the
same bucket of hashes share a row. First words that alone would fill a good part
of a partition (at most four times the number of partitions are such) are dealt
out by both words; a pair, however common, comes once a chunk.

``ngram_scores`` takes any order and any corpus, also one without the documents
that are scored, backs off level by level, and leaves out n-grams seen less than
``least`` times. Its count tables, joined to exploded n-grams, are Spark's own.

Null and empty texts, and texts without words, have n_words 0 and score 0.
Repeated rows count and are scored one by one. Very long texts are taken whole,
alone in a chunk if need be. Only doc_id and text are used, whatever other
columns there are. An empty table gives no row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SHARE, as_bytes, chunks, materialize, mix, span_hashes, width, word_spans

BACKOFF = 0.4
#: Words of the longest n-gram in ``ngram_scores``.
ORDER = 3
#: Bytes and number of the texts whose n-grams share rows.
CHUNK, CHUNK_ROWS = 6_000_000, 30_000
#: Texts, and bytes of them, that are hashed together: some 50 bytes of memory for each.
SLICE, PIECE = 500, 400_000
#: Bits of the buckets: some 50 occurrences of a full chunk each. More where there are many partitions to fill evenly.
BUCKETS, SPREAD = 14, 4
#: Stand for a text's end after its last word, for its start before its first, and for the text itself.
END, HEAD, TEXT = 0, 1, 2

IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

WORDS = "word long, n long"
GRAMS = "bucket long, total long, base long, firsts array<long>, seconds array<long>, ends array<int>, texts array<smallint>, doc_id long, n_words long"


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of texts, end to end, and the index of each word's text."""
    data = np.frombuffer(b"\n".join(texts).lower() + b"\n", dtype=np.uint8)
    starts, ends = word_spans(data, IS_WORD)
    with np.errstate(over="ignore"):
        words = span_hashes(data, starts, ends).view(np.int64)
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return words, np.searchsorted(bounds, starts, side="right")


def _chunks(batches):
    """(doc_ids, words, index of each word's text) of some CHUNK bytes of texts at a time; only the hashes are held."""
    ids, words, at, size, count = [], [], [], 0, 0

    def whole():
        return pa.concat_arrays(ids), np.concatenate(words), np.concatenate(at)

    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            part = batch.slice(start, SLICE)
            texts = as_bytes(part.column("text"))
            for a, b in chunks(texts, PIECE):
                found, of = hashed(texts[a:b])
                ids.append(part.column("doc_id").slice(a, b - a))
                words.append(found)
                at.append((of + count).astype(np.int16))
                size, count = size + sum(map(len, texts[a:b])), count + b - a
                if size > CHUNK or count > CHUNK_ROWS:
                    yield whole()
                    ids, words, at, size, count = [], [], [], 0, 0
    if ids:
        yield whole()


def _count(batches):
    for _, words, _ in _chunks(batches):
        word, n = np.unique(words, return_counts=True)
        for start in range(0, len(word), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(word[start : start + 100_000]), pa.array(n[start : start + 100_000])], ["word", "n"])


def _lists(values: np.ndarray, starts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), pa.array(values))


def _grams(heavy: np.ndarray, heavy_f: np.ndarray, n: int):
    """Rows (bucket, total, base, firsts, seconds, ends, texts): the bigrams of a chunk that fall into a bucket.

    The texts of a bigram, counted from ``base``, end at its place in ``ends``.
    ``total`` is known for the first words of ``heavy``, whose buckets go by both
    words. For each text also a row with its id and length.
    """
    names = [c.split()[0] for c in GRAMS.split(", ")]
    bits = max(BUCKETS, n.bit_length() + SPREAD)
    top = lambda x, k: (x >> np.uint64(64 - k)).astype(np.int64)

    def packed(words, at, base):
        """The bigrams of a chunk; END follows a last word, and a first word has HEAD once more."""
        last = np.append(at[1:] != at[:-1], True)
        head = np.flatnonzero(np.append(True, last[:-1]))
        second = np.where(last, END, np.append(words[1:], END)).view(np.uint64)
        first, second, at = np.append(words, words[head]).view(np.uint64), np.append(second, np.full(len(head), HEAD, np.uint64)), np.append(at, at[head])
        order = np.lexsort((second, first))
        first, second, at = first[order], second[order], at[order]
        begin = np.flatnonzero(np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])))
        past = np.append(begin[1:], len(first))
        first, second = first[begin], second[begin]
        # The order by hashes is one by buckets.
        bucket = top(first, bits)
        known, total = np.zeros(len(first), dtype=bool), np.zeros(len(first), dtype=np.int64)
        if len(heavy):
            which = np.minimum(np.searchsorted(heavy, first.view(np.int64)), len(heavy) - 1)
            known = heavy[which] == first.view(np.int64)
            total[known] = heavy_f[which[known]]
            bucket[known] = -1 - (which[known] << bits) - top(second[known], n.bit_length())
        row = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        ends = (past - np.repeat(begin[row], np.diff(np.append(row, len(begin))))).astype(np.int32)
        none = pa.nulls(len(row), pa.int64())
        return pa.RecordBatch.from_arrays([
            pa.array(bucket[row]), pa.array(total[row], mask=~known[row]), pa.array(np.full(len(row), base)),
            _lists(first.view(np.int64), row), _lists(second.view(np.int64), row), _lists(ends, row), _lists(at, begin[row]), none, none,
        ], names)

    def run(batches):
        base = TaskContext.get().partitionId() << 33
        for ids, words, at in _chunks(batches):
            size, each = len(ids), np.arange(len(ids))
            if len(words):
                whole = packed(words, at, base)
                for start in range(0, whole.num_rows, 5_000):
                    yield whole.slice(start, 5_000)
            yield pa.RecordBatch.from_arrays([
                pa.array(each), pa.nulls(size, pa.int64()), pa.array(np.full(size, base)), pa.ListArray.from_arrays(pa.array(np.arange(size + 1), pa.int32()), pa.nulls(size, pa.int64())),
                _lists(np.full(size, TEXT), each), _lists(np.ones(size, np.int32), each), _lists(each.astype(np.int16), each), ids, pa.array(np.bincount(at, minlength=size)),
            ], names)
            base += size

    return run


def _bounded(unigrams: DataFrame, total: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Words that make up more than one in ``most`` of all (fewer than ``most``), sorted, with their counts."""
    rows = sorted((r["word"], r["f"]) for r in unigrams.filter(F.col("f") * most > total).toLocalIterator())
    return np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.int64)


def lm_scores(docs: DataFrame, heavy: int | None = None) -> DataFrame:
    """(doc_id, n_words, score) for each row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    unigrams = materialize(docs.mapInArrow(_count, WORDS).groupBy("word").agg(F.sum("n").alias("f")), "unigrams")
    total = unigrams.agg(F.sum("f").alias("n")).first()["n"] or 1
    n = width(docs.sparkSession)
    dealt = docs.mapInArrow(_grams(*_bounded(unigrams, total, 4 * n if heavy is None else heavy), n), GRAMS).repartition(n, "bucket")
    start = lambda k: F.coalesce(F.get("ends", k - 1), F.lit(0))
    bigram = lambda w, k: F.struct(F.get("firsts", k).alias("first"), w.alias("second"), F.slice("texts", start(k) + 1, F.get("ends", k) - start(k)).alias("texts"))
    grams = dealt.select("bucket", "total", "base", "doc_id", "n_words", F.inline(F.transform("seconds", bigram)))
    # Sorted once, for both windows. A text's start is no bigram of its first word.
    n_here = F.when(F.col("second") != HEAD, F.size("texts"))
    grams = grams.withColumn("pair", F.sum(n_here).over(Window.partitionBy("bucket", "first", "second")))
    grams = grams.withColumn("f", F.coalesce("total", F.sum(n_here).over(Window.partitionBy("bucket", "first"))))
    value = F.when(F.col("second") == HEAD, F.log(F.col("f") / F.lit(float(total)))).when(~F.col("second").isin(END, TEXT), F.log(F.col("pair") / F.col("f"))).otherwise(0.0)
    each = grams.select("base", value.alias("value"), "doc_id", "n_words", F.explode("texts").alias("text"))
    return each.groupBy((F.col("base") + F.col("text")).alias("rid")).agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.sum("value").alias("score")).drop("rid")


def _windows(words: np.ndarray, at: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word the hashes of the 1 to ``order`` words that end with it, those of each but its last word, and the word's place in its text."""
    n = len(words)
    place = np.arange(n) - np.searchsorted(at, at)
    grams, contexts = np.zeros((n, order), dtype=np.uint64), np.zeros((n, order), dtype=np.uint64)
    with np.errstate(over="ignore"):
        grams[:, 0] = words.view(np.uint64)
        for k in range(1, order):
            contexts[1:, k] = grams[:-1, k - 1]
            grams[:, k] = mix(contexts[:, k] * np.uint64(0x9E3779B97F4A7C15) + grams[:, 0] + np.uint64(k))
    return grams.view(np.int64), contexts.view(np.int64), place


def _tables(order: int):
    """(k, gram, n): the n-grams of a chunk of texts with their numbers."""

    def run(batches):
        for _, words, at in _chunks(batches):
            grams, _, place = _windows(words, at, order)
            for k in range(order):
                gram, n = np.unique(grams[place >= k, k], return_counts=True)
                for start in range(0, len(gram), 100_000):
                    g, f = gram[start : start + 100_000], n[start : start + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), k + 1, np.int32)), pa.array(g), pa.array(f)], ["k", "gram", "n"])

    return run


def _lengths(batches):
    """The number of words of each batch of texts."""
    for batch in batches:
        n = 0
        texts = as_bytes(batch.column("text"))
        for a, b in chunks(texts):
            n += len(word_spans(np.frombuffer(b"\n".join(texts[a:b]).lower(), dtype=np.uint8), IS_WORD)[0])
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])


ASKED = "base long, texts array<smallint>, grams array<long>, contexts array<long>, doc_id long, n_words long"


def _asked(order: int):
    """Rows (base, texts, grams, contexts): the different longest n-grams that end with a word of a chunk, with the texts
    of all such words, counted from ``base``; the n-grams within it that end with its last word, the shortest first, and
    their contexts. For each text also a row with its id and length."""
    names = [c.split()[0] for c in ASKED.split(", ")]

    def run(batches):
        base = 0

        def based():
            # Not the task's own number: that is another one where a union computes these rows again.
            nonlocal base
            for batch in batches:
                if not base and batch.num_rows:
                    base = batch.column("part")[0].as_py() << 33
                yield batch

        for ids, words, at in _chunks(based()):
            grams, contexts, place = _windows(words, at, order)
            most = np.minimum(place, order - 1)
            longest = grams[np.arange(len(words)), most]
            by = np.argsort(longest, kind="stable")
            begin = np.flatnonzero(np.append(True, longest[by][1:] != longest[by][:-1])) if len(by) else by
            ends = np.append(begin[1:], len(by)) if len(by) else by
            for a in range(0, len(begin), 20_000):
                b = min(a + 20_000, len(begin))
                one = by[begin[a:b]]
                inside = most[one][:, None] >= np.arange(order)
                starts = np.cumsum(inside.sum(axis=1)) - inside.sum(axis=1)
                lists = [_lists(x[one][inside], starts) for x in (grams, contexts)]
                none = pa.nulls(b - a, pa.int64())
                texts = _lists(at[by[begin[a] : ends[b - 1]]], begin[a:b] - begin[a])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, base)), texts, *lists, none, none], names)
            each, empty = np.arange(len(ids)), _lists(np.zeros(0, np.int64), np.zeros(len(ids), np.int64))
            n_words = pa.array(np.bincount(at, minlength=len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), base)), _lists(each.astype(np.int16), each), empty, empty, ids, n_words], names)
            base += len(ids)

    return run


def ngram_scores(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, least: int = 1, corpus: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_words, n_backed, score) for each row of ``docs`` (doc_id, text), under the n-grams of up to ``order`` words of ``corpus``.

    Without ``corpus`` the documents' own n-grams count. n-grams of two words or
    more that occur less than ``least`` times back off, each time by ``backoff``;
    a word that the corpus doesn't hold backs off once more, to one in N (the
    corpus' words). ``n_backed`` counts the words that backed off.

    The count table is partitioned by the n-grams' hashes. Level by level, from
    the longest n-grams down, exploded n-grams meet it: those found then ask for
    their context at the level below, the others for the n-gram that is one word
    shorter. An n-gram asks once for each chunk of texts. Counts of n-grams that
    make up more than one in ``SHARE`` of the corpus, fewer than ``SHARE`` of each
    length, are broadcast; the rows that they answer are dealt out once, or stay.
    """
    corpus = (docs if corpus is None else corpus).select("doc_id", "text")
    total = corpus.mapInArrow(_lengths, "n long").agg(F.sum("n").alias("n")).first()["n"] or 1
    # Not written: every level reads the same shuffled rows, which are where the joins need them. The hash tells k.
    counts = corpus.mapInArrow(_tables(order), "k int, gram long, n long").groupBy("gram").agg(F.min("k").alias("k"), F.sum("n").alias("f"))
    # Written, so that a text's number stays the same however often its rows are computed.
    held = materialize(docs.select("doc_id", "text"), "ngram-docs")
    rows = held.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(_asked(order), ASKED)
    rows = rows.withColumns({"level": F.lit(0), "value": F.lit(0.0), "backed": F.lit(0), "next": F.lit(None).cast("long")})
    for k in range(order, 0, -1):
        open_, context = (F.col("level") == 0) & (F.size("grams") >= k), F.col("level") == k + 1
        table = counts.filter(F.col("k") == k).select(F.col("gram").alias("key"), "f")
        hot = table.filter(F.col("f") * SHARE > total).withColumnRenamed("f", "hot")
        keyed = rows.withColumn("key", F.when(open_, F.get("grams", F.lit(k - 1))).when(context, F.col("next")))
        keyed = keyed.join(F.broadcast(hot), "key", "left")
        settled = F.col("key").isNull() | F.col("hot").isNotNull()
        if k == order:
            # Rows without a question or with their answer go anywhere.
            dealt = keyed.withColumn("key", F.when(settled, F.xxhash64("base", "key", "texts")).otherwise(F.col("key")))
            met = dealt.join(table, "key", "left").withColumn("f", F.coalesce("hot", "f"))
        else:
            # They don't move again; both parts read the rows that the level above has shuffled.
            asking = keyed.filter(~settled).join(table, "key", "left")
            met = keyed.filter(settled).withColumn("f", F.col("hot")).unionByName(asking)
        found = open_ & F.coalesce(F.col("f") >= (least if k > 1 else 1), F.lit(False))
        step = F.when(found, F.log("f")).when(open_, math.log(backoff)).when(context, -F.log("f")).otherwise(0.0)
        # What is still to be asked goes on, no more.
        left = lambda c: F.when(found, F.slice(c, 1, 0)).otherwise(F.slice(c, 1, k - 1)).alias(c)  # noqa: B023, E731
        rows = met.select(
            "base", "texts", left("grams"), left("contexts"), "doc_id", "n_words", F.when(found, k).otherwise(F.col("level")).alias("level"),
            (F.col("value") + step).alias("value"), F.when(open_ & ~found, 1).otherwise(F.col("backed")).alias("backed"),
            F.when(found, F.get("contexts", F.lit(k - 1))).alias("next"),
        )
    value = F.col("value") - F.when(F.col("n_words").isNull() & (F.col("level") <= 1), math.log(total)).otherwise(0.0)
    each = rows.select("base", "doc_id", "n_words", "backed", value.alias("value"), F.explode("texts").alias("text"))
    sums = each.groupBy((F.col("base") + F.col("text")).alias("rid")).agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.sum("backed").alias("n_backed"), F.sum("value").alias("score"))
    return sums.drop("rid")
