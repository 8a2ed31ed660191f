"""Toxicity by a weighted lexicon.

Texts are folded (lower case, look-alike letters of other scripts, digits and
signs that stand for letters), and an Aho-Corasick automaton finds the
lexicon's patterns at the starts of words. A word counts once, with its
heaviest pattern; a hit inside an exception phrase doesn't count. The summed
weight, plain and in proportion to the text's length, goes through a logistic
curve.

The lexicon holds word beginnings that are much more frequent in toxic
training documents (weight: the log of the ratio of the two frequencies).
Exception phrases are a hit word with a neighbour that clean training documents
have together so often, and toxic ones never, that the word's own frequencies
don't explain it; a few fixed ones stand beside them. All this and the curve
are learned from at most ``SAMPLE`` labelled rows, chosen by a hash of their id
among those that are not held out; this bound is the fitting sample's alone,
every document is scored.

Null and empty texts have no hits and get the score of any text without hits.
Repeated rows are scored one by one. Without labels, or toxic ones among them,
all scores are 0. Very long texts are scored whole. An empty table gives no
row. Other columns of the tables are never used; those named like a result are
replaced. Only texts go to Python; the rest of a row stays where it is.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Labelled rows that are read for fitting, and patterns kept of them, at most.
SAMPLE = 20_000
PATTERNS = 2_000
#: Lengths of the word beginnings that are tried.
SHORTEST, LONGEST = 3, 12
#: Least toxic documents with a pattern, and least log ratio of frequencies.
SUPPORT, LEAST_WEIGHT = 3, 1.6
#: Least likelihood-ratio statistic of a pattern (about one in ten thousand by chance).
EVIDENCE = 15.0
#: Exception phrases that are learned, at most.
PHRASES = 2_000
#: Words added to a length, so that one hit in a very short text isn't everything.
SLACK = 20

#: Letters that look like Latin ones.
LOOK_ALIKE = str.maketrans(
    "авеіјкмнорстухѕԁɡαεικνορτυχ",
    "abeijkmhopctyxsdgaeiknoptux",
)
#: Digits and signs that stand for letters inside a word.
STAND_IN = str.maketrans("013457@$", "oieastas")
#: Harmless phrases around words that are often insults.
EXCEPTIONS = ("class clown", "clown fish", "trash bag", "trash bin", "trash can", "white trash bag")

MIXED = re.compile(r"(?<![\w@$])(?=[\w@$]*[^\W\d_])[^\W_@$]*(?:(?<![@$])[@$](?![@$])|[013457])[\w@$]*")
WORD = re.compile(r"[^\W_]+")

RESULT = "n_words long, n_hits long, weight double, density double"


def folded_words(text: str | None) -> list[str]:
    if not text:
        return []
    text = text.lower().translate(LOOK_ALIKE)
    if re.search(r"[013457@$]", text):
        text = MIXED.sub(lambda m: m[0].translate(STAND_IN), text)
    return WORD.findall(text)


def beginnings(words: list[str]) -> set[str]:
    distinct = set(words)
    return {w[:n] for w in distinct for n in range(SHORTEST, min(LONGEST, len(w)) + 1)}


def matcher(lexicon: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
    """words -> weight of each hit that counts, by its place in the words' text (from 1)."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for pattern, weight in lexicon.items():
        automaton.add_word(f" {pattern}", (len(pattern), weight))
    for phrase in exceptions:
        automaton.add_word(f" {phrase} ", (len(phrase), None))
    automaton.make_automaton()

    def find(words: list[str]) -> dict[int, float]:
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (size, weight) in automaton.iter(f" {' '.join(words)} "):
            if weight is None:
                spared.append((end - size, end))
            else:
                at = end - size + 1
                best[at] = max(best.get(at, 0.0), weight)
        if spared:
            # Of the spans that begin at a place or before it, whether the one that reaches farthest covers it.
            spared.sort()
            starts, reach = [a for a, _ in spared], list(accumulate((b for _, b in spared), max))
            covered = lambda at: (k := bisect_right(starts, at)) > 0 and reach[k - 1] > at
            best = {at: w for at, w in best.items() if not covered(at)}
        return best

    return find


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(toxic, text) of the fitting sample."""
    known = labels.filter(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    # At most SAMPLE rows of 12 bytes.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text")


def _count(candidates: set[str] | None):
    def run(batches):
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        n = [0, 0]
        for batch in batches:
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
                found = beginnings(folded_words(text))
                counts[toxic > 0].update(found if candidates is None else found & candidates)
                n[toxic > 0] += 1
        rows = [("", *n)] + [(k, counts[0][k], counts[1][k]) for k in counts[0].keys() | counts[1].keys()]
        a, b, c = zip(*rows)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, pa.int64()), pa.array(c, pa.int64())], ["pattern", "clean", "toxic"])

    return run


def _counts(rows: DataFrame, candidates: set[str] | None) -> dict[str, tuple[int, int]]:
    """Documents with each beginning, clean and toxic; those too rare in toxic ones are left out."""
    sums = rows.mapInArrow(_count(candidates), "pattern string, clean long, toxic long").groupBy("pattern").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    kept = sums.filter((F.col("pattern") == "") | (F.col("toxic") >= SUPPORT))
    return {r["pattern"]: (r["clean"], r["toxic"]) for r in kept.toLocalIterator()}


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Patterns and weights. What reaches the driver is bounded by the fitting sample."""
    candidates = set(_counts(rows.filter("toxic > 0"), None)) - {""}
    counts = _counts(rows, candidates)
    n_clean, n_toxic = counts.pop("", (0, 0))
    if not n_clean or not n_toxic:
        return {}

    def weight(clean: int, toxic: int) -> float:
        return math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))

    def evidence(clean: int, toxic: int) -> float:
        share = (clean + toxic) / (n_clean + n_toxic)
        parts = ((toxic, n_toxic * share), (clean, n_clean * share), (n_toxic - toxic, n_toxic * (1 - share)), (n_clean - clean, n_clean * (1 - share)))
        return 2 * sum(o * math.log(o / e) for o, e in parts if o and e)

    good = {p: (weight(*c), evidence(*c), c[1]) for p, c in counts.items() if weight(*c) >= LEAST_WEIGHT and evidence(*c) >= EVIDENCE}
    # Of beginnings with nearly the same toxic documents, the longest speaks for all.
    shadowed = {p[:-1] for p, (_, _, n) in good.items() if p[:-1] in good and n >= 0.95 * good[p[:-1]][2]}
    kept: dict[str, float] = {}
    for p in sorted(good.keys() - shadowed, key=lambda p: (len(p), p)):
        above = max((kept[p[:n]] for n in range(SHORTEST, len(p)) if p[:n] in kept), default=-math.inf)
        if good[p][0] > above + 0.5:
            kept[p] = good[p][0]
    return dict(sorted(kept.items(), key=lambda x: (-good[x[0]][1], x[0]))[:PATTERNS])


def _phrases(lexicon: dict[str, float]):
    """Each hit word alone and with the word before or after it: the clean and the toxic documents that have it."""

    def run(batches):
        find = matcher(lexicon, ())
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
                words = folded_words(text)
                place, found, at = {}, set(), 1
                for k, w in enumerate(words):
                    place[at] = k
                    at += len(w) + 1
                for k in map(place.__getitem__, find(words)):
                    found.add((words[k], words[k]))
                    found.update((words[k], f"{a} {b}") for a, b in zip(words[max(0, k - 1) : k + 1], words[max(1, k) : k + 2]))
                counts[toxic > 0].update(found)
        rows = [(*k, counts[0][k], counts[1][k]) for k in counts[0].keys() | counts[1].keys()]
        w, p, a, b = zip(*rows) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(p, pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["word", "phrase", "clean", "toxic"])

    return run


def learn_exceptions(rows: DataFrame, lexicon: dict[str, float]) -> tuple[str, ...]:
    """Phrases that only clean documents have, more often than chance would allow. Bounded by the fitting sample."""
    if not lexicon:
        return ()
    counts = rows.mapInArrow(_phrases(lexicon), "word string, phrase string, clean long, toxic long").groupBy("word", "phrase").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    alone = counts.filter("word = phrase").select("word", ((F.col("toxic") + 0.5) / (F.col("clean") + F.col("toxic") + 1)).alias("share"))
    evidence = -2 * F.col("clean") * F.log(1 - F.col("share"))
    good = counts.filter("word != phrase and toxic = 0").join(alone, "word").withColumn("evidence", evidence).filter(F.col("evidence") >= EVIDENCE)
    return tuple(r["phrase"] for r in good.groupBy("phrase").agg(F.max("evidence").alias("e")).orderBy(F.desc("e"), "phrase").limit(PHRASES).collect())


#: Texts that are taken out of an Arrow batch together.
SLICE = 500


def measure(docs: DataFrame, lexicon: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` (but the results' names) with hits, weight and density."""
    names = [c.split()[0] for c in RESULT.split(", ")]

    def measured(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        find = matcher(lexicon, exceptions)
        for array in texts:
            rows = []
            for at in range(0, len(array), SLICE):
                for text in array.slice(at, SLICE).to_pylist():
                    words = folded_words(text)
                    found = find(words)
                    total = math.fsum(found.values())
                    rows.append((len(words), len(found), total, 100 * total / (len(words) + SLACK)))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.StructArray.from_arrays([pa.array(c, pa.int64() if k < 2 else pa.float64()) for k, c in enumerate(columns)], names)

    # Not called anew for each use of its fields.
    call = F.arrow_udf(measured, RESULT).asNondeterministic()
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in names], call(F.col(f"`{text_col}`")).alias("__measured"))
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "__measured"], *[F.col(f"__measured.{n}").alias(n) for n in names])


def fit_curve(measured: DataFrame) -> list[float] | None:
    """Logistic coefficients (1, log weight, log density), from at most SAMPLE rows of three numbers."""
    rows = [(r["toxic"], r["weight"], r["density"]) for r in measured.select("toxic", "weight", "density").toLocalIterator()]
    y = np.array([float(r[0] > 0) for r in rows])
    if not len(y) or not y.any():
        return None
    x = np.column_stack([np.ones(len(y)), np.log1p([r[1] for r in rows]), np.log1p([r[2] for r in rows])])
    beta = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 0.1 * np.eye(3), x.T @ (y - p) - 0.1 * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return [float(b) for b in beta]


def score_column(beta: list[float] | None) -> Column:
    if beta is None:
        return F.lit(0.0)
    z = beta[0] + beta[1] * F.log1p("weight") + beta[2] * F.log1p("density")
    return 1 / (1 + F.exp(-z))


def score(docs: DataFrame, labelled_docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """Learn from ``labelled_docs`` and ``labels``; score all of ``docs``.

    All columns of ``docs`` with n_words, n_hits, weight, density, held_out,
    score and predicted (1 from a score of 0.5).
    """
    # At most SAMPLE rows, read four times.
    rows = materialize(training_rows(labelled_docs, labels), "labelled")
    lexicon = learn_lexicon(rows)
    exceptions = EXCEPTIONS + learn_exceptions(rows, lexicon)
    beta = fit_curve(measure(rows, lexicon, exceptions))
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("held_out", "score", "predicted")])
    out = measure(docs, lexicon, exceptions, text_col).withColumn("score", score_column(beta))
    return out.withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
