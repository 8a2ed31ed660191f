"""Line dedup: lines that many documents hold stay in one of them alone.

A text is split at line feeds. A line's key is the line without blanks at its
ends, A-Z lower-cased. A key of at least ``least_chars`` code points that at
least ``least_docs`` documents hold loses all its lines but those of the
largest doc_id that holds it. What stays is joined again in its order.

All of it is DataFrame functions. Hashes of 64 bits are counted first, with
partial aggregates; only lines whose hash occurs often enough go on, under 128
bits, to have their documents counted. Joins by a line's key give hot keys
to every task, of which there is a bounded number (``common.find``), and shuffle
the others.
Whole texts move once, to meet the places of their dropped lines.

Null and empty texts have one empty line and lose nothing, since it is too
short. Texts of any length are taken whole, with work by their length. Rows of
one doc_id are one document when documents are counted; each of them is cut by
its own text, and repeated rows give repeated results. Rows without an id
count as one document below all others. All rows that hold a key under the
largest doc_id keep its lines, however often it occurs there. An empty table
gives no rows. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, find, materialize

LEAST_CHARS, LEAST_DOCS = 20, 3
#: Fixed value: the blanks that a key doesn't have at its ends.
BLANKS = " \t\n\x0b\f\r"


def lines_of(docs: DataFrame, least_chars: int) -> DataFrame:
    """(doc_id, text_id, at, key) of all lines that are long enough."""
    # Before the lines come out, so that it is done once a text and not once a line.
    once = docs.select("doc_id", text_id(F.col("text")).alias("text_id"), F.split(ascii_lower(F.col("text")), "\n", -1).alias("lines"))
    rows = once.select("doc_id", "text_id", F.posexplode("lines").alias("at", "line"))
    keys = rows.select("doc_id", "text_id", "at", F.btrim("line", F.lit(BLANKS)).alias("key"))
    return keys.filter(F.char_length("key") >= least_chars)


def text_id(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def dropped_lines(docs: DataFrame, least_chars: int, least_docs: int) -> DataFrame:
    """(doc_id, text_id, cut): places of the dropped lines in each text that has some, ascending."""
    short = lines_of(docs, least_chars).withColumns({"h": F.xxhash64("key"), "key": F.unhex(F.md5("key"))})
    often = materialize(short.groupBy("h").agg(F.count("*").alias("rows")).filter(F.col("rows") >= least_docs), "often")
    hits = materialize(find(short, often, "h").select("doc_id", "text_id", "at", "key"), "hits")
    held = hits.groupBy("key", "doc_id").agg(F.count("*").alias("rows"))
    held = held.groupBy("key").agg(F.count("*").alias("docs"), F.max("doc_id").alias("last"), F.sum("rows").alias("rows"))
    held = materialize(held.filter(F.col("docs") >= least_docs), "held")
    gone = find(hits, held, "key").filter(F.col("doc_id").isNull() | (F.col("doc_id") < F.col("last")))
    return gone.groupBy("doc_id", "text_id").agg(F.array_sort(F.collect_set("at")).alias("cut"))


def without(lines: Column, cut: Column) -> Column:
    """``lines`` without those at the places of ``cut``, by a flag for each line: work by the number of lines."""
    start = lambda k: F.when(k == 0, 0).otherwise(F.get(cut, k - 1) + 1)
    end = lambda k: F.coalesce(F.get(cut, k), F.size(lines))
    # A run of lines that stay before each place, then the place itself.
    run = lambda k: F.concat(F.array_repeat(F.lit(False), end(k) - start(k)), F.array(F.lit(True)))
    gone = F.flatten(F.transform(F.sequence(F.lit(0), F.size(cut)), run))
    # As a variable, so that the flags are made once and not again for each line.
    return F.transform(F.array(gone), lambda flags: F.filter(lines, lambda line, k: ~F.get(flags, k)))[0]


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) of documents (doc_id, text): texts without the dropped lines."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    gone = dropped_lines(docs, least_chars, least_docs).withColumnsRenamed({"doc_id": "__id", "text_id": "__text"})
    keyed = docs.withColumn("text_id", text_id(F.col("text")))
    both = keyed.join(gone, keyed["doc_id"].eqNullSafe(gone["__id"]) & (keyed["text_id"] == gone["__text"]), "left")
    rows = both.select("doc_id", "text", "cut", F.split("text", "\n", -1).alias("lines"))
    kept = F.when(F.col("cut").isNull(), F.col("text")).otherwise(F.array_join(without(F.col("lines"), F.col("cut")), "\n"))
    n = F.size("lines").cast("long")
    return rows.select("doc_id", kept.alias("text"), n.alias("n_lines"), F.coalesce(F.size("cut"), F.lit(0)).cast("long").alias("n_dropped"))
