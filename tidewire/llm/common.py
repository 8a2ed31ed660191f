"""Helpers shared by the corpus operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..plans.session import shared_folder


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage: what follows survives lost executors without recomputing
    what precedes, and row ids drawn before the cut stay fixed.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def quoted(names) -> list[Column]:
    """Columns by name, whatever characters the names hold."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def extended(df: DataFrame, names, added: str) -> StructType:
    """The named columns of ``df`` and ``added`` ones: not by a string of their types, whose inner names may need quoting."""
    return StructType([StructField(n, df.schema[n].dataType) for n in names] + StructType.fromDDL(added).fields)


def with_row_id(docs: DataFrame, name: str = "__rid") -> DataFrame:
    """Number the rows, so that repeated rows and null or repeated ids stay apart."""
    return docs.withColumn(name, F.monotonically_increasing_id())


def width(spark: SparkSession) -> int:
    """Number of partitions for work that is heavier than its bytes tell."""
    return max(
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        spark.sparkContext.defaultParallelism,
    )


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is. Texts of ASCII alone take the quick way."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


#: A key of more than one row in so many is hot, so that there are fewer of these keys, whatever the data.
SHARE = 100_000


def find(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Inner join of rows with ``table``, one row for each ``key`` with the number of its ``rows``; hot keys are broadcast, fewer than SHARE."""
    least = (table.agg(F.sum("rows")).first()[0] or 0) / SHARE
    hot, rest = F.broadcast(table.filter(F.col("rows") > least)), table.filter(F.col("rows") <= least)
    found = rows.join(hot, key)
    if rest.isEmpty():
        return found
    return found.unionByName(rows.join(hot, key, "left_anti").join(rest, key))


def chunks(texts: list[bytes], limit: int = 2_000_000):
    """Yield (start, stop) of runs of texts with about ``limit`` bytes, one text at least."""
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > limit:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def as_bytes(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null becomes b""."""
    return [b"" if v is None else v.encode() for v in column.to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_RNG = np.random.default_rng(20240229)
#: One random 64-bit value per byte.
BYTE_VALUE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
#: Odd base of the polynomial hashes and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def word_spans(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes b with is_word[b]."""
    mask = np.zeros(len(data) + 2, dtype=np.int8)
    mask[1:-1] = is_word[data]
    edge = np.diff(mask)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of each data[start:end], whatever its place."""
    n = len(data)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUE[data] * powers(BASE, n), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(INVERSE, n + 1)[starts])
