"""Records as CSV lines: no quotes, backslash escapes, one record a line.

Lines are bytes: what isn't escaped stands as it is, bytes over 7F too, whether
or not they are text. Reading undoes writing byte by byte. (One case can't be
told: with a separator that isn't graphic, such as a tab, a NUL followed by the
last two digits of its escape looks like it.)
"""

from __future__ import annotations

import re
import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import escape, guard, number_list, rotation_start, strftime, time_text
from ..operators import rotation
from ..plans.config import valid_separator
from ..plans.schema import columns
from ..plans.session import remove

#: Fixed value: a missing string. A missing number is empty.
NULL_STRING = "\\N"
#: Length of the runs of ``seq`` by which a period is dealt out: packets of a table, or bytes of a capture.
FILE_SEQS = 1 << 26
GUARDED = {"qname", "client_addr", "server_addr", "edns_client_subnet", "edns_other"}


def csv_text(name: str, kind: str, separator: str) -> Column:
    """CSV text of a record column."""
    c = F.col(name)
    if name == "time":
        return F.coalesce(time_text(F.col("ts_us")), F.lit(""))
    if kind == "boolean":
        return F.coalesce(c.cast("int").cast("string"), F.lit(""))
    if kind.startswith("array"):
        return F.coalesce(number_list(c, separator), F.lit(NULL_STRING))
    if kind == "binary":
        return F.coalesce(escape(c.cast("string"), separator), F.lit(NULL_STRING))
    if kind == "string":
        return F.coalesce(guard(c, separator) if name in GUARDED else escape(c, separator), F.lit(NULL_STRING))
    return F.coalesce(c.cast("string"), F.lit(""))


def lines(records: DataFrame, flags=None, separator: str = ",", max_line_bytes: int | None = None, null_zero_udp_sum: bool = False) -> DataFrame:
    """(seq, ts_us, line) of projected records."""
    if not valid_separator(separator):
        raise ValueError(f"not a separator: {separator!r}")
    if null_zero_udp_sum and "req_udp_sum" in records.columns:
        records = records.withColumn("req_udp_sum", F.nullif("req_udp_sum", F.lit(0)))
    kinds = dict(records.dtypes)
    line = F.concat_ws(separator, *[csv_text(c, kinds[c], separator) for c in columns(flags)])
    if max_line_bytes:
        line = F.substring(line, 1, max_line_bytes)
    return records.select("seq", "ts_us", line.alias("line"))


def header(flags=None, separator: str = ",") -> str:
    return separator.join(columns(flags))


def write(records: DataFrame, path: str, flags=None, separator: str = ",", inline_header: bool = True, period_sec: int = 0, path_format: str = "%Y%m%d-%H%M%S", compression: str | None = None, header_path: str | None = None, greedy: bool = False) -> None:
    """Write text files, a folder for each period; without records nothing is left there.

    Periods are aligned; with ``greedy`` each begins with the first record that
    the one before is too old for.

    Each file has its lines by ``seq`` and, with ``inline_header``, the header
    first. A period of many records is dealt out by runs of ``FILE_SEQS`` of
    ``seq``, so that no task writes all of it. ``header_path`` gets a file with
    the header alone.
    """
    rows = lines(records, flags, separator)
    if period_sec:
        if greedy:
            rows = rows.join(rotation.greedy(rows.select("seq", "ts_us"), period_sec).select("seq", "opened_us"), "seq")
        start = F.col("opened_us") if greedy else rotation_start(F.col("ts_us"), period_sec)
        rows = rows.withColumn("period", strftime(start, path_format))
        rows = rows.repartition("period", F.floor(F.col("seq") / FILE_SEQS))
        names = ["period"]
    else:
        names = []
    rows = rows.select(*names, "seq", "line")
    if inline_header:
        rows = with_header(rows, names, header(flags, separator))
    writer = rows.sortWithinPartitions(*names, "seq").select(*names, "line").write.mode("overwrite")
    if names:
        writer = writer.partitionBy(*names)
    if compression:
        writer = writer.option("compression", compression)
    writer.text(path)
    spark = records.sparkSession
    if spark.read.schema("value string").text(path).isEmpty():
        remove(spark, path)
    elif header_path:
        spark.createDataFrame([(header(flags, separator),)], "line string").coalesce(1).write.mode("overwrite").text(header_path)


def show(records: DataFrame, flags=None, separator: str = ",", inline_header: bool = True) -> None:
    """Print lines by ``seq``. They come to the driver a partition at a time, as standard output is there."""
    if inline_header:
        print(header(flags, separator), flush=True)
    for row in lines(records, flags, separator).orderBy("seq").select(F.col("line").cast("binary")).toLocalIterator():
        sys.stdout.buffer.write(bytes(row[0]) + b"\n")
    sys.stdout.flush()


def with_header(rows: DataFrame, names: list[str], text: str) -> DataFrame:
    """Add a header line to every (partition, period) that has rows."""
    import pyarrow as pa

    def run(batches):
        seen = set()
        for batch in batches:
            keys = [tuple(r.values()) for r in batch.select(names).to_pylist()] if names else [()] * batch.num_rows
            for key in dict.fromkeys(keys):
                if key not in seen:
                    seen.add(key)
                    first = [*[pa.array([v]) for v in key], pa.array([-(2**63)], pa.int64()), pa.array([text])]
                    yield pa.RecordBatch.from_arrays(first, [*names, "seq", "line"])
            yield pa.RecordBatch.from_arrays(batch.columns, [*names, "seq", "line"])

    schema = ", ".join([*[f"`{n}` string" for n in names], "seq long", "line string"])
    return rows.mapInArrow(run, schema)


def read(spark, path: str, flags=None, separator: str = ",", inline_header: bool = True) -> DataFrame:
    """Columns of written lines, escapes undone: text, or bytes of the columns that hold them; partition folders become columns."""
    rows = spark.read.option("lineSep", "\n").text(path)
    names = columns(flags)
    if inline_header:
        rows = rows.filter(F.col("value") != header(flags, separator))
    cut = F.split(marked(F.col("value"), separator), "\0", -1)
    undone = [value_of(F.try_element_at(cut, F.lit(k + 1)), n, separator).alias(n) for k, n in enumerate(names)]
    return rows.select(*undone, *[c for c in rows.columns if c != "value"])


#: A byte's character each, so that text functions don't touch bytes that aren't text.
BYTES = "ISO-8859-1"
#: Columns of bytes; all others are text.
BINARY = {"resp_edns_nsid"}
PAIR = "\\\\"


def by_pairs(line: Column, change) -> Column:
    """``change`` applied to what lies between escaped backslashes. Pairs are told from the left, so that in between each backslash begins an escape."""
    return F.transform(F.split(line, r"\\\\", -1), change)


def marked(line: Column, separator: str) -> Column:
    """The line's bytes as characters, with NUL, which no line holds, for each separator that isn't escaped."""
    mark = re.escape(separator.encode().decode(BYTES))
    return F.array_join(by_pairs(F.decode(line.cast("binary"), BYTES), lambda part: F.regexp_replace(part, rf"(?<!\\){mark}", "\0")), PAIR)


def value_of(text: Column, name: str, separator: str) -> Column:
    """A column's value of its characters between separators."""
    whole = F.when(text != NULL_STRING, unescape(text, separator, name in GUARDED))
    out = F.encode(whole, BYTES)
    return out if name in BINARY else out.cast("string")


def unescape(text: Column, separator: str, guarded: bool = False) -> Column:
    """The inverse of ``escape``; ``guarded``: of ``guard``, under which other escapes are the name's own."""
    graphic = separator.isprintable() and not separator.isspace()
    plain = separator.encode().decode(BYTES)
    undone = [("\\n", "\n")] + ([(f"\\{plain}", plain)] if graphic else []) + ([] if guarded else [("\\0", "\0")])
    if not graphic and not guarded:
        # Before \0: the digits of a separator may begin with it.
        undone.insert(0, (f"\\{ord(separator):03o}", plain))

    def change(part: Column) -> Column:
        for old, new in undone:
            part = F.replace(part, F.lit(old), F.lit(new))
        return part

    return change(text) if guarded else F.array_join(by_pairs(text, change), "\\")
