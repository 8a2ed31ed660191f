"""Output files that are closed as soon as they are older than a period.

A file is opened by the first record, closed by the first one whose time is
more than the period later, which opens the next, and so on: each opening
depends on the one before. Records older than ones before them close nothing,
so what counts is the clock, the greatest time so far.

Records are cut into ranges by ``seq``. Within a range the last opening follows
from the first, and the first is the first clock value beyond a limit that
comes from the ranges before, the last opening there and the period. Only
values within a period of the ranges before can be the first. Tables of (first,
last) of neighbouring ranges are joined into those of pairs, then of four
ranges, and so on; then limits are handed down from the whole to its parts, and
each range is gone through once from its limit. Every step is spread over all
ranges, and none holds more than one range.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import written
from .arrival import greatest_so_far, ranged

#: Below all times.
NEVER = -(1 << 62)


def _chains(values: DataFrame, period_us: int) -> DataFrame:
    """(part, c, last): the last opening of a range for each value that may be its first. ``values``: (part, c, limit)."""

    def run(batches):
        part, held, limit = None, [], None

        def chains():
            c = np.unique(np.concatenate(held))
            at = np.searchsorted(c, c + period_us, side="right")
            last = np.append(np.where(at < len(c), at, np.arange(len(c))), len(c))
            while not np.array_equal(further := last[last[: len(c)]], last[: len(c)]):
                last[: len(c)] = further
            # Values up to the first beyond the limit.
            n = int(np.searchsorted(c, limit, side="right")) + 1
            kept = c[:n]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(kept), part)), pa.array(kept), pa.array(c[last[: len(kept)]])], ["part", "c", "last"])

        for batch in batches:
            numbers, c, limits = (batch.column(k).to_numpy() for k in range(3))
            for cut in np.split(np.arange(len(c)), np.flatnonzero(np.diff(numbers)) + 1):
                if held and numbers[cut[0]] != part:
                    yield chains()
                    held = []
                part, limit = int(numbers[cut[0]]), int(limits[cut[0]])
                held.append(c[cut])
        if held:
            yield chains()

    dealt = values.repartition("part").sortWithinPartitions("part")
    return dealt.select(F.col("part").cast("long").alias("part"), "c", "limit").mapInArrow(run, "part long, c long, last long")


def greedy(records: DataFrame, period_sec: int, ranges: int | None = None) -> DataFrame:
    """(seq, ts_us, opened_us): when the file of each record (seq, ts_us) was opened."""
    period = period_sec * 1_000_000
    rows = written(greatest_so_far(ranged(records.select("seq", "ts_us"), ranges), "ts_us", "c"), "clock")
    tops = rows.groupBy("part").agg(F.max("c").alias("top"))
    # A row for each range: small windows.
    before = tops.select("part", F.coalesce(F.lag("top").over(Window.orderBy("part")), F.lit(NEVER)).alias("before"), (F.row_number().over(Window.orderBy("part")) - 1).cast("long").alias("node"))
    before = written(before, "ranges")
    values = rows.join(F.broadcast(before), "part").filter(F.col("c") > F.col("before")).select(F.col("node").alias("part"), "c", (F.col("before") + period).alias("limit")).distinct()
    levels = [written(_chains(values, period).withColumnRenamed("part", "node"), "chains")]
    count = before.count()
    starts = [before.select("node", "before")]
    while count > 1:
        levels.append(written(_joined(levels[-1], starts[-1], period), "chains"))
        starts.append(starts[-1].filter("node % 2 = 0").select(F.floor(F.col("node") / 2).alias("node"), "before"))
        count = (count + 1) // 2
    limits = records.sparkSession.range(1).select(F.col("id").alias("node"), F.lit(NEVER).alias("limit"))
    for below in reversed(levels[:-1]):
        # The left half begins where the whole does, the right one where the left one's last opening leaves it.
        left = limits.select((F.col("node") * 2).alias("node"), "limit")
        first = below.join(F.broadcast(left), "node").filter(F.col("c") > F.col("limit")).groupBy("node").agg(F.min_by("last", "c").alias("last"))
        right = left.join(first, "node", "left").select((F.col("node") + 1).alias("node"), F.coalesce(F.col("last") + period, "limit").alias("limit"))
        limits = written(left.unionByName(right), "limits")
    known = before.join(limits, "node").select("part", "limit")

    def run(batches):
        part = limit = None
        for batch in batches:
            out = []
            for number, c, start in zip(*(batch.column(k).to_pylist() for k in ("part", "c", "limit"))):
                if number != part:
                    part, limit = number, start
                if c > limit:
                    limit = c + period
                out.append(limit - period)
            yield pa.RecordBatch.from_arrays([batch.column("seq"), batch.column("ts_us"), pa.array(out, pa.int64())], ["seq", "ts_us", "opened_us"])

    dealt = rows.join(F.broadcast(known), "part").repartition("part").sortWithinPartitions("part", "seq")
    return dealt.select("seq", "ts_us", "part", "c", "limit").mapInArrow(run, "seq long, ts_us long, opened_us long")


def _joined(chains: DataFrame, starts: DataFrame, period: int) -> DataFrame:
    """Chains of pairs of neighbouring ranges."""
    both = chains.select(F.floor(F.col("node") / 2).alias("pair"), (F.col("node") % 2).alias("side"), "c", "last")
    # From above: what a left chain goes on with is the last right one seen before its limit.
    at = F.when(F.col("side") == 0, F.col("last") + period).otherwise(F.col("c"))
    above = Window.partitionBy("pair").orderBy(F.col("at").desc(), "side").rowsBetween(Window.unboundedPreceding, -1)
    on = F.last(F.when(F.col("side") == 1, F.col("last")), ignorenulls=True).over(above)
    # At the same place, the left one comes first and doesn't see the right one: a file closes strictly later.
    whole = both.withColumn("at", at).withColumn("on", on).select(F.col("pair").alias("node"), "c", F.when(F.col("side") == 0, F.coalesce("on", "last")).otherwise(F.col("last")).alias("last"))
    first = starts.filter("node % 2 = 0").select(F.floor(F.col("node") / 2).alias("node"), (F.col("before") + period).alias("limit"))
    # Values up to the first beyond the limit of the pair.
    earlier = F.lag("c").over(Window.partitionBy("node").orderBy("c"))
    return whole.join(F.broadcast(first), "node").withColumn("earlier", earlier).filter(F.col("earlier").isNull() | (F.col("earlier") <= F.col("limit"))).select("node", "c", "last")
