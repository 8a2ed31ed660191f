"""The clock of arrival, for input whose times don't rise.

A packet advances the clock to its time; one that is older leaves it. So the
clock at a packet, ``C``, is the greatest time among all packets up to it, of
any key. Requests and responses without a request wait in a queue that leaves
in its order; what a request waits for is the greatest time among the queued
packets up to it, ``P``. A response answers the newest pending request of its
key if its C is less than the request's P and the window.

P depends on which responses find no request, and that on P of earlier
requests. Levels of brackets (``match``) don't depend on times, so which
request a response would take is known before. The verdicts are then computed
again and again from those of the round before; each depends on earlier packets
alone, so that there is one solution and no round changes what is right. Few
rounds are needed: a change has to pass from a response to a later request
that it keeps waiting just long enough.

Greatest times so far are found range by range: packets are dealt out by
``seq`` once, each range gives its greatest value, and a range starts with the
greatest of those before it. No task sees more than a range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import written


def ranged(rows: DataFrame, ranges: int | None = None) -> DataFrame:
    """``rows`` with ``part``, the number of the range of ``seq`` that they lie in; written, so that ranges stay."""
    ranges = ranges or max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism)
    return written(rows.repartitionByRange(ranges, "seq").withColumn("part", F.spark_partition_id()), "arrival")


def greatest_so_far(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Rows (seq, part, ...) with the greatest ``value`` among those up to each by ``seq``."""
    # One row for each range: that many rows are one small window, whatever the input.
    tops = rows.groupBy("part").agg(F.max(value).alias("__top"))
    before = tops.select("part", F.max("__top").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    here = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.join(F.broadcast(before), "part").withColumn(name, F.greatest(F.max(value).over(here), "__before"))
    return found.drop("__before")


def clock(packets: DataFrame, ranges: int | None = None) -> DataFrame:
    """(seq, ts_us, clock_us) of valid packets."""
    rows = ranged(packets.filter("drop_reason is null").select("seq", "ts_us"), ranges)
    return greatest_so_far(rows, "ts_us", "clock_us").select("seq", "ts_us", "clock_us")


def in_order(packets: DataFrame) -> bool:
    """Whether times of valid packets never fall."""
    return clock(packets).filter("ts_us < clock_us").isEmpty()


def accepted(packets: DataFrame, taken: DataFrame, window_us: int, ranges: int | None = None) -> DataFrame:
    """(resp, req) of those ``taken`` (resp, req: places of a response and the request it would take) that the clock of arrival allows.

    ``packets``: (seq, ts_us, is_response), all valid ones.
    """
    rows = ranged(packets.select("seq", "ts_us", "is_response").join(taken.withColumnRenamed("resp", "seq"), "seq", "left"), ranges)
    timed = written(greatest_so_far(rows, "ts_us", "c"), "clock")
    late = None
    while True:
        # In the queue: requests, responses that take none, those that were late in the round before.
        judged = timed if late is None else timed.join(late.withColumn("late", F.lit(True)), "seq", "left")
        was = F.lit(False) if late is None else F.col("late").isNotNull()
        queued = ~F.col("is_response") | F.col("req").isNull() | was
        waits = greatest_so_far(judged.select("seq", "part", "c", "is_response", "req", F.when(queued, F.col("ts_us")).alias("queued")), "queued", "p")
        asked = waits.filter(~F.col("is_response")).select(F.col("seq").alias("req"), "p")
        pairs = waits.filter("req is not null").select("seq", "req", "c").join(asked, "req")
        again = written(pairs.filter(F.col("c") >= F.col("p") + window_us).select("seq"), "late")
        if late is not None and again.count() == late.count() and again.join(late, "seq", "left_anti").isEmpty():
            return taken.join(again.withColumnRenamed("seq", "resp"), "resp", "left_anti")
        late = again
