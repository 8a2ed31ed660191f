"""Pairing requests with responses.

A response takes the newest request with its key that is still pending, came
before it, and is less than the window older. Each request answers once; what
finds no partner stays as a row of its own. Rows are ordered by ``seq``, the
request's or the lone response's.

Without names this is bracket matching, and expiry never changes which request
is on top (older ones expire first). So windows do it: a running sum gives each
packet its level, and within (key, level) a response's predecessor is its
request. One exchange by key serves both windows.

**Hot keys.** A response only sees requests younger than the window, so a key
can be cut into time slices that overlap by a window on both sides: what is
pending of the last window is found from an empty start, because the newest go
first. With ``slice_us`` the groups are (key, slice), and one key's packets
spread over as many tasks as it has slices. This needs times that don't
decrease along ``seq``; the default is without slices, which doesn't.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import directed
from ..plans.schema import KEY
from .arrival import accepted

#: Candidates whose name differs that one response looks at, one more than so many.
SEARCH_CAP = 32


def _sliced(packets: DataFrame, window_us: int, slice_us: int | None) -> tuple[DataFrame, list[str], Column]:
    """Packets in all slices that need them; grouping columns; whether the row belongs to the slice."""
    if slice_us is None:
        return packets, KEY, F.lit(True)
    if slice_us < window_us:
        raise ValueError("a slice is at least as long as the window")
    at = lambda c: F.floor(c / F.lit(slice_us)).cast("long")
    ts = F.col("ts_us")
    spread = packets.withColumn("__slice", F.explode(F.sequence(at(ts - window_us), at(ts + window_us))))
    return spread, [*KEY, "__slice"], F.col("__slice") == at(ts)


def _leveled(packets: DataFrame, key: list[str]) -> DataFrame:
    """Packets with ``__level``: a response's predecessor on its level of its key is the request it takes."""
    order = Window.partitionBy(*key).orderBy("seq")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    response = F.col("is_response")
    rows = packets.withColumn("__s", F.sum(F.when(response, -1).otherwise(1)).over(running))
    rows = rows.withColumn("__depth", F.col("__s") - F.least(F.lit(0), F.min("__s").over(running)))
    return rows.withColumn("__level", F.when(response, F.coalesce(F.lag("__depth").over(order), F.lit(0))).otherwise(F.col("__depth")))


def match(packets: DataFrame, window_us: int, match_qname: bool = False, slice_us: int | None = None, pick: str = "newest", strict_arrival: bool = False) -> DataFrame:
    """(seq, ts_us, req, resp) of valid packets; at least one of the structs isn't null.

    ``strict_arrival`` goes by the clock of arrival where times don't rise (``arrival``), without slices.

    ``match_qname`` adds the name to the key. That is exact without root names
    among responses and with at most SEARCH_CAP + 1 pending requests a key;
    otherwise take ``match_fold``.
    """
    if strict_arrival:
        return _match_strict(packets, window_us, match_qname)
    if pick == "oldest":
        return match_fold(packets, window_us, match_qname, slice_us, pick)
    packets = directed(packets.filter("drop_reason is null"))
    names = packets.columns
    packets, key, own = _sliced(packets, window_us, slice_us)
    if match_qname:
        key = [*key, "qname"]
    rows = _leveled(packets, key)
    level = Window.partitionBy(*key, "__level").orderBy("seq")
    rows = rows.withColumns({
        "__own": own, "__next": F.lead(F.struct(*names)).over(level),
        "__before": F.lag(F.struct("is_response", "ts_us")).over(level),
    })
    response, near = F.col("is_response"), F.lit(window_us)
    answered = F.coalesce(F.col("__next.is_response") & (F.col("__next.ts_us") - F.col("ts_us") < near), F.lit(False))
    answers = F.coalesce((F.col("__level") > 0) & ~F.col("__before.is_response") & (F.col("ts_us") - F.col("__before.ts_us") < near), F.lit(False))
    own_row = F.struct(*names)
    return rows.filter(F.col("__own") & ~(response & answers)).select(
        "seq", "ts_us", F.when(~response, own_row).alias("req"),
        F.when(response, own_row).otherwise(F.when(answered, F.col("__next"))).alias("resp"),
    )


def _match_strict(packets: DataFrame, window_us: int, match_qname: bool) -> DataFrame:
    packets = directed(packets.filter("drop_reason is null"))
    key = [*KEY, "qname"] if match_qname else KEY
    rows = _leveled(packets.select(*key, "seq", "is_response"), key)
    before = F.lag(F.struct("seq", "is_response")).over(Window.partitionBy(*key, "__level").orderBy("seq"))
    taken = rows.withColumn("__before", before).filter("is_response and __level > 0 and not __before.is_response")
    pairs = accepted(packets, taken.select(F.col("seq").alias("resp"), F.col("__before.seq").alias("req")), window_us)
    row = F.struct(*packets.columns)
    found = pairs.select(F.col("req").alias("seq"), F.col("resp").alias("mate"))
    asked = packets.filter("not is_response").select("seq", "ts_us", row.alias("req")).join(found, "seq", "left")
    answers = packets.filter("is_response").select(F.col("seq").alias("mate"), F.col("ts_us").alias("__ts"), row.alias("resp"))
    both = asked.join(answers, "mate", "full")
    return both.select(F.coalesce("seq", "mate").alias("seq"), F.coalesce("ts_us", "__ts").alias("ts_us"), "req", "resp")


class Open:
    """Requests of one key that wait for their responses, in the order of packets."""

    def __init__(self, window_us: int, match_qname: bool, pick: str):
        self.window, self.names, self.newest = window_us, match_qname, pick == "newest"
        self.waiting: deque[tuple[int, int, str | None]] = deque()
        self.rising = True  # times don't decrease among those that wait

    def ask(self, request: int, ts: int, name: str | None) -> None:
        self.rising = not self.waiting or (self.rising and self.waiting[-1][1] <= ts)
        self.waiting.append((request, ts, name))

    def expire(self, ts: int) -> list[int]:
        """Requests that are a window or more older than ``ts``; they wait no more."""
        gone = []
        if self.rising:
            while self.waiting and ts - self.waiting[0][1] >= self.window:
                gone.append(self.waiting.popleft()[0])
        else:
            gone = [w[0] for w in self.waiting if ts - w[1] >= self.window]
            self.waiting = deque(w for w in self.waiting if ts - w[1] < self.window)
        return gone

    def answer(self, name: str | None) -> int | None:
        """The request that a response takes, if any."""
        n = len(self.waiting)
        for tried in range(min(n, SEARCH_CAP + 1)):
            k = n - 1 - tried if self.newest else tried
            request, _, asked = self.waiting[k]
            if not self.names or name == "." or asked == name:
                del self.waiting[k]
                return request
        return None


def fold(group: pd.DataFrame, window_us: int, match_qname: bool, pick: str = "newest") -> list[int]:
    """Position of each row's partner in a group sorted by seq, -1 without."""
    partner, pending = [-1] * len(group), Open(window_us, match_qname, pick)
    names = group["qname"].astype(object).where(group["qname"].notna(), None)
    for i, (response, ts, name) in enumerate(zip(group["is_response"], group["ts_us"], names)):
        pending.expire(ts)
        if not response:
            pending.ask(i, ts, name)
        elif (j := pending.answer(name)) is not None:
            partner[i], partner[j] = j, i
    return partner


def _pairs(rows: list[tuple[int, int | None]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], ["seq", "mate"])


def match_fold(packets: DataFrame, window_us: int, match_qname: bool = True, slice_us: int | None = None, pick: str = "newest") -> DataFrame:
    """Like ``match``, packet by packet within each key: names with the root as wildcard, and the search cap."""
    packets = directed(packets.filter("drop_reason is null"))
    names = packets.columns
    spread, key, own = _sliced(packets, window_us, slice_us)
    order = Window.partitionBy(*key).orderBy("seq")
    slim = spread.select(*key, "seq", "ts_us", "is_response", "qname", own.alias("own")).withColumn("first", F.row_number().over(order) == 1)
    slim = slim.sortWithinPartitions(*key, "seq").select("first", "seq", "ts_us", "is_response", "qname", "own")

    def run(batches):
        # Groups follow each other; of each, only what waits is kept.
        pending, owned = Open(window_us, match_qname, pick), set()
        for batch in batches:
            out: list[tuple[int, int | None]] = []
            for first, seq, ts, response, name, here in zip(*(c.to_pylist() for c in batch.columns)):
                if first:
                    out += [(s, None) for s in owned]
                    pending, owned = Open(window_us, match_qname, pick), set()
                for s in pending.expire(ts):
                    if s in owned:
                        owned.remove(s)
                        out.append((s, None))
                if not response:
                    pending.ask(seq, ts, name)
                    if here:
                        owned.add(seq)
                elif (s := pending.answer(name)) is None:
                    if here:
                        out.append((seq, None))
                elif s in owned:
                    owned.remove(s)
                    out.append((s, seq))
            yield _pairs(out)
        yield _pairs([(s, None) for s in owned])

    found = slim.mapInArrow(run, "seq long, mate long")
    row = F.struct(*names)
    whole = packets.select(F.col("seq").alias("__seq"), row.alias("row"))
    one = found.join(whole.withColumnRenamed("__seq", "seq"), "seq")
    other = whole.filter("row.is_response").select(F.col("__seq").alias("mate"), F.col("row").alias("other"))
    both = one.join(other, "mate", "left")
    response = F.col("row.is_response")
    return both.select("seq", F.col("row.ts_us").alias("ts_us"), F.when(~response, F.col("row")).alias("req"), F.when(response, F.col("row")).otherwise(F.col("other")).alias("resp"))
