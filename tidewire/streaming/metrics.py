"""Running counters of a stream, one report for each trigger.

``observed`` counts packets as they pass, without another look at them;
``Reports`` is a listener that gathers the counts, with the lag behind the
clock on the wall and rates over the time since the report before.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

NAME = "packets_read"


def observed(packets: DataFrame, name: str = NAME) -> DataFrame:
    """The same packets, counted for each trigger."""
    return packets.observe(
        name, F.count(F.lit(1)).alias("packets"), F.coalesce(F.sum(F.col("net_len").cast("long")), F.lit(0)).alias("bytes"), F.count("drop_reason").alias("dropped"),
        F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"),
    )


class Reports(StreamingQueryListener):
    """``rows``: a report for each trigger that read packets; ``total()``: their sums."""

    def __init__(self, name: str = NAME, clock=time.time):
        self.name, self.clock, self.rows, self.last = name, clock, [], None

    def onQueryStarted(self, event):
        self.last = self.clock()

    def onQueryProgress(self, event):
        found = event.progress.observedMetrics.get(self.name)
        if found is None or not found["packets"]:
            return
        now = self.clock()
        span = max(now - (self.last or now), 1e-9)
        self.rows.append({
            "batch": event.progress.batchId, **{c: found[c] for c in ("packets", "bytes", "dropped", "first_us", "last_us")},
            "packets_per_sec": found["packets"] / span, "bytes_per_sec": found["bytes"] / span, "lag_sec": now - found["last_us"] / 1e6,
        })
        self.last = now

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass

    def total(self) -> dict:
        return {c: sum(r[c] for r in self.rows) for c in ("packets", "bytes", "dropped")}
