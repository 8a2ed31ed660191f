"""Matching on a stream: pending requests as state, expired by timers.

The semantics are those of the batch operator; rows of a micro-batch are put in
order of ``seq`` within their key.

State is kept by groups of keys (``BUCKETS``, by a hash), not by key: a call into
Python, its state and its timer cost as much as hundreds of packets. A group's
pending requests are one value, an Arrow stream; its one timer is that of the
request that leaves first. The number of groups belongs to a checkpoint.

By event time (the default) requests leave as the watermark passes their window.
Spark drops rows behind the watermark, so its delay must be at least the
disorder of the input. What is pending when a stream ends is given out by a late
row (``flush_row``): it moves the watermark past the window of all requests, so
that their timers fire. It must come last, since rows after it are behind the
watermark.

By the clock on the wall (``idle_us``) a request leaves when the window and
``idle_us`` have gone by since it was read, whether or not packets come; before
that, a packet of its key with a later time lets it leave as ever. There is no
watermark, so no row is dropped however late: it pairs with what is pending or
is a row of its own.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..functions.scalar import directed
from ..operators.match import Open
from ..plans.schema import KEY

#: Groups of keys. A task holds the packets of a group in a micro-batch, so very large micro-batches want more.
BUCKETS = 4096
PENDING = pa.schema([("key", pa.string()), ("seq", pa.int64()), ("ts_us", pa.int64()), ("qname", pa.string()), ("read_ms", pa.int64()), ("row", pa.string())])
OUT = "seq long, ts_us long, req_seq long, resp_seq long, delay_us long"
#: What ``match_stream_rows`` has beside: packets as JSON.
ROWS = "req_row string, resp_row string"


def packed(rows: list[tuple]) -> bytes:
    """Pending requests as an Arrow stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, PENDING) as out:
        out.write_batch(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PENDING)], schema=PENDING))
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> list[tuple]:
    return list(zip(*(c.to_pylist() for c in pa.ipc.open_stream(data).read_all().columns)))


def matcher(window_us: int, match_qname: bool, idle_us: int | None, rows_too: bool = False):
    wait_ms = (window_us + (idle_us or 0)) // 1000 + 1

    def leaves(p: tuple) -> int:
        """When a pending request leaves, in milliseconds of its clock."""
        return p[4] + wait_ms if idle_us is not None else (p[2] + window_us) // 1000 + 1

    class Matcher(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.pending = handle.getValueState("pending", "rows binary")

        def _load(self) -> list[tuple]:
            found = self.pending.get()
            return [] if found is None else unpacked(bytes(found[0]))

        def _store(self, rows: list[tuple], before: list[tuple]) -> None:
            # The timer of what is pending is always set; one that was set for nothing finds nothing.
            if rows:
                if (first := min(map(leaves, rows))) != min(map(leaves, before), default=None):
                    self.handle.registerTimer(first)
                self.pending.update((packed(rows),))
            elif before:
                self.pending.clear()

        @staticmethod
        def _frame(out: list[tuple]) -> pd.DataFrame:
            columns = list(zip(*out))
            numbers = {n: pd.array(columns[k], dtype="Int64") for k, n in enumerate(("seq", "ts_us", "req_seq", "resp_seq", "delay_us"))}
            rows = {n: pd.Series(columns[k], dtype=object) for k, n in ((5, "req_row"), (6, "resp_row"))} if rows_too else {}
            return pd.DataFrame(numbers | rows)

        def handleInputRows(self, key, rows, timerValues):
            # Flush rows have no key; they only move the watermark.
            data = pd.concat([r[r["key"].notna()] for r in rows], ignore_index=True).sort_values("seq")
            now = timerValues.getCurrentProcessingTimeInMs() if idle_us is not None else 0
            before, open_keys, out = self._load(), {}, []
            for k, seq, ts, name, read, row in before:
                open_keys.setdefault(k, Open(window_us, match_qname, "newest")).ask((seq, ts, read, row), ts, name)
            whole = data["row"].tolist() if rows_too else [None] * len(data)
            for k, seq, ts, response, name, row in zip(*(data[c].tolist() for c in ("key", "seq", "ts_us", "is_response", "qname")), whole):
                if (waiting := open_keys.get(k)) is None:
                    waiting = open_keys[k] = Open(window_us, match_qname, "newest")
                out += [(s, t, s, None, None, r, None) for s, t, _, r in waiting.expire(ts)]
                if not response:
                    waiting.ask((seq, ts, now, row), ts, name)
                elif (found := waiting.answer(name)) is None:
                    out.append((seq, ts, None, seq, None, None, row))
                else:
                    out.append((found[0], found[1], found[0], seq, ts - found[1], found[3], row))
            self._store([(k, s, ts, name, read, row) for k, o in open_keys.items() for (s, ts, read, row), _, name in o.waiting], before)
            if out:
                yield self._frame(out)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            now = timerValues.getCurrentWatermarkInMs() if idle_us is None else timerValues.getCurrentProcessingTimeInMs()
            pending = self._load()
            gone = [p for p in pending if leaves(p) <= now]
            if gone:
                self._store([p for p in pending if leaves(p) > now], pending)
                yield self._frame([(p[1], p[2], p[1], None, None, p[5], None) for p in gone])

        def close(self) -> None:
            pass

    return Matcher()


def match_stream(packets: DataFrame, window_us: int, match_qname: bool = False, watermark: str = "1 minute", idle_us: int | None = None) -> DataFrame:
    """(seq, ts_us, req_seq, resp_seq, delay_us) of a stream of packets, appended as they are decided.

    With ``idle_us`` requests expire by the clock on the wall and no row is too late; ``watermark`` isn't used.
    """
    return _matched(directed(packets.filter("drop_reason is null")), window_us, match_qname, watermark, idle_us, False)


def match_stream_rows(packets: DataFrame, window_us: int, match_qname: bool = False, watermark: str = "1 minute", idle_us: int | None = None) -> DataFrame:
    """(seq, ts_us, req, resp) as the batch operator gives them; state holds whole requests, so leave out columns that aren't used."""
    packets = directed(packets.filter("drop_reason is null"))
    kind = packets.schema.simpleString()
    row = F.to_json(F.struct(*packets.columns))
    found = _matched(packets.withColumn("row", row), window_us, match_qname, watermark, idle_us, True)
    return found.select("seq", "ts_us", *[F.from_json(f"{side}_row", kind).alias(side) for side in ("req", "resp")])


def _matched(rows: DataFrame, window_us: int, match_qname: bool, watermark: str, idle_us: int | None, rows_too: bool) -> DataFrame:
    if idle_us is None:
        rows = rows.withColumn("event_time", F.timestamp_micros("ts_us")).withWatermark("event_time", watermark)
    # Exact keys as text, null for flush rows, which have no ``seq``; its column then holds no nulls, so that it stays whole numbers.
    key = F.when(F.col("seq").isNotNull(), F.to_json(F.struct(*KEY)))
    rows = rows.withColumns({"bucket": F.pmod(F.xxhash64(*KEY), F.lit(BUCKETS)).cast("int"), "key": key, "seq": F.coalesce("seq", F.lit(0))})
    kept = ["bucket", "key", *(["event_time"] if idle_us is None else []), "seq", "ts_us", "is_response", "qname", *(["row"] if rows_too else [])]
    return rows.select(*kept).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=matcher(window_us, match_qname, idle_us, rows_too), outputStructType=f"{OUT}, {ROWS}" if rows_too else OUT,
        outputMode="append", timeMode="EventTime" if idle_us is None else "ProcessingTime",
    )


def flush_row(spark: SparkSession, schema: StructType, last_us: int, window_us: int, watermark: str = "1 minute") -> DataFrame:
    """A packet of ``schema`` for the end of a stream whose last packet is of ``last_us``; it gives no row of its own."""
    late = F.timestamp_micros(F.lit(last_us + window_us + 2_000_000)) + F.expr(f"INTERVAL {watermark}")
    facts = {"ts_us": F.unix_micros(late), "is_response": F.lit(False)}
    return spark.range(1).select(*[facts.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
