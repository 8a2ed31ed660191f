"""Running counters as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import rotation_start
from . import rotation


def input_totals(packets: DataFrame) -> DataFrame:
    """Packets read, their bytes, those dropped, and rates over the time covered."""
    span = (F.max("ts_us") - F.min("ts_us")) / F.lit(1e6)
    return packets.agg(*_input(), *_rates(span))


def input_per_period(packets: DataFrame, period_sec: int) -> DataFrame:
    start = rotation_start(F.col("ts_us"), period_sec).alias("period_us")
    return packets.groupBy(start).agg(*_input(), *_rates(F.lit(float(period_sec))))


def _input() -> list[Column]:
    return [F.count("*").alias("packets"), F.sum(F.col("net_len").cast("long")).alias("bytes"), F.count("drop_reason").alias("dropped")]


def _rates(span: Column) -> list[Column]:
    per = lambda c: F.when(span > 0, c / span)
    return [per(F.count("*")).alias("packets_per_sec"), per(F.sum(F.col("net_len").cast("long"))).alias("bytes_per_sec")]


def output_totals(pairs: DataFrame, *by: Column) -> DataFrame:
    """Records, requests without response, responses without request."""
    counts = [F.count("*").alias("items"), F.count_if(F.col("resp").isNull()).alias("request_only"), F.count_if(F.col("req").isNull()).alias("response_only")]
    return pairs.groupBy(*by).agg(*counts) if by else pairs.agg(*counts)


def output_per_file(pairs: DataFrame, period_sec: int) -> DataFrame:
    return output_totals(pairs, rotation_start(F.col("ts_us"), period_sec).alias("file_us"))


def output_per_opening(pairs: DataFrame, period_sec: int) -> DataFrame:
    """Counters of files that each open when the one before is older than the period."""
    opened = rotation.greedy(pairs.select("seq", "ts_us"), period_sec).select("seq", "opened_us")
    return output_totals(pairs.join(opened, "seq"), F.col("opened_us"))


def drop_counts(packets: DataFrame) -> DataFrame:
    return packets.groupBy(F.coalesce("drop_reason", F.lit("valid")).alias("drop_reason")).agg(F.count("*").alias("packets"), F.sum(F.col("net_len").cast("long")).alias("bytes"))


def frame_stats(packets: DataFrame, pairs: DataFrame, frame_us: int) -> DataFrame:
    """For each frame of time: packets, bytes, requests, matched requests and lone responses."""
    frame = (F.col("ts_us") - F.pmod("ts_us", F.lit(frame_us))).alias("frame_us")
    read = packets.filter("drop_reason is null").groupBy(frame).agg(F.count("*").alias("packets"), F.sum(F.col("net_len").cast("long")).alias("bytes"), F.count_if(~F.col("is_response")).alias("requests"))
    made = pairs.groupBy(frame).agg(F.count_if(F.col("req").isNotNull() & F.col("resp").isNotNull()).alias("matched"), F.count_if(F.col("req").isNull()).alias("unmatched_responses"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return read.join(made, "frame_us", "full").select("frame_us", *[zero(c) for c in ("packets", "bytes", "requests", "matched", "unmatched_responses")])


def dump_stats(admitted: DataFrame) -> DataFrame:
    """Of the token bucket's verdicts: dumped packets and bytes, and those skipped, per file."""
    kept = F.col("admitted")
    return admitted.groupBy("file_us").agg(F.count_if(kept).alias("dumped"), F.coalesce(F.sum(F.when(kept, F.col("size"))), F.lit(0)).alias("dumped_bytes"), F.count_if(~kept).alias("skipped"))


def lag_seconds(packets: DataFrame) -> DataFrame:
    """Seconds that the newest packet is behind the clock."""
    return packets.agg(((F.unix_micros(F.current_timestamp()) - F.max("ts_us")) / F.lit(1e6)).alias("lag_sec"))
