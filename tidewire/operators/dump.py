"""The dump of invalid packets, limited in bytes a second.

A bucket of ten seconds' worth fills at the rate as packet time goes on; a
packet is written if the bucket isn't in debt, and its size is then taken out.
Each file starts with a full bucket, so files are independent groups; within
one, the order of packets decides, as a fold over Arrow batches sorted by
``seq``. No file is gathered whole: the fold keeps three numbers.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import rotation_start

#: Seconds' worth that a full bucket holds.
BURST = 10
#: Rates up to this mean no limit.
NO_LIMIT = 1e-6


def invalid(packets: DataFrame) -> DataFrame:
    return packets.filter("drop_reason is not null")


def limited(dropped: DataFrame, rate: float, period_sec: int = 600, size_col: str = "net_len") -> DataFrame:
    """(seq, file_us, ts_us, size, admitted) of dropped packets."""
    rows = dropped.select("seq", rotation_start(F.col("ts_us"), period_sec).alias("file_us"), "ts_us", F.col(size_col).cast("long").alias("size"))
    if rate <= NO_LIMIT:
        return rows.withColumn("admitted", F.lit(True))

    def run(batches):
        file, tokens, clock = None, 0.0, 0
        for batch in batches:
            admitted = []
            for f, ts, size in zip(*(batch.column(c).to_pylist() for c in ("file_us", "ts_us", "size"))):
                if f != file:
                    file, tokens, clock = f, rate * BURST, ts
                if ts > clock:
                    tokens, clock = min(rate * BURST, tokens + rate * (ts - clock) / 1e6), ts
                admitted.append(tokens >= 0)
                if tokens >= 0:
                    tokens -= size
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(admitted, pa.bool_())], [*batch.schema.names, "admitted"])

    ordered = rows.repartition("file_us").sortWithinPartitions("file_us", "seq")
    return ordered.mapInArrow(run, "seq long, file_us long, ts_us long, size long, admitted boolean")
