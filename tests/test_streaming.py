import glob
import time

import pytest

from tidewire.operators import stats
from tidewire.plans import catalog
from tidewire.sources.events import packets
from tidewire.streaming.match import OUT, match_stream
from tidewire.streaming.metrics import Reports, observed

from .oracle import compare, connect
from .packets import SCHEMA, table
from .packets import packet as p

SF = "/root/testdata/sf0.001"
W = catalog.WINDOW / 1e6
#: Spark counts what lies at its first watermark, the epoch, as late.
T = 1_000

CASES = {
    "lone request": ([p(1, "R", T)], [(1, 1, None)]),
    "lone response": ([p(1, "A", T)], [(1, None, 1)]),
    "all kinds": ([p(1, "R", T), p(2, "A", T + 1), p(3, "A", T + 2, dns_id=8), p(4, "R", T + 3, dns_id=9), p(5, "R", T + W + 9)], [(1, 1, 2), (3, None, 3), (4, 4, None), (5, 5, None)]),
    "expired": ([p(1, "R", T), p(2, "A", T + W)], [(1, 1, None), (2, None, 2)]),
    "empty": ([], []),
}


@pytest.mark.parametrize("name", CASES)
def test_nothing_is_lost(spark, name):
    rows, expected = CASES[name]
    got = catalog.streamed(table(spark, rows)).collect()
    assert sorted((r["seq"], r["req_seq"], r["resp_seq"]) for r in got) == expected


def test_all_rows(spark):
    compare(spark, connect(SF), catalog.QUERIES["match_streaming_all"], catalog.ORACLE_SQL["match_outer_all"], SF)


def test_requests_leave_an_idle_stream_and_late_rows_stay(spark, tmp_path):
    """By the clock on the wall: a lone request comes out without further input, a row ten windows late isn't lost."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    window = 4_000_000
    table(spark, [p(1, "R", T), p(2, "R", T + 1), p(3, "A", T + 2), p(4, "R", T + 2, dns_id=9)]).write.parquet(source)
    found = match_stream(spark.readStream.schema(SCHEMA).parquet(source), window, idle_us=100_000)
    job = found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="100 milliseconds").start(out)

    def rows(n):
        end = time.time() + 60
        while time.time() < end:
            got = sorted((r["seq"], r["req_seq"], r["resp_seq"]) for r in spark.read.schema(OUT).parquet(out).collect()) if glob.glob(f"{out}/*.parquet") else []
            if len(got) >= n:
                return got
            time.sleep(0.3)
        return got

    try:
        assert rows(1)[:1] == [(2, 2, 3)]
        start = time.time()
        assert rows(3) == [(1, 1, None), (2, 2, 3), (4, 4, None)] and time.time() - start < 50
        late = [p(5, "A", T - 40), p(6, "R", T - 45, dns_id=8), p(7, "A", T - 44, dns_id=8), p(8, "R", T - 60, dns_id=5)]
        table(spark, late).write.mode("append").parquet(source)
        assert rows(6) == [(1, 1, None), (2, 2, 3), (4, 4, None), (5, None, 5), (6, 6, 7), (8, 8, None)]
    finally:
        job.stop()
        spark.conf.unset(name)


def test_reports_of_triggers(spark, tmp_path):
    """Counters of a stream add up to those of the batch; each trigger tells its lag."""
    made = packets(spark, SF)
    made.repartitionByRange(4, "seq").write.parquet(str(tmp_path / "in"))
    reports = Reports(clock=lambda: 2_000_000_000.0)
    spark.streams.addListener(reports)
    try:
        stream = spark.readStream.schema(made.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        job = observed(stream).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        job.awaitTermination()
        end = time.time() + 20
        want = stats.input_totals(made).first().asDict()
        while reports.total()["packets"] < want["packets"] and time.time() < end:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(reports)
    assert reports.total() == {c: want[c] for c in ("packets", "bytes", "dropped")} and len(reports.rows) == 4
    assert all(r["lag_sec"] == 2_000_000_000.0 - r["last_us"] / 1e6 for r in reports.rows)
