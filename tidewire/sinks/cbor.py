"""Records as a CBOR sequence: an array of names, then an array for each record.

``read`` and ``write`` are a Python data source ``cborseq``. A written file is
one partition's records; it is named on commit, and none is left of an empty
partition.
"""

from __future__ import annotations

import gzip
import json
import os

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions.cbor import encode, stream_items
from ..plans.schema import columns
from ..sources.pcap import list_files


def encoded(records: DataFrame, flags=None) -> DataFrame:
    """(seq, cbor) of projected records."""
    names = columns(flags, cbor=True)

    def run(batches):
        for batch in batches:
            columns_ = [batch.column(n).to_pylist() for n in names]
            rows = pa.array([encode(row) for row in zip(*columns_)] if columns_ else [], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("seq"), rows], ["seq", "cbor"])

    return records.select("seq", *[n for n in names if n != "seq"]).mapInArrow(run, "seq long, cbor binary")


class CborPartition(InputPartition):
    def __init__(self, number, path):
        self.number, self.path = number, path


class CborReader(DataSourceReader):
    def __init__(self, options):
        self.files = list_files(options["path"])

    def partitions(self):
        return [CborPartition(k, p) for k, p in enumerate(self.files)]

    def read(self, partition):
        with (gzip.open if partition.path.endswith(".gz") else open)(partition.path, "rb") as file:
            for k, item in enumerate(stream_items(file.read)):
                yield (partition.number, k, json.dumps(item, default=lambda b: {"hex": b.hex()}))


class CborWriter(DataSourceWriter):
    def __init__(self, options):
        self.path, self.header = options["path"].removeprefix("file://"), options.get("header", "")
        self.gzip = options.get("compression", "none") == "gzip"
        os.makedirs(self.path, exist_ok=True)

    def write(self, iterator):
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}.cbor" + ".gz" * self.gzip
        temporary, n = os.path.join(self.path, f"_{name}.{task.taskAttemptId()}"), 0
        with (gzip.open if self.gzip else open)(temporary, "wb") as file:
            if self.header:
                file.write(encode(self.header.split(",")))
            for row in iterator:
                file.write(bytes(row["cbor"]))
                n += 1
        return CborWritten(temporary, os.path.join(self.path, name), n)

    def commit(self, messages):
        for m in filter(None, messages):
            os.replace(m.temporary, m.final) if m.n else os.unlink(m.temporary)
        if not os.listdir(self.path):
            os.rmdir(self.path)

    def abort(self, messages):
        for m in filter(None, messages):
            os.unlink(m.temporary)


class CborWritten(WriterCommitMessage):
    def __init__(self, temporary, final, n):
        self.temporary, self.final, self.n = temporary, final, n


class CborSource(DataSource):
    @classmethod
    def name(cls):
        return "cborseq"

    def schema(self):
        return "file int, number long, item string"

    def reader(self, schema):
        return CborReader(self.options)

    def writer(self, schema, overwrite):
        return CborWriter(self.options)


def write(records: DataFrame, path: str, flags=None, compression: str = "none") -> None:
    """Write projected records in order of ``seq``; nothing is left of an empty run."""
    records.sparkSession.dataSource.register(CborSource)
    rows = encoded(records, flags).sortWithinPartitions("seq").select("cbor")
    rows.write.format("cborseq").option("header", ",".join(columns(flags, cbor=True))).option("compression", compression).mode("append").save(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, item): every item of the sequences, as JSON text; byte strings as {"hex": ...}."""
    spark.dataSource.register(CborSource)
    return spark.read.format("cborseq").load(path)
