"""Command line: ``python -m tidewire.cli -C settings -o out file...``

With ``-i folder`` instead of files, the capture files of a folder into which a
capture tool writes are followed as they come, until the stream is stopped. An
output of ``-`` is standard output.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .functions.wire import decode
from .operators.arrival import in_order
from .operators.dump import limited
from .operators.match import match, match_fold
from .operators.project import project
from .plans.config import Config, parse
from .plans.session import shared_root, written
from .sinks import cbor, csv
from .sources import pcap
from .streaming.match import match_stream_rows
from .streaming.metrics import Reports, observed


#: Windows of a time slice.
SLICES = 64


def arguments(argv=None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description="Pair DNS requests with responses from capture files.")
    parser.add_argument("-C", "--config", help="file of settings")
    parser.add_argument("-i", "--input", help="folder of capture files that grows")
    parser.add_argument("-o", "--output", help="folder to write to, or - for standard output")
    parser.add_argument("files", nargs="*", help="capture files, read in this order")
    args = parser.parse_args(argv)
    if args.input and args.files:
        parser.error("a live input and files can't be given together")
    if not args.files and not args.input:
        parser.error("no input")
    return args


def run(spark: SparkSession, files: list[str], out: str, config: Config) -> None:
    """Files to records: read, filter, decode, dump what is invalid, match, project, write."""
    frames = decode(pcap.read(spark, ",".join(files), config.input_snaplen, config.input_filter))
    # Decoded once. Captured bytes are needed of invalid packets alone, for the dump.
    raw = F.when(F.col("drop_reason").isNotNull() & F.lit(bool(config.dump_path_fmt)), F.col("raw"))
    frames = written(frames.drop("payload").withColumn("raw", raw), "decoded")
    window = int(config.match_window * 1e6)
    # Slices spread a hot key over tasks, where times rise.
    slice_us = SLICES * window if in_order(frames) else None
    pairs = (match_fold if config.match_qname else match)(frames.drop("raw"), window, slice_us=slice_us)
    write(pairs, out, config)
    if config.dump_path_fmt:
        bad = frames.filter("drop_reason is not null")
        kept = limited(bad, config.dump_rate_limit, config.dump_period or 600).filter("admitted").select("seq")
        pcap.write(bad.join(kept, "seq"), config.dump_path_fmt, config.dump_compress_type, config.dump_compress_level)


#: Commands that an output may be piped through, as compression.
PIPES = {"gzip": "gzip", "pigz": "gzip", "bzip2": "bzip2"}


def write(pairs: DataFrame, out: str, config: Config) -> None:
    records = project(pairs, config.output_fields, config.output_type == "cbor")
    command = (config.output_pipe_cmd.split() or [""])[0]
    if command and command not in PIPES or command == "bzip2" and config.output_type == "cbor":
        raise ValueError(f"an output can't be piped through {command!r}; known are {', '.join(PIPES)}")
    if config.output_type == "cbor":
        cbor.write(records, out, config.cbor_fields, PIPES.get(command, "none"))
    elif out == "-":
        csv.show(records, config.csv_fields, config.csv_separator, bool(config.csv_inline_header))
    else:
        csv.write(records, out, config.csv_fields, config.csv_separator, bool(config.csv_inline_header), config.output_period, compression=PIPES.get(command), header_path=config.csv_external_header_path_fmt or None)


#: Beyond the window, how long a request waits for an answer that is still on its way (microseconds).
GRACE = 100_000


def follow(spark: SparkSession, folder: str, out: str, config: Config, settle: float = 10) -> StreamingQuery:
    """The stream of records of a folder's capture files; each batch with records is a folder of its own in ``out``."""
    frames = pcap.read_stream(spark, folder, config.input_snaplen, config.input_filter, settle)
    packets = observed(decode(frames)).drop("raw", "payload")
    pairs = match_stream_rows(packets, int(config.match_window * 1e6), bool(config.match_qname), idle_us=GRACE)

    def batch(pairs: DataFrame, number: int) -> None:
        # The same batch again replaces what it wrote before.
        write(pairs, out if out == "-" else f"{out}/batch={number}", config)

    every = f"{max(1, int(config.max_frame_duration * 1000))} milliseconds"
    return pairs.writeStream.foreachBatch(batch).option("checkpointLocation", f"{shared_root(spark)}/follow").trigger(processingTime=every).start()


def main(argv=None) -> None:
    args = arguments(argv)
    config = Config()
    if args.config:
        with open(args.config) as file:
            config = parse(file.read())
    out = args.output or config.output_path_fmt
    if not out:
        raise SystemExit("no output path")
    spark = SparkSession.builder.appName("tidewire").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.input:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        reports = Reports()
        spark.streams.addListener(reports)
        follow(spark, args.input, out, config).awaitTermination()
    else:
        run(spark, args.files, out, config)


if __name__ == "__main__":
    main()
