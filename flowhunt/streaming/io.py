"""Streaming sources and sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from flowhunt.functions.columns import nan_to_null
from flowhunt.schemas import FLOW, PACKET
from flowhunt.sources.files import cast_to, text_times
from flowhunt.sources.store import HIDDEN, exists, publish, remove

EXPORT_INTERVAL = "30 seconds"
ROWS_PER_FILE = 10_000  # flows of one JSON array


def read_packet_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Packet files as they arrive."""
    reader = spark.readStream.schema(PACKET)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def read_live_flows(spark: SparkSession, folder: str) -> DataFrame:
    """``flows_live_*.json`` as a collector drops them: JSON arrays with RFC 3339 times.

    Takes single files and the folders of :func:`drop_flow_files`. Drops that are not finished lie in a
    hidden folder and are not seen.
    """
    raw = spark.readStream.schema(text_times(FLOW)).option("multiLine", True).json(f"{folder}/flows_live_*.json")
    return nan_to_null(cast_to(raw, FLOW))


def drop_flow_files(folder: str, rows_per_file: int = ROWS_PER_FILE) -> Callable[[DataFrame, int], None]:
    """Batch handler: the flows of a batch as JSON arrays below ``flows_live_<batch>.json``, exactly once.

    The arrays are written to a hidden folder, which one rename publishes whole. A batch that is given again
    after a failure finds its folder and writes nothing, or replaces what it had not published. The store
    must rename folders atomically. Batches without flows leave nothing.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        _publish(batch, folder, f"{batch_id:010d}", rows_per_file)

    return handle


def drop_open_flows(flows: DataFrame, folder: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """The last drop of a stream that has ended: what its state still held. The checkpoint is not used again."""
    _publish(flows, folder, "final", rows_per_file)


def _publish(flows: DataFrame, folder: str, name: str, rows_per_file: int) -> None:
    spark = flows.sparkSession
    final, hidden = f"{folder}/flows_live_{name}.json", f"{folder}/{HIDDEN}/{name}"
    if exists(spark, final):
        return
    place = F.monotonically_increasing_id()
    times = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    rows = flows.select(
        F.shiftright(place, 33).alias("part"), F.floor(place.bitwiseAND(F.lit((1 << 33) - 1)) / rows_per_file).alias("chunk"),
        F.to_json(F.struct(*[f.name for f in FLOW.fields]), times).alias("flow"),
    )
    arrays = rows.groupBy("part", "chunk").agg(F.concat(F.lit("["), F.array_join(F.collect_list("flow"), ",\n"), F.lit("]")).alias("value"))
    arrays.select("value").write.mode("overwrite").option("maxRecordsPerFile", 1).text(hidden)
    if spark.read.text(hidden).isEmpty():
        remove(spark, hidden)
    else:
        publish(spark, hidden, final)


def run_to_table(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    interval: str | None = None,
    state_partitions: int | None = None,
) -> StreamingQuery:
    """Append to a Parquet table: every ``interval``, or everything available and stop.

    The number of state partitions is fixed by the first start of a checkpoint.
    """
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", path)
    return _start(writer, stream.sparkSession, checkpoint, interval, state_partitions)


def run_batches(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = None,
    state_partitions: int | None = None,
) -> StreamingQuery:
    """Call ``handle`` per micro-batch; it must tolerate being given a batch twice."""
    return _start(stream.writeStream.foreachBatch(handle), stream.sparkSession, checkpoint, interval, state_partitions)


def _start(
    writer: DataStreamWriter, spark: SparkSession, checkpoint: str, interval: str | None, state_partitions: int | None
) -> StreamingQuery:
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    writer = writer.option("checkpointLocation", checkpoint).trigger(**trigger)
    if state_partitions is None:
        return writer.start()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", state_partitions)
    try:
        return writer.start()  # the query keeps its own copy of the settings
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def clock_packet(spark: SparkSession, ts: str) -> DataFrame:
    """One packet of a flow of its own that moves the watermark, to close what is still open.

    Sessions and windows end when event time passes them. At the end of a finite input nothing
    does, so a shutdown appends this row; its own flow stays open.
    """
    row = spark.range(1).select(
        F.lit(-1).alias("packet_id"), F.lit(ts).cast("timestamp").alias("ts"), F.lit("clock").alias("src_ip"),
        F.lit("clock").alias("dst_ip"), F.lit(0).alias("src_port"), F.lit(0).alias("dst_port"),
        F.lit("TCP").alias("protocol"), F.lit(0).alias("length"), F.lit(None).alias("dns_query"),
    )
    return row.select(*[F.col(f.name).cast(f.dataType) for f in PACKET.fields])
