"""The sensor-log plan as a stream: parse, first record per key, findings."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shoreline.operators import records as R
from shoreline.operators.classify import classify_findings
from shoreline.operators.metrics import unwatched
from shoreline.schema import conform
from shoreline.sources.ids_log import parse_eve
from shoreline.sources.sensor_logs import parse_ssl_json

KEYS = {
    "ssl": ["resp_host", "resp_port", "cipher", "curve", "pqc_key_share"],
    "eve": ["dest_ip", "dest_port", "cipher", "version", "sni"],
}


def stream_lines(spark: SparkSession, path, **options) -> DataFrame:
    """New text files under a folder as lines, stamped with their file's time."""
    return spark.readStream.options(**options).text(path).select(
        F.col("_metadata.file_path").alias("src_file"),
        F.col("_metadata.file_block_start").alias("src_block"),
        F.lit(0).cast("bigint").alias("row_no"),
        F.rtrim(F.col("value"), F.lit("\r")).alias("line"),
        F.col("_metadata.file_modification_time").alias("ts_received"),
    )


def stream_tls_logs(spark: SparkSession, path, fmt: str = "eve", watch=unwatched, **options) -> DataFrame:
    """Records of rotated NDJSON logs, parsed as in batch; malformed lines are dropped, and
    counted by a watch in the progress of the query."""
    lines = stream_lines(spark, path, **options)
    if fmt == "eve":
        return parse_eve(lines, watch)
    if fmt == "ssl":
        return parse_ssl_json(lines, watch)
    raise ValueError(f"unknown stream format {fmt!r}")


def stream_dedup(
    df: DataFrame, keys: list, watermark: str | None = None, time: str = "ts_received"
) -> DataFrame:
    """First record per key.

    Nothing is dropped for its age: the state holds a row for each key, dealt over the
    state partitions.  With a ``watermark`` the state is bounded, and records of files
    that are later than it are lost.
    """
    if watermark is None:
        return df.dropDuplicates(keys)
    return df.withWatermark(time, watermark).dropDuplicatesWithinWatermark(keys)


def findings_of(df: DataFrame, fmt: str) -> DataFrame:
    """Classified findings of a batch or stream of records; no state is involved."""
    rows = R.eve_record_to_findings(df) if fmt == "eve" else R.ssl_record_to_findings(df)
    return classify_findings(rows.withColumn("seq", F.col("row_no")))


def stream_findings(
    df: DataFrame, out: str, checkpoint: str, fmt: str = "eve", watermark: str | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Append classified findings of new records to parquet files.

    The file sink and its checkpoint make the output exactly-once when executors
    or the driver are lost.
    """
    first = stream_dedup(df, KEYS[fmt], watermark)
    result = conform(findings_of(first, fmt), derived=True)
    return (
        result.writeStream.format("parquet").outputMode("append")
        .option("path", out).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 minute"})).start()
    )
