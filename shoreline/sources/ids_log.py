"""TLS events of an intrusion-detection log (NDJSON)."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoreline.functions import tls as X
from shoreline.functions.text import blank_to_null
from shoreline.operators.known import once
from shoreline.operators.metrics import unwatched
from shoreline.sources.lines import PLACE, read_lines

EVENT = (
    "timestamp string, event_type string, dest_ip string, dest_port int, "
    "tls struct<version:string,cipher_suite:string,sni:string,"
    "ja3:struct<hash:string>,ja3s:struct<hash:string>,sigalgs:string,groups:string>, "
    "_bad string"
)


def parse_eve(lines: DataFrame, watch=unwatched) -> DataFrame:
    """TLS records of the log; other events and torn lines are dropped, and torn ones with
    something of TLS in them counted by a watch.

    The substring test is only there to skip JSON parsing of other events; the
    exact test follows it.
    """
    read = once(
        lines.where(F.col("line").contains('"tls"')),
        F.from_json(F.col("line"), EVENT, {"columnNameOfCorruptRecord": "_bad"}), "_e")
    parsed = watch(read, "lines", malformed=F.col("_e._bad").isNotNull()).where(
        F.col("_e._bad").isNull() & (F.col("_e.event_type") == "tls") & F.col("_e.tls").isNotNull()
    )
    extra = [c for c in ("ts_received",) if c in lines.columns]
    t = "_e.tls."
    return parsed.select(
        "src_file", *PLACE, *extra,
        F.col("_e.timestamp").alias("event_time"),
        blank_to_null(F.col("_e.dest_ip")).alias("dest_ip"),
        F.coalesce(F.col("_e.dest_port"), F.lit(0)).cast("string").alias("dest_port"),
        blank_to_null(F.col(t + "cipher_suite")).alias("cipher"),
        blank_to_null(F.col(t + "version")).alias("version"),
        blank_to_null(F.col(t + "sni")).alias("sni"),
        X.valid_ja3(F.col(t + "ja3.hash")).alias("ja3"),
        X.valid_ja3(F.col(t + "ja3s.hash")).alias("ja3s"),
        blank_to_null(F.col(t + "sigalgs")).alias("sigalgs"),
        blank_to_null(F.col(t + "groups")).alias("groups"),
    )


def scan_suricata_eve(spark: SparkSession, path) -> DataFrame:
    return parse_eve(read_lines(spark, path))
