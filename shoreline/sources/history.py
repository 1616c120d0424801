"""Scan history and cache snapshots."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoreline.operators.history import last_n_scans
from shoreline.schema import FINDING

HISTORY_TYPE = (
    "project string, scan_seq bigint, timestamp string, score int, grade string, total bigint, "
    "critical bigint, high bigint, medium bigint, low bigint, info bigint, vulnerable bigint, "
    "weakened bigint, safe bigint, resistant bigint, deprecated bigint"
)
_FINDING_TYPE = "struct<" + ",".join(f"{c}:{t}" for c, t in FINDING.items()) + ">"
CACHE_TYPE = (
    "engine_version string, path string, content_hash string, "
    f"findings array<{_FINDING_TYPE}>, engine string"
)


def load_scan_history(spark: SparkSession, path, limit: int | None = None) -> DataFrame:
    """Records of all projects, in no order; only the last ``limit`` of each project if given."""
    history = spark.read.schema(HISTORY_TYPE).json(path)
    counts = [c for c, t in history.dtypes if t in ("bigint", "int") and c != "scan_seq"]
    history = history.na.fill(0, counts)
    return last_n_scans(history, limit) if limit else history


def load_cache_snapshot(spark: SparkSession, path, engines: list | None = None) -> DataFrame:
    """Cached findings per feed and file; only the asked feeds' folders are read."""
    cache = spark.read.schema(CACHE_TYPE).parquet(path)
    return cache.where(F.col("engine").isin(engines)) if engines else cache
