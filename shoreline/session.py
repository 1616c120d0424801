"""Session settings that suit these plans."""

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    # The JVM does not compile methods above 8000 bytes of bytecode.  Past that
    # size Spark then falls back to generating several smaller methods.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def builder(app: str = "shoreline") -> SparkSession.Builder:
    b = SparkSession.builder.appName(app)
    for key, value in SETTINGS.items():
        b = b.config(key, value)
    return b
