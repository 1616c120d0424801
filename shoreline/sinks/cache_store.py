"""The findings cache as one partitioned table that a scan brings up to date in place.

Entries are partitioned by feed and by a bucket of their path.  A scan reads and writes
only the partitions in which something changed, by dynamic partition overwrite; the files
of the others are not touched.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoreline.operators.cache import updated_cache
from shoreline.plans.checkpoints import cut
from shoreline.sources.history import CACHE_TYPE

BUCKETS = 64
_STORED = CACHE_TYPE + ", bucket int"


def bucket_of(path: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_cache(spark: SparkSession, path: str, engines: list | None = None) -> DataFrame:
    """Entries of the cache, empty where there is none yet; only the asked feeds' folders are read."""
    if not _exists(spark, path):
        return spark.createDataFrame([], CACHE_TYPE)
    # a partition whose entries are all gone holds one row without a path
    stored = spark.read.schema(_STORED).parquet(path).where("path is not null")
    return (stored.where(F.col("engine").isin(engines)) if engines else stored).drop("bucket")


def refresh_cache(
    fresh: DataFrame, current_paths: DataFrame, path: str, mode: str = "full", buckets: int = BUCKETS
) -> None:
    """Bring the cache at ``path`` up to date after a scan.

    ``fresh`` are the entries of scanned files, as :func:`updated_cache` takes them.  In a
    full scan entries of files that are not among ``current_paths`` go.  ``buckets`` must
    stay the same for a cache.  What is written is checkpointed first, so a task that is run
    again does not need the files it replaces.
    """
    spark = fresh.sparkSession
    exists = _exists(spark, path)
    fresh = cut(fresh.select(*[F.col(c.split(" ")[0]) for c in _fields()]))
    old = read_cache(spark, path).withColumn("bucket", bucket_of(F.col("path"), buckets))
    if exists:
        old = spark.read.schema(_STORED).parquet(path).where("path is not null")
    touched = fresh.select("engine", bucket_of(F.col("path"), buckets).alias("bucket"))
    if mode == "full":
        gone = old.select("engine", "bucket", "path").join(current_paths.select("path").distinct(), "path", "left_anti")
        touched = touched.unionByName(gone.select("engine", "bucket"))
    # at most a row for each feed and bucket
    touched = cut(touched.distinct())
    held = old.join(F.broadcast(touched), ["engine", "bucket"], "left_semi").drop("bucket")
    rows = updated_cache(held, fresh, current_paths, mode).withColumn("bucket", bucket_of(F.col("path"), buckets))
    if exists:
        rows = cut(rows)
    emptied = touched.join(rows.select("engine", "bucket").distinct(), ["engine", "bucket"], "left_anti")
    whole = rows.unionByName(emptied, allowMissingColumns=True).select(*rows.columns)
    (whole.repartition("engine", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("engine", "bucket").parquet(path))


def _fields() -> list[str]:
    return ["engine_version", "path", "content_hash", "findings", "engine"]
