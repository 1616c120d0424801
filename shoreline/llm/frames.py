"""Small helpers that the operators of this package share."""

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where the session names none, one on this machine is made and set; a cluster, whose
    executors would not see it, is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not named:
        named = tempfile.mkdtemp(prefix="shoreline-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    """A path of its own in the shared folder, removed when the session ends."""
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = new_folder(spark, what)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(schema).parquet(path)
    table._stored_at = path
    return table


def stored_with(df: DataFrame, what: str, **sums: Column) -> tuple[DataFrame, dict[str, int]]:
    """As :func:`stored`, with sums over the rows taken while they are written; none of no rows."""
    seen = Observation()
    table = stored(df.observe(seen, *[c.alias(n) for n, c in sums.items()]), what)
    try:
        return table, dict(seen.get)
    except Py4JJavaError:
        # adaptive execution leaves out what has no rows, and its sums with it
        return table, {}


def forget(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more; what depends on them must be stored itself."""
    for table in tables:
        jvm = table.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(table._stored_at)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, for the Python functions."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="shoreline-code-"), "shoreline_llm.zip")
    with zipfile.ZipFile(path, "w") as z:
        z.write(os.path.join(top, "__init__.py"), "shoreline/__init__.py")
        for name in sorted(os.listdir(os.path.join(top, "llm"))):
            if name.endswith(".py"):
                z.write(os.path.join(top, "llm", name), f"shoreline/llm/{name}")
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches cut small, so that only what is made of a few texts is held at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def own_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have yet, whatever the case rules are."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = "_" + stem
    return stem


def text_keys(text: Column) -> list[Column]:
    """Two independent 64-bit hashes: together they stand for a text."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(77), text).alias("k2")]


def numbered(df: DataFrame, groups: list[str], order: list[str], name: str, rows: int,
             slice_rows: int = 20_000) -> DataFrame:
    """Number the rows of each group from 0 without gaps, in a fixed pseudo-random order.

    ``rows`` is the number of rows of ``df``.  A group is dealt over hash slices of
    about ``slice_rows`` rows, so that a group of any size is spread over tasks; only
    the counts of the slices are summed up in order.  Rows that agree in all of
    ``order`` are interchangeable.
    """
    slices = max(1, -(-rows // slice_rows))
    # reading the hash as two halves keeps the slices even when `groups` came from the same hash
    cut = F.pmod(F.xxhash64(F.lit(1013), *order), F.lit(slices))
    df = df.withColumn("_slice", cut)
    sizes = df.groupBy(*groups, "_slice").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        *[F.col(g).alias(f"_{g}") for g in groups], F.col("_slice").alias("_at"),
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy(*groups, "_slice").orderBy(F.xxhash64(F.lit(2027), *order), *order)
    ranked = df.withColumn("_rank", F.row_number().over(inside) - 1)
    same = ranked["_slice"] == sizes["_at"]
    for g in groups:
        same = same & (ranked[g] == sizes[f"_{g}"])
    return (ranked.join(sizes, same)
            .withColumn(name, F.col("_first") + F.col("_rank"))
            .drop("_slice", "_rank", "_first", "_at", *[f"_{g}" for g in groups]))
