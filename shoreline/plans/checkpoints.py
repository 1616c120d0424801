"""Cut long lineages where a step is read more than once, in the folder all executors share."""

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, set as the session's checkpoint folder.

    Where the session names none, one on this machine gets a folder; a cluster, whose
    executors would not see it, is refused.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="shoreline-"))
    return (named or context.getCheckpointDir()).rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark)}/{what}-{os.urandom(8).hex()}"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df`` in the shared folder.

    Checkpoint files survive the loss of executors, unlike cached blocks.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
