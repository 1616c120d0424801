"""Rule tables as DataFrames."""

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TYPES = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}


def literal_table(spark: SparkSession, rows: list, columns: str) -> DataFrame:
    """A fixed table as a local scan inside the plan: no job and no Python worker.

    ``columns`` is ``"name type, ..."`` with types string, int and boolean.
    """
    names = [c.split() for c in columns.split(",")]
    arrays = [
        pa.array([row[i] for row in rows], type=_TYPES[t]) for i, (_, t) in enumerate(names)
    ]
    return spark.createDataFrame(pa.table(arrays, names=[n for n, _ in names]))


def side_by_side(*one_row_frames: DataFrame) -> DataFrame:
    """One row with the columns of several one-row frames, such as global totals."""
    rows = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), one_row_frames
    )
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])
