"""Long files as blocks of lines: what a line takes over from the lines above it.

A file of very many lines must not be one window.  Its lines are dealt over blocks of
``BLOCK`` lines, a block is reduced to what it passes on, the blocks of a file (one small
row each) are put together in order, and every block gets what comes in from above.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shoreline import schema

#: Lines in a block.
BLOCK = 10_000


def _file_key(df: DataFrame) -> Column:
    # a struct compares absent projects as equal
    return F.struct(*schema.scope_columns(df), "file")


def in_blocks(lines: DataFrame, block: int = BLOCK) -> DataFrame:
    """Add the file's key ``_f`` and the block ``_b`` of each line."""
    return lines.withColumns({"_f": _file_key(lines), "_b": F.floor((F.col("line_no") - 1) / block)})


def inside() -> W:
    """From the first line of a block to the current one."""
    return W.partitionBy("_f", "_b").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)


def _earlier() -> W:
    return W.partitionBy("_f").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)


def _with_incoming(df: DataFrame, incoming: DataFrame) -> DataFrame:
    return df.join(incoming, ["_f", "_b"], "left")


def last_above(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Add the last value that is not NULL at or above each line of its file, under each name."""
    local = df.withColumns({n: F.last(v, ignorenulls=True).over(inside()) for n, v in values.items()})
    ends = local.groupBy("_f", "_b").agg(*[F.max_by(n, "line_no").alias(n) for n in values])
    incoming = ends.select("_f", "_b", *[
        F.last(n, ignorenulls=True).over(_earlier()).alias(f"_{n}_in") for n in values])
    full = _with_incoming(local, incoming)
    return full.withColumns({n: F.coalesce(n, f"_{n}_in") for n in values}).drop(*[f"_{n}_in" for n in values])


def switch_above(df: DataFrame, sets: Column, flips: Column, name: str) -> DataFrame:
    """Add a switch as it stands above each line.

    A line sets it (``sets`` is 0 or 1), turns it over (``flips``) or leaves it.  What a
    block does to the switch is again one of these: it sets it, or turns it over or not.
    So the blocks' effects compose like those of the lines, and the switch at a line is
    the last value set, turned over as often as turns came since.
    """
    local = df.withColumn("_turn", flips.cast("int")).withColumn("_set", sets.cast("int"))
    local = local.withColumn("_turns", F.sum("_turn").over(inside()) % 2)
    local = local.withColumn("_raw", F.last(
        F.when(F.col("_set").isNotNull(), F.col("_set").bitwiseXOR(F.col("_turns").cast("int"))),
        ignorenulls=True).over(inside()))
    ends = local.groupBy("_f", "_b").agg(
        F.max_by("_turns", "line_no").cast("int").alias("turns"), F.max_by("_raw", "line_no").alias("raw"))
    # a block that sets leaves raw xor turns; one that does not turns what it gets
    total = F.sum("turns").over(_earlier().rowsBetween(W.unboundedPreceding, 0)) % 2
    placed = ends.withColumn("all", total.cast("int")).withColumn(
        "base", F.when(F.col("raw").isNotNull(), F.col("raw").bitwiseXOR(F.col("turns")).bitwiseXOR(F.col("all"))))
    turned = F.coalesce(F.sum("turns").over(_earlier()), F.lit(0)) % 2
    base = F.coalesce(F.last("base", ignorenulls=True).over(_earlier()), F.lit(0))
    incoming = placed.select("_f", "_b", base.bitwiseXOR(turned.cast("int")).alias("_in"))
    full = _with_incoming(local, incoming)
    after = F.coalesce("_raw", "_in").bitwiseXOR(F.col("_turns").cast("int"))
    above = W.partitionBy("_f", "_b").orderBy("line_no")
    full = full.withColumn("_after", after)
    return full.withColumn(name, F.coalesce(F.lag("_after").over(above), F.col("_in")) == 1).drop(
        "_turn", "_set", "_turns", "_raw", "_in", "_after")
