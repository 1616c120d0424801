"""Text files as rows of lines that remember their place."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoreline import schema
from shoreline.functions.text import strip, strip_left

# Order of a line inside its file: byte offset of the split, then row in it.
PLACE = ["src_block", "row_no"]


#: Rows of a compressed file that count as one of its blocks.
GZIP_ROWS = 100_000


def read_lines(spark: SparkSession, path, project: str | Column | None = None, **options) -> DataFrame:
    """Lines as ``(src_file, src_block, row_no, line)``.

    A split file is read by several tasks, so ``row_no`` counts within a split and
    ``src_block`` (where the split starts) comes first in the order.  A gzip file is
    unpacked by one task; its rows get their numbers there, count as blocks of
    ``GZIP_ROWS`` rows and are dealt over tasks before anything else is done with them.
    ``project`` adds the scan the lines belong to, by name or as a Column over
    ``src_file``.
    """
    read = spark.read.options(**options).text(path)
    packed = F.col("_metadata.file_path").endswith(".gz")

    def rows(df: DataFrame, block: Column) -> DataFrame:
        return df.select(
            F.col("_metadata.file_path").alias("src_file"), block.alias("src_block"),
            F.monotonically_increasing_id().alias("row_no"),
            F.rtrim(F.col("value"), F.lit("\r")).alias("line"),
        )

    names = read.inputFiles()
    plain = rows(read.where(~packed) if any(n.endswith(".gz") for n in names) else read, F.col("_metadata.file_block_start"))
    if any(n.endswith(".gz") for n in names):
        # the upper bits of the number are the task's
        in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        unpacked = rows(read.where(packed), F.floor(in_task / GZIP_ROWS)).repartition("src_file", "src_block")
        plain = plain.unionByName(unpacked) if not all(n.endswith(".gz") for n in names) else unpacked
    return schema.in_project(plain, project)


def place() -> Column:
    """Orderable position of a row in its file."""
    return F.struct(*PLACE)


def first_sign() -> Column:
    """The first character of a line that is not blank, NULL without one."""
    return F.when(strip(F.col("line")) != "", F.substring(strip_left(F.col("line")), 1, 1))


def format_of(sign: Column) -> Column:
    """``tsv``, ``json`` or ``unknown`` by a file's first character that is not blank."""
    return F.when(sign == "#", "tsv").when(sign == "{", "json").otherwise("unknown")


def detect_log_format(lines: DataFrame) -> DataFrame:
    """``tsv``, ``json`` or ``unknown`` per file, by its first non-blank character."""
    blocks = lines.where(first_sign().isNotNull()).groupBy("src_file", "src_block").agg(
        F.min_by(first_sign(), "row_no").alias("c"))
    first = blocks.groupBy("src_file").agg(F.min_by("c", "src_block").alias("c"))
    return first.select("src_file", format_of(F.col("c")).alias("fmt"))
