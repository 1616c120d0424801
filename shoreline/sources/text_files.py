"""Source text, ignore files, binary artifacts and JSON documents."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoreline import schema
from shoreline.functions.text import contains_any, strip
from shoreline.rules import files
from shoreline.sources.declarations import extract_constants
from shoreline.sources.json_text import flatten_json_kv

__all__ = [
    "extract_constants", "flatten_json_kv", "load_artifact_bytes", "load_ignore_patterns", "load_source_files",
    "load_source_lines", "parse_ignore_patterns", "skipped_files", "split_lines",
]


def _in_skipped_dir(path):
    return contains_any(path, [f"/{d}/" for d in files.SKIPPED_DIRS])


def _listed(spark: SparkSession, path, glob: str) -> DataFrame:
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob).load(path).where(~_in_skipped_dir(F.col("path")))
    )


def skipped_files(spark: SparkSession, path, max_bytes: int, glob: str = "*") -> DataFrame:
    """``(file, length)`` of the files that a limit of ``max_bytes`` leaves out."""
    return _listed(spark, path, glob).where(F.col("length") > max_bytes).select(
        F.col("path").alias("file"), "length")


def load_source_files(
    spark: SparkSession, path, max_bytes: int | None = None, glob: str = "*",
    project: str | Column | None = None,
) -> DataFrame:
    """Text files as ``(file, content)``; vendored folders are left out.

    ``project`` adds the scan they belong to: a name, or a Column over ``file`` that reads
    it from the path, so that many projects can be read at once.  With ``max_bytes`` larger files are left out too (:func:`skipped_files` lists them);
    the limit is applied to file metadata, before any content is read.
    """
    listing = _listed(spark, path, glob)
    if max_bytes is not None:
        listing = listing.where(F.col("length") <= max_bytes)
    return schema.in_project(listing.select(
        F.col("path").alias("file"),
        F.try_validate_utf8(F.col("content").cast("string")).alias("content"),
    ), project)


def split_lines(df: DataFrame) -> DataFrame:
    """``(file, content)`` to ``(file, line_no, text)``, numbered from 1; ``project`` is kept."""
    lines = F.split(F.col("content"), r"\r\n|\r|\n")
    keep = [*schema.scope_columns(df), "file"]
    return df.select(*keep, F.posexplode(lines).alias("_i", "text")).select(
        *keep, (F.col("_i") + 1).alias("line_no"), "text"
    )


def load_source_lines(
    spark: SparkSession, path, max_bytes: int | None = None, project: str | Column | None = None
) -> DataFrame:
    return split_lines(load_source_files(spark, path, max_bytes, project=project))


def load_artifact_bytes(
    spark: SparkSession, path, max_bytes: int | None = None, project: str | Column | None = None
) -> DataFrame:
    """Binary artifacts as ``(path, length, content)``; up to a size, if one is given.

    :func:`skipped_files` lists what a size leaves out.  ``project`` adds the scan they
    belong to, by name or as a Column over ``path``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if max_bytes is not None:
        files = files.where(F.col("length") <= max_bytes)
    return schema.in_project(files.select("path", "length", "content"), project)


def parse_ignore_patterns(lines: DataFrame) -> DataFrame:
    """Trimmed patterns in file order, without blank and comment lines."""
    text = strip(F.col("line"))
    return lines.where((text != "") & ~text.startswith("#")).select(
        *schema.scope_columns(lines), "src_file", "src_block", "row_no", text.alias("pattern")
    )


def load_ignore_patterns(spark: SparkSession, path) -> DataFrame:
    from shoreline.sources.lines import read_lines

    return parse_ignore_patterns(read_lines(spark, path))
