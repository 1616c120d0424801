"""Key/value settings of properties, env and INI files."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoreline import schema
from shoreline.functions.text import blank_to_null, strip, strip_left
from shoreline.sources.spread import in_blocks, last_above, switch_above
from shoreline.sources.text_files import split_lines

COMMENTS = {"properties": ["#", "!"], "ini": ["#", ";"]}


def config_sections(lines: DataFrame) -> DataFrame:
    """Add ``section``: the last ``[name]`` header above each line of its file.

    The lines of a file are dealt over blocks, so a file of any length is spread.
    """
    placed = last_above(in_blocks(lines), {"section": _header(strip(F.col("text")))})
    return placed.select(*lines.columns, "section")


def _header(text: Column) -> Column:
    """Name inside ``[...]``, NULL on other lines."""
    return F.when(text.rlike(r"^\[[^\]]*\]"), strip(F.regexp_extract(text, r"^\[([^\]]*)\]", 1)))


def _with_continuation(lines: DataFrame, skipped: Column) -> DataFrame:
    """Add ``_inside``: the line continues an entry begun above it.

    Reading a file top to bottom, each line either sets that state (an entry
    that ends in a backslash begins one, any other entry ends it), keeps it (a
    comment that ends in a backslash), or flips it (an entry with blanks after
    the backslash begins one, but does not go on with one).
    """
    text = F.col("text")
    opens = strip(text).endswith("\\") & ~skipped
    goes_on = text.endswith("\\")
    flips = opens & ~goes_on
    keeps = goes_on & skipped
    return switch_above(lines, F.when(~flips & ~keeps, goes_on.cast("int")), flips, "_inside")


def _entries(lines: DataFrame, comments: list, has_sections: bool) -> DataFrame:
    """Entries with continuations glued on: ``(file, line_no, section, text)``.

    An entry is known by the line it begins at.  Its pieces are put together in one
    row, which is the length of one value.
    """
    keep = [*schema.scope_columns(lines), "file"]
    stripped = strip(F.col("text"))
    skipped = (stripped == "") | F.substring(stripped, 1, 1).isin(comments)
    if has_sections:
        skipped = skipped | stripped.startswith("[")
    staged = _with_continuation(in_blocks(lines), skipped)
    header = F.when(~F.col("_inside") & F.lit(has_sections), _header(stripped))
    begins = ~F.col("_inside") & ~skipped
    piece = F.regexp_replace(
        F.when(F.col("_inside"), strip_left(F.col("text"), " \t")).otherwise(stripped), r"\\$", "")
    staged = last_above(
        staged.withColumns({"_begins": begins, "_piece": piece}),
        {"section": header, "_entry": F.when(begins, F.col("line_no"))})
    pieces = staged.where(F.col("_inside") | F.col("_begins"))
    return pieces.groupBy(*keep, "_entry").agg(
        F.min("line_no").alias("line_no"),
        F.min_by("section", "line_no").alias("section"),
        F.array_sort(F.collect_list(F.struct("line_no", "_piece"))).alias("_p"),
    ).select(*keep, "line_no", "section", F.array_join(F.col("_p._piece"), "").alias("text"))


def _split_pair(text: Column):
    """Key and value around the first ``=`` or ``:``; NULL key when there is none."""
    key = F.when(text.rlike("[=:]"), strip(F.regexp_extract(text, "(?s)^([^=:]*)[=:]", 1)))
    return key, strip(F.regexp_extract(text, r"(?s)^[^=:]*[=:](.*)$", 1))


def _unquote(value: Column, comments: list, drop_open_quote: bool) -> Column:
    """Text inside leading quotes; otherwise the value without a trailing comment."""
    plain = F.when(F.lit(False), value)
    for mark in comments:
        plain = plain.when(
            value.contains(f" {mark}"), strip(F.substring_index(value, f" {mark}", 1))
        )
    out = F.when(F.lit(False), value)
    for q in ('"', "'"):
        opened = (F.length(value) >= 2) & value.startswith(q)
        closed = value.rlike(f"(?s)^{q}[^{q}]*{q}")
        out = out.when(opened & closed, F.regexp_extract(value, f"(?s)^{q}([^{q}]*){q}", 1))
        out = out.when(opened, F.substr(value, F.lit(2)) if drop_open_quote else value)
    return out.otherwise(plain.otherwise(value))


def load_config_kv(lines: DataFrame, fmt: str) -> DataFrame:
    """Settings ``(file, key, value, line)`` of lines ``(file, line_no, text)``.

    ``fmt`` is ``properties``, ``env`` or ``ini``.  A column ``project`` is kept.  What a
    line takes over from those above it comes through blocks of lines, so one long file
    is read by many tasks.
    """
    if fmt == "properties":
        entries = _entries(lines, COMMENTS[fmt], has_sections=False)
        key, value = _split_pair(F.col("text"))
    elif fmt == "ini":
        entries = _entries(lines, COMMENTS[fmt], has_sections=True)
        key, value = _split_pair(F.col("text"))
        key = F.when(
            key != "", F.concat_ws(".", blank_to_null(F.col("section")), key)
        )
        value = _unquote(value, [";", "#"], drop_open_quote=False)
    elif fmt == "env":
        text = strip(F.col("text"))
        entries = lines.where((text != "") & ~text.startswith("#"))
        key, value = _split_pair(strip(F.regexp_replace(text, "(?i)^export ", "")))
        value = _unquote(value, ["#"], drop_open_quote=True)
    else:
        raise ValueError(f"unknown config format {fmt!r}")
    return entries.select(
        *schema.scope_columns(lines), "file", key.alias("key"), value.alias("value"), F.col("line_no").alias("line")
    ).where(F.col("key").isNotNull())


def read_config_kv(files: DataFrame, fmt: str) -> DataFrame:
    """As :func:`load_config_kv`, from whole files ``(file, content)``."""
    return load_config_kv(split_lines(files), fmt)
