"""Choose feeds and files; mark test and generated code."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoreline.functions.text import (
    base_name_of_path,
    contains_any,
    ends_with_any,
    extension,
    glob_to_regex,
    matches_regexes,
    relative_to,
    starts_with_any,
)
from shoreline.rules import files
from shoreline.tables import literal_table


def _exclude_regex(glob: str) -> str | None:
    glob = glob.lower()
    if glob.endswith("/*") or glob.endswith("/**"):
        # everything below the folder, at any depth; the folder is literal text
        return r"(?:.*/)?" + _quote(glob[: glob.rindex("/")]) + "/.*"
    piece = glob_to_regex(glob)
    return None if piece is None else "(?:.*/)?" + piece


def _quote(text):
    return "\\Q" + text + "\\E"


def excluded(path: Column, globs: list) -> Column:
    """``path`` matches an exclude glob as a whole, by its name or by a trailing part."""
    return matches_regexes(F.lower(path), [_exclude_regex(g) for g in globs])


def exclude_globs(df: DataFrame, globs: list, base: str | None = None) -> DataFrame:
    """Drop findings in excluded paths; the globs become one regex."""
    if not globs:
        return df
    return df.where(~F.coalesce(excluded(relative_to(F.col("file"), base), globs), F.lit(False)))


def _clean(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "/+", "/"), r"^(?:\./)+", "")


def filter_changed_files(df: DataFrame, changed: DataFrame, base: str | None = None) -> DataFrame:
    """Keep findings in changed files, and network findings, whose paths are not files.

    ``changed`` is ``(path)`` relative to ``base``.  No broadcast hint: a change
    list is usually short, and then Spark broadcasts it by its measured size.
    """
    paths = changed.select(_clean(F.col("path")).alias("_p")).distinct()
    synthetic = F.coalesce(F.col("file").startswith("("), F.lit(False))
    in_change = df.where(~synthetic).withColumn(
        "_path", _clean(relative_to(F.col("file"), base))
    ).join(paths, F.col("_path") == F.col("_p"), "left_semi").drop("_path")
    return df.where(synthetic).unionByName(in_change)


def engines_dim(spark) -> DataFrame:
    """The feeds: ``(engine, tier, engine_rank)``."""
    return literal_table(
        spark, [(name, tier, i) for i, (name, tier) in enumerate(files.FEEDS)],
        "engine string, tier int, engine_rank int",
    )


def filter_engines(
    df: DataFrame,
    engines_dim: DataFrame,
    names: list | None = None,
    mode: str = "full",
    scan_type: str = "source",
) -> DataFrame:
    """Findings of the feeds that a scan of this mode and type runs.

    ``diff`` and ``quick`` run pattern feeds only; otherwise ``binary`` runs the
    binary feeds, ``all`` every feed, and ``source`` neither binary nor network.
    """
    tier = F.col("tier")
    if mode in ("diff", "quick"):
        wanted = tier == 1
    elif scan_type == "binary":
        wanted = tier == 4
    elif scan_type == "all":
        wanted = F.lit(True)
    else:
        wanted = ~tier.isin(4, 5)
    if names:
        wanted = wanted & F.col("engine").isin(names)
    run = engines_dim.where(wanted).select(F.col("engine").alias("_engine"))
    return df.join(run, F.col("source_engine") == F.col("_engine"), "left_semi")


def relevant_extension(path: Column, langs: list) -> Column:
    """Whether a feed for these languages reads the file; no extensions reads all."""
    extensions = sorted({e for name in langs for e in files.LANGUAGE_EXTENSIONS.get(name, [])})
    if files.ANY_FILE in langs or not extensions:
        return F.lit(True)
    leaf = F.lower(base_name_of_path(path))
    return (leaf == ".env") | leaf.startswith(".env.") | extension(leaf).isin(extensions)


def is_config_file(path: Column) -> Column:
    """Known names, ``.env*``, or a config extension with a telling folder or name."""
    lower = F.lower(path)
    leaf = base_name_of_path(lower)
    folder = F.regexp_extract(lower, r"^(.*)/[^/]*$", 1)
    by_words = contains_any(folder, files.CONFIG_DIR_WORDS) | contains_any(
        leaf, files.CONFIG_FILE_WORDS
    )
    return (
        leaf.isin(files.CONFIG_NAMES) | leaf.startswith(".env.")
        | (extension(leaf).isin(files.CONFIG_EXTENSIONS) & by_words)
    )


def is_test_file(path: Column) -> Column:
    lower = F.lower(path)
    dirs = "|".join(files.TEST_DIRS)
    return ends_with_any(base_name_of_path(lower), files.TEST_SUFFIXES) | lower.rlike(
        f"(?:^|/)(?:{dirs})/"
    )


def is_generated_file(path: Column) -> Column:
    lower = F.lower(path)
    leaf = base_name_of_path(lower)
    return (
        ends_with_any(leaf, files.GENERATED_SUFFIXES)
        | starts_with_any(leaf, files.GENERATED_PREFIXES)
        | contains_any(lower, [f"/{d}/" for d in files.GENERATED_DIRS])
    )


def mark_test_generated(df: DataFrame) -> DataFrame:
    """Flag findings in test and generated files; none is dropped."""
    path = F.coalesce(F.col("file"), F.lit(""))
    return df.withColumns({
        "test_file": is_test_file(path), "generated_file": is_generated_file(path),
    })
