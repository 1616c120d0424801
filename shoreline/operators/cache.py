"""Incremental scans: reuse findings of files that did not change."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoreline.functions.text import lookup

# the path first: sorts compare their first column, and there are few feeds
KEY = ["path", "engine"]


def content_hash(df: DataFrame) -> DataFrame:
    """``(path, content)`` to ``(path, content_hash)``."""
    return df.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"))


def incremental_split(
    files: DataFrame, cache: DataFrame, engine_versions: dict
) -> tuple[DataFrame, DataFrame]:
    """``(changed, cached)`` for files ``(path, content_hash)`` and feeds ``{engine: version}``.

    A cached entry is reused if feed version and content are the same; every other
    pair of feed and file is to be scanned.  The feeds are a literal in each row,
    so pairing them with the files needs no join.
    """
    current = lookup(F.col("engine"), engine_versions) == F.col("engine_version")
    reused = cache.where(current).join(files, ["path", "content_hash"], "left_semi")
    done = reused.select(*KEY).distinct()
    feeds = F.array(*[F.lit(e) for e in engine_versions])
    pairs = files.withColumn("engine", F.explode(feeds))
    changed = pairs.join(done, KEY, "left_anti")
    return changed.select("engine", "path", "content_hash"), reused


def cached_findings(cached: DataFrame) -> DataFrame:
    """The findings inside cache entries, one row each."""
    return cached.select("engine", "path", F.inline("findings"))


def union_feeds(dfs: list) -> DataFrame:
    """Feeds one after another; ``engine_rank`` is their place in the list."""
    ranked = [df.withColumn("engine_rank", F.lit(i)) for i, df in enumerate(dfs)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)


def union_cached_fresh(cached: DataFrame, fresh: DataFrame) -> DataFrame:
    return cached.unionByName(fresh, allowMissingColumns=True)


def prune_deleted(cache: DataFrame, current_paths: DataFrame) -> DataFrame:
    """Cache entries whose file still exists."""
    return cache.join(current_paths.select("path").distinct(), "path", "left_semi")


def updated_cache(
    old: DataFrame, fresh: DataFrame, current_paths: DataFrame, mode: str = "full"
) -> DataFrame:
    """Cache after a scan: fresh entries replace old ones of the same feed and file.

    Fresh entries of files that are gone by now are not kept.  A full scan also
    drops old entries of deleted files.
    """
    known = current_paths.select("path").distinct()
    fresh = fresh.join(known, "path", "left_semi")
    kept = old.join(fresh.select(*KEY).distinct(), KEY, "left_anti")
    if mode == "full":
        kept = kept.join(known, "path", "left_semi")
    return kept.unionByName(fresh)
