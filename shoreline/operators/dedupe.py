"""Merge findings that several feeds report for the same place.

The merge is two aggregations.  The first groups by (key, feed) and combines on
the map side, so even a key that holds a third of all rows is shuffled as one row
per task and feed.  The second sees at most one row per feed and key.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoreline import schema
from shoreline.functions.scoring import confidence_rank
from shoreline.functions.text import blank_to_null
from shoreline.operators.normalize import fold_generic_protocol
from shoreline.rules import quantum


def _present(value: Column, order) -> Column:
    """First value of a group that is not NULL, in arrival order."""
    return F.min_by(value, F.when(value.isNotNull(), order))


def dedupe_findings(df: DataFrame, n_feeds: int = 2) -> DataFrame:
    """One row per duplicate key, in the order (engine_rank, seq).

    The first row wins and takes over what it lacks: primitive, mode, curve and
    flow path from the first row that has them, the smallest positive key size,
    the best reachability.  Its confidence rises one level for every duplicate
    from the moment a second engine agrees.  With one feed nothing is merged.

    ``engine_rank`` names the feed: all its rows carry one ``source_engine``.
    """
    if n_feeds <= 1:
        return df
    a = F.col("algorithm")
    flow = F.when(F.size("data_flow_path") > 0, F.col("data_flow_path"))
    reach = F.coalesce(
        F.when(F.col("reachable") == "yes", 3).when(F.col("reachable") == "unknown", 2)
        .when(F.col("reachable") == "no", 1), F.lit(0),
    )
    folded = fold_generic_protocol(df).withColumns({
        "_key": schema.finding_key(), "_reach": reach, "_flow": flow,
    })
    order = F.col("seq")
    per_feed = folded.groupBy("_key", "engine_rank", "source_engine").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("seq").alias("first_seq"),
        F.min_by(F.struct(*df.columns), order).alias("first"),
        _present(blank_to_null(a["primitive"]), order).alias("primitive"),
        _present(blank_to_null(a["mode"]), order).alias("mode"),
        _present(blank_to_null(a["curve"]), order).alias("curve"),
        F.min(F.when(a["key_size"] > 0, a["key_size"])).alias("key_size"),
        F.max("_reach").alias("reach"),
        _present(F.col("_flow"), order).alias("flow"),
    )
    place = F.struct("engine_rank", "first_seq")
    merged = per_feed.groupBy("_key").agg(
        F.min_by("first", place).alias("w"),
        # one entry per feed: bounded by the number of feeds, not by the data
        F.array_sort(F.collect_list(
            F.struct("engine_rank", "first_seq", "source_engine", "n")
        )).alias("feeds"),
        _present(F.col("primitive"), place).alias("primitive"),
        _present(F.col("mode"), place).alias("mode"),
        _present(F.col("curve"), place).alias("curve"),
        F.min("key_size").alias("key_size"),
        F.max("reach").alias("reach"),
        _present(F.col("flow"), place).alias("flow"),
    )
    return _finish(merged, df.columns)


def _rows(feeds) -> Column:
    return F.aggregate(feeds, F.lit(0).cast("bigint"), lambda s, f: s + f["n"])


def _finish(merged: DataFrame, columns: list) -> DataFrame:
    w = F.col("w")
    winner = w["source_engine"]
    others = F.filter("feeds", lambda f: ~f["source_engine"].eqNullSafe(winner))
    second = F.get(others, F.lit(0))
    # feeds from the first other engine on, the winner's own later feeds included
    after = F.filter(
        "feeds",
        lambda f: F.struct(f["engine_rank"], f["first_seq"])
        >= F.struct(second["engine_rank"], second["first_seq"]),
    )
    already = F.coalesce(w["corroborated_by"], F.array().cast("array<string>"))
    boosts = F.when(F.size(already) > 0, _rows("feeds") - 1).when(
        second.isNotNull(), _rows(after)
    )
    start = confidence_rank(w["confidence"])
    levels = F.array(*[F.lit(c) for c in quantum.CONFIDENCE_ORDER])
    level = F.least(F.lit(5), start + F.coalesce(boosts, F.lit(0))).cast("int")
    confidence = F.when(
        boosts.isNotNull() & (start > 0), F.element_at(levels, level)
    ).otherwise(w["confidence"])
    joined_by = F.array_distinct(
        F.concat(already, F.transform(others, lambda f: f["source_engine"]))
    )
    algorithm = F.when(w["algorithm"].isNotNull(), F.struct(
        w["algorithm"]["name"].alias("name"),
        F.coalesce(blank_to_null(w["algorithm"]["primitive"]), F.col("primitive")).alias("primitive"),
        F.col("key_size"),
        F.coalesce(blank_to_null(w["algorithm"]["mode"]), F.col("mode")).alias("mode"),
        F.coalesce(blank_to_null(w["algorithm"]["curve"]), F.col("curve")).alias("curve"),
    ))
    reachable = F.when(w["reachable"] == "yes", "yes").when(F.col("reach") == 3, "yes").when(
        (w["reachable"] == "no") & (F.col("reach") == 2), "unknown"
    ).otherwise(w["reachable"])
    new = {
        "algorithm": algorithm,
        "corroborated_by": F.when(F.size(joined_by) > 0, joined_by),
        "reachable": reachable,
        "confidence": confidence,
        "data_flow_path": F.col("flow"),
    }
    return merged.select(*[new.get(c, w[c]).alias(c) for c in columns])


def dedupe_ordinals(df: DataFrame) -> DataFrame:
    """How many rows of the same key arrived before each row, counted per feed.

    Returns one row per (key, feed): the ordinal of its first row and its number
    of rows, so a hot key stays one small row per feed.
    """
    per_feed = df.withColumn("finding_key", schema.finding_key()).groupBy(
        "finding_key", "engine_rank", "source_engine"
    ).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))
    feeds = F.array_sort(F.collect_list(F.struct("engine_rank", "first_seq", "source_engine", "n")))
    grouped = per_feed.groupBy("finding_key").agg(feeds.alias("feeds"))
    out = grouped.select("finding_key", "feeds", F.posexplode("feeds").alias("i", "f"))
    before = F.aggregate(
        F.slice("feeds", F.lit(1), F.col("i")), F.lit(0).cast("bigint"), lambda s, f: s + f["n"]
    )
    return out.select(
        "finding_key", F.col("f.engine_rank").alias("engine_rank"),
        F.col("f.first_seq").alias("first_seq"),
        F.col("f.source_engine").alias("source_engine"), F.col("f.n").alias("n"),
        (before + 1).alias("first_ordinal"),
        (F.col("i") > 0).alias("is_duplicate"),
    )
