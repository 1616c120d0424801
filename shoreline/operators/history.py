"""Scan records over time."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shoreline.functions.text import blank_to_null
from shoreline.operators.score import qrs
from shoreline.tables import side_by_side

MAX_TOP = 100
_RISKS = {
    "vulnerable": "quantum-vulnerable", "weakened": "quantum-weakened", "safe": "quantum-safe",
    "resistant": "quantum-resistant", "deprecated": "deprecated",
}


def scan_record(df: DataFrame, by=()) -> DataFrame:
    """Totals by severity and risk, with score and grade, per scan."""
    counts = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("severity") == s).alias(s)
          for s in ("critical", "high", "medium", "low", "info")],
        *[F.count_if(F.col("quantum_risk") == r).alias(c) for c, r in _RISKS.items()],
    )
    scores = qrs(df, by)
    if by:
        return counts.join(scores, list(by))
    return side_by_side(counts, scores)


def top_findings(df: DataFrame, n: int = MAX_TOP, by=()) -> DataFrame:
    """First ``n`` findings per scan in priority order, with shortened paths.

    Spark keeps only ``n`` rows per scan in each task before the shuffle, so a
    scan with a third of all findings is no heavier than the others.
    """
    from shoreline.functions import scoring as S

    name = F.coalesce(F.col("algorithm.name"), F.col("dependency.library"))
    order = [
        S.priority_rank(F.col("priority")), S.severity_rank(F.col("severity")), F.col("file"),
        F.col("engine_rank"), F.col("seq"),
    ]
    parts = F.split(F.col("file"), "/")
    short = F.when(
        F.size(parts) > 2,
        F.concat(F.lit(".../"), F.array_join(F.slice(parts, -2, 2), "/")),
    ).otherwise(F.col("file"))
    named = df.where(blank_to_null(name).isNotNull())
    if not by:
        # the best of all tasks, so that the window below sees n rows
        named = named.orderBy(*order).limit(n)
    keys = [F.col(c) for c in by] or [F.lit(0)]
    ranked = named.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    top = ranked.where(F.col("place") <= n)
    return top.select(
        *by, "place", short.alias("file"), "line", name.alias("algorithm"),
        F.when(F.col("algorithm").isNotNull(), F.col("algorithm.primitive"))
        .otherwise("dependency").alias("primitive"),
        "quantum_risk", "severity", "migration_effort", "hndl_risk", "source_engine",
    )


def last_n_scans(history: DataFrame, n: int) -> DataFrame:
    """The last ``n`` records of each project, a project's records in order."""
    latest = W.partitionBy("project").orderBy(F.col("scan_seq").desc())
    return history.withColumn("_place", F.row_number().over(latest)).where(
        F.col("_place") <= n
    ).drop("_place").sortWithinPartitions("project", "scan_seq")


def _data_point():
    """Counts of a record; old records without risk counts fall back to severities."""
    safe = F.col("safe") + F.col("resistant")
    old = (
        (F.col("vulnerable") == 0) & (F.col("deprecated") == 0) & (safe == 0) & (F.col("total") > 0)
    )
    return F.struct(
        "score", "total",
        F.when(old, F.col("critical") + F.col("high")).otherwise(F.col("vulnerable"))
        .alias("vulnerable"),
        F.when(old, F.col("medium")).otherwise(F.col("deprecated")).alias("deprecated"),
        F.when(old, F.col("low") + F.col("info")).otherwise(safe).alias("safe"),
        "grade",
    )


def trend_delta(history: DataFrame) -> DataFrame:
    """First against last scan of each project, with a one-line summary.

    Two map-side-combined aggregates give both ends of a project; its records
    are never sorted or gathered.
    """
    ends = history.withColumn("_p", _data_point()).groupBy("project").agg(
        F.count(F.lit(1)).alias("scans"),
        F.min_by("_p", "scan_seq").alias("a"), F.max_by("_p", "scan_seq").alias("b"),
    )
    d = {c: F.col(f"b.{c}") - F.col(f"a.{c}") for c in ("score", "total", "vulnerable", "deprecated")}
    improving = (d["score"] > 0) | (d["vulnerable"] < 0)
    word = F.when(d["score"] > 0, "improved").when(d["score"] < 0, "degraded").otherwise("unchanged")
    signed = F.concat(F.when(d["score"] < 0, "").otherwise("+"), d["score"])
    change = F.when(
        d["vulnerable"] < 0,
        F.concat(F.lit(" Vulnerable findings decreased by "), -d["vulnerable"], F.lit(".")),
    ).when(
        d["vulnerable"] > 0,
        F.concat(F.lit(" Vulnerable findings increased by "), d["vulnerable"], F.lit(".")),
    ).otherwise("")
    verdict = F.when(improving, " Improving.").when(
        (d["score"] == 0) & (d["vulnerable"] == 0), " Stable."
    ).otherwise(" Not improving.")
    summary = F.when(
        F.col("scans") == 1,
        F.concat(F.lit("QRS "), F.col("b.score"), F.lit(" ("), F.col("b.grade"),
                 F.lit(") — 1 scan recorded.")),
    ).otherwise(F.concat(
        F.lit("QRS "), word, F.lit(" "), F.col("a.score"), F.lit("→"), F.col("b.score"),
        F.lit(" ("), signed, F.lit(") over "), F.col("scans"), F.lit(" scans."), change, verdict,
    ))
    return ends.select(
        "project", "scans", d["score"].alias("score_delta"), d["total"].alias("findings_delta"),
        d["vulnerable"].alias("vulnerable_delta"), d["deprecated"].alias("deprecated_delta"),
        (improving & (F.col("scans") > 1)).alias("improving"), summary.alias("summary"),
    )


def project_overview(history: DataFrame) -> DataFrame:
    """Scans, latest score and time per project, latest first."""
    return history.groupBy("project").agg(
        F.count(F.lit(1)).alias("scan_count"),
        F.max_by("score", "scan_seq").alias("latest_score"),
        F.max_by("timestamp", "scan_seq").alias("last_scan"),
    ).orderBy(F.col("last_scan").desc(), "project")


def metric_regression(
    baseline: DataFrame, current: DataFrame, threshold_pct: float = 20.0
) -> DataFrame:
    """Change of each metric ``(name, value)`` in percent; over the threshold fails."""
    b = baseline.select(F.col("name"), F.col("value").alias("baseline"))
    c = current.select(F.col("name"), F.col("value").alias("current"))
    joined = b.join(c, "name", "full_outer")
    change = F.when(
        F.col("baseline").isNotNull() & F.col("current").isNotNull(),
        F.when(
            F.col("baseline") > 0,
            (F.col("current") - F.col("baseline")) / F.col("baseline") * 100,
        ).otherwise(F.lit(0.0)),
    )
    status = (
        F.when(F.col("baseline").isNull(), "new").when(F.col("current").isNull(), "removed")
        .when(change <= threshold_pct, "pass").otherwise("fail")
    )
    return joined.select("name", "baseline", "current", change.alias("change_pct"),
                         status.alias("status"))


def new_and_removed(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Names on one side only: ``(name, status)``."""
    b, c = baseline.select("name").distinct(), current.select("name").distinct()
    new = c.join(b, "name", "left_anti").withColumn("status", F.lit("new"))
    removed = b.join(c, "name", "left_anti").withColumn("status", F.lit("removed"))
    return new.unionByName(removed)
