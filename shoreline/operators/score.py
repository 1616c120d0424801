"""Scan counters and the quantum readiness score.

Scores are one map-side-combined aggregate over exact decimals, so the order in
which partitions arrive cannot move a sum across a grade boundary.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoreline import schema
from shoreline.functions import scoring as S
from shoreline.operators.impact import first_zone
from shoreline.plans.checkpoints import cut
from shoreline.tables import side_by_side

_SCORE = "decimal(28,6)"


def scan_summary(df: DataFrame, by=()) -> DataFrame:
    """Ten counters per group."""
    def risk(value):
        return F.count_if(F.col("quantum_risk") == value)

    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_findings"),
        F.count_if(F.col("algorithm").isNotNull()).alias("algorithms"),
        F.count_if(F.col("dependency").isNotNull()).alias("dependencies"),
        F.count_if(F.coalesce(F.size("corroborated_by"), F.lit(0)) > 0).alias("corroborated"),
        risk("quantum-vulnerable").alias("quantum_vulnerable"),
        risk("quantum-weakened").alias("quantum_weakened"),
        risk("quantum-safe").alias("quantum_safe"),
        risk("quantum-resistant").alias("quantum_resistant"),
        risk("deprecated").alias("deprecated"),
        risk("unknown").alias("unknown"),
    )


def _points(df: DataFrame, multiplier: Column | None = None, years: int | None = None):
    """Sum of penalties and of bonuses."""
    cost = S.penalty(F.col("quantum_risk"), F.col("severity"))
    agreed = F.coalesce(F.size(schema.column(df, "corroborated_by")), F.lit(0)) > 0
    cost = cost * F.when(agreed, F.lit("1.5")).otherwise(F.lit("1.0")).cast("decimal(4,2)")
    if multiplier is not None:
        cost = cost * multiplier
    if years is not None:
        cost = cost * S.lifetime_multiplier(F.lit(years))
    bonus = F.when(F.col("quantum_risk") == "quantum-safe", F.lit("0.5")).otherwise("0")
    return [
        F.coalesce(F.sum(cost.cast("decimal(18,6)")), F.lit(0)).cast(_SCORE).alias("_cost"),
        F.coalesce(F.sum(bonus.cast("decimal(18,6)")), F.lit(0)).cast(_SCORE).alias("_bonus"),
    ]


def _rounded(score: Column) -> Column:
    return F.round(S.clamp(score, 0, 100), 0).cast("int")


def _graded(df: DataFrame, by) -> DataFrame:
    return df.select(*by, "score", S.grade(F.col("score")).alias("grade"))


def qrs(df: DataFrame, by=()) -> DataFrame:
    """Readiness score per group; without findings it is 100."""
    return qrs_lifetime(df, 0, by)


def qrs_lifetime(df: DataFrame, years: int, by=()) -> DataFrame:
    """Readiness score with penalties scaled by how long data must live."""
    sums = df.groupBy(*by).agg(*_points(df, years=years))
    return _graded(
        sums.withColumn("score", _rounded(100 - F.col("_cost") + F.col("_bonus"))), by
    )


def _scored(zones: DataFrame, by) -> DataFrame:
    """What the scores need of the zones; read twice, so that flow paths are followed once."""
    columns = dict.fromkeys([*by, "finding_key", "engine_rank", "seq", "target_no", "blast_radius_score"])
    return cut(zones.select(*columns, S.protocol_multiplier(F.col("violated_protocols.protocol")).alias("_mult")))


def _with_protocols(df: DataFrame, zones: DataFrame) -> DataFrame:
    """Findings with the protocol multiplier of the first zone of their key."""
    names = first_zone(zones, "_mult").select(F.col("finding_key").alias("_zone_key"), "_mult")
    joined = df.withColumn("_key", schema.finding_key()).join(
        names, F.col("_key") == F.col("_zone_key"), "left"
    )
    return joined.withColumn(
        "_mult", F.coalesce("_mult", F.lit("1.00").cast("decimal(4,2)"))
    )


def _blast(zones: DataFrame, by) -> DataFrame:
    """Average blast radius; grouped zones must carry the ``by`` columns."""
    return zones.groupBy(*by).agg(F.avg("blast_radius_score").alias("_avg"))


def _with_blast(sums: DataFrame, zones: DataFrame, by) -> DataFrame:
    blast = _blast(zones, by)
    if by:
        return sums.join(blast, list(by), "left")
    return side_by_side(sums, blast)


def _shrunk(score: Column) -> Column:
    """Score reduced by up to 15% for the average blast radius."""
    less = score.cast("double") * (1.0 - 0.15 * F.col("_avg") / 100.0)
    return F.when(F.col("_avg").isNull(), score.cast("double")).otherwise(less)


def _round_half_up(score: Column) -> Column:
    return F.floor(S.clamp(score, 0.0, 100.0) + 0.5).cast("int")


def qrs_impact(df: DataFrame, zones: DataFrame, by=()) -> DataFrame:
    """Readiness score with protocol multipliers and the blast radius of all zones."""
    zones = _scored(zones, by)
    sums = _with_protocols(df, zones).groupBy(*by).agg(*_points(df, F.col("_mult")))
    joined = _with_blast(sums, zones, by)
    score = S.clamp(100 - F.col("_cost") + F.col("_bonus"), 0, 100)
    return _graded(joined.withColumn("score", _round_half_up(_shrunk(score))), by)


def qrs_full(df: DataFrame, zones: DataFrame, years: int, by=()) -> DataFrame:
    """As :func:`qrs_impact`, with lifetime, clamping before the bonus and rounding twice."""
    zones = _scored(zones, by)
    sums = _with_protocols(df, zones).groupBy(*by).agg(*_points(df, F.col("_mult"), years))
    joined = _with_blast(sums, zones, by)
    first = _rounded(F.greatest(100 - F.col("_cost"), F.lit(0)) + F.col("_bonus"))
    return _graded(joined.withColumn("score", _round_half_up(_shrunk(first))), by)


def ingest_metrics(df: DataFrame, suppressed: DataFrame | None = None) -> DataFrame:
    """Rows per feed and, if given, rows that suppression took away."""
    kept = df.groupBy("source_engine").agg(F.count(F.lit(1)).alias("rows"))
    if suppressed is None:
        return kept.withColumn("suppressed", F.lit(0).cast("bigint"))
    gone = suppressed.groupBy("source_engine").agg(F.count(F.lit(1)).alias("suppressed"))
    return kept.join(gone, "source_engine", "full_outer").na.fill(0, ["rows", "suppressed"])


def group_by_file(df: DataFrame) -> DataFrame:
    """Findings per file."""
    return df.groupBy("file").agg(F.count(F.lit(1)).alias("n_findings"))
