"""Evaluate compliance frameworks over findings."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoreline.functions import compliance as C
from shoreline.functions.text import blank_to_null, lookup
from shoreline.rules import compliance as rules

PCI = "pci-dss-4.0"


def compliance_eval(df: DataFrame, frameworks: list | None = None) -> DataFrame:
    """Violations: the finding's columns, then framework, rule, deadline, severity.

    All frameworks are judged in one projection and exploded, so the findings
    are read once however many frameworks are asked for.
    """
    facts = C.Facts()
    chosen = list(C.FRAMEWORKS) if frameworks is None else [f for f in frameworks if f != PCI]
    found = F.array_compact(F.array(*[C.violation(f, facts) for f in chosen]))
    subject = F.when(F.col("algorithm").isNotNull(), F.col("algorithm.name")).otherwise(
        F.col("raw_identifier")
    )
    out = df.withColumn("_v", F.explode(found)).select(
        *[c for c in ("project", "file", "line", "engine_rank", "seq") if c in df.columns],
        subject.alias("algorithm"), "_v.*",
    )
    return out.withColumn("remediation", lookup(F.col("rule"), rules.REMEDIATION))


def pci_inventory_evidence(df: DataFrame) -> DataFrame:
    """One violation when no finding carries a risk class, with the reason."""
    risk = F.col("quantum_risk")
    counts = df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.coalesce(risk, F.lit("")).isin("", "unknown") == F.lit(False))
        .alias("classified"),
    )
    deadline = next(kex for f, _, kex, _ in rules.FRAMEWORKS if f == PCI)
    return counts.where(F.col("classified") == 0).select(
        F.lit(PCI).alias("framework"), F.lit("pci-no-inventory-evidence").alias("rule"),
        F.lit(deadline).alias("deadline"), F.lit("error").alias("severity"),
        F.when(F.col("total") == 0, "no findings").otherwise("findings without risk class")
        .alias("reason"),
    )


def _subject():
    return F.coalesce(
        blank_to_null(F.col("algorithm.name")), blank_to_null(F.col("dependency.library")),
        blank_to_null(F.col("raw_identifier")),
    )


def _algorithms(df: DataFrame) -> DataFrame:
    """Per algorithm or library: occurrences, first known risk and first effort."""
    label = lookup(F.col("quantum_risk"), rules.RISK_LABELS)
    effort = blank_to_null(F.col("migration_effort"))
    order = F.struct("engine_rank", "seq")
    return df.withColumn("_name", _subject()).where(F.col("_name").isNotNull()).groupBy("_name").agg(
        F.count(F.lit(1)).alias("occurrences"),
        F.coalesce(
            F.min_by(label, F.when(label.isNotNull(), order)), F.lit("Unknown")
        ).alias("risk"),
        F.coalesce(
            F.min_by(effort, F.when(effort.isNotNull(), order)), F.lit("-")
        ).alias("effort"),
    )


def _violated(violations: DataFrame, *keys: str) -> DataFrame:
    return violations.where(F.coalesce(F.col("algorithm"), F.lit("")) != "").select(
        *[F.col(k).alias(f"_{k}") for k in keys], F.col("algorithm").alias("_bad")
    ).distinct()


def compliance_algorithm_summary(df: DataFrame, violations: DataFrame) -> DataFrame:
    """Per algorithm or library: occurrences, first known risk and effort, compliance."""
    bad = _violated(violations)
    return _algorithms(df).join(bad, F.col("_name") == F.col("_bad"), "left").select(
        F.col("_name").alias("algorithm"), "risk", "effort",
        F.col("_bad").isNull().alias("compliant"), "occurrences",
    )


def framework_algorithm_summaries(
    df: DataFrame, violations: DataFrame, frameworks: list | None = None
) -> DataFrame:
    """The algorithm table of every framework, in one pass over the findings."""
    chosen = list(C.FRAMEWORKS) if frameworks is None else frameworks
    each = _algorithms(df).withColumn(
        "framework", F.explode(F.array(*[F.lit(f) for f in chosen]))
    )
    bad = _violated(violations, "framework")
    same = (F.col("_name") == F.col("_bad")) & (F.col("framework") == F.col("_framework"))
    return each.join(bad, same, "left").select(
        "framework", F.col("_name").alias("algorithm"), "risk", "effort",
        F.col("_bad").isNull().alias("compliant"), "occurrences",
    )
