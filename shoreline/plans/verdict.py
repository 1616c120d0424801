"""Findings to compliance, policy and trend verdicts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoreline.operators import compliance, policy, score
from shoreline.operators.history import trend_delta
from shoreline.tables import side_by_side


def compliance_verdict(findings: DataFrame, frameworks: list | None = None) -> DataFrame:
    """Violations per framework and rule, with the earliest deadline."""
    violations = compliance.compliance_eval(findings, frameworks)
    return violations.groupBy("framework", "rule", "severity").agg(
        F.count(F.lit(1)).alias("violations"),
        F.min("deadline").alias("deadline"),
    )


def policy_verdict(findings: DataFrame, **rules) -> DataFrame:
    """All violations of a policy; see :func:`policy.evaluate_policy`."""
    summary = side_by_side(score.scan_summary(findings), score.qrs(findings))
    return policy.evaluate_policy(findings, summary, **rules)


def trend_verdict(history: DataFrame) -> DataFrame:
    return trend_delta(history)
