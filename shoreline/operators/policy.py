"""Policy rules over findings and scan totals."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoreline.functions.scoring import severity_rank
from shoreline.functions.text import covers_version, glob_to_regex, matches_regexes
from shoreline.rules import quantum


def fail_on(df: DataFrame, level: str) -> DataFrame:
    """Findings at or above a severity; an unknown level fails nothing."""
    if level.lower() not in quantum.SEVERITY_ORDER:
        return df.limit(0)
    limit = quantum.SEVERITY_ORDER.index(level.lower()) + 1
    return df.where(severity_rank(F.col("severity")) <= limit)


def _cleaned(items) -> list:
    return list(dict.fromkeys(s for s in (i.strip().lower() for i in items or []) if s))


def matches_policy_list(name: Column, items: list) -> Column:
    """Lower-case ``name`` is on the list: exactly, by glob, or as a TLS/SSL version."""
    globs = [i for i in items if any(ch in i for ch in "*?[")]
    exact = [i for i in items if i not in globs]
    out = matches_regexes(name, [glob_to_regex(g) for g in globs])
    if exact:
        out = out | name.isin(exact)
    for generic in ("tls", "ssl"):
        if generic in exact:
            out = out | covers_version(F.lit(generic), name)
    return out


def policy_glob_match(df: DataFrame, allowed=None, blocked=None) -> DataFrame:
    """Violations of the block list and of the allow list.

    Both lists are policy text and become one regex each; the findings are read
    once and never move.
    """
    allowed, blocked = _cleaned(allowed), _cleaned(blocked)
    name = F.lower(F.col("algorithm.name"))
    on_blocked = matches_policy_list(name, blocked) if blocked else F.lit(False)
    off_allowed = ~matches_policy_list(name, allowed) if allowed else F.lit(False)
    rules = F.array_compact(F.array(
        F.when(on_blocked, "blocked-algorithm"), F.when(off_allowed, "allowed-algorithms")
    ))
    judged = df.where(F.col("algorithm").isNotNull())
    return judged.select(*df.columns, F.explode(rules).alias("rule"))


def policy_aggregate_rules(
    summary: DataFrame,
    require_pqc: bool = False,
    max_vulnerable: int | None = None,
    min_score: int = 0,
) -> DataFrame:
    """Violations of whole-scan rules; ``summary`` has the counters and ``score``."""
    if max_vulnerable is not None and max_vulnerable < 0:
        raise ValueError("max_vulnerable must not be negative")
    if not 0 <= min_score <= 100:
        raise ValueError("min_score must be between 0 and 100")
    broken = [F.when(
        F.lit(require_pqc) & (F.col("quantum_safe") + F.col("quantum_resistant") == 0),
        "require-pqc",
    )]
    if max_vulnerable is not None:
        broken.append(F.when(
            F.col("quantum_vulnerable") > max_vulnerable, "max-quantum-vulnerable"
        ))
    if min_score > 0:
        broken.append(F.when(
            F.col("score").isNull() | (F.col("score") < min_score), "min-qrs"
        ))
    keep = [c for c in summary.columns if c == "project"]
    return summary.select(
        *keep, F.explode(F.array_compact(F.array(*broken))).alias("rule"),
        F.lit("high").alias("severity"),
    )


def evaluate_policy(
    findings: DataFrame, summary: DataFrame, level: str = "", allowed=None, blocked=None,
    require_pqc: bool = False, max_vulnerable: int | None = None, min_score: int = 0,
) -> DataFrame:
    """All violations of a policy as ``(rule, severity, file, line, algorithm)``."""
    def of_finding(df, rule, severity):
        return df.select(
            rule.alias("rule"), severity.alias("severity"), "file", "line",
            F.col("algorithm.name").alias("algorithm"),
        )

    per_finding = of_finding(fail_on(findings, level), F.lit("fail-on"), F.col("severity"))
    lists = policy_glob_match(findings, allowed, blocked)
    per_list = of_finding(lists, F.col("rule"), F.lit("high"))
    whole = policy_aggregate_rules(summary, require_pqc, max_vulnerable, min_score).select(
        "rule", "severity", F.lit(None).cast("string").alias("file"),
        F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("algorithm"),
    )
    return per_finding.unionByName(per_list).unionByName(whole)
