"""Priority, harvest-now-decrypt-later and readiness expressions."""

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from shoreline.functions.text import lookup
from shoreline.rules import quantum as rules


def rank(c: Column, order: list, missing: int) -> Column:
    """1-based place of ``c`` in ``order``."""
    return F.coalesce(
        lookup(c, {v: i for i, v in enumerate(order, 1)}), F.lit(missing)
    )


def severity_rank(severity: Column) -> Column:
    """1 for critical to 5 for info, 6 otherwise."""
    return rank(severity, rules.SEVERITY_ORDER, 6)


def confidence_rank(confidence: Column) -> Column:
    """1 for low to 5 for high, 0 otherwise."""
    return rank(confidence, rules.CONFIDENCE_ORDER, 0)


def priority_rank(priority: Column) -> Column:
    return rank(priority, ["P1", "P2", "P3", "P4"], 5)


def priority(
    severity: Column, reachable: Column, blast: Column, confidence: Column, test_or_generated: Column
) -> Column:
    """P1 to P4."""
    reached = F.coalesce(reachable == "yes", F.lit(False))
    blast = F.coalesce(blast, F.lit(0))
    return (
        F.when(F.coalesce(test_or_generated, F.lit(False)), "P4")
        .when(
            severity == "critical",
            F.when(reached | (blast >= 70) | (confidence_rank(confidence) >= 4), "P1")
            .otherwise("P2"),
        )
        .when(severity == "high", F.when(reached | (blast >= 40), "P2").otherwise("P3"))
        .when((severity == "medium") & reached, "P3")
        .otherwise("P4")
    )


def sector_years(sector: Column) -> Column:
    """Years a sector's data must stay secret; unknown sectors count as generic."""
    return F.coalesce(
        lookup(F.lower(sector), rules.SECTOR_YEARS), F.lit(rules.DEFAULT_SECTOR_YEARS)
    )


def hndl_surplus(
    shelf_life: Column, lag: Column, years_to_crqc: Column, year: int | None = None
) -> Column:
    """Shelf life plus migration lag minus years until the quantum computer.

    Zero or missing ``lag`` and ``years_to_crqc`` take their defaults; the
    latter counts from ``year`` (this year unless given).
    """
    year = year or datetime.date.today().year
    default_crqc = max(0, rules.CRQC_YEAR - year)
    return (
        shelf_life
        + F.when(lag > 0, lag).otherwise(F.lit(rules.DEFAULT_LAG_YEARS))
        - F.when(years_to_crqc > 0, years_to_crqc).otherwise(F.lit(default_crqc))
    )


def hndl_level(surplus: Column) -> Column:
    return F.when(surplus > 2, "high").when(surplus >= 0, "medium").otherwise("low")


def lifetime_multiplier(years: Column) -> Column:
    """Score multiplier for the years data must live; exact decimals."""
    return (
        F.when(years > 10, F.lit("1.15"))
        .when((years >= 1) & (years < 5), F.lit("0.85"))
        .otherwise(F.lit("1.00"))
        .cast("decimal(4,2)")
    )


def penalty(risk: Column, severity: Column) -> Column:
    """Points a finding costs before multipliers; exact decimals."""
    return (
        F.when(
            risk == "quantum-vulnerable",
            F.when(severity == "critical", F.lit("2.0"))
            .when(severity == "high", F.lit("1.5"))
            .otherwise(F.lit("1.0")),
        )
        .when(risk == "deprecated", F.lit("1.5"))
        .when(risk == "quantum-weakened", F.lit("0.5"))
        .otherwise(F.lit("0.0"))
        .cast("decimal(4,2)")
    )


def protocol_multiplier(protocols: Column) -> Column:
    """Largest multiplier among an array of protocol names, 1 when none is known."""
    known = F.transform(
        protocols,
        lambda p: lookup(F.lower(p), rules.PROTOCOL_MULTIPLIERS).cast("decimal(4,2)"),
    )
    return F.coalesce(F.array_max(known), F.lit("1.00").cast("decimal(4,2)"))


def grade(score: Column) -> Column:
    out = F.when(score >= rules.GRADES[0][0], rules.GRADES[0][1])
    for at_least, letter in rules.GRADES[1:]:
        out = out.when(score >= at_least, letter)
    return out.otherwise("F")


def clamp(c: Column, low, high) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))
