"""Write findings, component lists, SARIF rows, compliance tables, history and cache."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoreline import schema
from shoreline.functions import output as O
from shoreline.functions.quantum import advice_text
from shoreline.operators import inventory as N
from shoreline.operators import score
from shoreline.operators.cache import updated_cache
from shoreline.operators.compliance import framework_algorithm_summaries
from shoreline.tables import side_by_side


def with_advice_text(df: DataFrame) -> DataFrame:
    """Advice codes replaced by their wording."""
    code = F.col("recommendation")
    return df.withColumn("recommendation", F.coalesce(advice_text(code), code))


def store_findings(df: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """Write classified findings to ``<path>/table`` and read them back.

    Every writer below derives its outputs from such a table, so the plan of a scan runs
    once, however many outputs are asked for.  A writer that is given other findings stores
    them itself.
    """
    full = schema.conform(df, derived=True)
    full.write.mode(mode).parquet(f"{path}/table")
    table = df.sparkSession.read.schema(full.schema).parquet(f"{path}/table")
    table._stored_at = f"{path}/table"
    return table


def _stored(df: DataFrame, path: str, mode: str) -> DataFrame:
    return df if getattr(df, "_stored_at", None) else store_findings(df, path, mode)


def write_findings_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``<path>/findings`` with one line per finding, ``<path>/summary`` with one row."""
    full = _stored(df, path, mode)
    with_advice_text(full).write.mode(mode).json(f"{path}/findings")
    summary = side_by_side(score.scan_summary(full), score.qrs(full))
    summary.coalesce(1).write.mode(mode).json(f"{path}/summary")


def write_findings_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The 18 fixed columns, CRLF line ends, formulas neutralised."""
    schema.conform(df, derived=True).select(*O.csv_columns()).write.mode(mode).option(
        "header", "true"
    ).option("lineSep", "\r\n").option("emptyValue", "").option("escape", '"').csv(path)


def write_cbom_components(
    df: DataFrame, path: str, zones: DataFrame | None = None, base: str | None = None,
    mode: str = "errorifexists",
) -> None:
    """Component rows, their places, dependencies and metadata as JSON lines.

    Places are written apart, partitioned by kind, so that no component has to
    hold a list as long as the data.
    """
    df = _stored(df, path, mode)
    if zones is not None:
        zones.write.mode(mode).parquet(f"{path}/zones")
        zones = df.sparkSession.read.schema(zones.schema).parquet(f"{path}/zones")
    N.cbom_components(df, base, zones).write.mode(mode).json(f"{path}/components")
    N.cbom_occurrences(df, base).write.mode(mode).partitionBy("kind").json(f"{path}/occurrences")
    N.cbom_dependencies(df).write.mode(mode).json(f"{path}/dependencies")
    N.cbom_metadata(df, zones).coalesce(1).write.mode(mode).json(f"{path}/metadata")


def write_sarif_rows(
    df: DataFrame, path: str, base: str | None = None, mode: str = "errorifexists"
) -> None:
    """Rules and results as JSON lines."""
    df = _stored(df, path, mode)
    N.sarif_rules(df).write.mode(mode).json(f"{path}/rules")
    N.sarif_results(df, base).drop("engine_rank", "seq").write.mode(mode).json(f"{path}/results")


def write_compliance_summary(
    df: DataFrame, violations: DataFrame, path: str, mode: str = "errorifexists"
) -> None:
    """Violations and algorithm tables, partitioned by framework."""
    violations.write.mode(mode).partitionBy("framework").parquet(f"{path}/violations")
    df = _stored(df, path, mode)
    violations = df.sparkSession.read.schema(violations.schema).parquet(f"{path}/violations")
    framework_algorithm_summaries(df, violations).write.mode(mode).partitionBy(
        "framework"
    ).parquet(f"{path}/algorithms")


def append_scan_history(records: DataFrame, path: str) -> None:
    """Append scan records, one file a day, however many projects were scanned."""
    day = F.coalesce(F.substring("timestamp", 1, 10), F.lit("undated")) if "timestamp" in records.columns else F.lit("undated")
    dated = records.withColumn("day", day)
    dated.repartition("day").write.mode("append").partitionBy("day").json(path)


def write_cache_snapshot(
    old: DataFrame, fresh: DataFrame, current_paths: DataFrame, path: str, mode: str = "full"
) -> None:
    """Write the cache after a scan to a new place, partitioned by feed.

    A snapshot never overwrites the one it is computed from: a job that dies
    half-way leaves the old one whole.
    """
    updated_cache(old, fresh, current_paths, mode).write.mode("errorifexists").partitionBy(
        "engine"
    ).parquet(path)


WRITERS = {
    "json": write_findings_json, "csv": write_findings_csv, "cbom": write_cbom_components,
    "sarif": write_sarif_rows,
}


def write_all(df: DataFrame, path: str, formats=tuple(WRITERS), mode: str = "errorifexists", **options) -> DataFrame:
    """All asked outputs under ``<path>/<format>`` from one stored table, which is returned.

    ``options`` has further arguments of the writers by format.
    """
    table = store_findings(df, path, mode)
    for name in formats:
        WRITERS[name](table, f"{path}/{name}", mode=mode, **options.get(name, {}))
    return table
