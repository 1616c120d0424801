"""Component lists, SARIF rules and annotations."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoreline import schema
from shoreline.functions import output as O
from shoreline.functions.text import blank_to_null, relative_to
from shoreline.operators.impact import last_zone
from shoreline.rules import formats
from shoreline.tables import side_by_side

NAMESPACE = "crypto"
RULE_PREFIX = "CRYPTO"


def _order():
    return F.struct("engine_rank", "seq")


def cbom_occurrences(df: DataFrame, base: str | None = None) -> DataFrame:
    """One row per place of a component: ``(component, kind, location, line, offset)``.

    Occurrences stay rows, so an algorithm used in a third of all findings is not
    gathered into one group.
    """
    a = F.col("algorithm")
    is_algorithm = blank_to_null(a["name"]).isNotNull()
    wanted = df.where(is_algorithm | F.col("dependency").isNotNull())
    inner = blank_to_null(F.col("inner_path"))
    location = F.concat_ws(
        "!", relative_to(F.col("file"), base), F.when(is_algorithm, inner)
    )
    return wanted.select(
        component_key(), F.when(is_algorithm, "algorithm").otherwise("library").alias("kind"),
        location.alias("location"), F.coalesce("line", F.lit(0)).alias("line"),
        F.when(is_algorithm, F.coalesce("col", F.lit(0))).alias("offset"),
        "engine_rank", "seq",
    )


def component_key():
    """Algorithms by name, size, mode and curve; libraries by name."""
    a = F.col("algorithm")
    library = F.coalesce(blank_to_null(F.col("dependency.library")), F.col("raw_identifier"))
    return F.when(
        blank_to_null(a["name"]).isNotNull(),
        F.concat_ws(
            "|", a["name"], F.coalesce(a["key_size"], F.lit(0)).cast("string"),
            F.coalesce(a["mode"], F.lit("")), F.coalesce(a["curve"], F.lit("")),
        ),
    ).otherwise(F.concat(F.lit("lib:"), library)).alias("component")


def cbom_components(df: DataFrame, base: str | None = None, zones: DataFrame | None = None) -> DataFrame:
    """One row per component with its first finding, sources and number of places.

    Everything aggregated combines on the map side; the places themselves come
    from :func:`cbom_occurrences`.  With ``zones`` the last zone of the first
    finding is attached.
    """
    a = F.col("algorithm")
    is_algorithm = blank_to_null(a["name"]).isNotNull()
    engines = F.concat(
        F.array("source_engine"), F.coalesce("corroborated_by", F.array().cast("array<string>"))
    )
    wanted = schema.conform(df, derived=True).where(
        is_algorithm | F.col("dependency").isNotNull()
    ).withColumn("component", component_key())
    # one row per component and source, so that sources merge without long lists
    by_source = wanted.withColumn("_sources", engines).select(
        "component", "engine_rank", "seq", F.posexplode("_sources").alias("_pos", "_source")
    ).where(F.col("_source").isNotNull()).groupBy("component", "_source").agg(
        F.min(F.struct("engine_rank", "seq", "_pos")).alias("_first")
    ).groupBy("component").agg(F.array_sort(F.collect_list(
        F.struct("_first", "_source")
    )).alias("_s")).select(
        F.col("component").alias("_c"), F.array_join(F.col("_s._source"), "+").alias("sources")
    )
    keep = [c for c in wanted.columns if c != "component"]
    grouped = wanted.groupBy("component").agg(
        F.count(F.lit(1)).alias("occurrences"),
        F.min_by(F.struct(*keep), _order()).alias("f"),
    )
    joined = grouped.join(by_source, F.col("component") == F.col("_c"), "left")
    fa = F.col("f.algorithm")
    is_alg = blank_to_null(fa["name"]).isNotNull()
    library = F.coalesce(F.col("f.dependency.library"), F.lit(""))
    out = joined.select(
        "component", "occurrences",
        F.when(is_alg, "cryptographic-asset").otherwise("library").alias("type"),
        F.when(is_alg, O.component_name(fa)).otherwise(library).alias("name"),
        F.when(is_alg, O.bom_ref("crypto-asset", fa["name"], fa["key_size"], fa["mode"]))
        .otherwise(O.bom_ref("lib", library)).alias("bom_ref"),
        F.when(is_alg, O.cdx_primitive(fa["primitive"])).alias("primitive"),
        F.when(is_alg, fa["key_size"]).alias("key_size"),
        F.when(is_alg, O.cdx_mode(fa["mode"])).alias("mode"),
        F.when(is_alg, fa["curve"]).alias("curve"),
        F.when(is_alg, O.component_family(fa["name"])).alias("family"),
        F.when(is_alg, F.col("sources")).otherwise(F.col("f.source_engine")).alias("sources"),
        F.col("f.confidence").alias("confidence"), F.col("f.reachable").alias("reachable"),
        F.col("f.quantum_risk").alias("quantum_risk"), F.col("f.severity").alias("severity"),
        F.col("f.artifact_type").alias("artifact_type"),
        F.col("f").alias("finding"),
    )
    if zones is None:
        return out.drop("finding")
    z = last_zone(
        zones, "to_algorithm", "blast_radius_score", "blast_radius_grade", "hop_count"
    )
    keyed = out.withColumn("_key", schema.finding_key("finding"))
    return keyed.join(z, F.col("_key") == F.col("finding_key"), "left").drop(
        "finding", "_key", "finding_key"
    )


def cbom_dependencies(df: DataFrame) -> DataFrame:
    """References of the libraries found, in order: what the scanned root depends on."""
    return (
        df.where(F.col("dependency").isNotNull())
        .select(O.bom_ref("lib", F.col("dependency.library")).alias("depends_on"))
        .distinct().select(F.lit("repo-root").alias("ref"), "depends_on").orderBy("depends_on")
    )


def cbom_metadata(df: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """Totals of the component list, in one row."""
    risk = F.col("quantum_risk")
    safe = F.count_if(risk.isin("quantum-safe", "quantum-resistant"))
    total = F.count(F.lit(1))
    meta = df.agg(
        total.alias("finding_count"),
        F.count_if(risk == "quantum-vulnerable").alias("quantum_vulnerable_count"),
        F.count_if(risk == "deprecated").alias("deprecated_count"),
        F.when(total > 0, F.format_string("%.1f", safe / total * 100)).alias("pqc_safe_percent"),
    )
    if zones is None:
        return meta
    counts = zones.agg(
        F.count_if(F.col("blast_radius_grade") == "Critical").alias("critical_migrations"),
        F.count_if(F.col("blast_radius_grade") == "Significant").alias("significant_migrations"),
        F.coalesce(F.sum(F.size("violated_protocols")), F.lit(0)).alias("protocols_affected"),
    )
    return side_by_side(meta, counts)


def finding_annotations(df: DataFrame) -> DataFrame:
    """One (name, value) row per field that a finding has."""
    full = schema.conform(df, derived=True)
    return full.select(
        schema.finding_key().alias("finding_key"), "engine_rank", "seq", F.inline(O.annotations())
    )


def sarif_rules(df: DataFrame, prefix: str = RULE_PREFIX) -> DataFrame:
    """The rule of each rule key, from its first finding."""
    a = F.col("algorithm")
    name = F.coalesce(F.col("dependency.library"), a["name"])
    described = F.when(
        F.col("dependency").isNotNull(),
        F.concat(F.lit("Cryptographic library: "), F.coalesce(name, F.lit(""))),
    ).when(
        blank_to_null(a["name"]).isNotNull(),
        F.concat(F.lit("Cryptographic algorithm: "), a["name"]),
    ).when(
        blank_to_null(F.col("raw_identifier")).isNotNull(),
        F.concat(F.lit("Cryptographic usage: "), F.col("raw_identifier")),
    ).otherwise("Unknown cryptographic usage")
    rule = F.struct(
        O.sarif_rule_id(prefix).alias("rule_id"), name.alias("rule_name"),
        described.alias("description"),
        F.when(F.col("dependency").isNull(), a["primitive"]).alias("primitive"),
    )
    first = df.groupBy(O.sarif_rule_key().alias("rule_key")).agg(
        F.min_by(rule, _order()).alias("_r")
    )
    return first.select("rule_key", "_r.*")


def sarif_results(df: DataFrame, base: str | None = None, prefix: str = RULE_PREFIX) -> DataFrame:
    """One result row per finding: rule, level, message and place."""
    full = schema.conform(df, derived=True)
    uri = F.concat_ws("!", relative_to(F.col("file"), base), blank_to_null(F.col("inner_path")))
    return full.select(
        O.sarif_rule_id(prefix).alias("rule_id"),
        O.sarif_level(F.col("severity"), F.col("confidence")).alias("level"),
        O.sarif_message().alias("message"), uri.alias("uri"),
        F.when(F.col("line") > 0, F.col("line")).alias("start_line"),
        F.when((F.col("line") > 0) & (F.col("col") > 0), F.col("col")).alias("start_column"),
        "source_engine", "confidence", "reachable", "target_algorithm", "target_standard",
        "data_flow_path", "migration_snippet", O.annotations().alias("properties"),
        "engine_rank", "seq",
    )


def redact_cbom(components: DataFrame, sensitive=None, namespace: str = NAMESPACE) -> DataFrame:
    """Drop properties that must not be shared, from the ``properties`` array column."""
    names = [f"{namespace}:{n}" for n in (sensitive or formats.SENSITIVE_PROPERTIES)]
    return components.withColumn(
        "properties",
        F.filter("properties", lambda p: ~F.coalesce(p["name"].isin(names), F.lit(False))),
    )
