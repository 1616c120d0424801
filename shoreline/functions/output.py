"""Expressions of the output formats."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from shoreline import schema
from shoreline.functions.text import blank_to_null, lookup, lookup_spelling, strip
from shoreline.rules import formats


def neutralize_formula(c: Column) -> Column:
    """A leading quote for texts that a spreadsheet would run as a formula."""
    return F.when(c.rlike("^[=+\\-@\\t\\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def cdx_primitive(c: Column) -> Column:
    known = lookup_spelling(F.lower(c), formats.CDX_PRIMITIVES)
    return F.coalesce(known, F.lit("unknown"))


def cdx_mode(c: Column) -> Column:
    """Mode as the component schema knows it; NULL when the finding has none."""
    mode = F.lower(strip(c))
    return F.when(mode.isin(formats.CDX_MODES), mode).when(blank_to_null(c).isNotNull(), "other")


def component_family(name: Column) -> Column:
    upper = F.upper(name)
    out = F.when(F.lit(False), name)
    for family in formats.COMPONENT_FAMILIES:
        out = out.when(upper.startswith(family.upper()), family)
    return out.otherwise(F.substring_index(name, "-", 1))


def component_name(a: Column) -> Column:
    """Algorithm name with size and mode added where it lacks them."""
    size = F.when(a["key_size"] > 0, a["key_size"].cast("string"))
    sized = F.when(
        size.isNotNull() & ~a["name"].contains(size), F.concat_ws("-", a["name"], size)
    ).otherwise(a["name"])
    mode = blank_to_null(a["mode"])
    return F.when(
        mode.isNotNull() & ~F.upper(sized).contains(F.upper(mode)), F.concat_ws("-", sized, mode)
    ).otherwise(sized)


def bom_ref(prefix: str, name: Column, size: Column | None = None, mode: Column | None = None) -> Column:
    """Stable reference: the prefix and 64 bits of a digest of what is referred to."""
    parts = [F.lit(prefix), F.coalesce(name, F.lit(""))]
    if size is not None:
        parts.append(F.coalesce(F.when(size > 0, size.cast("string")), F.lit("")))
    if mode is not None:
        parts.append(F.coalesce(mode, F.lit("")))
    return F.concat(
        F.lit(prefix + "-"), F.substring(F.sha2(F.concat(*parts).cast("binary"), 256), 1, 16)
    )


def sarif_level(severity: Column, confidence: Column) -> Column:
    return F.coalesce(
        lookup(severity, formats.SARIF_SEVERITY_LEVELS),
        F.when(confidence.isin(formats.SARIF_WARNING_CONFIDENCES), "warning"),
        F.lit("note"),
    )


def sarif_message() -> Column:
    """One line about a finding, over the findings schema."""
    a, library = F.col("algorithm"), F.col("dependency.library")
    agreed = F.coalesce(F.size("corroborated_by"), F.lit(0)) > 0
    confirmed = F.when(agreed, F.concat(
        F.lit(" (confirmed by "),
        F.array_join(F.concat(F.array("source_engine"), F.col("corroborated_by")), ", "), F.lit(")"),
    )).otherwise("")
    about_library = F.concat(F.lit("Cryptographic library detected: "), F.coalesce(library, F.lit("")))
    about_algorithm = F.concat_ws(
        ", ",
        F.concat(F.lit("Cryptographic algorithm detected: "), F.coalesce(a["name"], F.lit(""))),
        F.concat(F.lit("primitive="), blank_to_null(a["primitive"])),
        F.when(a["key_size"] > 0, F.concat(F.lit("keySize="), a["key_size"])),
        F.concat(F.lit("mode="), blank_to_null(a["mode"])),
        F.concat(F.lit("curve="), blank_to_null(a["curve"])),
    )
    return (
        F.when(F.col("dependency").isNotNull(), F.concat(about_library, confirmed))
        .when(a.isNotNull(), F.concat(about_algorithm, confirmed))
        .otherwise("Cryptographic usage detected")
    )


def sarif_rule_key() -> Column:
    return F.coalesce(
        F.concat(F.lit("dep/"), blank_to_null(F.col("dependency.library"))),
        F.concat(F.lit("alg/"), blank_to_null(F.col("algorithm.name"))),
        F.concat(F.lit("raw/"), blank_to_null(F.col("raw_identifier"))),
        F.concat(F.lit("unknown/"), F.coalesce("source_engine", F.lit(""))),
    )


def sanitize_id(c: Column) -> Column:
    """Upper-case id text without separators and quotes."""
    out = c
    for old, new in formats.RULE_ID_REPLACEMENTS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.upper(out)


def sarif_rule_id(prefix: str) -> Column:
    """Rule id of a finding, such as ``<prefix>-ALG-AES``."""
    def ident(kind, c):
        return F.concat(F.lit(f"{prefix}-{kind}-"), sanitize_id(c))

    return F.coalesce(
        F.when(F.col("dependency").isNotNull(),
               ident("DEP", F.coalesce(F.col("dependency.library"), F.lit("")))),
        ident("ALG", blank_to_null(F.col("algorithm.name"))),
        ident("RAW", blank_to_null(F.col("raw_identifier"))),
        F.lit(f"{prefix}-UNKNOWN"),
    )


def annotations() -> Column:
    """Name/value pairs of the fields a finding has, over the derived findings schema."""
    def pair(name, value):
        return F.when(value.isNotNull(), F.struct(F.lit(name).alias("name"), value.alias("value")))

    def text(c):
        return blank_to_null(F.col(c))

    def flag(c):
        return F.when(F.col(c), "true")

    def numbers(c):
        return F.when(F.size(c) > 0, F.to_json(F.col(c)))

    hidden = F.when(F.col("partial_inventory"), text("partial_inventory_reason"))
    group = F.col("server_preferred_group")
    return F.array_compact(F.array(
        pair("quantumRisk", text("quantum_risk")),
        pair("severity", text("severity")),
        pair("recommendation", text("recommendation")),
        pair("hndlRisk", text("hndl_risk")),
        pair("migrationEffort", text("migration_effort")),
        pair("negotiatedGroupName", text("negotiated_group_name")),
        pair("pqcPresent", flag("pqc_present")),
        pair("pqcMaturity", text("pqc_maturity")),
        pair("partialInventory", flag("partial_inventory")),
        pair("partialInventoryReason", hidden),
        pair("handshakeVolumeClass", text("handshake_volume_class")),
        pair("handshakeBytes", F.when(
            F.col("handshake_bytes") > 0, F.col("handshake_bytes").cast("string"))),
        pair("supportedGroups", numbers("supported_groups")),
        pair("supportedSigAlgs", numbers("supported_sig_algs")),
        pair("serverPreferredGroup", F.when(
            group != 0, F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(group)), 4, "0")))),
        pair("serverPreferenceMode", text("server_preference_mode")),
        pair("enumerationMode", text("enumeration_mode")),
    ))


def csv_columns() -> list:
    """The fixed CSV columns over the derived findings schema."""
    def text(c):
        return neutralize_formula(F.coalesce(c, F.lit("")))

    def flag(c):
        return F.coalesce(F.col(c), F.lit(False)).cast("string")

    def positive(c):
        return F.coalesce(F.when(c > 0, c.cast("string")), F.lit(""))

    values = [
        text(F.col("severity")), text(F.col("confidence")), text(F.col("algorithm.name")),
        text(F.col("algorithm.primitive")), positive(F.col("algorithm.key_size")),
        text(F.col("quantum_risk")), flag("pqc_present"), text(F.col("pqc_maturity")),
        text(F.col("negotiated_group_name")), text(F.col("handshake_volume_class")),
        positive(F.col("handshake_bytes")), text(F.col("file")),
        F.coalesce("line", F.lit(0)).cast("string"), text(F.col("source_engine")),
        text(F.col("reachable")), flag("partial_inventory"),
        text(F.col("partial_inventory_reason")), text(schema.key_text(schema.finding_key())),
    ]
    return [v.alias(name) for name, v in zip(formats.CSV_COLUMNS, values)]
