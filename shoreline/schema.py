"""The findings schema and helpers to reach it."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALGORITHM = "struct<name:string,primitive:string,key_size:int,mode:string,curve:string>"
DEPENDENCY = "struct<library:string,version:string>"
FLOW = "array<struct<file:string,line:int,col:int,message:string>>"

# Observed columns, then columns later steps derive.  Absent is NULL.
# ``project`` is the scan a finding belongs to; nothing is matched across projects.
FINDING = {
    "project": "string", "file": "string", "line": "int", "col": "int", "inner_path": "string",
    "artifact_type": "string", "algorithm": ALGORITHM,
    "dependency": DEPENDENCY, "confidence": "string",
    "source_engine": "string", "corroborated_by": "array<string>",
    "reachable": "string", "raw_identifier": "string",
    "data_flow_path": FLOW,
    "negotiated_group": "int", "negotiated_group_name": "string",
    "pqc_present": "boolean", "pqc_maturity": "string",
    "partial_inventory": "boolean", "partial_inventory_reason": "string",
    "handshake_volume_class": "string", "handshake_bytes": "bigint",
    "deep_probe_supported_groups": "array<int>", "deep_probe_hrr_groups": "array<int>",
    "supported_groups": "array<int>", "supported_sig_algs": "array<int>",
    "server_preferred_group": "int", "server_preference_mode": "string",
    "enumeration_mode": "string", "engine_rank": "int", "seq": "bigint",
}
DERIVED = {
    "quantum_risk": "string", "severity": "string", "recommendation": "string",
    "hndl_risk": "string", "priority": "string", "blast_radius": "int",
    "test_file": "boolean", "generated_file": "boolean", "migration_effort": "string",
    "target_algorithm": "string", "target_standard": "string",
    "migration_snippet": "struct<language:string,before:string,after:string,explanation:string>",
}


def conform(df: DataFrame, derived: bool = False) -> DataFrame:
    """Exactly the findings columns: missing ones are NULL, other ones are dropped."""
    wanted = {**FINDING, **DERIVED} if derived else FINDING
    have = set(df.columns)
    return df.select(*[
        (F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in wanted.items()
    ])


def column(df: DataFrame, name: str) -> Column:
    """A findings column, NULL of its type where the DataFrame does not have it."""
    if name in df.columns:
        return F.col(name)
    return F.lit(None).cast({**FINDING, **DERIVED}[name])


def algorithm(name, primitive=None, key_size=None, mode=None, curve=None) -> Column:
    """The algorithm struct; zero sizes and blank texts become NULL."""
    def text(c):
        return F.lit(None).cast("string") if c is None else F.nullif(c, F.lit(""))

    size = F.lit(None).cast("int") if key_size is None else F.nullif(key_size, F.lit(0))
    return F.struct(
        name.alias("name"), text(primitive).alias("primitive"),
        size.cast("int").alias("key_size"), text(mode).alias("mode"), text(curve).alias("curve"),
    )


def finding_key(within: str | None = None) -> Column:
    """Duplicate key: project, place and algorithm name, or library and version.

    A struct, so that no two findings share a key by the way their parts are written;
    in joins and groups an absent project is equal to an absent one only.  Column, key
    size, mode and curve are left out on purpose, since feeds disagree about them.
    ``within`` names a struct column holding the finding; :func:`key_text` writes a key.
    """
    def col(name):
        return F.col(name if within is None else f"{within}.{name}")

    name = F.nullif(col("algorithm")["name"], F.lit(""))
    library = F.nullif(col("dependency")["library"], F.lit(""))
    kind = F.when(name.isNotNull(), "alg").when(library.isNotNull(), "dep").otherwise("raw")
    line = F.when(name.isNull() & library.isNotNull(), 0).otherwise(F.coalesce(col("line"), F.lit(0)))
    version = F.nullif(col("dependency")["version"], F.lit(""))
    detail = F.when(name.isNotNull(), None).when(library.isNotNull(), version).otherwise(
        F.coalesce(col("source_engine"), F.lit("")))
    return F.struct(
        *file_key(within), kind.alias("kind"), line.alias("line"),
        F.coalesce(name, library, col("raw_identifier"), F.lit("")).alias("name"), detail.alias("detail"),
    )


def key_text(key: Column) -> Column:
    """A duplicate key as reports show it; for reading, since separators are not escaped."""
    place = F.when(key["inner_path"] != "", F.concat(key["file"], F.lit("!"), key["inner_path"])).otherwise(key["file"])
    line = key["line"].cast("string")
    text = (
        F.when(key["kind"] == "alg", F.concat_ws("|", place, line, F.lit("alg"), key["name"]))
        .when(key["kind"] == "dep", F.concat_ws("|", place, F.lit("dep"), F.concat_ws("@", key["name"], key["detail"])))
        .otherwise(F.concat_ws("|", place, line, key["name"], key["detail"]))
    )
    return F.concat_ws("|", key["project"], text)


def file_key(within: str | None = None) -> list[Column]:
    """Project, file and path inside the archive."""
    def col(name):
        return F.col(name if within is None else f"{within}.{name}")

    return [col("project").alias("project"), F.coalesce(col("file"), F.lit("")).alias("file"),
            F.coalesce(col("inner_path"), F.lit("")).alias("inner_path")]


SCOPE = "project"


def scope_columns(df: DataFrame) -> list[str]:
    """The columns that say which scan a row belongs to: ``project``, where there is one."""
    return [SCOPE] if SCOPE in df.columns else []


def in_project(df: DataFrame, project: str | Column | None) -> DataFrame:
    """Say which scan rows belong to; a Column may read it from their file names."""
    if project is None:
        return df
    return df.withColumn(SCOPE, project if isinstance(project, Column) else F.lit(project))


def scope_of(df: DataFrame, other: DataFrame, what: str) -> Column:
    """The scope to match ``other`` in: its project, or none if neither side names projects.

    Rows without a project match such rows only.  A side without the column says nothing
    about which scan it is from, so it is refused where the other side has it.
    """
    if (SCOPE in df.columns) != (SCOPE in other.columns):
        raise ValueError(f"findings and {what} must both have a column {SCOPE!r}, or neither")
    return F.col(SCOPE) if SCOPE in df.columns else F.lit(None).cast("string")
