"""Canonical algorithm and curve names; folding of generic protocol names."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoreline import schema
from shoreline.functions.text import blank_to_null, longest_prefix, lookup, strip
from shoreline.operators import known
from shoreline.rules import quantum, registry
from shoreline.tables import literal_table


def patterns_dim(spark) -> DataFrame:
    """Literal names of the registry: 259 fixed rows, so broadcasting is safe."""
    return literal_table(
        spark, [(n.upper(), n, p) for n, _, p in registry.patterns()],
        "pattern string, canonical string, primitive string",
    )


def with_canonical_name(df: DataFrame, name, key_size, mode, out: str = "canonical") -> DataFrame:
    """Add ``out``: struct of canonical name, primitive and kind of match.

    Exact names come first (with ``_`` read as ``-``, then as written), then the
    longest family that the name starts with; otherwise the name stays.
    Both lookups join a fixed 259-row table, so the rows themselves never move.
    """
    dim = patterns_dim(df.sparkSession)
    clean = F.replace(strip(name), F.lit("_"), F.lit("-"))
    hit = ["pattern", "canonical", "primitive"]
    by_clean = F.broadcast(dim.select(*[F.col(c).alias(f"_c_{c}") for c in hit]))
    by_raw = F.broadcast(dim.select(*[F.col(c).alias(f"_r_{c}") for c in hit]))
    families = registry.families()
    upper = F.upper(clean)
    prefix = longest_prefix(upper, [f.upper() for f in families])
    family = F.col("_family")
    rest = blank_to_null(
        F.regexp_replace(F.substr(upper, F.lit(5)), "^[-_]+|[-_]+$", "")
    )
    by_family = F.when(
        (family == "HMAC") & rest.isNotNull(), F.concat(F.lit("HMAC-"), rest)
    ).otherwise(F.concat_ws(
        "-", family,
        F.when(key_size > 0, key_size.cast("string")),
        F.upper(blank_to_null(mode)),
    ))
    joined = (
        df.withColumn("_upper_clean", upper).withColumn("_upper_raw", F.upper(strip(name)))
        .join(by_clean, F.col("_upper_clean") == F.col("_c_pattern"), "left")
        .join(by_raw, F.col("_upper_raw") == F.col("_r_pattern"), "left")
    )
    exact = F.coalesce(F.col("_c_canonical"), F.col("_r_canonical"))
    joined = known.once(joined, F.when(exact.isNull(), lookup(prefix, {f.upper(): f for f in families})), "_family")
    result = F.struct(
        F.when(exact.isNotNull(), exact).when(family.isNotNull(), by_family)
        .otherwise(name).alias("name"),
        F.when(exact.isNotNull(), F.coalesce(F.col("_c_primitive"), F.col("_r_primitive")))
        .otherwise(lookup(family, families)).alias("primitive"),
        F.when(exact.isNotNull(), "exact").when(family.isNotNull(), "prefix")
        .otherwise("none").alias("match"),
    )
    helpers = ["_upper_clean", "_upper_raw", "_family"] + [f"_{s}_{c}" for s in "cr" for c in hit]
    return known.once(joined, F.when(name.isNotNull(), result), out).drop(*helpers)


def resolve_curve_column(curve):
    """Curve by name (kept as written), alias (any case) or OID; else unchanged."""
    names = {}
    aliases, oids = {}, {}
    for family, name, oid, alias in registry.CURVES:
        names[name] = name
        names[f"{family}/{name}"] = f"{family}/{name}"
        oids[oid] = f"{family}/{name}"
        aliases.update({a.lower(): f"{family}/{name}" for a in alias})
    return F.coalesce(
        lookup(curve, names), lookup(F.lower(strip(curve)), aliases), lookup(curve, oids), curve
    )


def resolve_curve(df: DataFrame, key: str = "curve") -> DataFrame:
    return df.withColumn("resolved_curve", resolve_curve_column(F.col(key)))


def normalize_algorithm(df: DataFrame) -> DataFrame:
    """Canonical name and curve of every finding; a missing primitive is filled in."""
    a = F.col("algorithm")
    named = with_canonical_name(df, a["name"], a["key_size"], a["mode"], "_canon")
    fixed = F.struct(
        F.col("_canon.name").alias("name"),
        F.coalesce(blank_to_null(a["primitive"]), F.col("_canon.primitive")).alias("primitive"),
        a["key_size"].alias("key_size"), a["mode"].alias("mode"),
        resolve_curve_column(a["curve"]).alias("curve"),
    )
    # worked out once, since the merge filters on the name three times
    fixed = F.when(a.isNotNull() & F.col("_canon").isNotNull(), fixed).otherwise(a)
    return known.once(named, fixed, "_fixed").withColumn("algorithm", F.col("_fixed")).drop("_canon", "_fixed")


def fold_generic_protocol(df: DataFrame) -> DataFrame:
    """``TLS``/``SSL`` takes the versioned name if its line has exactly one version.

    Only rows with a generic name are joined and shuffled.  The other rows are a
    filter over the input, and the version sets hold at most six names per line.
    """
    name = F.col("algorithm.name")
    is_generic = F.coalesce(name.isin(quantum.GENERIC_PROTOCOLS), F.lit(False))
    versions = (
        df.where(name.isin(quantum.VERSIONED_PROTOCOLS))
        .select(F.struct(*schema.file_key()).alias("_fk"), F.coalesce("line", F.lit(0)).alias("_ln"),
                name.alias("_version"))
        .groupBy("_fk", "_ln")
        .agg(F.min("_version").alias("_low"), F.max("_version").alias("_high"))
        .where(F.col("_low") == F.col("_high"))
    )
    generic = (
        df.where(is_generic)
        .withColumns({"_fk": F.struct(*schema.file_key()), "_ln": F.coalesce("line", F.lit(0))})
        .join(versions, ["_fk", "_ln"], "left")
    )
    a = F.col("algorithm")
    folded = generic.withColumn("algorithm", F.struct(
        F.coalesce("_low", a["name"]).alias("name"), a["primitive"].alias("primitive"),
        a["key_size"].alias("key_size"), a["mode"].alias("mode"), a["curve"].alias("curve"),
    )).select(*df.columns)
    return df.where(~is_generic).unionByName(folded)
