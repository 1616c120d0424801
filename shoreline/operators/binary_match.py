"""Match rows extracted from binaries with tables of known crypto."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoreline.functions.text import lookup, strip
from shoreline.operators.records import first_per_key
from shoreline.rules import binaries as rules
from shoreline.tables import literal_table


def normalize_symbol(c: Column) -> Column:
    return F.lower(F.ltrim(c, F.lit("_")))


def symbols_kb(spark) -> DataFrame:
    """97 fixed rows."""
    return literal_table(
        spark, rules.symbols(),
        "symbol string, library string, algorithm string, primitive string",
    )


def modules_kb(spark) -> DataFrame:
    """30 fixed rows."""
    return literal_table(
        spark, rules.GO_MODULES, "module string, algorithm string, primitive string"
    )


def symbol_kb_match(symbols: DataFrame, kb: DataFrame | None = None) -> DataFrame:
    """Symbols ``(artifact, symbol, is_dynamic)`` that belong to a crypto library.

    The built-in table is broadcast (97 rows); a given one joins as Spark sees fit.
    """
    table = F.broadcast(symbols_kb(symbols.sparkSession)) if kb is None else kb
    named = symbols.withColumn("symbol", normalize_symbol(F.col("symbol")))
    return named.join(table, "symbol").select(
        "artifact", "symbol", "is_dynamic", "library", "algorithm", "primitive"
    )


def dynlib_kb_match(libs: DataFrame, kb: list | None = None) -> DataFrame:
    """Shared libraries ``(artifact, library)``: the first table row inside the name wins."""
    lower = F.lower(F.col("library"))
    row = F.when(F.lit(False), F.lit(None).cast("struct<algorithm:string,primitive:string>"))
    for part, algorithm, primitive in kb or rules.LIBRARIES:
        row = row.when(lower.contains(part), F.struct(
            F.lit(algorithm).alias("algorithm"), F.lit(primitive).alias("primitive")
        ))
    return libs.withColumn("_m", row).where(F.col("_m").isNotNull()).select(
        *libs.columns, "_m.*"
    )


def module_kb_match(modules: DataFrame, kb: DataFrame | None = None) -> DataFrame:
    """Go modules ``(artifact, path, version, replace_path, replace_version)`` with crypto.

    A replacement is what counts, but the module keeps its own path.
    """
    table = F.broadcast(modules_kb(modules.sparkSession)) if kb is None else kb
    replaced = F.col("replace_path").isNotNull()
    staged = modules.withColumns({
        "module": F.when(replaced, F.col("replace_path")).otherwise(F.col("path")),
        "_v": F.nullif(
            F.when(replaced, F.col("replace_version")).otherwise(F.col("version")), F.lit("")
        ),
    })
    return staged.join(table, "module").select(
        "artifact", "path", "algorithm", "primitive",
        F.concat_ws("@", "path", "_v").alias("library"),
    )


def python_package(name: Column) -> Column:
    """Display name of a known crypto package, by its normalised name."""
    return lookup(F.regexp_replace(F.lower(name), "[_.]", "-"), rules.PYTHON_PACKAGES)


def python_pkg_match(lines: DataFrame) -> DataFrame:
    """Crypto packages in ``(artifact, inner_path, line_text)``, once per inner file.

    Metadata files name them in ``Requires-Dist``, sources in import statements.
    """
    text = F.col("line_text")
    is_metadata = F.col("inner_path").rlike(
        r"(?:\.dist-info/METADATA|\.egg-info/PKG-INFO|EGG-INFO/PKG-INFO)$"
    )
    required = F.regexp_extract(
        strip(F.regexp_extract(text, "^Requires-Dist:(.*)$", 1)), r"^([^ \t(\[<>=!~;]*)", 1
    )
    imported = F.regexp_extract(
        text, r"^(?:import|from)\s+(" + "|".join(rules.PYTHON_IMPORTS) + ")", 1
    )
    is_source = F.col("inner_path").endswith(".py")
    found = F.when(is_metadata, python_package(required)).when(
        is_source, python_package(imported)
    )
    # either kind of line holds one of these words
    likely = lines.where(text.rlike("^(?:Requires-Dist:|import|from)"))
    return likely.withColumn("library", found).where(F.col("library").isNotNull()).select(
        "artifact", "inner_path", "library"
    ).distinct()


def dotnet_type_match(bytes_df: DataFrame, kb: list | None = None) -> DataFrame:
    """.NET crypto types named in artifacts ``(path, content)``, one row per type.

    A single scan per artifact skips those that name none of the namespaces.
    """
    types = rules.dotnet_types() if kb is None else kb
    content = F.col("content")
    likely = bytes_df.where(
        F.contains(content, F.lit(rules.DOTNET_SYSTEM).cast("binary"))
        | F.contains(content, F.lit(rules.DOTNET_BC).cast("binary"))
    ) if kb is None else bytes_df
    found = F.array_compact(F.array(*[
        F.when(F.contains(content, F.lit(name).cast("binary")), F.struct(
            F.lit(name).alias("type_name"), F.lit(algorithm).alias("algorithm"),
            F.lit(primitive).alias("primitive"),
        ))
        for name, algorithm, primitive in types
    ]))
    return likely.select("path", F.inline(found))


def byte_signature_match(bytes_df: DataFrame) -> DataFrame:
    """Crypto constants in artifacts ``(path, content)``: one row per algorithm.

    The first signature in table order counts, with the offset of its first
    place.  Content is only turned to hex for signatures that are there.
    """
    content = F.col("content")

    def offset(pattern):
        # Position in hex; an odd number of digits before it is a hit between two
        # bytes, so those are skipped by matching whole bytes.
        text = F.hex(content)
        before = F.regexp_extract(text, "^((?:..)*?)" + pattern, 1)
        return (F.length(before) / 2).cast("bigint")

    found = F.array_compact(F.array(*[
        F.when(F.contains(content, F.unhex(F.lit(pattern))), F.struct(
            F.lit(i).alias("row_no"), F.lit(name).alias("pattern_name"),
            F.lit(algorithm).alias("algorithm"), F.lit(primitive).alias("primitive"),
            offset(pattern).alias("offset"),
        ))
        for i, (name, algorithm, primitive, pattern) in enumerate(rules.SIGNATURES)
    ]))
    # rows come out in table order: keep the first of each algorithm
    unique = F.filter("_found", lambda m, i: ~F.exists(
        F.slice("_found", F.lit(1), i), lambda e: e["algorithm"] == m["algorithm"]
    ))
    return bytes_df.select("path", found.alias("_found")).where(F.size("_found") > 0).select(
        "path", F.inline(unique)
    )


def binary_signal_confidence(matches: DataFrame) -> DataFrame:
    """Confidence of matches ``(artifact, kind, is_dynamic, ...)`` by what else is there.

    Kinds are ``constant``, ``symbol`` and ``library``.  A dynamic symbol, or
    three kinds of evidence, make it medium.  Symbol rows are judged by their own
    dynamic flag.  The flags per artifact are one map-side-combined row.
    """
    is_symbol = F.col("kind") == "symbol"
    dynamic = F.coalesce(F.col("is_dynamic"), F.lit(False))
    flags = matches.groupBy(F.col("artifact").alias("_a")).agg(
        F.bool_or(F.col("kind") == "constant").alias("_const"),
        F.bool_or(is_symbol & ~dynamic).alias("_static"),
        F.bool_or(is_symbol & dynamic).alias("_dyn"),
        F.bool_or(F.col("kind") == "library").alias("_lib"),
    )
    own_dynamic = F.when(is_symbol, dynamic).otherwise(F.col("_dyn"))
    signals = (
        F.col("_const").cast("int") + F.col("_static").cast("int")
        + own_dynamic.cast("int") + F.col("_lib").cast("int")
    )
    return matches.join(flags, F.col("artifact") == F.col("_a")).select(
        *matches.columns,
        F.when(own_dynamic | (signals >= 3), "medium").otherwise("low").alias("confidence"),
    )


def dedup_artifact_findings(df: DataFrame) -> DataFrame:
    """First row per artifact, algorithm, primitive and raw identifier."""
    return first_per_key(
        df, ["artifact", "algorithm", "primitive", "raw_identifier"], F.col("seq")
    )
