"""Classify algorithm names and findings; effort, target and migration example."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoreline.functions import quantum as Q
from shoreline.functions import scoring as S
from shoreline.functions.text import (
    base_name_of_path,
    blank_to_null,
    contains_any,
    extension,
    let,
    longest_prefix,
    lookup,
    lookup_spelling,
    strip,
)
from shoreline.operators import known
from shoreline.rules import files, snippets
from shoreline.schema import column


def with_classification(
    df: DataFrame, name: Column, primitive: Column, key_size: Column, out: str = "classification"
) -> DataFrame:
    """Add ``out`` (:data:`Q.CLASSIFICATION_TYPE`); NULL where ``name`` is NULL.

    Works on batches and streams alike: rows stay where they are.
    """
    asked = df.withColumn("_name", strip(name)).withColumn("_given", F.struct(
        primitive.alias("primitive"), F.coalesce(key_size, F.lit(0)).alias("size")
    ))
    facts, size = F.col("_facts"), F.col("_given.size")
    staged = known.with_facts(asked, F.col("_name"), Q.name_facts, "_facts")
    staged = known.once(staged, Q.normalize_primitive(F.col("_given.primitive")), "_prim")
    staged = known.once(
        staged, F.when(facts.isNotNull(), Q.outcome(facts, F.col("_prim"), size)), "_outcome"
    )
    result = Q.classification(F.col("_outcome"), facts, size)
    return known.once(staged, F.when(F.col("_outcome").isNotNull(), result), out).drop(
        "_name", "_given", "_facts", "_prim", "_outcome"
    )


def classify_algorithm(names: DataFrame) -> DataFrame:
    """Rows of (name, primitive, key_size) with their classification columns."""
    return with_classification(
        names, F.col("name"), F.col("primitive"), F.col("key_size"), "_c"
    ).select(
        *names.columns,
        F.col("_c.risk").alias("quantum_risk"),
        F.col("_c.severity").alias("severity"),
        F.col("_c.hndl").alias("hndl_risk"),
        F.col("_c.advice").alias("recommendation"),
        F.col("_c.target").alias("target_algorithm"),
        F.col("_c.standard").alias("target_standard"),
    )


def classify_findings(df: DataFrame) -> DataFrame:
    """Classify every finding anew, whatever its feed said.

    Findings that only name a library are ``unknown`` / ``info``.
    """
    keep = [c for c in df.columns if c not in (
        "quantum_risk", "severity", "hndl_risk", "recommendation", "target_algorithm",
        "target_standard", "migration_effort",
    )]
    out = with_classification(
        df, F.col("algorithm.name"), F.col("algorithm.primitive"), F.col("algorithm.key_size"), "_c"
    )
    library_only = F.col("algorithm").isNull() & column(df, "dependency").isNotNull()
    is_config = F.col("source_engine").isin("config-scanner", "tls-probe")
    return out.select(
        *keep,
        F.when(F.col("_c").isNotNull(), F.col("_c.risk"))
        .when(library_only, "unknown").otherwise(column(df, "quantum_risk")).alias("quantum_risk"),
        F.when(F.col("_c").isNotNull(), F.col("_c.severity"))
        .when(library_only, "info").otherwise(column(df, "severity")).alias("severity"),
        F.col("_c.hndl").alias("hndl_risk"),
        F.col("_c.advice").alias("recommendation"),
        F.col("_c.target").alias("target_algorithm"),
        F.col("_c.standard").alias("target_standard"),
        Q.migration_effort(
            F.col("_c.risk"), F.col("algorithm.primitive"), F.coalesce(is_config, F.lit(False))
        ).alias("migration_effort"),
    )


def migration_target(df: DataFrame) -> DataFrame:
    """Target of each (name, key_size): family first, then the size tier."""
    staged = known.with_facts(df, strip(F.col("name")), Q.name_facts, "_facts")
    t = Q.migration_target_for_size(F.col("_facts"), F.coalesce(F.col("key_size"), F.lit(0)))
    return staged.withColumns({
        "target_algorithm": t["algorithm"], "target_standard": t["standard"],
    }).drop("_facts")


def with_priority(df: DataFrame) -> DataFrame:
    """Raise the effort of far-reaching findings, then set P1 to P4."""
    return df.withColumns({
        "migration_effort": Q.upgrade_effort(F.col("migration_effort"), F.col("blast_radius")),
        "priority": S.priority(
            F.col("severity"), F.col("reachable"), F.col("blast_radius"), F.col("confidence"),
            F.col("test_file") | F.col("generated_file"),
        ),
    })


def sort_by_priority(df: DataFrame) -> DataFrame:
    """Priority, severity, file; ties in arrival order."""
    return df.orderBy(
        S.priority_rank(F.col("priority")), S.severity_rank(F.col("severity")),
        F.col("file"), F.col("engine_rank"), F.col("seq"),
    )


def _family(name):
    """``sign`` or ``kem`` for a classical name, cut before ``-<digit>`` or ``-P<digit>``."""
    base = F.regexp_replace(name, r"-[0-9].*$", "")
    base = F.when(base == name, F.regexp_replace(name, r"-[Pp][0-9].*$", "")).otherwise(base)
    return F.when(F.upper(base).isin(snippets.SIGN_FAMILIES), "sign").when(
        F.upper(base).isin(snippets.KEM_FAMILIES), "kem"
    )


def _use(name, primitive, target):
    """``sign`` or ``kem``: by the target, else by name or primitive; NULL if neither fits."""
    by_target = {"ML-KEM": "kem", "MLKEM": "kem", "ML-DSA": "sign", "MLDSA": "sign",
                 "SLH-DSA": "sign", "SLHDSA": "sign"}
    own = F.coalesce(
        _family(name),
        F.when(primitive.isin(snippets.SIGN_PRIMITIVES), "sign"),
        F.when(primitive.isin(snippets.KEM_PRIMITIVES), "kem"),
    )
    return F.when(
        own.isNotNull(),
        F.coalesce(lookup(longest_prefix(F.upper(target), by_target), by_target), own),
    )


def _language(path, leaf, ext):
    in_server_dir = contains_any(path, [f"/{d}/" for d in files.SERVER_DIRS])
    is_ssh = leaf.isin("sshd_config", "ssh_config")
    return F.coalesce(
        lookup_spelling(ext, files.SNIPPET_LANGUAGES),
        F.when((ext == "") & (is_ssh | in_server_dir), "config"),
    )


def _server(path, leaf):
    return (
        F.when(path.contains("haproxy"), "haproxy")
        .when(path.contains("apache") | path.contains("httpd"), "apache")
        .when(path.contains("nginx"), "nginx")
        .when(
            leaf.isin("sshd_config", "ssh_config")
            | contains_any(path, ["/sshd_config.d/", "/ssh/"]),
            "ssh",
        )
        .otherwise("generic")
    )


def migration_snippet(df: DataFrame, templates: list | None = None) -> DataFrame:
    """Add ``migration_snippet`` where file, algorithm and target allow one.

    ``templates`` (language, use, before, after) replaces the built-in examples.
    They are a short rule table and go into the projection as literals.
    """
    rows = snippets.TEMPLATES if templates is None else templates
    name, target = F.col("algorithm.name"), F.col("target_algorithm")
    before = {f"{r[0]}|{r[1]}": r[2] for r in rows}
    after = {f"{r[0]}|{r[1]}": r[3] for r in rows}

    def filled(texts, key):
        raw = lookup(key, texts)
        return F.replace(F.replace(raw, F.lit("{target}"), target), F.lit("{alg}"), name)

    def snippet(language, key):
        return F.when(lookup(key, before).isNotNull(), F.struct(
            language.alias("language"), filled(before, key).alias("before"),
            filled(after, key).alias("after"),
            F.concat(F.lit("Replace "), name, F.lit(" with "), target, F.lit(".")).alias("explanation"),
        ))

    def of(language, path, use):
        leaf = base_name_of_path(path)
        template = (
            F.when(language == "config", F.concat(F.lit("config/"), _server(path, leaf)))
            .when(language == "cpp", "c").when(language == "typescript", "javascript")
            .otherwise(language)
        )
        return let(F.concat(template, F.lit("|"), use), lambda key: snippet(language, key))

    path = F.lower(F.col("file"))
    already_safe = F.upper(name).rlike("^(?:" + "|".join(snippets.ALREADY_SAFE) + ")(?:-|$)")
    wanted = blank_to_null(target).isNotNull() & ~already_safe
    # bound step by step, so that no step is repeated wherever it is named
    found = let(
        _use(name, F.lower(F.col("algorithm.primitive")), target),
        lambda use: F.when(use.isNotNull(), let(
            _language(path, base_name_of_path(path), extension(path)),
            lambda language: F.when(language.isNotNull(), of(language, path, use)),
        )),
    )
    return df.withColumn("migration_snippet", F.when(wanted, found))


def hndl(df: DataFrame, year: int | None = None) -> DataFrame:
    """Surplus and level for rows of (sector, lag_years, crqc_years)."""
    surplus = S.hndl_surplus(
        S.sector_years(F.col("sector")), F.col("lag_years"), F.col("crqc_years"), year
    )
    return df.withColumn("hndl_surplus", surplus).withColumn(
        "hndl_level", S.hndl_level(F.col("hndl_surplus"))
    )


def sector_shelf_life(df: DataFrame) -> DataFrame:
    return df.withColumn("shelf_life_years", S.sector_years(F.col("sector")))
