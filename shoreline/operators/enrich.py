"""Fill in missing key sizes from constants in the source."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoreline import schema
from shoreline.plans.checkpoints import cut
from shoreline.rules import constants as rules


def algorithm_token(name: Column) -> Column:
    """Leading letters and digits of the name, upper case."""
    return F.regexp_extract(F.upper(name), "^([A-Z0-9]*)", 1)


def plausible_key_size(token: Column, value: Column) -> Column:
    """Whether a number can be a key size of this kind of algorithm."""
    symmetric = value.isin(rules.SYMMETRIC_SIZES)
    rsa = value.isin(rules.RSA_SIZES)
    ec = value.isin(rules.EC_SIZES)
    return (
        F.when(token.isin(rules.SYMMETRIC_TOKENS), symmetric)
        .when(token.isin(rules.RSA_TOKENS), rsa)
        .when(token.isin(rules.EC_TOKENS), ec)
        .otherwise(symmetric | rsa | ec)
    )


def name_segments(name: Column) -> Column:
    """Upper-case parts of a constant name, split at separators and camel case."""
    spaced = F.regexp_replace(name, "(?<=[a-z])(?=[A-Z])", " ")
    return F.filter(F.split(F.upper(spaced), "[^A-Z0-9]+"), lambda s: s != "")


def _contains_word(text: Column, word: Column) -> Column:
    """``word`` occurs in ``text`` without a letter or digit right beside it."""
    quoted = F.concat(
        F.lit(r"(?<![A-Za-z0-9])\Q"), F.replace(word, F.lit("\\E"), F.lit("\\E\\\\E\\Q")),
        F.lit(r"\E(?![A-Za-z0-9])"),
    )
    return F.rlike(text, quoted)


def _with_key_size(algorithm: Column, size: Column) -> Column:
    return F.struct(
        algorithm["name"].alias("name"), algorithm["primitive"].alias("primitive"),
        size.cast("int").alias("key_size"), algorithm["mode"].alias("mode"),
        algorithm["curve"].alias("curve"),
    )


def _lacks_size() -> Column:
    a = F.col("algorithm")
    return a.isNotNull() & (F.coalesce(a["key_size"], F.lit(0)) <= 0)


def enrich_key_size(df: DataFrame, constants: DataFrame) -> DataFrame:
    """Key size from the constants ``(file, name, value)`` of the finding's file.

    A constant counts if its name speaks of keys or of the algorithm and its
    value is plausible.  One such constant is taken; of several, the only one
    whose name holds the algorithm, if there is just one.

    The answer depends on file and algorithm token alone, so it is worked out
    once per pair and joined back; findings themselves are joined once.
    """
    token = algorithm_token(F.col("algorithm.name"))
    # the constants of a file are those of the finding's own project
    project = schema.scope_of(df, constants, "constants")
    wanted = (
        df.where(_lacks_size() & (F.coalesce(F.col("file"), F.lit("")) != ""))
        .select(project.alias("_project"), F.col("file").alias("_file"), token.alias("_token")).distinct()
    )
    known_sizes = sorted({*rules.SYMMETRIC_SIZES, *rules.RSA_SIZES, *rules.EC_SIZES})
    consts = constants.where(F.col("value").isin(known_sizes)).select(
        project.alias("_in"), F.col("file").alias("_at"), F.col("name").alias("_name"),
        F.col("value").alias("_value"),
    ).distinct()
    in_name = (F.col("_token") != "") & _contains_word(F.upper("_name"), F.col("_token"))
    speaks_of_keys = F.arrays_overlap(
        name_segments(F.col("_name")), F.array(*[F.lit(w) for w in rules.KEY_WORDS])
    )
    same = F.col("_project").eqNullSafe(F.col("_in")) & (F.col("_file") == F.col("_at"))
    eligible = wanted.join(consts, same).withColumn("_in_name", in_name).where(
        (F.col("_in_name") | speaks_of_keys)
        & plausible_key_size(F.col("_token"), F.col("_value"))
    )
    named = F.col("_in_name")
    answers = eligible.groupBy("_project", "_file", "_token").agg(
        F.count(F.lit(1)).alias("n"), F.max("_value").alias("only"),
        F.count_if(named).alias("n_named"), F.max(F.when(named, F.col("_value"))).alias("named"),
    ).select(
        "_project", "_file", "_token",
        F.when(F.col("n") == 1, F.col("only")).when(F.col("n_named") == 1, F.col("named"))
        .alias("_found"),
    ).where(F.col("_found").isNotNull())
    a = F.col("algorithm")
    joined = df.withColumn("_t", token).join(
        answers, project.eqNullSafe(F.col("_project")) & (F.col("file") == F.col("_file"))
        & (F.col("_t") == F.col("_token")), "left"
    )
    return joined.withColumn(
        "algorithm",
        F.when(_lacks_size() & F.col("_found").isNotNull(), _with_key_size(a, F.col("_found")))
        .otherwise(a),
    ).drop("_t", "_project", "_file", "_token", "_found")


def _tokens(text: Column) -> Column:
    return F.filter(F.split(text, "[^A-Za-z0-9]+"), lambda s: s != "")


def enrich_key_size_by_identifier(df: DataFrame, constants: DataFrame) -> DataFrame:
    """Key size from the longest constant name that is a word of the raw identifier.

    A name found as a word is a run of the identifier's tokens, so names and runs
    are joined on equality of all their tokens and only names that differ in their
    separators are tested further.  A name without any letter or digit is looked
    for by its first character.  Each distinct identifier of a project is taken apart
    once, and only constants of its own project count.
    """
    project = schema.scope_of(df, constants, "constants")
    field = F.regexp_replace(F.col("name"), r"^[^.]*\.", "")
    # read twice, for the names and for the longest of them; the sources are read once
    consts = cut(
        constants.where(F.col("value") > 0)
        .select(project.alias("_in"), field.alias("_field"), F.col("value").alias("_value"))
        .where(F.col("_field") != "")
        .groupBy("_in", "_field").agg(F.max("_value").alias("_value"))
        .withColumn("_n", F.size(_tokens(F.col("_field"))))
        .withColumn("_run", F.when(F.col("_n") > 0, F.array_join(_tokens(F.col("_field")), " "))
                    .otherwise(F.concat(F.lit("#"), F.substring("_field", 1, 1))))
    )
    raw = F.col("raw_identifier")
    tokens = F.col("_tokens")
    runs = F.flatten(F.transform(tokens, lambda t, i: F.transform(
        F.sequence(F.lit(1), F.least(F.size(tokens) - i, F.col("_most"))),
        lambda n: F.array_join(F.slice(tokens, i + 1, n), " "))))
    separators = F.array_distinct(F.filter(
        F.split(F.regexp_replace("_raw", "[A-Za-z0-9]+", ""), ""), lambda c: c != ""))
    words = (
        df.where(_lacks_size() & (F.coalesce(raw, F.lit("")) != "")).select(project.alias("_project"), raw.alias("_raw"))
        .distinct()
        # no run longer than the longest name is needed
        .withColumn("_most", F.greatest(F.lit(1), consts.agg(F.max("_n")).scalar()))
        .withColumn("_tokens", _tokens(F.col("_raw")))
        .select("_project", "_raw", F.explode(F.concat(
            F.array_distinct(runs), F.transform(separators, lambda c: F.concat(F.lit("#"), c)))).alias("_asked"))
    )
    same = (F.col("_asked") == F.col("_run")) & F.col("_project").eqNullSafe(F.col("_in"))
    hits = words.join(consts, same).where(_contains_word(F.col("_raw"), F.col("_field")))
    # longest name first, then alphabetical
    best = F.max_by("_value", F.struct(F.length("_field"), _reversed_order("_field")))
    answers = hits.groupBy("_project", "_raw").agg(best.alias("_found"))
    a = F.col("algorithm")
    joined = df.join(answers, project.eqNullSafe(F.col("_project")) & (raw == F.col("_raw")), "left")
    return joined.withColumn(
        "algorithm",
        F.when(_lacks_size() & F.col("_found").isNotNull(), _with_key_size(a, F.col("_found")))
        .otherwise(a),
    ).drop("_project", "_raw", "_found")


def _reversed_order(field: str) -> Column:
    """Sorts names of one length backwards, so that the maximum is the first of them."""
    return F.translate(
        F.hex(F.encode(F.col(field), "UTF-8")), "0123456789ABCDEF", "FEDCBA9876543210"
    )
