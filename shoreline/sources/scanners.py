"""Outputs of scanning tools as findings.

Each ``parse_*`` takes rows in the tool's shape; each ``load_*`` reads the
tool's files into it.  ``engine_rank`` is the feed's place in the merge order.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoreline import schema
from shoreline.functions.scanners import (
    infer_from_rule_id,
    parse_algorithm_columns,
    primitive_from_rule_id,
    purl_manifest,
    purl_namespace,
)
from shoreline.functions.text import blank_to_null, lookup, lookup_spelling
from shoreline.rules import formats

AST_TYPE = (
    "assetType string, identifier string, path string, "
    "evidence struct<line:int,column:int>, "
    "metadata struct<keysize:string,primitive:string,mode:string,curve:string>"
)
PATTERN_TYPE = (
    "findings array<struct<id:string,findingType:string,category:string,algorithm:string,"
    "primitive:string,keySize:int,file:string,line:int,column:int,severity:int,"
    "quantumRisk:string,confidence:string>>"
)
MATCH_TYPE = (
    "text string, range struct<start:struct<line:int,column:int>>, file string, "
    "ruleId string, message string, severity string, "
    "metaVariables map<string,struct<text:string>>"
)
_PHYSICAL = (
    "struct<artifactLocation:struct<uri:string>,region:struct<startLine:int,startColumn:int>>"
)
SARIF_TYPE = (
    "runs array<struct<"
    "tool:struct<driver:struct<rules:array<struct<id:string,"
    "properties:struct<algorithm:string,primitive:string>>>>>,"
    f"results:array<struct<ruleId:string,locations:array<struct<physicalLocation:{_PHYSICAL}>>,"
    "codeFlows:array<struct<threadFlows:array<struct<locations:array<struct<"
    f"location:struct<physicalLocation:{_PHYSICAL}>,message:struct<text:string>>>>>>>>>>>"
)
SBOM_TYPE = (
    "components array<struct<type:string,name:string,version:string,purl:string,"
    "`group`:string,properties:array<struct<name:string,value:string>>>>"
)
ASSETS_TYPE = (
    "assets array<struct<type:string,algorithm:string,keySize:int,curve:string,file:string,"
    "line:int>>"
)
USAGES_TYPE = (
    "dependencies array<struct<name:string,version:string,ecosystem:string,"
    "cryptoUsages:array<struct<algorithm:string,quantumRisk:string,reachable:boolean,"
    "file:string,line:int>>>>"
)


def _finding(df: DataFrame, engine: str, engine_rank: int, **columns) -> DataFrame:
    """Findings of one feed; ``seq`` keeps the order in which its rows were read."""
    given = {
        "confidence": F.lit("medium"), "reachable": F.lit("unknown"), "line": F.lit(0),
        "source_engine": F.lit(engine), "engine_rank": F.lit(engine_rank),
        "seq": F.col("seq") if "seq" in df.columns else F.monotonically_increasing_id(),
        **columns,
    }
    return schema.conform(df.select(*[c.alias(name) for name, c in given.items()]))


def _documents(spark: SparkSession, path, ddl: str) -> DataFrame:
    return spark.read.schema(ddl).option("multiLine", "true").json(path)


def parse_scanner(df: DataFrame, engine_rank: int = 0) -> DataFrame:
    """AST scanner rows: libraries, and algorithms whose metadata beats the name."""
    is_algorithm = F.col("assetType") == "algorithm"
    parsed = parse_algorithm_columns(F.col("identifier"))
    meta = F.col("metadata")
    number = F.regexp_replace(meta["keysize"], r"\.0+$", "")
    size = F.when(number.rlike("^[0-9]{1,10}$"), number.try_cast("int"))
    algorithm = schema.algorithm(
        F.col("identifier"), meta["primitive"],
        F.coalesce(F.when(size > 0, size), parsed["key_size"]),
        F.coalesce(blank_to_null(meta["mode"]), parsed["mode"]),
        F.coalesce(blank_to_null(meta["curve"]), parsed["curve"]),
    )
    library = F.struct(
        F.col("identifier").alias("library"), F.lit(None).cast("string").alias("version")
    )
    return _finding(
        df, "cipherscope", engine_rank,
        file=F.col("path"), line=F.col("evidence.line"), col=F.col("evidence.column"),
        algorithm=F.when(is_algorithm, algorithm),
        dependency=F.when(F.col("assetType") == "library", library),
        raw_identifier=F.col("identifier"),
    )


def load_scanner_jsonl(spark: SparkSession, path, engine_rank: int = 0) -> DataFrame:
    return parse_scanner(spark.read.schema(AST_TYPE).json(path), engine_rank)


def parse_algorithm_id(df: DataFrame) -> DataFrame:
    """Add size, mode and curve that the ``identifier`` spells out."""
    p = parse_algorithm_columns(F.col("identifier"))
    return df.withColumns({"key_size": p["key_size"], "mode": p["mode"], "curve": p["curve"]})


def parse_pattern_findings(df: DataFrame, engine_rank: int = 1) -> DataFrame:
    """Pattern scanner rows; those without an algorithm are kept only for settings."""
    kind, name = F.col("findingType"), blank_to_null(F.col("algorithm"))
    lower = F.lower(F.col("primitive"))
    primitive = F.coalesce(lookup(lower, formats.SCANNER_PRIMITIVES), lower)
    level = F.upper(F.col("confidence"))
    with_algorithm = (kind == "algorithm") | (kind.isin("config", "protocol") & name.isNotNull())
    kept = df.where(name.isNotNull() | kind.isin("config", "protocol"))
    return _finding(
        kept, "cryptoscan", engine_rank,
        file=F.col("file"), line=F.col("line"), col=F.col("column"),
        confidence=F.when(level == "HIGH", "high").when(level == "LOW", "low").otherwise("medium"),
        algorithm=F.when(with_algorithm, schema.algorithm(name, primitive, F.col("keySize"))),
        raw_identifier=F.col("algorithm"),
    )


def load_pattern_findings(spark: SparkSession, path, engine_rank: int = 1) -> DataFrame:
    rows = _documents(spark, path, PATTERN_TYPE).select(F.inline("findings"))
    return parse_pattern_findings(rows, engine_rank)


def parse_astgrep_matches(df: DataFrame, engine_rank: int = 2) -> DataFrame:
    """Rule matches: the captured name, else the end of the message, else of the rule id."""
    rule, message = F.col("ruleId"), F.coalesce(F.col("message"), F.lit(""))
    quotes = "[\"']"
    captured = blank_to_null(F.col("metaVariables")["ALGO"]["text"])
    captured = F.regexp_replace(captured, f"^{quotes}+|{quotes}+$", "")
    tail = F.trim(F.regexp_extract(message, r"(?s)^.*: (.*)$", 1))
    tail = F.regexp_replace(tail, f"^{quotes}+|{quotes}+$", "")
    tail = F.when(~tail.rlike(r"[ \t\n]"), blank_to_null(tail))
    last = F.upper(F.element_at(F.split(rule, "-"), -1))
    name = blank_to_null(F.coalesce(captured, tail, last))
    severity = F.lower(F.col("severity"))
    return _finding(
        df, "astgrep", engine_rank,
        file=F.col("file"), line=F.col("range.start.line") + 1,
        col=F.col("range.start.column") + 1,
        confidence=F.when(severity == "error", "high").when(severity == "warning", "medium")
        .otherwise("low"),
        algorithm=F.when(name.isNotNull(), schema.algorithm(name, primitive_from_rule_id(rule))),
        raw_identifier=rule,
    )


def load_astgrep_matches(spark: SparkSession, path, engine_rank: int = 2) -> DataFrame:
    return parse_astgrep_matches(_documents(spark, path, MATCH_TYPE), engine_rank)


def _uri(c: Column) -> Column:
    return F.regexp_replace(c, "^file://", "")


def parse_sarif_taint(df: DataFrame, engine_rank: int = 3) -> DataFrame:
    """Taint results of SARIF documents.

    A result with a code flow is reachable and of high confidence.  Rule data
    lies in the same run, so it is looked up in the row and no join is needed.
    """
    runs = df.select(*[c for c in df.columns if c != "runs"], F.explode("runs").alias("run"))
    results = runs.select(
        *[c for c in df.columns if c != "runs"],
        F.col("run.tool.driver.rules").alias("_rules"), F.explode("run.results").alias("r"),
    )
    rule = F.col("r.ruleId")
    # of two rules with the same id the last one counts
    meta = F.try_element_at(
        F.filter("_rules", lambda x: x["id"] == rule), F.lit(-1)
    )["properties"]
    inferred = infer_from_rule_id(rule)
    name = F.coalesce(blank_to_null(meta["algorithm"]), inferred["algorithm"])
    primitive = F.coalesce(blank_to_null(meta["primitive"]), inferred["primitive"])
    flow = F.get(F.get(F.col("r.codeFlows"), F.lit(0))["threadFlows"], F.lit(0))["locations"]
    steps = F.transform(flow, lambda s: F.struct(
        _uri(s["location"]["physicalLocation"]["artifactLocation"]["uri"]).alias("file"),
        s["location"]["physicalLocation"]["region"]["startLine"].alias("line"),
        s["location"]["physicalLocation"]["region"]["startColumn"].alias("col"),
        s["message"]["text"].alias("message"),
    ))
    first = F.get(F.col("r.locations"), F.lit(0))["physicalLocation"]
    has_flow = F.coalesce(F.size(flow) > 0, F.lit(False))
    return _finding(
        results, "semgrep", engine_rank,
        file=_uri(first["artifactLocation"]["uri"]),
        line=F.coalesce(first["region"]["startLine"], F.lit(0)),
        col=first["region"]["startColumn"],
        confidence=F.when(has_flow, "high").otherwise("medium"),
        reachable=F.when(has_flow, "yes").otherwise("unknown"),
        algorithm=F.when(name.isNotNull(), schema.algorithm(name, primitive)),
        data_flow_path=F.when(has_flow, steps),
        raw_identifier=rule,
    )


def load_sarif_taint(spark: SparkSession, path, engine_rank: int = 3) -> DataFrame:
    return parse_sarif_taint(_documents(spark, path, SARIF_TYPE), engine_rank)


def parse_dependency_usages(df: DataFrame, engine_rank: int = 4, base: str = ".") -> DataFrame:
    """One row per dependency and one per crypto use inside it."""
    name, version = F.col("name"), blank_to_null(F.col("version"))
    library = F.struct(name.alias("library"), version.alias("version"))
    uses = F.filter(
        F.coalesce(F.col("cryptoUsages"), F.array()),
        lambda u: F.coalesce(u["algorithm"], F.lit("")) != "",
    )

    def entry(file, line, raw, algorithm, reachable, dep):
        return F.struct(
            file.alias("file"), line.alias("line"), raw.alias("raw"),
            algorithm.alias("algorithm"), reachable.alias("reachable"), dep.alias("dep"),
        )

    no = F.lit(None)
    own = entry(
        F.lit(base), F.lit(0), F.concat_ws("@", name, version), no.cast("string"),
        F.lit("unknown"), library,
    )
    used = F.transform(uses, lambda u: entry(
        F.coalesce(blank_to_null(u["file"]), F.lit(base)), F.coalesce(u["line"], F.lit(0)),
        u["algorithm"], u["algorithm"],
        F.when(u["reachable"], "yes").when(~u["reachable"], "no").otherwise("unknown"),
        no.cast("struct<library:string,version:string>"),
    ))
    keep = [c for c in ("seq",) if c in df.columns]
    rows = df.select(*keep, F.posexplode(F.concat(F.array(own), used)).alias("_i", "_e"))
    if keep:
        rows = rows.withColumn("seq", F.col("seq") * 1000 + F.col("_i"))
    return _finding(
        rows, "cryptodeps", engine_rank,
        file=F.col("_e.file"), line=F.col("_e.line"), raw_identifier=F.col("_e.raw"),
        algorithm=F.when(
            F.col("_e.algorithm").isNotNull(), schema.algorithm(F.col("_e.algorithm"))
        ),
        dependency=F.col("_e.dep"), reachable=F.col("_e.reachable"),
    )


def load_dependency_usages(
    spark: SparkSession, path, engine_rank: int = 4, base: str = "."
) -> DataFrame:
    rows = _documents(spark, path, USAGES_TYPE).select(F.inline("dependencies"))
    return parse_dependency_usages(rows, engine_rank, base)


def _raw_component() -> Column:
    return F.coalesce(
        blank_to_null(F.col("purl")),
        F.concat_ws("@", F.col("name"), blank_to_null(F.col("version"))),
    )


def parse_sbom_components(df: DataFrame, engine_rank: int = 5, base: str = ".") -> DataFrame:
    """Library components; the first ``cdx:crypto:`` property names an algorithm."""
    crypto = F.filter(
        F.coalesce(F.col("properties"), F.array()),
        lambda p: p["name"].startswith("cdx:crypto:") & (p["value"] != ""),
    )
    name = F.get(crypto, F.lit(0))["value"]
    library = F.concat_ws(":", blank_to_null(F.col("group")), F.col("name"))
    return _finding(
        df.where(F.col("type") == "library"), "cdxgen", engine_rank,
        file=purl_manifest(F.col("purl"), base), confidence=F.lit("low"),
        raw_identifier=_raw_component(),
        algorithm=F.when(name.isNotNull(), schema.algorithm(name)),
        dependency=F.struct(
            library.alias("library"), F.lit(None).cast("string").alias("version")
        ),
    )


def load_sbom_components(
    spark: SparkSession, path, engine_rank: int = 5, base: str = "."
) -> DataFrame:
    rows = _documents(spark, path, SBOM_TYPE).select(F.inline("components"))
    return parse_sbom_components(rows, engine_rank, base)


def parse_sbom_purl_ns(df: DataFrame, engine_rank: int = 6, base: str = ".") -> DataFrame:
    """Library components named by the namespace in their package URL."""
    library = F.concat_ws(":", purl_namespace(F.col("purl")), F.col("name"))
    return _finding(
        df.where(F.col("type") == "library"), "syft", engine_rank,
        file=F.lit(base), confidence=F.lit("low"), raw_identifier=_raw_component(),
        dependency=F.struct(
            library.alias("library"), F.lit(None).cast("string").alias("version")
        ),
    )


def load_sbom_purl_ns(
    spark: SparkSession, path, engine_rank: int = 6, base: str = "."
) -> DataFrame:
    rows = _documents(spark, path, SBOM_TYPE).select(F.inline("components"))
    return parse_sbom_purl_ns(rows, engine_rank, base)


def parse_cbom_assets(df: DataFrame, engine_rank: int = 7) -> DataFrame:
    """Keys, certificates and settings found by an asset scanner."""
    kind = F.coalesce(F.col("type"), F.lit(""))
    name = blank_to_null(F.col("algorithm"))
    file = F.coalesce(
        blank_to_null(F.col("file")),
        F.when(kind != "", F.concat(F.lit("cbom://"), kind)).otherwise(""),
    )
    return _finding(
        df, "cbomkit-theia", engine_rank,
        file=file, line=F.coalesce(F.col("line"), F.lit(0)),
        raw_identifier=F.concat(kind, F.lit(":"), F.coalesce(name, F.lit(""))),
        algorithm=F.when(name.isNotNull(), schema.algorithm(
            name, lookup_spelling(kind, formats.ASSET_PRIMITIVES), F.col("keySize"), None,
            F.col("curve"),
        )),
    )


def load_cbom_assets(spark: SparkSession, path, engine_rank: int = 7) -> DataFrame:
    rows = _documents(spark, path, ASSETS_TYPE).select(F.inline("assets"))
    return parse_cbom_assets(rows, engine_rank)
