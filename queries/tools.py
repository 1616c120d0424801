"""Queries over outputs of scanning tools."""

from pyspark.sql import functions as F

from queries import oracle as O
from queries import views as V
from queries.registry import query
from queries.texts import _rule_sql
from queries.views import div, pick
from shoreline.rules import files, formats
from shoreline.sources import scanners as S

IDS = ["AES-256-GCM", "OpenSSL", "RSA-2048", "ML-KEM-768", "ECDSA-P256", "SHA-1", "AES-32-128-cbc-ecb", "X"]
ID_SIZE = [256, None, 2048, None, None, None, 128, None]
ID_MODE = ["GCM", None, None, None, None, None, "ECB", None]
ID_CURVE = [None, None, None, None, "P256", None, None, None]
_AT = f"event_id % {len(IDS)}"


@query("parse_algorithm_id", f"""SELECT event_id, {pick(_AT, IDS)} AS identifier, {pick(_AT, ID_SIZE)} AS key_size,
    {pick(_AT, ID_MODE)} AS mode, {pick(_AT, ID_CURVE)} AS curve FROM events""")
def parse_algorithm_id(spark, sf):
    rows = V.table(spark, sf, "events").select("event_id", V.expr(pick(_AT, IDS)).alias("identifier"))
    return S.parse_algorithm_id(rows)


KEYSIZES = ["512", None, "abc", "384.0", "-5", "0"]
META_SIZE = [512, None, None, 384, None, None]
_META = f"{div('event_id', 3)} % {len(KEYSIZES)}"


@query("load_scanner_jsonl", f"""SELECT event_id AS seq, CASE WHEN lib THEN id END AS library,
    CASE WHEN NOT lib THEN id END AS alg_name, CASE WHEN NOT lib THEN COALESCE(ms, ks) END AS key_size,
    CASE WHEN NOT lib THEN CASE WHEN event_id % 4 = 1 THEN 'XTS' ELSE md END END AS mode,
    CASE WHEN NOT lib THEN CASE WHEN event_id % 4 = 2 THEN 'hash' END END AS primitive, CAST(event_id % 90 AS INT) AS line
    FROM (SELECT event_id, event_id % 5 = 0 AS lib, {pick(_AT, IDS)} AS id, {pick(_AT, ID_SIZE)} AS ks,
        {pick(_AT, ID_MODE)} AS md, {pick(_META, META_SIZE)} AS ms FROM events)""")
def load_scanner_jsonl(spark, sf):
    e = F.col("event_id")
    rows = V.table(spark, sf, "events").select(
        e.alias("seq"), F.when(e % 5 == 0, "library").otherwise("algorithm").alias("assetType"),
        V.expr(pick(_AT, IDS)).alias("identifier"), F.lit("a.go").alias("path"),
        F.struct((e % 90).cast("int").alias("line"), F.lit(1).alias("column")).alias("evidence"),
        F.struct(
            V.expr(pick(_META, KEYSIZES)).alias("keysize"),
            F.when(e % 4 == 2, "hash").otherwise("").alias("primitive"),
            F.when(e % 4 == 1, "XTS").otherwise("").alias("mode"), F.lit("").alias("curve"),
        ).alias("metadata"))
    return S.parse_scanner(rows).select(
        "seq", "dependency.library", F.col("algorithm.name").alias("alg_name"),
        F.col("algorithm.key_size").alias("key_size"), F.col("algorithm.mode").alias("mode"),
        F.col("algorithm.primitive").alias("primitive"), "line")


KINDS = ["algorithm", "config", "protocol", "other"]
PRIMS = ["PKE", "kem", "aead", "stream-cipher", "hash", None]
PRIMS_OUT = ["asymmetric", "kem", "symmetric", "symmetric", "hash", None]
LEVELS = ["HIGH", "low", "Medium", None]
LEVELS_OUT = ["high", "low", "medium", "medium"]


@query("load_pattern_findings", f"""SELECT event_id AS seq, CASE WHEN kind <> 'other' THEN alg END AS alg_name,
    CASE WHEN kind <> 'other' AND alg IS NOT NULL THEN {pick(f'event_id % {len(PRIMS)}', PRIMS_OUT)} END AS primitive,
    {pick(f'{div("event_id", 2)} % 4', LEVELS_OUT)} AS confidence
    FROM (SELECT *, {pick('event_id % 4', KINDS)} AS kind, NULLIF({pick('event_id % 3', ['RSA', '', 'AES'])}, '') AS alg
          FROM events) WHERE alg IS NOT NULL OR kind IN ('config', 'protocol')""")
def load_pattern_findings(spark, sf):
    e = F.col("event_id")
    rows = V.table(spark, sf, "events").select(
        e.alias("seq"), V.expr(pick("event_id % 4", KINDS)).alias("findingType"),
        V.expr(pick("event_id % 3", ["RSA", "", "AES"])).alias("algorithm"),
        V.expr(pick(f"event_id % {len(PRIMS)}", PRIMS)).alias("primitive"), F.lit(0).alias("keySize"),
        F.lit("f").alias("file"), F.lit(1).alias("line"), F.lit(1).alias("column"),
        V.expr(pick(f"{div('event_id', 2)} % 4", LEVELS)).alias("confidence"))
    return S.parse_pattern_findings(rows).select(
        "seq", F.col("algorithm.name").alias("alg_name"), F.col("algorithm.primitive").alias("primitive"),
        "confidence")


MATCH_RULES = ["go-rsa-gen", "py-md5-use", "js-aes"]
MATCH_TEXT = ["Uses: RSA", "weak hash", "call: 'AES-GCM'", "note: two words", None]
MATCH_NAME = ["RSA", None, "AES-GCM", None, None]
_M_ALG, _M_PRIM = _rule_sql("lower(rule)")


@query("load_astgrep_matches", f"""SELECT seq, COALESCE(cap, msg, upper(string_split(rule, '-')[-1])) AS alg_name,
    {_M_PRIM} AS primitive, CAST(seq % 50 + 1 AS INT) AS line, {pick('seq % 3', ['high', 'medium', 'low'])} AS confidence
    FROM (SELECT event_id AS seq, {pick('event_id % 3', MATCH_RULES)} AS rule,
        {pick(f'{div("event_id", 2)} % 5', MATCH_NAME)} AS msg, CASE WHEN event_id % 4 = 0 THEN 'SHA-1' END AS cap
        FROM events)""")
def load_astgrep_matches(spark, sf):
    e = F.col("event_id")
    meta = F.create_map(F.lit("ALGO"), F.struct(F.when(e % 4 == 0, "\"SHA-1'").alias("text")))
    rows = V.table(spark, sf, "events").select(
        e.alias("seq"), V.expr(pick("event_id % 3", MATCH_RULES)).alias("ruleId"),
        V.expr(pick(f"{div('event_id', 2)} % 5", MATCH_TEXT)).alias("message"), F.lit("f").alias("file"),
        V.expr(pick("event_id % 3", ["Error", "warning", "hint"])).alias("severity"),
        F.struct(F.struct((e % 50).cast("int").alias("line"), F.lit(0).alias("column")).alias("start")).alias("range"),
        F.when(e % 2 == 0, meta).alias("metaVariables"))
    return S.parse_astgrep_matches(rows).select(
        "seq", F.col("algorithm.name").alias("alg_name"), F.col("algorithm.primitive").alias("primitive"),
        "line", "confidence")


SARIF_RULES = ["go-rsa-x", "py-md5", "meta-rule", "nothing"]
_S_ALG, _S_PRIM = _rule_sql("lower(rule)")


@query("load_sarif_taint", f"""SELECT seq, rule AS raw_identifier,
    CASE WHEN rule = 'meta-rule' THEN 'AES' ELSE {_S_ALG} END AS alg_name,
    'src/' || seq % 9 || '.go' AS file, CAST(seq % 40 AS INT) AS line,
    CASE WHEN seq % 3 = 0 THEN 'yes' ELSE 'unknown' END AS reachable,
    CASE WHEN seq % 3 = 0 THEN 'high' ELSE 'medium' END AS confidence,
    CASE WHEN seq % 3 = 0 THEN 'lib.go:' || seq % 5 || ':sink' END AS flow
    FROM (SELECT event_id AS seq, {pick('event_id % 4', SARIF_RULES)} AS rule FROM events)""")
def load_sarif_taint(spark, sf):
    e = F.col("event_id")

    def place(uri, line):
        return F.struct(
            F.struct(uri.alias("uri")).alias("artifactLocation"),
            F.struct(line.cast("int").alias("startLine"), F.lit(1).alias("startColumn")).alias("region"))

    here = F.array(F.struct(place(
        F.concat(F.lit("file://src/"), (e % 9).cast("string"), F.lit(".go")), e % 40).alias("physicalLocation")))
    step = F.struct(F.struct(place(F.lit("lib.go"), e % 5).alias("physicalLocation")).alias("location"),
                    F.struct(F.lit("sink").alias("text")).alias("message"))
    flow = F.array(F.struct(F.array(F.struct(F.array(step).alias("locations"))).alias("threadFlows")))
    results = F.array(F.struct(
        V.expr(pick("event_id % 4", SARIF_RULES)).alias("ruleId"), here.alias("locations"),
        F.when(e % 3 == 0, flow).alias("codeFlows")))
    rule = F.struct(F.lit("meta-rule").alias("id"), F.struct(
        F.lit("AES").alias("algorithm"), F.lit("").alias("primitive")).alias("properties"))
    tool = F.struct(F.struct(F.array(rule).alias("rules")).alias("driver"))
    docs = V.table(spark, sf, "events").select(
        e.alias("seq"), F.array(F.struct(tool.alias("tool"), results.alias("results"))).alias("runs"))
    out = S.parse_sarif_taint(docs)
    first = F.get("data_flow_path", F.lit(0))
    return out.select(
        "seq", "raw_identifier", F.col("algorithm.name").alias("alg_name"), "file", "line", "reachable",
        "confidence", F.concat_ws(":", first["file"], first["line"].cast("string"), first["message"]).alias("f")
    ).withColumn("flow", F.nullif("f", F.lit(""))).drop("f")


COMPONENTS = f"""SELECT p_partkey, p_name, CASE WHEN p_size % 3 = 0 THEN '' ELSE CAST(p_size AS STRING) END AS version,
    CASE WHEN p_partkey % 4 = 3 THEN '' ELSE 'pkg:' || {pick('p_partkey % 5',
    ['npm', 'maven', 'golang', 'nuget', 'pypi'])} || '/' || CASE WHEN p_size % 2 = 0 THEN 'acme/' ELSE '' END || p_brand
    || '@' || CAST(p_size AS STRING) END AS purl, CASE WHEN p_partkey % 6 = 0 THEN 'org.x' ELSE '' END AS grp,
    CASE WHEN p_partkey % 9 = 0 THEN 'file' ELSE 'library' END AS type FROM {{part}}"""
_RAWID = "COALESCE(NULLIF(purl, ''), p_name || COALESCE('@' || NULLIF(version, ''), ''))"
_MANIFEST = O.mapping("regexp_extract(purl, '^pkg:([^/]*)/', 1)", {k: "w/" + v for k, v in files.PURL_MANIFESTS.items()}, "'w'")


def components(spark, sf):
    view = COMPONENTS.replace("SELECT p_partkey, p_name,", "SELECT p_partkey, p_name, p_brand,")

    def prop(n, v):
        return F.struct(F.lit(n).alias("name"), v.alias("value"))

    props = F.array(prop("x", F.lit("y")), prop("cdx:crypto:a", F.lit("")),
                    prop("cdx:crypto:b", F.col("p_brand")), prop("cdx:crypto:c", F.lit("z")))
    return V.view(spark, sf, view).withColumns({
        "seq": F.col("p_partkey"), "name": F.col("p_name"), "group": F.col("grp"),
        "properties": F.when(F.col("p_partkey") % 2 == 0, props)})


@query("load_sbom_components", f"""SELECT p_partkey AS seq, {_MANIFEST} AS file, {_RAWID} AS raw_identifier,
    CASE WHEN grp <> '' THEN grp || ':' ELSE '' END || p_name AS library,
    CASE WHEN p_partkey % 2 = 0 THEN (SELECT p_brand FROM part AS q WHERE q.p_partkey = c.p_partkey) END AS alg_name
    FROM {V.duck(COMPONENTS)} AS c WHERE type = 'library'""")
def load_sbom_components(spark, sf):
    return S.parse_sbom_components(components(spark, sf), base="w").select(
        "seq", "file", "raw_identifier", "dependency.library", F.col("algorithm.name").alias("alg_name"))


@query("load_sbom_purl_ns", f"""SELECT p_partkey AS seq, {_RAWID} AS raw_identifier,
    CASE WHEN contains(rest, '/') THEN split_part(rest, '/', 1) || ':' ELSE '' END || p_name AS library
    FROM (SELECT *, CASE WHEN contains(purl, '/') THEN split_part(substr(purl, instr(purl, '/') + 1), '@', 1)
        ELSE '' END AS rest FROM {V.duck(COMPONENTS)}) WHERE type = 'library'""")
def load_sbom_purl_ns(spark, sf):
    return S.parse_sbom_purl_ns(components(spark, sf)).select(
        "seq", "raw_identifier", "dependency.library")


ASSET_KINDS = ["certificate", "private-key", "config", "other", ""]
_ASSET_PRIM = O.mapping("kind", {s: k for k, ss in formats.ASSET_PRIMITIVES.items() for s in ss})


@query("load_cbom_assets", f"""SELECT seq, CASE WHEN seq % 3 = 0 THEN 'k.pem' WHEN kind <> '' THEN 'cbom://' || kind
        ELSE '' END AS file, alg AS alg_name, CASE WHEN alg IS NOT NULL THEN {_ASSET_PRIM} END AS primitive,
    CASE WHEN alg IS NOT NULL THEN NULLIF(CAST(seq % 4 * 1024 AS INT), 0) END AS key_size,
    kind || ':' || COALESCE(alg, '') AS raw_identifier
    FROM (SELECT event_id AS seq, {pick('event_id % 5', ASSET_KINDS)} AS kind,
        NULLIF({pick(f'{div("event_id", 5)} % 3', ['RSA', '', 'TLS 1.2'])}, '') AS alg FROM events)""")
def load_cbom_assets(spark, sf):
    e = F.col("event_id")
    rows = V.table(spark, sf, "events").select(
        e.alias("seq"), V.expr(pick("event_id % 5", ASSET_KINDS)).alias("type"),
        V.expr(pick(f"{div('event_id', 5)} % 3", ["RSA", "", "TLS 1.2"])).alias("algorithm"),
        (e % 4 * 1024).cast("int").alias("keySize"), F.lit("").alias("curve"),
        F.when(e % 3 == 0, "k.pem").otherwise("").alias("file"), F.lit(0).alias("line"))
    return S.parse_cbom_assets(rows).select(
        "seq", "file", F.col("algorithm.name").alias("alg_name"), F.col("algorithm.primitive").alias("primitive"),
        F.col("algorithm.key_size").alias("key_size"), "raw_identifier")


@query("load_dependency_usages", """
    SELECT event_id * 1000 AS seq, 'd' || event_id % 40 || COALESCE('@' || NULLIF(v, ''), '') AS raw_identifier,
        'd' || event_id % 40 AS library, CAST(NULL AS STRING) AS alg_name, 'unknown' AS reachable, 'w' AS file
    FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN '1.0' ELSE '' END AS v FROM events)
    UNION ALL SELECT event_id * 1000 + 1, 'RSA', NULL, 'RSA', CASE WHEN event_id % 3 = 0 THEN 'yes'
        WHEN event_id % 3 = 1 THEN 'no' ELSE 'unknown' END, 'u.go' FROM events WHERE event_id % 4 <> 3
    UNION ALL SELECT event_id * 1000 + 2, 'MD5', NULL, 'MD5', 'unknown', 'w' FROM events WHERE event_id % 4 <> 3""")
def load_dependency_usages(spark, sf):
    e = F.col("event_id")

    def use(alg, reachable, file):
        return F.struct(F.lit(alg).alias("algorithm"), reachable.cast("boolean").alias("reachable"),
                        F.lit(file).alias("file"), F.lit(3).alias("line"))

    uses = F.array(use("RSA", F.when(e % 3 == 0, True).when(e % 3 == 1, False), "u.go"),
                   use("", F.lit(None), "x"), use("MD5", F.lit(None), ""))
    rows = V.table(spark, sf, "events").select(
        e.alias("seq"), F.concat(F.lit("d"), (e % 40).cast("string")).alias("name"),
        F.when(e % 2 == 0, "1.0").otherwise("").alias("version"),
        F.when(e % 4 != 3, uses).alias("cryptoUsages"))
    return S.parse_dependency_usages(rows, base="w").select(
        "seq", "raw_identifier", "dependency.library", F.col("algorithm.name").alias("alg_name"), "reachable", "file")

