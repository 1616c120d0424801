"""Queries over findings: names, merging, filters, classification, priority."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queries import oracle as O
from queries import views as V
from queries.registry import query
from queries.views import pick
from shoreline import schema
from shoreline.functions import quantum as Q
from shoreline.functions import scoring as S
from shoreline.functions.text import strip
from shoreline.operators import cache, dedupe, filters, known
from shoreline.operators import classify as C
from shoreline.operators import normalize as M
from shoreline.plans.checkpoints import cut
from shoreline.rules import files
from shoreline.rules import quantum as rules

RAW = V.duck(V.FINDINGS)


def classified(spark, sf, view: str = V.FINDINGS) -> DataFrame:
    return C.classify_findings(V.findings(spark, sf, view))


def flat(df: DataFrame, *extra) -> DataFrame:
    """Findings with the algorithm and library spelled out as columns."""
    return df.select(
        "seq", F.col("algorithm.name").alias("alg_name"),
        F.col("algorithm.primitive").alias("primitive"), F.col("algorithm.key_size").alias("key_size"),
        F.col("algorithm.mode").alias("mode"), F.col("algorithm.curve").alias("curve"), *extra,
    )


# --- names ----------------------------------------------------------------------
@query("base_name", f"""SELECT seq, alg_name, {O.base_name('alg_name')} AS base
    FROM {RAW} WHERE alg_name IS NOT NULL""")
def base_name(spark, sf):
    found = V.findings(spark, sf).where(F.col("algorithm").isNotNull())
    facts = known.with_facts(found, strip(F.col("algorithm.name")), Q.name_facts, "facts")
    return facts.select("seq", F.col("algorithm.name").alias("alg_name"), F.col("facts.base").alias("base"))


@query("base_name_long_way", f"""SELECT DISTINCT alg_name, {O.base_name('alg_name')} AS base
    FROM {RAW} WHERE alg_name IS NOT NULL""")
def base_name_long_way(spark, sf):
    """The same without the table of known names, on distinct names."""
    names = V.findings(spark, sf).where(F.col("algorithm").isNotNull()).select(
        F.col("algorithm.name").alias("alg_name")
    ).distinct()
    return names.select("alg_name", Q.base_name(strip(F.col("alg_name"))).alias("base"))


@query("normalize_primitive", f"""SELECT seq, {O.primitive('primitive')} AS normal FROM {RAW}""")
def normalize_primitive(spark, sf):
    return V.findings(spark, sf).select(
        "seq", Q.normalize_primitive(F.col("algorithm.primitive")).alias("normal")
    )


_NORMAL = O.normalized(RAW, "s.alg_name", "s.key_size", "s.mode", "n")


@query("normalize_algorithm", f"""SELECT seq, n_name AS alg_name,
    CASE WHEN alg_name IS NOT NULL THEN COALESCE(primitive, n_primitive) END AS primitive,
    key_size, mode, CASE WHEN alg_name IS NOT NULL THEN {O.curve('curve')} END AS curve FROM {_NORMAL}""")
def normalize_algorithm(spark, sf):
    return flat(M.normalize_algorithm(V.findings(spark, sf)))


@query("resolve_curve", f"SELECT seq, curve, {O.curve('curve')} AS resolved_curve FROM {RAW}")
def resolve_curve(spark, sf):
    found = V.view(spark, sf, V.FINDINGS).select("seq", "curve")
    return M.resolve_curve(found)


_VERSIONED = ", ".join(V.text(n) for n in rules.VERSIONED_PROTOCOLS)
# every second row of a place that names a protocol, so that versions meet
PROTOCOL_NAMES = ["TLS", "TLSv1.2", "SSL", "TLS", "SSLv3", "AES", "TLSv1.2", "TLS"]


def protocol_rows(spark, sf):
    raw = V.findings(spark, sf).where(F.col("algorithm").isNotNull())
    name = V.expr(pick(f"(place * 3 + seq % 3 * (place % 3)) % {len(PROTOCOL_NAMES)}", PROTOCOL_NAMES))
    a = F.col("algorithm")
    return raw.withColumn("algorithm", F.struct(
        name.alias("name"), a["primitive"].alias("primitive"), a["key_size"].alias("key_size"),
        a["mode"].alias("mode"), a["curve"].alias("curve"),
    ))


_PROTO = f"""(SELECT * REPLACE ({pick(f'(place * 3 + seq % 3 * (place % 3)) % {len(PROTOCOL_NAMES)}',
    PROTOCOL_NAMES)} AS alg_name) FROM {RAW} WHERE alg_name IS NOT NULL)"""


def _fold(source: str) -> str:
    place = O.place().replace("file", "f.file").replace("inner_path", "f.inner_path")
    return f"""(SELECT f.* REPLACE (CASE WHEN f.alg_name IN ('TLS', 'SSL') AND v.n = 1
        THEN v.low ELSE f.alg_name END AS alg_name)
    FROM {source} AS f LEFT JOIN (SELECT {O.place()} AS fk, line AS ln,
        count(DISTINCT alg_name) AS n, min(alg_name) AS low
        FROM {source} WHERE alg_name IN ({_VERSIONED}) GROUP BY 1, 2) AS v
    ON v.fk = {place} AND v.ln = f.line)"""


_FOLDED = _fold(_PROTO)


@query("fold_generic_protocol", f"SELECT seq, alg_name, primitive, key_size, mode, curve FROM {_FOLDED}")
def fold_generic_protocol(spark, sf):
    return flat(M.fold_generic_protocol(protocol_rows(spark, sf)))


# --- merging --------------------------------------------------------------------
def _merged(source: str) -> str:
    """Row-by-row merge, restated with windows over (engine_rank, seq)."""
    w = "(PARTITION BY k ORDER BY engine_rank, seq)"
    levels = O.array(rules.CONFIDENCE_ORDER)
    return f"""
    WITH r AS (SELECT *, {O.finding_key()} AS k FROM {source}),
    o AS (SELECT *, row_number() OVER {w} AS rn, first_value(source_engine) OVER {w} AS winner FROM r),
    f AS (SELECT *, min(CASE WHEN source_engine <> winner THEN rn END) OVER (PARTITION BY k) AS first_other
          FROM o),
    c AS (SELECT k, array_to_string(list(source_engine ORDER BY engine_rank, first_rn), ',') AS others
          FROM (SELECT k, source_engine, min(engine_rank) AS engine_rank, min(rn) AS first_rn FROM f
                WHERE source_engine <> winner GROUP BY k, source_engine) GROUP BY k),
    g AS (SELECT k, min(CASE WHEN rn = 1 THEN seq END) AS seq,
        min(CASE WHEN rn = 1 THEN alg_name END) AS alg_name,
        arg_min(primitive, rn) FILTER (primitive IS NOT NULL) AS primitive,
        min(key_size) FILTER (key_size > 0) AS key_size,
        arg_min(mode, rn) FILTER (mode IS NOT NULL) AS mode,
        arg_min(curve, rn) FILTER (curve IS NOT NULL) AS curve,
        min(CASE WHEN rn = 1 THEN reachable END) AS r0,
        bool_or(reachable = 'yes') AS any_yes, bool_or(reachable = 'unknown') AS any_unknown,
        min(CASE WHEN rn = 1 THEN confidence END) AS c0, min(winner) AS source_engine,
        count(*) FILTER (rn >= first_other) AS boosts
        FROM f GROUP BY k)
    SELECT g.seq, g.k AS finding_key, g.alg_name,
        CASE WHEN g.alg_name IS NOT NULL THEN g.primitive END AS primitive,
        CASE WHEN g.alg_name IS NOT NULL THEN g.key_size END AS key_size,
        CASE WHEN g.alg_name IS NOT NULL THEN g.mode END AS mode,
        CASE WHEN g.alg_name IS NOT NULL THEN g.curve END AS curve, g.source_engine, c.others,
        CASE WHEN any_yes THEN 'yes' WHEN r0 = 'no' AND any_unknown THEN 'unknown' ELSE r0 END AS reachable,
        ({levels})[least(5, {O.confidence_rank('c0')} + boosts)] AS confidence
    FROM g LEFT JOIN c USING (k)"""


def _show_merged(df):
    return flat(
        df.withColumn("finding_key", schema.key_text(schema.finding_key())), "finding_key", "source_engine",
        F.array_join("corroborated_by", ",").alias("others"), "reachable", "confidence",
    )


@query("dedupe_findings", _merged(_fold(RAW)))
def dedupe_findings(spark, sf):
    return _show_merged(dedupe.dedupe_findings(V.findings(spark, sf), n_feeds=5))


@query("dedupe_protocol_findings", _merged(_FOLDED))
def dedupe_protocol_findings(spark, sf):
    return _show_merged(dedupe.dedupe_findings(protocol_rows(spark, sf), n_feeds=5))


@query("dedupe_hot_key", f"""SELECT project, engine_rank, count(*) AS n, min(seq) AS first_seq
    FROM {RAW} GROUP BY project, engine_rank""")
def dedupe_hot_key(spark, sf):
    """All rows of a project share a key: the sizes that reach the second step."""
    one = V.findings(spark, sf).withColumns({
        "algorithm": F.lit(None).cast(schema.ALGORITHM),
        "dependency": F.struct(F.lit("lib").alias("library"), F.lit(None).cast("string").alias("version")),
        "inner_path": F.lit(None).cast("string"), "file": F.col("project"),
    })
    out = dedupe.dedupe_ordinals(one)
    return out.select(
        F.col("finding_key.project").alias("project"), "engine_rank", "n",
        F.col("first_seq"),
    )


@query("dedupe_ordinals", f"""
    SELECT finding_key, engine_rank, source_engine, n,
        1 + COALESCE(sum(n) OVER (PARTITION BY finding_key ORDER BY engine_rank
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_ordinal,
        row_number() OVER (PARTITION BY finding_key ORDER BY engine_rank) > 1 AS is_duplicate
    FROM (SELECT {O.finding_key()} AS finding_key, engine_rank, source_engine, count(*) AS n
          FROM {RAW} GROUP BY 1, 2, 3)""")
def dedupe_ordinals(spark, sf):
    out = dedupe.dedupe_ordinals(V.findings(spark, sf)).drop("first_seq")
    return out.withColumn("finding_key", schema.key_text(F.col("finding_key")))


@query("finding_key", f"SELECT seq, {O.finding_key()} AS finding_key FROM {RAW}")
def finding_key(spark, sf):
    return V.findings(spark, sf).select("seq", schema.key_text(schema.finding_key()).alias("finding_key"))


# --- filters --------------------------------------------------------------------
EXCLUDES = ["vendor/*", "*.min.js", "core/m1?/*.go", "Mock_*.go", "conf/**", "m[0-3]/lib.rs"]
_EXCLUDED = """(regexp_full_match(f, '(.*/)?vendor/.*') OR regexp_full_match(f, '(.*/)?[^/]*\\.min\\.js')
    OR regexp_full_match(f, '(.*/)?core/m1[^/]/[^/]*\\.go') OR regexp_full_match(f, '(.*/)?mock_[^/]*\\.go')
    OR regexp_full_match(f, '(.*/)?conf/.*') OR regexp_full_match(f, '(.*/)?m[0-3]/lib\\.rs'))"""


@query("exclude_globs", f"""SELECT seq, file FROM (SELECT *, lower(file) AS f FROM {RAW})
    WHERE NOT {_EXCLUDED}""")
def exclude_globs(spark, sf):
    return filters.exclude_globs(V.findings(spark, sf), EXCLUDES).select("seq", "file")


@query("filter_changed_files", f"""SELECT seq, file FROM (SELECT *, CASE WHEN seq % 17 = 0
        THEN '(tls-probe)/h#kex' ELSE file END AS f FROM {RAW})
    WHERE starts_with(f, '(') OR file IN (SELECT file FROM {RAW} WHERE seq % 30 = 0)""")
def filter_changed_files(spark, sf):
    found = V.findings(spark, sf)
    changed = found.where("seq % 30 = 0").select(F.concat(F.lit("./"), "file").alias("path"))
    rows = found.withColumn("old", F.col("file")).withColumn(
        "file", F.when(F.col("seq") % 17 == 0, "(tls-probe)/h#kex").otherwise(F.concat(F.lit("/w/"), "file"))
    )
    return filters.filter_changed_files(rows, changed, "/w").select("seq", F.col("old").alias("file"))


_TIERS = dict(files.FEEDS)


@query("filter_engines", f"""SELECT 'source' AS run, seq FROM {RAW}
        WHERE {O.isin('source_engine', [n for n, t in files.FEEDS if t not in (4, 5)])}
    UNION ALL SELECT 'quick', seq FROM {RAW}
        WHERE {O.isin('source_engine', [n for n, t in files.FEEDS if t == 1])}
    UNION ALL SELECT 'named', seq FROM {RAW} WHERE source_engine IN ('semgrep', 'tls-probe')""")
def filter_engines(spark, sf):
    found, dim = V.findings(spark, sf), filters.engines_dim(spark)
    runs = {
        "source": filters.filter_engines(found, dim),
        "quick": filters.filter_engines(found, dim, mode="quick"),
        "named": filters.filter_engines(found, dim, names=["semgrep", "tls-probe"], scan_type="all"),
    }
    parts = [df.select(F.lit(k).alias("run"), "seq") for k, df in runs.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _ends(names):
    return "(" + " OR ".join(f"ends_with(leaf, {V.text(n)})" for n in names) + ")"


_LEAF = f"(SELECT *, lower(file) AS f, lower(regexp_extract(file, '([^/]*)$', 1)) AS leaf FROM {RAW})"


@query("relevant_extension", f"""SELECT seq, file, regexp_extract(leaf, '(\\.[^.]*)$', 1) IN
        ('.go', '.mod', '.sum', '.py', '.pyi', '.pyw') AS go_python, TRUE AS anything FROM {_LEAF}""")
def relevant_extension(spark, sf):
    f = F.col("file")
    return V.findings(spark, sf).select(
        "seq", "file", filters.relevant_extension(f, ["go", "python"]).alias("go_python"),
        filters.relevant_extension(f, ["(artifacts)"]).alias("anything"),
    )


@query("is_config_file", f"""SELECT seq, file, ({O.isin('leaf', files.CONFIG_NAMES)}
        OR starts_with(leaf, '.env.') OR ({O.isin("regexp_extract(leaf, '(\\.[^.]*)$', 1)",
        files.CONFIG_EXTENSIONS)} AND ({O.any_part("regexp_extract(f, '^(.*)/[^/]*$', 1)",
        files.CONFIG_DIR_WORDS)} OR {O.any_part('leaf', files.CONFIG_FILE_WORDS)}))) AS is_config
    FROM {_LEAF}""")
def is_config_file(spark, sf):
    return V.findings(spark, sf).select(
        "seq", "file", filters.is_config_file(F.col("file")).alias("is_config")
    )


_TEST = f"""({_ends(files.TEST_SUFFIXES)} OR """ + " OR ".join(
    f"contains(f, '/{d}/') OR starts_with(f, '{d}/')" for d in files.TEST_DIRS) + ")"
_GENERATED = f"""({_ends(files.GENERATED_SUFFIXES)} OR
    {O.any_prefix('leaf', files.GENERATED_PREFIXES)} OR """ + " OR ".join(
    f"contains(f, '/{d}/')" for d in files.GENERATED_DIRS) + ")"


@query("mark_test_generated", f"""SELECT seq, file, {_TEST} AS test_file, {_GENERATED} AS generated_file
    FROM {_LEAF}""")
def mark_test_generated(spark, sf):
    return filters.mark_test_generated(V.findings(spark, sf)).select(
        "seq", "file", "test_file", "generated_file"
    )


# --- classification -------------------------------------------------------------
_CLASS_COLUMNS = ["quantum_risk", "severity", "hndl_risk", "recommendation", "target_algorithm",
                  "target_standard"]


@query("classify_algorithm", f"""SELECT alg_name, primitive, key_size, c_risk AS quantum_risk,
    c_severity AS severity, c_hndl AS hndl_risk, c_advice AS recommendation,
    c_target AS target_algorithm, c_standard AS target_standard
    FROM {O.classified(f'(SELECT DISTINCT alg_name, primitive, key_size FROM {RAW} WHERE alg_name IS NOT NULL)',
                       's.alg_name', 's.primitive', 's.key_size')}""")
def classify_algorithm(spark, sf):
    names = V.view(spark, sf, V.FINDINGS).where("alg_name IS NOT NULL").select(
        F.col("alg_name").alias("name"), "primitive", "key_size"
    ).distinct()
    return C.classify_algorithm(names).withColumnRenamed("name", "alg_name")


@query("classify_findings", f"""SELECT seq, {', '.join(_CLASS_COLUMNS)}, migration_effort
    FROM {O.findings()}""")
def classify_findings(spark, sf):
    return classified(spark, sf).select("seq", *_CLASS_COLUMNS, "migration_effort")


@query("classify_symmetric", f"""SELECT name, size, c_risk AS quantum_risk, c_severity AS severity
    FROM {O.classified('''(SELECT DISTINCT list_element(['AES', 'SEED-ECB', 'LSH-512-256', 'SM4', 'ChaCha20',
        'SHAKE128', 'BLAKE2s', 'LEA-192', 'HAS', 'Whirlpool'], CAST(1 + event_id % 10 AS INT)) AS name,
        CAST(event_id * 64 % 640 AS INT) AS size,
        CASE WHEN event_id % 3 = 0 THEN 'hash' ELSE 'symmetric' END AS kind FROM events)''',
        's.name', 's.kind', 's.size')}""")
def classify_symmetric(spark, sf):
    names = ["AES", "SEED-ECB", "LSH-512-256", "SM4", "ChaCha20", "SHAKE128", "BLAKE2s", "LEA-192",
             "HAS", "Whirlpool"]
    rows = V.table(spark, sf, "events").select(
        V.expr(pick("event_id % 10", names)).alias("name"),
        F.when(F.col("event_id") % 3 == 0, "hash").otherwise("symmetric").alias("primitive"),
        (F.col("event_id") * 64 % 640).cast("int").alias("key_size"),
    ).distinct()
    return C.classify_algorithm(rows).select(
        "name", F.col("key_size").alias("size"), "quantum_risk", "severity"
    )


@query("migration_target", f"""SELECT seq, alg_name, key_size, split_part(t, '|', 1) AS t1,
    NULLIF(split_part(t, '|', 2), '') AS t2
    FROM (SELECT *, {O.target(O.base_name('alg_name'), 'COALESCE(key_size, 0)')} AS t FROM {RAW}
          WHERE alg_name IS NOT NULL) WHERE t <> '|'""")
def migration_target(spark, sf):
    rows = V.view(spark, sf, V.FINDINGS).where("alg_name IS NOT NULL").select(
        "seq", F.col("alg_name").alias("name"), "key_size"
    )
    return C.migration_target(rows).where(F.col("target_algorithm").isNotNull()).select(
        "seq", F.col("name").alias("alg_name"), "key_size",
        F.col("target_algorithm").alias("t1"), F.col("target_standard").alias("t2"),
    )


@query("migration_effort", f"""SELECT risk, prim, config, {O.effort('risk', 'prim', 'config')} AS effort,
    count(*) AS n FROM (SELECT {pick('event_id % 5', ['deprecated', 'quantum-weakened',
        'quantum-vulnerable', 'quantum-safe', 'unknown'])} AS risk,
        {pick('event_id % 7', ['sign', 'digest', 'kem', 'symmetric', None, 'dh', 'mac'])} AS prim,
        event_id % 2 = 0 AS config FROM events) GROUP BY ALL""")
def migration_effort(spark, sf):
    rows = V.table(spark, sf, "events").select(
        V.expr(pick("event_id % 5", ["deprecated", "quantum-weakened", "quantum-vulnerable",
                                     "quantum-safe", "unknown"])).alias("risk"),
        V.expr(pick("event_id % 7", ["sign", "digest", "kem", "symmetric", None, "dh", "mac"])).alias("prim"),
        (F.col("event_id") % 2 == 0).alias("config"),
    )
    effort = Q.migration_effort(F.col("risk"), F.col("prim"), F.col("config"))
    return rows.groupBy("risk", "prim", "config", effort.alias("effort")).agg(F.count(F.lit(1)).alias("n"))


@query("upgrade_effort", """SELECT effort, blast, CASE WHEN blast <= 70 THEN effort WHEN effort = 'simple'
        THEN 'moderate' WHEN effort = 'moderate' THEN 'complex' ELSE effort END AS raised, count(*) AS n
    FROM (SELECT list_element(['simple', 'moderate', 'complex', NULL], CAST(1 + event_id % 4 AS INT)) AS effort,
        event_id % 101 AS blast FROM events) GROUP BY ALL""")
def upgrade_effort(spark, sf):
    rows = V.table(spark, sf, "events").select(
        V.expr(pick("event_id % 4", ["simple", "moderate", "complex", None])).alias("effort"),
        (F.col("event_id") % 101).alias("blast"),
    )
    raised = Q.upgrade_effort(F.col("effort"), F.col("blast"))
    return rows.groupBy("effort", "blast", raised.alias("raised")).agg(F.count(F.lit(1)).alias("n"))


# --- priority -------------------------------------------------------------------
_PRIORITY = f"""CASE WHEN test_file OR generated_file THEN 'P4'
    WHEN severity = 'critical' THEN CASE WHEN reachable = 'yes' OR blast >= 70
        OR {O.confidence_rank('confidence')} >= 4 THEN 'P1' ELSE 'P2' END
    WHEN severity = 'high' THEN CASE WHEN reachable = 'yes' OR blast >= 40 THEN 'P2' ELSE 'P3' END
    WHEN severity = 'medium' AND reachable = 'yes' THEN 'P3' ELSE 'P4' END"""
_RANKED = f"""(SELECT *, {_PRIORITY} AS priority FROM (SELECT *, {_TEST} AS test_file,
    {_GENERATED} AS generated_file FROM (SELECT *, lower(file) AS f,
    lower(regexp_extract(file, '([^/]*)$', 1)) AS leaf, seq * 7 % 101 AS blast FROM cf)))"""
_CF = f"WITH cf AS MATERIALIZED (SELECT * FROM {O.findings()})"


def prioritised(spark, sf):
    blast = (F.col("seq") * 7 % 101).cast("int")
    found = classified(spark, sf).withColumn("blast_radius", blast)
    return C.with_priority(filters.mark_test_generated(found))


@query("priority", f"""{_CF} SELECT seq, priority, CASE WHEN blast <= 70 THEN migration_effort
    WHEN migration_effort = 'simple' THEN 'moderate' WHEN migration_effort = 'moderate' THEN 'complex'
    ELSE migration_effort END AS migration_effort FROM {_RANKED}""")
def priority(spark, sf):
    return prioritised(spark, sf).select("seq", "priority", "migration_effort")




@query("sort_by_priority", f"""{_CF} SELECT seq, row_number() OVER (ORDER BY CAST(substr(priority, 2) AS INT),
    {O.severity_rank('severity')}, file, engine_rank, seq) AS place FROM {_RANKED}""")
def sort_by_priority(spark, sf):
    """Places in the sorted order, counted per range partition without a global window."""
    order = C.sort_by_priority(prioritised(spark, sf)).select("seq")
    parts = cut(order.withColumn("part", F.spark_partition_id()).withColumn(
        "inside", F.monotonically_increasing_id() - F.shiftleft(F.col("part").cast("bigint"), 33) + 1
    ))
    # one number per partition
    counts = parts.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    all_counts = counts.agg(F.array_sort(F.collect_list(F.struct("part", "rows"))).alias("c"))
    starts = all_counts.select("c", F.posexplode("c").alias("i", "p")).select(
        F.col("p.part").alias("part"),
        F.aggregate(
            F.slice("c", F.lit(1), F.col("i")), F.lit(0).cast("bigint"), lambda s, x: s + x["rows"]
        ).alias("start"),
    )
    return parts.join(starts, "part").select("seq", (F.col("inside") + F.col("start")).alias("place"))


# --- feeds ----------------------------------------------------------------------
@query("union_feeds", f"""SELECT seq, CASE WHEN source_engine = 'semgrep' THEN 0 ELSE 1 END AS engine_rank
    FROM {RAW} WHERE source_engine IN ('semgrep', 'tls-probe')""")
def union_feeds(spark, sf):
    found = V.findings(spark, sf)
    feeds = [found.where(F.col("source_engine") == e).drop("mode") for e in ("semgrep", "tls-probe")]
    return cache.union_feeds(feeds).select("seq", "engine_rank")


@query("hndl_surplus", f"""SELECT sector, lag, crqc, surplus AS hndl_surplus, CASE WHEN surplus > 2 THEN 'high'
        WHEN surplus >= 0 THEN 'medium' ELSE 'low' END AS hndl_level, count(*) AS n
    FROM (SELECT *, COALESCE({O.mapping('lower(sector)', rules.SECTOR_YEARS)}, 10)
        + CASE WHEN lag > 0 THEN lag ELSE 5 END - CASE WHEN crqc > 0 THEN crqc ELSE 5 END AS surplus
        FROM (SELECT {pick('event_id % 8', ['medical', 'Finance', 'state', 'infra', 'code', 'generic', 'x', None])}
            AS sector, CAST(event_id % 4 AS INT) AS lag, CAST(event_id * 3 % 17 AS INT) AS crqc FROM events))
    GROUP BY ALL""")
def hndl_surplus(spark, sf):
    sectors = ["medical", "Finance", "state", "infra", "code", "generic", "x", None]
    rows = V.table(spark, sf, "events").select(
        V.expr(pick("event_id % 8", sectors)).alias("sector"),
        (F.col("event_id") % 4).cast("int").alias("lag_years"),
        (F.col("event_id") * 3 % 17).cast("int").alias("crqc_years"),
    )
    return C.hndl(rows, year=2026).groupBy(
        "sector", F.col("lag_years").alias("lag"), F.col("crqc_years").alias("crqc"), "hndl_surplus",
        "hndl_level",
    ).agg(F.count(F.lit(1)).alias("n"))


@query("sector_shelf_life", f"""SELECT sector, COALESCE({O.mapping('lower(sector)', rules.SECTOR_YEARS)}, 10)
    AS shelf_life_years, count(*) AS n FROM (SELECT {pick('o_custkey % 4', ['Medical', 'code', 'zzz', None])}
    AS sector FROM orders) GROUP BY ALL""")
def sector_shelf_life(spark, sf):
    rows = V.table(spark, sf, "orders").select(
        V.expr(pick("o_custkey % 4", ["Medical", "code", "zzz", None])).alias("sector")
    )
    return C.sector_shelf_life(rows).groupBy("sector", "shelf_life_years").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("lifetime_multiplier", """SELECT years, CASE WHEN years > 10 THEN '1.15' WHEN years BETWEEN 1 AND 4
    THEN '0.85' ELSE '1.00' END AS multiplier, count(*) AS n
    FROM (SELECT CAST(event_id % 30 - 2 AS INT) AS years FROM events) GROUP BY ALL""")
def lifetime_multiplier(spark, sf):
    rows = V.table(spark, sf, "events").select((F.col("event_id") % 30 - 2).cast("int").alias("years"))
    return rows.groupBy("years", S.lifetime_multiplier(F.col("years")).cast("string").alias("multiplier")).agg(
        F.count(F.lit(1)).alias("n")
    )


_SNIPPET_EXT = {e: lang for lang, es in files.SNIPPET_LANGUAGES.items() for e in es}
_SIGN = ["RSA", "RSASSA-PKCS1", "RSASSA-PSS", "DSA", "ECDSA", "EDDSA", "ED25519", "ED448", "KCDSA", "EC-KCDSA"]
_KEM = ["ECDH", "ECDHE", "X25519", "X448", "DH", "FFDH", "DIFFIE-HELLMAN", "RSAES-PKCS1", "RSAES-OAEP",
        "ELGAMAL", "ECIES", "MQV", "ECMQV"]


@query("migration_snippet", f"""
    WITH cf AS MATERIALIZED (SELECT * FROM {O.findings()})
    SELECT seq, lang AS language, fam AS use, target_algorithm FROM (
        SELECT *, CASE WHEN regexp_matches(upper(target_algorithm), '^ML-?KEM') THEN 'kem'
            WHEN regexp_matches(upper(target_algorithm), '^(ML-?DSA|SLH-?DSA)') THEN 'sign' ELSE own END AS fam
        FROM (SELECT *, {O.mapping("regexp_extract(lower(file), '(\\.[^./]*)$', 1)", _SNIPPET_EXT)} AS lang,
            CASE WHEN {O.isin('upper(b)', _SIGN)} THEN 'sign' WHEN {O.isin('upper(b)', _KEM)} THEN 'kem'
                WHEN lower(primitive) IN ('signing', 'signature') THEN 'sign'
                WHEN lower(primitive) IN ('kem', 'key-exchange', 'key-agree') THEN 'kem' END AS own
            FROM (SELECT *, CASE WHEN regexp_matches(alg_name, '-[0-9]')
                    THEN regexp_replace(alg_name, '-[0-9].*$', '')
                    ELSE regexp_replace(alg_name, '-[Pp][0-9].*$', '') END AS b FROM cf))
        WHERE lang IS NOT NULL AND own IS NOT NULL AND target_algorithm IS NOT NULL
            AND NOT regexp_matches(upper(alg_name), '^(ML-DSA|ML-KEM|SLH-DSA|XMSS|LMS|HQC)(-|$)'))""")
def migration_snippet(spark, sf):
    out = C.migration_snippet(classified(spark, sf)).where(F.col("migration_snippet").isNotNull())
    is_kem = F.col("migration_snippet.after").rlike(
        "(?i)encap|kem|curve|groups X|KexAlg|key_exchange|encapsulate"
    )
    return out.select(
        "seq", F.col("migration_snippet.language").alias("language"),
        F.when(is_kem, "kem").otherwise("sign").alias("use"), "target_algorithm",
    )


