"""Queries over scores, compliance, policy, impact and output formats."""

from pyspark.sql import functions as F

from queries import oracle as O
from queries import views as V
from queries.findings import _CF, RAW, _PRIORITY, _RANKED, classified, prioritised  # noqa: F401
from queries.registry import query
from queries.views import pick, string
from shoreline import schema
from shoreline.functions import impact as I
from shoreline.functions import output as X
from shoreline.functions import scoring as S
from shoreline.operators import compliance as CO
from shoreline.operators import history as H
from shoreline.operators import impact as IM
from shoreline.operators import inventory as N
from shoreline.operators import policy as P
from shoreline.operators import score as SC
from shoreline.plans import verdict
from shoreline.plans.checkpoints import cut
from shoreline.rules import compliance, formats
from shoreline.rules import impact as irules
from shoreline.tables import literal_table

_BIG = f"WITH cf AS MATERIALIZED (SELECT * FROM {O.findings(V.FINDINGS_BIG)})"


def big(spark, sf):
    return classified(spark, sf, V.FINDINGS_BIG)


def _risk(name):
    return f"count(*) FILTER (quantum_risk = '{name}')"


_SUMMARY = f"""count(*) AS total_findings, count(alg_name) AS algorithms, count(library) AS dependencies,
    CAST(0 AS BIGINT) AS corroborated, {_risk('quantum-vulnerable')} AS quantum_vulnerable,
    {_risk('quantum-weakened')} AS quantum_weakened, {_risk('quantum-safe')} AS quantum_safe,
    {_risk('quantum-resistant')} AS quantum_resistant, {_risk('deprecated')} AS deprecated,
    {_risk('unknown')} AS unknown"""


@query("scan_summary", f"{_BIG} SELECT project, {_SUMMARY} FROM cf GROUP BY project")
def scan_summary(spark, sf):
    return SC.scan_summary(big(spark, sf), by=("project",))


def _score(cost, years=None):
    mult = {None: "1.0", 0: "1.0", 3: "0.85", 20: "1.15"}[years]
    return f"""CAST(round(least(greatest(100 - sum(CAST({cost} * {mult} AS DECIMAL(18,6)))
        + sum(CASE WHEN quantum_risk = 'quantum-safe' THEN 0.5 ELSE 0 END), 0), 100)) AS INT)"""


@query("qrs", f"""{_BIG} SELECT file, score, {O.grade('score')} AS grade FROM (
    SELECT file, {_score(O.penalty())} AS score FROM cf GROUP BY file)""")
def qrs(spark, sf):
    return SC.qrs(big(spark, sf), by=("file",))


@query("qrs_lifetime", f"""{_BIG} SELECT file, score, {O.grade('score')} AS grade FROM (
    SELECT file, {_score(O.penalty(), 3)} AS score FROM cf GROUP BY file)""")
def qrs_lifetime(spark, sf):
    return SC.qrs_lifetime(big(spark, sf), 3, by=("file",))


@query("grade", f"""SELECT score, {O.grade('score')} AS grade, count(*) AS n
    FROM (SELECT CAST(event_id % 101 AS INT) AS score FROM events) GROUP BY ALL""")
def grade(spark, sf):
    rows = V.table(spark, sf, "events").select((F.col("event_id") % 101).cast("int").alias("score"))
    return rows.groupBy("score", S.grade(F.col("score")).alias("grade")).agg(F.count(F.lit(1)).alias("n"))


# --- compliance -----------------------------------------------------------------
@query("compliance_eval", f"""{_BIG} SELECT project, framework, rule, deadline,
    violation_severity AS severity, count(*) AS violations, count(DISTINCT algorithm) AS algorithms
    FROM {O.violations('cf')} GROUP BY ALL""")
def compliance_eval(spark, sf):
    return CO.compliance_eval(big(spark, sf)).groupBy(
        "project", "framework", "rule", "deadline", "severity"
    ).agg(F.count(F.lit(1)).alias("violations"), F.count_distinct("algorithm").alias("algorithms"))


@query("compliance_violations", f"""{_CF} SELECT seq, algorithm, framework, rule, deadline,
    violation_severity AS severity FROM {O.violations('cf')}""")
def compliance_violations(spark, sf):
    return CO.compliance_eval(classified(spark, sf)).select(
        "seq", "algorithm", "framework", "rule", "deadline", "severity"
    )


@query("pci_inventory_evidence", f"""{_CF} SELECT 'pci-dss-4.0' AS framework,
    'pci-no-inventory-evidence' AS rule, '2025-03-31' AS deadline, 'error' AS severity,
    CASE WHEN count(*) = 0 THEN 'no findings' ELSE 'findings without risk class' END AS reason FROM cf
    WHERE quantum_risk IS NULL OR quantum_risk = 'unknown' HAVING count(*) FILTER
    (COALESCE(quantum_risk, 'unknown') NOT IN ('', 'unknown')) = 0""")
def pci_inventory_evidence(spark, sf):
    """On the findings that nobody could classify."""
    rows = classified(spark, sf).where(F.col("quantum_risk").isNull() | (F.col("quantum_risk") == "unknown"))
    return CO.pci_inventory_evidence(rows)


@query("compliance_algorithm_summary", f"""{_CF}, v AS (SELECT DISTINCT algorithm FROM
        (SELECT * FROM {O.violations('cf')}) WHERE framework = 'cnsa-2.0')
    SELECT s.algorithm, COALESCE(risk, 'Unknown') AS risk, COALESCE(effort, '-') AS effort,
        v.algorithm IS NULL AS compliant, occurrences FROM (
        SELECT COALESCE(alg_name, library, raw_identifier) AS algorithm, count(*) AS occurrences,
            arg_min(label, (engine_rank, seq)) FILTER (label IS NOT NULL) AS risk,
            arg_min(migration_effort, (engine_rank, seq)) FILTER (migration_effort IS NOT NULL) AS effort
        FROM (SELECT *, {O.mapping('quantum_risk', compliance.RISK_LABELS)} AS label FROM cf) GROUP BY 1) AS s
    LEFT JOIN v ON v.algorithm = s.algorithm""")
def compliance_algorithm_summary(spark, sf):
    found = classified(spark, sf)
    return CO.compliance_algorithm_summary(found, CO.compliance_eval(found, ["cnsa-2.0"]))


@query("framework_algorithm_summaries", f"""{_CF}, v AS MATERIALIZED (SELECT DISTINCT framework, algorithm FROM
        {O.violations('cf')}), a AS (SELECT COALESCE(alg_name, library, raw_identifier) AS algorithm,
        count(*) AS occurrences FROM cf GROUP BY 1)
    SELECT w.framework, a.algorithm, v.algorithm IS NULL AS compliant, occurrences
    FROM a CROSS JOIN (VALUES {', '.join(f"('{f[0]}')" for f in compliance.FRAMEWORKS[:6])}) AS w(framework)
    LEFT JOIN v ON v.algorithm = a.algorithm AND v.framework = w.framework""")
def framework_algorithm_summaries(spark, sf):
    found = cut(classified(spark, sf))
    return CO.framework_algorithm_summaries(found, CO.compliance_eval(found)).drop("risk", "effort")


@query("compliance_verdict", f"""{_CF} SELECT framework, rule, violation_severity AS severity,
    count(*) AS violations, min(deadline) AS deadline FROM {O.violations('cf')} GROUP BY ALL""")
def compliance_verdict(spark, sf):
    return verdict.compliance_verdict(classified(spark, sf))


# --- policy ---------------------------------------------------------------------
@query("fail_on", f"{_BIG} SELECT severity, count(*) AS n FROM cf WHERE severity IN ('critical', 'high') GROUP BY 1")
def fail_on(spark, sf):
    return P.fail_on(big(spark, sf), "High").groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


ALLOWED = ["aes*", "SHA-256", "ml-*", "tls", " RSA-20?8 ", "[xe]*"]
BLOCKED = ["md5", "*des*", "ssl", "rc4", "Kyber[0-9]*"]
_TLS = "regexp_full_match(n, '{0}([0-9]|v[0-9]| [0-9]).*')"


@query("policy_glob_match", f"""
    SELECT seq, alg_name, 'blocked-algorithm' AS rule FROM (SELECT *, lower(alg_name) AS n FROM {RAW})
    WHERE n IN ('md5', 'ssl', 'rc4') OR regexp_full_match(n, '[^/]*des[^/]*')
        OR regexp_full_match(n, 'kyber[0-9][^/]*') OR {_TLS.format('ssl')}
    UNION ALL
    SELECT seq, alg_name, 'allowed-algorithms' FROM (SELECT *, lower(alg_name) AS n FROM {RAW})
    WHERE alg_name IS NOT NULL AND NOT (n IN ('sha-256', 'tls') OR regexp_full_match(n, 'aes[^/]*')
        OR regexp_full_match(n, 'ml-[^/]*') OR regexp_full_match(n, 'rsa-20[^/]8')
        OR regexp_full_match(n, '[xe][^/]*') OR {_TLS.format('tls')})""")
def policy_glob_match(spark, sf):
    out = P.policy_glob_match(V.findings(spark, sf), ALLOWED, BLOCKED)
    return out.select("seq", F.col("algorithm.name").alias("alg_name"), "rule")


@query("policy_aggregate_rules", f"""{_BIG}, s AS (SELECT project, {_SUMMARY}, {_score(O.penalty())} AS score
        FROM cf GROUP BY project)
    SELECT project, 'require-pqc' AS rule, 'high' AS severity FROM s WHERE quantum_safe + quantum_resistant = 0
    UNION ALL SELECT project, 'max-quantum-vulnerable', 'high' FROM s WHERE quantum_vulnerable > 100
    UNION ALL SELECT project, 'min-qrs', 'high' FROM s WHERE score < 60""")
def policy_aggregate_rules(spark, sf):
    found = big(spark, sf)
    joined = SC.scan_summary(found, by=("project",)).join(SC.qrs(found, by=("project",)), "project")
    return P.policy_aggregate_rules(joined, True, 100, 60)


# --- impact ---------------------------------------------------------------------
MESSAGES = [
    "buf := make([]byte, 256)", "INSERT INTO t VARCHAR(4000)", "jwt.Sign(claims) and Set-Cookie",
    "tls.Config and more", "return result", "SIG_MAX_LEN = 512 max_len = 90", "new byte[64] dtls.Dial",
    "x509.CreateCertificate", "append(list, v)", "a := b", "ocsp.CreateRequest jwt.Encode",
    "send to socket VARCHAR(0)",
]
FLOW_NAMES = ["RSA-2048", "ECDSA-P256", "ECDH", "Ed25519", "rsa", "KCDSA-2048", "X25519", "AES-128",
              "ML-DSA-65", "SHA-1", "EC", "RSAES-OAEP"]
STEPS = f"""
    SELECT l_orderkey AS seq, {pick(f'l_orderkey % {len(FLOW_NAMES)}', FLOW_NAMES)} AS alg_name,
           CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
               l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS INT)
               AS hop,
           's' || {string('l_partkey % 50')} || '.go' AS file, l_linenumber AS line,
           {pick(f'(l_partkey + l_suppkey) % {len(MESSAGES)}', MESSAGES)} AS message
    FROM {{lineitem}}
"""


def flows(spark, sf):
    """One finding per order, with its lines as flow steps."""
    steps = V.view(spark, sf, STEPS).groupBy("seq", "alg_name").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("hop", "file", "line", "message"))),
        lambda s: F.struct(
            s["file"].alias("file"), s["line"].alias("line"), F.lit(None).cast("int").alias("col"),
            s["message"].alias("message"),
        ),
    ).alias("data_flow_path"))
    rows = steps.withColumns({
        "file": F.concat(F.lit("o"), F.col("seq").cast("string")), "line": F.lit(1),
        "algorithm": schema.algorithm(F.col("alg_name")), "engine_rank": F.lit(0),
    })
    return schema.conform(rows)


_STEPS = V.duck(STEPS)
_CONSUMER = "CASE " + " ".join(
    f"WHEN {O.any_part('lower(message)', [w.lower() for w in words])} THEN '{k}'"
    for k, words in irules.CONSUMERS) + " ELSE 'assignment' END"


@query("hop_edges", f"""
    SELECT seq, hop, COALESCE(lag(file) OVER w, 'o' || seq) AS source_file,
        COALESCE(lag(line) OVER w, 1) AS source_line, file AS target_file, line AS target_line,
        {_CONSUMER} AS consumer FROM {_STEPS} WHERE hop <= 4 WINDOW w AS (PARTITION BY seq ORDER BY hop)""")
def hop_edges(spark, sf):
    return IM.hop_edges(flows(spark, sf), max_hops=4).drop("finding_key", "engine_rank")


@query("consumer_type", f"SELECT seq, hop, {_CONSUMER} AS consumer FROM {_STEPS}")
def consumer_type(spark, sf):
    return V.view(spark, sf, STEPS).select("seq", "hop", I.consumer_type(F.col("message")).alias("consumer"))


LIMITS = [
    ("buf := make([]byte, 256)", "buffer-alloc", 256), ("INSERT INTO t VARCHAR(4000)", "db-column", 4000),
    ("SIG_MAX_LEN = 512 max_len = 90", "config", 90), ("SIG_MAX_LEN = 512 max_len = 90", "constant", 512),
    ("new byte[64] dtls.Dial", "buffer-alloc", 64),
]
_LIMIT_ROWS = ", ".join(f"({V.text(m)}, {V.text(k)}, {n})" for m, k, n in LIMITS)
_HITS = f"""SELECT seq, hop, file, line, type, n FROM {_STEPS} AS s
    JOIN (VALUES {_LIMIT_ROWS}) AS x(said, type, n) ON x.said = s.message"""


@query("constraint_hits", f"""SELECT seq, hop, file, line, type, CAST(n AS BIGINT) AS max_bytes
    FROM ({_HITS}) WHERE CAST(n AS BIGINT) > 0""")
def constraint_hits(spark, sf):
    return IM.constraint_hits(IM.flow_steps(flows(spark, sf))).drop("finding_key", "engine_rank")


_CROSS = " UNION ALL ".join(
    f"SELECT seq, hop, file, line, '{p}' AS protocol FROM {_STEPS} WHERE {O.any_part('message', calls)}"
    for p, calls in irules.PROTOCOL_CALLS.items())


@query("protocol_boundaries", _CROSS)
def protocol_boundaries(spark, sf):
    return IM.protocol_boundaries(IM.flow_steps(flows(spark, sf))).drop("finding_key", "engine_rank")


@query("protocol_boundaries_rows", _CROSS)
def protocol_boundaries_rows(spark, sf):
    """The same API names as rows of a table."""
    calls = literal_table(spark, [(p, c) for p, cs in irules.PROTOCOL_CALLS.items() for c in cs], "protocol string, call string")
    return IM.protocol_boundaries(IM.flow_steps(flows(spark, sf)), calls).drop("finding_key", "engine_rank")


_SIZES = ", ".join(f"({V.text(n)}, {sig or ct or pub})" for n, pub, sig, ct in irules.SIZES)
_TARGETS = ", ".join(f"({V.text(k)}, {i}, {V.text(t)})" for k, ts in irules.TARGETS.items() for i, t in enumerate(ts))


def _size_of(rel, col):
    """Size rows for the distinct names in a relation: exact, else longest table name either way."""
    return f"""(SELECT n.{col} AS name, COALESCE(max(CASE WHEN s.name = n.{col} THEN s.bytes END),
            arg_min(s.bytes, (-length(s.name), s.name))) AS bytes
        FROM (SELECT DISTINCT {col} FROM {rel}) AS n JOIN (VALUES {_SIZES}) AS s(name, bytes)
        ON s.name = n.{col} OR starts_with(upper(n.{col}), upper(s.name))
            OR starts_with(upper(s.name), upper(n.{col})) GROUP BY 1)"""


def _targets_of(rel):
    return f"""(SELECT n.alg_name, t.no, t.target FROM (SELECT alg_name,
            COALESCE(max(CASE WHEN k.fam = alg_name THEN k.fam END),
                arg_min(k.fam, (-length(k.fam), k.fam))) AS fam
            FROM (SELECT DISTINCT alg_name FROM {rel}) JOIN (SELECT DISTINCT fam FROM (VALUES {_TARGETS})
                AS v(fam, no, target)) AS k ON starts_with(upper(alg_name), upper(k.fam)) GROUP BY 1) AS n
        JOIN (VALUES {_TARGETS}) AS t(fam, no, target) ON t.fam = n.fam)"""


@query("size_profile", f"""SELECT f.seq, f.alg_name, s.bytes AS dominant_bytes
    FROM (SELECT seq, alg_name FROM {RAW} WHERE alg_name IS NOT NULL) AS f
    LEFT JOIN {_size_of(f'(SELECT alg_name FROM {RAW} WHERE alg_name IS NOT NULL)', 'alg_name')} AS s
    ON s.name = f.alg_name""")
def size_profile(spark, sf):
    names = V.view(spark, sf, V.FINDINGS).where("alg_name IS NOT NULL").select("seq", "alg_name")
    return IM.size_profile(names, "alg_name")


@query("impact_targets", f"""SELECT f.seq, f.alg_name, t.no AS target_no, t.target
    FROM (SELECT seq, alg_name FROM {RAW} WHERE alg_name IS NOT NULL) AS f
    JOIN {_targets_of(f'(SELECT alg_name FROM {RAW} WHERE alg_name IS NOT NULL)')} AS t
    ON t.alg_name = f.alg_name""")
def impact_targets(spark, sf):
    names = V.view(spark, sf, V.FINDINGS).where("alg_name IS NOT NULL").select("seq", "alg_name")
    return IM.impact_targets(names, "alg_name")


_LIMITS = ", ".join(f"('{p}', {n}, '{e}')" for p, n, _, e in irules.PROTOCOL_LIMITS)
_ENC = """CASE e.enc WHEN 'base64' THEN CAST(ceil(b / 3.0) AS BIGINT) * 4 WHEN 'der' THEN b + 8
    WHEN 'pem' THEN CAST(ceil(b / 3.0) AS BIGINT) * 4 + CAST(ceil(CAST(ceil(b / 3.0) AS BIGINT) * 4 / 64.0) AS BIGINT) + 52
    ELSE b END"""
_ZONES = f"""
    WITH st AS MATERIALIZED (SELECT * FROM {_STEPS}),
    hits AS (SELECT seq, CAST(n AS BIGINT) AS max_bytes FROM ({_HITS.replace(_STEPS, 'st')})
             WHERE CAST(n AS BIGINT) > 0),
    crossings AS (SELECT seq, protocol FROM ({_CROSS.replace(_STEPS, 'st')})),
    f AS (SELECT seq, alg_name, least(count(*), 3) AS hops FROM st GROUP BY 1, 2),
    z0 AS (SELECT f.*, t.no, t.target FROM f JOIN {_targets_of('f')} AS t USING (alg_name)),
    z AS (SELECT z0.*, a.bytes AS from_bytes, CAST(b.bytes AS BIGINT) AS b FROM z0
          JOIN {_size_of('z0', 'alg_name')} AS a ON a.name = z0.alg_name
          JOIN {_size_of('z0', 'target')} AS b ON b.name = z0.target),
    broken AS (SELECT z.seq, z.no, count(*) AS n FROM z JOIN hits USING (seq) WHERE z.b > max_bytes GROUP BY 1, 2),
    violated AS (SELECT z.seq, z.no, count(*) AS n, list(e.protocol) AS names FROM z
        JOIN crossings AS c USING (seq) JOIN (VALUES {_LIMITS}) AS e(protocol, lim, enc) ON e.protocol = c.protocol
        WHERE {_ENC} > e.lim GROUP BY 1, 2),
    s AS (SELECT z.*, COALESCE(k.n, 0) AS broken, COALESCE(v.n, 0) AS violated, v.names,
        CAST(floor(least(hops / 10.0::DOUBLE, 1.0) * 100.0::DOUBLE * 0.20::DOUBLE
          + least(COALESCE(k.n, 0) * 25.0::DOUBLE, 100.0) * 0.35::DOUBLE
          + least(COALESCE(v.n, 0) * 33.0::DOUBLE, 100.0) * 0.25::DOUBLE
          + least(CAST(b AS DOUBLE) / from_bytes / 50.0::DOUBLE, 1.0) * 100.0::DOUBLE * 0.20::DOUBLE
          + 0.5::DOUBLE) AS INT) AS score
        FROM z LEFT JOIN broken AS k ON k.seq = z.seq AND k.no = z.no
        LEFT JOIN violated AS v ON v.seq = z.seq AND v.no = z.no)"""
_BLAST_GRADE = """CASE WHEN score <= 15 THEN 'Minimal' WHEN score <= 40 THEN 'Contained'
    WHEN score <= 70 THEN 'Significant' ELSE 'Critical' END"""


def zones(spark, sf):
    return IM.impact_zones(flows(spark, sf), max_hops=3)


@query("impact_zones", f"""{_ZONES} SELECT seq, no AS target_no, target AS to_algorithm, hops AS hop_count,
    broken, violated, score, {_BLAST_GRADE} AS grade FROM s""")
def impact_zones(spark, sf):
    return zones(spark, sf).select(
        "seq", "target_no", "to_algorithm", F.col("hop_count").cast("bigint").alias("hop_count"),
        F.size("broken_constraints").cast("bigint").alias("broken"),
        F.size("violated_protocols").cast("bigint").alias("violated"),
        F.col("blast_radius_score").alias("score"), F.col("blast_radius_grade").alias("grade"),
    )


@query("attach_impact", f"""{_ZONES} SELECT f.seq, first.score AS blast_radius FROM f LEFT JOIN
    (SELECT seq, arg_min(score, no) AS score FROM s GROUP BY seq) AS first ON first.seq = f.seq""")
def attach_impact(spark, sf):
    found = flows(spark, sf)
    return IM.attach_impact(found, IM.impact_zones(found, max_hops=3)).select("seq", "blast_radius")


_SCORED = O.classified("(SELECT * FROM f)", "s.alg_name", "CAST(NULL AS STRING)", "CAST(NULL AS INT)")
_MULT = O.mapping("lower(x)", {"tls": 1.2, "dtls": 1.2, "ssh": 1.1, "x.509": 1.15, "grpc": 1.1, "jwt": 1.0,
                               "ocsp": 1.0, "s/mime": 0.9})
def classified_flows(spark, sf):
    from shoreline.operators.classify import classify_findings

    return classify_findings(flows(spark, sf))


_PER = f"""{_ZONES}, first AS (SELECT seq, names FROM s WHERE no = 0),
    c AS (SELECT * FROM {_SCORED}),
    m AS (SELECT seq, max({_MULT}) AS mult FROM (SELECT seq, unnest(names) AS x FROM first) GROUP BY seq),
    q AS (SELECT c.seq, c.c_risk, CAST({O.penalty('c_risk', 'c_severity')} * COALESCE(m.mult, 1.0) * {{years}}
        AS DECIMAL(18,6)) AS cost FROM c LEFT JOIN m ON m.seq = c.seq),
    t AS (SELECT seq % 400 AS project, sum(cost) AS cost,
        sum(CASE WHEN c_risk = 'quantum-safe' THEN 0.5 ELSE 0 END) AS bonus FROM q GROUP BY 1),
    a AS (SELECT seq % 400 AS project, avg(score) AS avg FROM s GROUP BY 1)"""
_SHRINK = "CASE WHEN avg IS NULL THEN {0} ELSE {0} * (1.0::DOUBLE - 0.15::DOUBLE * avg / 100.0::DOUBLE) END"


def _by_project(df):
    return df.withColumn("part", F.col("seq") % 400)


@query("qrs_impact", _PER.replace("{years}", "1.0") + f""" SELECT project, score, {O.grade('score')} AS grade
    FROM (SELECT t.project, CAST(floor(least(greatest({_SHRINK.format(
        'CAST(least(greatest(100 - cost + bonus, 0), 100) AS DOUBLE)')}, 0), 100) + 0.5) AS INT) AS score
        FROM t LEFT JOIN a USING (project))""")
def qrs_impact(spark, sf):
    found = _by_project(classified_flows(spark, sf))
    return SC.qrs_impact(found, _by_project(zones(spark, sf)), by=("part",)).withColumnRenamed("part", "project")


@query("qrs_full", _PER.replace("{years}", "1.15") + f""" SELECT project, score, {O.grade('score')} AS grade
    FROM (SELECT t.project, CAST(floor(least(greatest({_SHRINK.format(
        'CAST(round(least(greatest(100 - cost, 0) + bonus, 100)) AS DOUBLE)')}, 0), 100) + 0.5) AS INT) AS score
        FROM t LEFT JOIN a USING (project))""")
def qrs_full(spark, sf):
    found = _by_project(classified_flows(spark, sf))
    return SC.qrs_full(found, _by_project(zones(spark, sf)), 20, by=("part",)).withColumnRenamed("part", "project")


@query("encoded_size", f"""SELECT enc, b, CASE e.enc WHEN 'hex' THEN b * 2 ELSE {_ENC} END AS bytes,
    count(*) AS n FROM (SELECT {pick('event_id % 5', ['base64', 'hex', 'pem', 'der', 'raw'])} AS enc,
    event_id * 13 % 3000 AS b FROM events) AS e GROUP BY ALL""")
def encoded_size(spark, sf):
    rows = V.table(spark, sf, "events").select(
        V.expr(pick("event_id % 5", ["base64", "hex", "pem", "der", "raw"])).alias("enc"),
        (F.col("event_id") * 13 % 3000).alias("b"),
    )
    return rows.groupBy("enc", "b", I.encoded_size(F.col("b"), F.col("enc")).alias("bytes")).agg(
        F.count(F.lit(1)).alias("n"))


@query("blast_radius", f"""SELECT event_id, score, {_BLAST_GRADE} AS grade FROM (SELECT event_id,
    CAST(floor(least(h / 10.0::DOUBLE, 1.0) * 100.0::DOUBLE * 0.20::DOUBLE
        + least(c * 25.0::DOUBLE, 100.0) * 0.35::DOUBLE + least(p * 33.0::DOUBLE, 100.0) * 0.25::DOUBLE
        + least(r / 50.0::DOUBLE, 1.0) * 100.0::DOUBLE * 0.20::DOUBLE + 0.5::DOUBLE) AS INT) AS score
    FROM (SELECT event_id, event_id % 13 AS h, event_id % 6 AS c, event_id % 5 AS p,
        CAST(event_id % 70 AS DOUBLE) AS r FROM events))""")
def blast_radius(spark, sf):
    e = F.col("event_id")
    score = I.blast_radius(e % 13, e % 6, e % 5, (e % 70).cast("double"))
    rows = V.table(spark, sf, "events").select("event_id", score.alias("score"))
    return rows.withColumn("grade", I.blast_grade(F.col("score")))


# --- output formats -------------------------------------------------------------
@query("cdx_primitive", f"""SELECT seq, {O.mapping("lower(COALESCE(primitive, ''))",
    {s: k for k, ss in formats.CDX_PRIMITIVES.items() for s in ss}, "'unknown'")} AS cdx,
    CASE WHEN mode IS NULL THEN NULL ELSE 'gcm' END AS cdx_mode FROM {RAW}""")
def cdx_primitive(spark, sf):
    a = F.col("algorithm")
    return V.findings(spark, sf).select(
        "seq", X.cdx_primitive(a["primitive"]).alias("cdx"), X.cdx_mode(a["mode"]).alias("cdx_mode")
    )


_MESSAGE = """CASE WHEN library IS NOT NULL THEN 'Cryptographic library detected: ' || library
    WHEN alg_name IS NOT NULL THEN concat_ws(', ', 'Cryptographic algorithm detected: ' || alg_name,
        'primitive=' || primitive, 'keySize=' || key_size, 'mode=' || mode, 'curve=' || curve)
    ELSE 'Cryptographic usage detected' END"""
_LEVEL = """CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'warning' WHEN 'medium' THEN 'warning'
    WHEN 'low' THEN 'note' WHEN 'info' THEN 'none' ELSE CASE WHEN confidence IN ('high', 'medium-high', 'medium')
    THEN 'warning' ELSE 'note' END END"""


def _ident(expr):
    out = expr
    for old, new in formats.RULE_ID_REPLACEMENTS:
        out = f"replace({out}, {V.text(old)}, {V.text(new)})"
    return f"upper({out})"


_RULE_ID = f"""CASE WHEN library IS NOT NULL THEN 'CRYPTO-DEP-' || {_ident('library')}
    WHEN alg_name IS NOT NULL THEN 'CRYPTO-ALG-' || {_ident('alg_name')}
    ELSE 'CRYPTO-RAW-' || {_ident('raw_identifier')} END"""


@query("sarif_results", f"""{_CF} SELECT seq, {_RULE_ID} AS rule_id, {_LEVEL} AS level, {_MESSAGE} AS message,
    {O.place()} AS uri, line AS start_line, NULLIF(col, 0) AS start_column FROM cf""")
def sarif_results(spark, sf):
    return N.sarif_results(classified(spark, sf)).select(
        "seq", "rule_id", "level", "message", "uri", "start_line", "start_column"
    )


@query("sarif_rules", f"""SELECT rule_key, arg_min(rule_id, (engine_rank, seq)) AS rule_id,
    arg_min(name, (engine_rank, seq)) AS rule_name FROM (SELECT *, {_RULE_ID} AS rule_id,
    COALESCE(library, alg_name, '') AS name, COALESCE('dep/' || library, 'alg/' || alg_name,
    'raw/' || raw_identifier) AS rule_key FROM {RAW}) GROUP BY 1""")
def sarif_rules(spark, sf):
    return N.sarif_rules(V.findings(spark, sf)).select(
        "rule_key", "rule_id", F.coalesce("rule_name", F.lit("")).alias("rule_name"))


@query("finding_annotations", f"""{_CF}
    SELECT seq, 'quantumRisk' AS name, quantum_risk AS value FROM cf WHERE quantum_risk IS NOT NULL
    UNION ALL SELECT seq, 'severity', severity FROM cf WHERE severity IS NOT NULL
    UNION ALL SELECT seq, 'recommendation', recommendation FROM cf WHERE recommendation IS NOT NULL
    UNION ALL SELECT seq, 'hndlRisk', hndl_risk FROM cf WHERE hndl_risk IS NOT NULL
    UNION ALL SELECT seq, 'migrationEffort', migration_effort FROM cf WHERE migration_effort IS NOT NULL
    UNION ALL SELECT seq, 'pqcPresent', 'true' FROM cf WHERE seq % 3 = 0
    UNION ALL SELECT seq, 'handshakeBytes', CAST(seq AS STRING) FROM cf WHERE seq > 0
    UNION ALL SELECT seq, 'serverPreferredGroup', '0x' || lpad(lower(to_hex(seq % 5000)), 4, '0') FROM cf
        WHERE seq % 5000 <> 0
    UNION ALL SELECT seq, 'supportedGroups', '[29,' || seq % 7 || ']' FROM cf WHERE seq % 2 = 0""")
def finding_annotations(spark, sf):
    rows = classified(spark, sf).withColumns({
        "pqc_present": F.col("seq") % 3 == 0, "handshake_bytes": F.col("seq"),
        "server_preferred_group": (F.col("seq") % 5000).cast("int"),
        "supported_groups": F.when(
            F.col("seq") % 2 == 0, F.array(F.lit(29), (F.col("seq") % 7).cast("int"))),
    })
    return N.finding_annotations(rows).select("seq", "name", "value")


def _safe(expr):
    return f"CASE WHEN regexp_matches({expr}, '^[=+@-]') THEN '''' || {expr} ELSE {expr} END"


@query("csv_columns", f"""{_CF} SELECT seq, COALESCE(severity, '') AS severity,
    {_safe("COALESCE(alg_name, '')")} AS algorithm, COALESCE(CAST(key_size AS STRING), '') AS "keySize",
    COALESCE(quantum_risk, '') AS risk, 'false' AS "pqcPresent", {_safe("'=' || file")} AS file,
    CAST(line AS STRING) AS line, {O.finding_key('=')} AS "dedupeKey" FROM cf""")
def csv_columns(spark, sf):
    rows = classified(spark, sf).withColumn("file", F.concat(F.lit("="), "file"))
    full = schema.conform(rows, derived=True)
    return full.select("seq", *[c for c in X.csv_columns()]).select(
        "seq", "severity", "algorithm", "keySize", "risk", "pqcPresent", "file", "line", "dedupeKey")


_COMPONENT = """CASE WHEN alg_name IS NOT NULL THEN alg_name || '|' || COALESCE(key_size, 0) || '|' ||
    COALESCE(mode, '') || '|' || COALESCE(curve, '') ELSE 'lib:' || library END"""


@query("cbom_components", f"""
    SELECT component, count(*) AS occurrences,
        CASE WHEN min(alg_name) IS NOT NULL THEN 'cryptographic-asset' ELSE 'library' END AS type,
        arg_min(CASE WHEN alg_name IS NULL THEN library ELSE nm || CASE WHEN mode IS NOT NULL
            AND NOT contains(upper(nm), upper(mode)) THEN '-' || mode ELSE '' END END, (engine_rank, seq)) AS name,
        arg_min(CASE WHEN alg_name IS NULL THEN 'lib-' || substr(sha256('lib' || library), 1, 16)
            ELSE 'crypto-asset-' || substr(sha256('crypto-asset' || alg_name || COALESCE(CAST(key_size AS STRING), '')
            || COALESCE(mode, '')), 1, 16) END, (engine_rank, seq)) AS bom_ref
    FROM (SELECT *, {_COMPONENT} AS component, alg_name || CASE WHEN key_size > 0
            AND NOT contains(alg_name, CAST(key_size AS STRING)) THEN '-' || key_size ELSE '' END AS nm
          FROM {RAW} WHERE alg_name IS NOT NULL OR library IS NOT NULL) GROUP BY component""")
def cbom_components(spark, sf):
    return N.cbom_components(V.findings(spark, sf)).select(
        "component", "occurrences", "type", "name", "bom_ref")


@query("cbom_sources", f"""SELECT component, array_to_string(list(source_engine ORDER BY engine_rank), '+') AS sources
    FROM (SELECT DISTINCT {_COMPONENT} AS component, source_engine, engine_rank FROM {RAW}
          WHERE alg_name IS NOT NULL) GROUP BY 1""")
def cbom_sources(spark, sf):
    found = V.findings(spark, sf).where(F.col("algorithm").isNotNull())
    return N.cbom_components(found).select("component", "sources")


@query("cbom_occurrences", f"""SELECT {_COMPONENT} AS component, CASE WHEN alg_name IS NOT NULL THEN 'algorithm'
    ELSE 'library' END AS kind, CASE WHEN alg_name IS NOT NULL THEN {O.place()} ELSE file END AS location, line,
    CASE WHEN alg_name IS NOT NULL THEN col END AS "offset", seq
    FROM {RAW} WHERE alg_name IS NOT NULL OR library IS NOT NULL""")
def cbom_occurrences(spark, sf):
    return N.cbom_occurrences(V.findings(spark, sf)).drop("engine_rank")


@query("cbom_dependencies", f"""SELECT DISTINCT 'repo-root' AS ref, 'lib-' || substr(sha256('lib' || library), 1, 16)
    AS depends_on FROM {RAW} WHERE library IS NOT NULL""")
def cbom_dependencies(spark, sf):
    return N.cbom_dependencies(V.findings(spark, sf))


@query("cbom_metadata", f"""{_CF} SELECT count(*) AS finding_count, {_risk('quantum-vulnerable')}
    AS quantum_vulnerable_count, {_risk('deprecated')} AS deprecated_count,
    printf('%.1f', CAST({_risk('quantum-safe')} + {_risk('quantum-resistant')} AS DOUBLE) / count(*) * 100)
    AS pqc_safe_percent FROM cf""")
def cbom_metadata(spark, sf):
    return N.cbom_metadata(classified(spark, sf))


@query("cbom_zone_metadata", f"""{_ZONES} SELECT count(*) FILTER (score > 70) AS critical_migrations,
    count(*) FILTER (score BETWEEN 41 AND 70) AS significant_migrations,
    CAST(sum(violated) AS BIGINT) AS protocols_affected FROM s""")
def cbom_zone_metadata(spark, sf):
    found = cut(classified_flows(spark, sf))
    return N.cbom_metadata(found, IM.impact_zones(found, max_hops=3)).select(
        "critical_migrations", "significant_migrations", "protocols_affected")


@query("redact_cbom", f"""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'crypto:confidence' ELSE
    'crypto:confidence,x:codeSnippet' END AS names FROM part""")
def redact_cbom(spark, sf):
    def prop(name):
        return F.struct(F.lit(name).alias("name"), F.col("p_name").alias("value"))

    kept = F.array(prop("crypto:confidence"), prop("crypto:codeSnippet"))
    rows = V.table(spark, sf, "part").select("p_partkey", F.when(
        F.col("p_partkey") % 3 == 0, kept
    ).otherwise(F.concat(kept, F.array(prop("crypto:sourceContext"), prop("x:codeSnippet")))).alias("properties"))
    return N.redact_cbom(rows).select("p_partkey", F.array_join("properties.name", ",").alias("names"))


# --- records of a scan ----------------------------------------------------------
@query("scan_record", f"""{_BIG} SELECT r.*, {O.grade('score')} AS grade FROM (SELECT project, count(*) AS total,
    count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high,
    count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low,
    count(*) FILTER (severity = 'info') AS info, {_risk('quantum-vulnerable')} AS vulnerable,
    {_risk('quantum-weakened')} AS weakened, {_risk('quantum-safe')} AS safe,
    {_risk('quantum-resistant')} AS resistant, {_risk('deprecated')} AS deprecated,
    {_score(O.penalty())} AS score FROM cf GROUP BY project) AS r""")
def scan_record(spark, sf):
    return H.scan_record(big(spark, sf), by=("project",))


@query("top_findings", f"""{_CF} SELECT project, rn AS place, seq_file AS file, line, alg AS algorithm FROM (
    SELECT *, row_number() OVER (PARTITION BY project ORDER BY CAST(substr(priority, 2) AS INT),
        {O.severity_rank('severity')}, file, engine_rank, seq) AS rn,
        CASE WHEN len(string_split(file, '/')) > 2 THEN '.../' || string_split(file, '/')[-2] || '/'
            || string_split(file, '/')[-1] ELSE file END AS seq_file
    FROM (SELECT *, COALESCE(alg_name, library) AS alg FROM {_RANKED}) WHERE alg IS NOT NULL) WHERE rn <= 5""")
def top_findings(spark, sf):
    return H.top_findings(prioritised(spark, sf), 5, by=("project",)).select(
        "project", "place", "file", "line", "algorithm")


@query("group_by_file", f"SELECT file, count(*) AS n_findings FROM {RAW} GROUP BY file")
def group_by_file(spark, sf):
    return SC.group_by_file(V.findings(spark, sf))


@query("ingest_metrics", f"""SELECT source_engine, count(*) FILTER (seq % 4 <> 0) AS "rows",
    count(*) FILTER (seq % 4 = 0) AS suppressed FROM {RAW} GROUP BY 1""")
def ingest_metrics(spark, sf):
    found = V.findings(spark, sf)
    return SC.ingest_metrics(found.where("seq % 4 <> 0"), found.where("seq % 4 = 0"))
