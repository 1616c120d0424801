"""Queries that go through files: readers, sinks, the cache, and counts of what was read.

Each writes what it needs from the driver's tables to a folder of its own in the shared
folder and reads it back.
"""

from pyspark.sql import functions as F

from queries import network as NQ
from queries import oracle as O
from queries import records as RQ
from queries import texts as TQ
from queries import verdicts as VQ
from queries import views as V
from queries.registry import ORACLES, query
from queries.views import pick
from shoreline import schema
from shoreline.operators import cache as C
from shoreline.operators import compliance as CO
from shoreline.operators import inventory as N
from shoreline.operators import metrics, suppress
from shoreline.plans import scan
from shoreline.plans.checkpoints import new_folder
from shoreline.sinks import cache_store, writers
from shoreline.sources import certificates, history, sensor_logs, text_files
from shoreline.sources.lines import read_lines

# --- readers --------------------------------------------------------------------
_RECORD = ["uid", "resp_host", "resp_port", "version", "cipher", "curve", "server_name", "pqc_key_share"]


def _written_lines(spark, lines, name, **options):
    """Log lines as files of a folder, each log in order in one file."""
    folder = new_folder(spark, name)
    lines.repartition("src_file").sortWithinPartitions("src_file", "src_block", "row_no").select("line").write.options(
        **options).text(folder)
    return folder


@query("gzip_input", f"SELECT {', '.join(_RECORD)} FROM ({ORACLES['scan_zeek_ssl_json']})")
def gzip_input(spark, sf):
    folder = _written_lines(spark, NQ.ssl_json_lines(spark, sf), "packed", compression="gzip")
    return sensor_logs.scan_zeek_ssl_json(spark, folder).select(*_RECORD)


@query("scan_zeek_ssl_files", f"SELECT {', '.join(_RECORD)} FROM ({ORACLES['scan_zeek_ssl_tsv']})")
def scan_zeek_ssl_files(spark, sf):
    """Logs with headers that change inside, found out by their first character."""
    folder = _written_lines(spark, NQ.ssl_tsv_lines(spark, sf), "logs")
    return sensor_logs.scan_zeek_ssl(spark, folder).select(*_RECORD)


@query("load_tls_observations", f"""SELECT count(*) AS n, count(DISTINCT target) AS targets,
    CAST(sum(bytes_in + bytes_out) AS BIGINT) AS bytes FROM {V.duck(V.ENDPOINTS)}""")
def load_tls_observations(spark, sf):
    folder = new_folder(spark, "observations")
    NQ.endpoints(spark, sf).drop("event_id").write.parquet(folder)
    return certificates.load_tls_observations(spark, folder).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("target").alias("targets"),
        F.sum(F.col("bytes_in") + F.col("bytes_out")).alias("bytes"))


@query("load_artifact_bytes", """SELECT CAST(sum(octet_length(encode(html)) + 1) AS BIGINT) AS length,
    CAST(sum(octet_length(encode(html)) + 1) AS BIGINT) AS bytes FROM pages""")
def load_artifact_bytes(spark, sf):
    folder = new_folder(spark, "artifacts")
    V.table(spark, sf, "pages").select("html").repartition(8).write.text(folder)
    # Spark's own marker of a finished write is empty
    return text_files.load_artifact_bytes(spark, folder).agg(
        F.sum("length").alias("length"), F.sum(F.octet_length("content").cast("bigint")).alias("bytes"))


@query("load_scan_history", f"SELECT project, scan_seq, score, total, vulnerable FROM {RQ._HIST}")
def load_scan_history(spark, sf):
    """History appended in two parts, then read back."""
    folder = new_folder(spark, "history")
    records = RQ.history(spark, sf)
    for half in (0, 1):
        writers.append_scan_history(records.where(F.col("scan_seq") % 2 == half), folder)
    return history.load_scan_history(spark, folder).select("project", "scan_seq", "score", "total", "vulnerable")


@query("append_scan_history", f"""SELECT project, scan_seq FROM (SELECT *, row_number() OVER
    (PARTITION BY project ORDER BY scan_seq DESC) AS rn FROM {RQ._HIST}) WHERE rn <= 2""")
def append_scan_history(spark, sf):
    folder = new_folder(spark, "history")
    writers.append_scan_history(RQ.history(spark, sf), folder)
    return history.load_scan_history(spark, folder, limit=2).select("project", "scan_seq")


# --- sinks ----------------------------------------------------------------------
@query("write_findings_json", f"""{VQ._CF} SELECT seq, file, line, alg_name AS name, quantum_risk AS risk, severity,
    total, score FROM cf, (SELECT count(*) AS total, {VQ._score(O.penalty())} AS score FROM cf)""")
def write_findings_json(spark, sf):
    folder = new_folder(spark, "json")
    writers.write_findings_json(VQ.classified(spark, sf), folder)
    rows = spark.read.json(f"{folder}/findings").select(
        "seq", "file", F.col("line").cast("int").alias("line"), F.col("algorithm.name").alias("name"),
        F.col("quantum_risk").alias("risk"), "severity")
    summary = spark.read.json(f"{folder}/summary").select(
        F.col("total_findings").alias("total"), F.col("score").cast("int").alias("score"))
    # the summary is one row
    return rows.join(F.broadcast(summary))


@query("write_cbom_components", ORACLES["cbom_components"])
def write_cbom_components(spark, sf):
    folder = new_folder(spark, "cbom")
    found = V.findings(spark, sf)
    writers.write_cbom_components(found, folder)
    like = N.cbom_components(schema.conform(found, derived=True)).schema
    return spark.read.schema(like).json(f"{folder}/components").select(
        "component", "occurrences", "type", "name", "bom_ref")


@query("write_sarif_rows", f"SELECT rule_id, level, message, uri, start_line, start_column FROM ({ORACLES['sarif_results']})")
def write_sarif_rows(spark, sf):
    folder = new_folder(spark, "sarif")
    writers.write_sarif_rows(VQ.classified(spark, sf), folder)
    return spark.read.json(f"{folder}/results").select(
        "rule_id", "level", "message", "uri", F.col("start_line").cast("int").alias("start_line"),
        F.col("start_column").cast("int").alias("start_column"))


@query("write_compliance_summary", f"""SELECT 'violations' AS part, framework, count(*) AS n
    FROM ({ORACLES['compliance_violations']}) GROUP BY framework
    UNION ALL SELECT 'algorithms', framework, count(*) FROM ({ORACLES['framework_algorithm_summaries']}) GROUP BY framework""")
def write_compliance_summary(spark, sf):
    folder = new_folder(spark, "compliance")
    found = VQ.classified(spark, sf)
    writers.write_compliance_summary(found, CO.compliance_eval(found), folder)
    parts = [spark.read.parquet(f"{folder}/{p}").groupBy("framework").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(p).alias("part"), "framework", "n") for p in ("violations", "algorithms")]
    return parts[0].unionByName(parts[1])


# --- cache and incremental scan ---------------------------------------------------
FEEDS = {"cipherscope": "2", "semgrep": "1"}
_NAMES = ["RSA-2048", "AES-128-CBC", "ML-KEM-768", "SHA-1", "ECDSA-P256"]


def _files(spark, sf, then: bool):
    """Documents as files, now and at an earlier scan: every fourth text was another, some were not there
    and some have gone since."""
    docs = V.table(spark, sf, "documents").where("doc_id % 11 <> 5" if then else "doc_id % 13 <> 7")
    text = F.coalesce("text", F.lit(""))
    text = F.when(F.col("doc_id") % 4 == 0, F.concat(text, F.lit(" old"))).otherwise(text) if then else text
    return docs.select(F.concat(F.lit("d"), "doc_id").alias("path"), text.alias("content"))


def _scanned(files):
    """Findings of a feed in each of its files: as many as the text's length ``_n`` says, modulo 3."""
    rows = files.select("engine", "path", "_n", F.explode(F.sequence(F.lit(1), F.col("_n") % 3 + 1)).alias("_k"))
    name = V.expr(pick(f"(_n + _k) % {len(_NAMES)}", _NAMES))
    return rows.select(
        "engine", "path", F.col("path").alias("file"), F.col("_k").cast("int").alias("line"),
        schema.algorithm(name).alias("algorithm"), F.lit("medium").alias("confidence"),
        F.col("engine").alias("source_engine"), F.lit("unknown").alias("reachable"),
        (F.regexp_extract("path", "([0-9]+)", 1).cast("bigint") * 10 + F.col("_k")).alias("seq"))


@query("incremental_scan", f"""
    SELECT file, line, alg_name, 2 AS feeds FROM (
        SELECT 'd' || doc_id AS file, k AS line, {pick(f'(n + k) % {len(_NAMES)}', _NAMES)} AS alg_name
        FROM (SELECT doc_id, length(COALESCE(text, '')) AS n, unnest(range(1, length(COALESCE(text, '')) % 3 + 2)) AS k
              FROM documents WHERE doc_id % 13 <> 7))""")
def incremental_scan(spark, sf):
    """A first scan fills the cache; the second scans what changed and gives what a full scan would."""
    folder = new_folder(spark, "cache")
    for then in (True, False):
        files = _files(spark, sf, then)
        # the texts stay where they are; what this scan looks at is their length
        lengths = files.select("path", F.length("content").alias("_n"))

        def changed_only(changed, lengths=lengths):
            return _scanned(lengths.join(changed.select("engine", "path"), "path"))

        out = scan.incremental_scan(C.content_hash(files), cache_store.read_cache(spark, folder), FEEDS, changed_only,
                                    scan.ScanOptions(snippets=False, cut_lineage=False))
        cache_store.refresh_cache(out.entries, out.files, folder)
    return out.findings.select("file", "line", F.col("algorithm.name").alias("alg_name"),
                               (1 + F.size("corroborated_by")).alias("feeds"))


@query("load_cache_snapshot", """SELECT e AS engine, 'd' || doc_id AS path, 'f' || doc_id AS file
    FROM documents, (VALUES ('cipherscope'), ('semgrep')) AS v(e) WHERE e = 'cipherscope'""")
def load_cache_snapshot(spark, sf):
    """The cache as a table of files, of which one feed's are read."""
    folder = new_folder(spark, "cache")
    # entries with whole findings, of which the older ones had a file and a line
    empty = {c: F.lit(None).cast(t) for c, t in schema.FINDING.items()}
    rows = RQ.cached(spark, sf).withColumn("findings", F.transform("findings", lambda f: F.struct(*[
        (f[c] if c in ("file", "line") else v).alias(c) for c, v in empty.items()])))
    current = rows.select("path").distinct()
    cache_store.refresh_cache(rows, current, folder)
    return C.cached_findings(cache_store.read_cache(spark, folder, ["cipherscope"])).select("engine", "path", "file")


# --- counts -----------------------------------------------------------------------
_TORN = "event_id % 17 = 5"


@query("ingest_observed", f"""
    SELECT 'lines' AS step, 'rows' AS measure, count(*) AS value FROM events
    UNION ALL SELECT 'lines', 'malformed', count(*) FILTER ({_TORN}) FROM events
    UNION ALL SELECT 'records', 'rows', count(*) FROM {V.duck(V.TLS)}
        WHERE established AND NOT ({_TORN}) AND event_id % 29 <> 3
    UNION ALL SELECT 'findings', 'rows', (SELECT count(*) FROM {V.duck(V.FINDINGS)})
    UNION ALL SELECT 'not suppressed by marker', 'rows', (SELECT count(*) FROM ({ORACLES['suppress_inline']}))
    UNION ALL SELECT 'feed broken', 'errors', 1""")
def ingest_observed(spark, sf):
    """Counts taken while a log is read, markers are applied and a feed cannot be read."""
    watch = metrics.Watch()
    scan.run_feeds({"broken": lambda: spark.read.schema("a int").parquet(new_folder(spark, "is-not-there"))}, watch)
    folder = _written_lines(spark, NQ.ssl_json_lines(spark, sf), "logs")
    records = watch(sensor_logs.parse_ssl_json(read_lines(spark, folder), watch), "records")
    found = watch(TQ.code_findings(spark, sf), "findings")
    left = watch(suppress.suppress_inline(found, suppress.extract_directives(TQ.lines(spark, sf))), "not suppressed by marker")
    for df in (records, left):
        df.write.format("noop").mode("overwrite").save()
    return watch.table(spark)
