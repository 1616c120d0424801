"""Queries over history, cache, regression metrics and streams."""

from pyspark.sql import functions as F

from queries import network as NQ
from queries import views as V
from queries.registry import query
from shoreline.operators import cache as C
from shoreline.operators import history as H
from shoreline.plans.checkpoints import new_folder
from shoreline.rules import files
from shoreline.streaming import tls_stream as T

_HIST = V.duck(V.HISTORY)


def history(spark, sf):
    return V.view(spark, sf, V.HISTORY)


@query("last_n_scans", f"""SELECT project, scan_seq, score FROM (SELECT *, row_number() OVER
    (PARTITION BY project ORDER BY scan_seq DESC) AS rn FROM {_HIST}) WHERE rn <= 3""")
def last_n_scans(spark, sf):
    return H.last_n_scans(history(spark, sf), 3).select("project", "scan_seq", "score")


_POINTS = f"""(SELECT *, CASE WHEN old THEN critical + high ELSE vulnerable END AS v,
    CASE WHEN old THEN medium ELSE deprecated END AS d FROM (SELECT *, vulnerable = 0 AND deprecated = 0
    AND safe + resistant = 0 AND total > 0 AS old FROM {_HIST}))"""


@query("trend_delta", f"""
    SELECT project, scans, b.score - a.score AS score_delta, b.total - a.total AS findings_delta,
        b.v - a.v AS vulnerable_delta, b.d - a.d AS deprecated_delta,
        scans > 1 AND (b.score > a.score OR b.v < a.v) AS improving,
        CASE WHEN scans = 1 THEN 'QRS ' || b.score || ' (' || b.grade || ') — 1 scan recorded.'
        ELSE 'QRS ' || CASE WHEN b.score > a.score THEN 'improved' WHEN b.score < a.score THEN 'degraded'
            ELSE 'unchanged' END || ' ' || a.score || '→' || b.score || ' (' ||
            CASE WHEN b.score < a.score THEN '' ELSE '+' END || (b.score - a.score) || ') over ' || scans || ' scans.'
            || CASE WHEN b.v < a.v THEN ' Vulnerable findings decreased by ' || (a.v - b.v) || '.'
                WHEN b.v > a.v THEN ' Vulnerable findings increased by ' || (b.v - a.v) || '.' ELSE '' END
            || CASE WHEN b.score > a.score OR b.v < a.v THEN ' Improving.'
                WHEN b.score = a.score AND b.v = a.v THEN ' Stable.' ELSE ' Not improving.' END END AS summary
    FROM (SELECT project, count(*) AS scans, arg_min(p, scan_seq) AS a, arg_max(p, scan_seq) AS b
        FROM (SELECT project, scan_seq, {{'score': score, 'total': total, 'v': v, 'd': d, 'grade': grade}} AS p
              FROM {_POINTS}) GROUP BY project)""")
def trend_delta(spark, sf):
    return H.trend_delta(history(spark, sf))


@query("project_overview", f"""SELECT project, count(*) AS scan_count, arg_max(score, scan_seq) AS latest_score,
    arg_max("timestamp", scan_seq) AS last_scan FROM {_HIST} GROUP BY project""")
def project_overview(spark, sf):
    return H.project_overview(history(spark, sf))


def _metrics(spark, sf):
    s = V.table(spark, sf, "supplier")
    base = s.where("s_suppkey % 5 <> 0").select(
        F.concat(F.lit("m"), "s_suppkey").alias("name"), (F.col("s_suppkey") % 9 * 100).cast("double").alias("value"))
    now = s.where("s_suppkey % 7 <> 0").select(
        F.concat(F.lit("m"), "s_suppkey").alias("name"), (F.col("s_suppkey") % 11 * 90).cast("double").alias("value"))
    return base, now


_MET = """(SELECT 'm' || s_suppkey AS name, CASE WHEN s_suppkey % 5 <> 0 THEN CAST(s_suppkey % 9 * 100 AS DOUBLE) END
    AS b, CASE WHEN s_suppkey % 7 <> 0 THEN CAST(s_suppkey % 11 * 90 AS DOUBLE) END AS c FROM supplier
    WHERE s_suppkey % 5 <> 0 OR s_suppkey % 7 <> 0)"""


@query("metric_regression", f"""SELECT name, CASE WHEN b IS NULL THEN 'new' WHEN c IS NULL THEN 'removed'
    WHEN CASE WHEN b > 0 THEN (c - b) / b * 100 ELSE 0 END <= 20 THEN 'pass' ELSE 'fail' END AS status,
    CAST(round(CASE WHEN b IS NULL OR c IS NULL THEN NULL WHEN b > 0 THEN (c - b) / b * 100 ELSE 0 END) AS INT)
    AS change FROM {_MET}""")
def metric_regression(spark, sf):
    out = H.metric_regression(*_metrics(spark, sf))
    return out.select("name", "status", F.round("change_pct").cast("int").alias("change"))


@query("new_and_removed", f"""SELECT name, CASE WHEN b IS NULL THEN 'new' ELSE 'removed' END AS status FROM {_MET}
    WHERE b IS NULL OR c IS NULL""")
def new_and_removed(spark, sf):
    return H.new_and_removed(*_metrics(spark, sf))


# --- cache ----------------------------------------------------------------------
VERSIONS = {"cipherscope": "2", "semgrep": "1", "config-scanner": "5"}


def files_now(spark, sf, deleted=False):
    """Documents as files; the content hash is over the whole text.  With ``deleted`` some are gone by now."""
    docs = V.table(spark, sf, "documents")
    docs = docs.where("doc_id % 10 <> 9") if deleted else docs
    return C.content_hash(docs.select(F.concat(F.lit("d"), "doc_id").alias("path"), F.col("text").alias("content")))


def cached(spark, sf):
    """A cache of an earlier scan: some texts and one feed version differ."""
    docs = V.table(spark, sf, "documents").select("doc_id", F.explode(F.array(
        *[F.lit(e) for e in ("cipherscope", "semgrep")])).alias("engine"), "text")
    old = F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return docs.select(
        "engine", F.when(F.col("engine") == "semgrep", "0").otherwise("2").alias("engine_version"),
        F.concat(F.lit("d"), "doc_id").alias("path"), F.sha2(old.cast("binary"), 256).alias("content_hash"),
        F.array(F.struct(F.concat(F.lit("f"), "doc_id").alias("file"), F.lit(1).alias("line"))).alias("findings"))


@query("incremental_split", """
    SELECT 'changed' AS side, e AS engine, 'd' || doc_id AS path FROM documents,
        (VALUES ('cipherscope'), ('semgrep'), ('config-scanner')) AS v(e)
    WHERE NOT (e = 'cipherscope' AND doc_id % 4 <> 0)
    UNION ALL SELECT 'cached', 'cipherscope', 'd' || doc_id FROM documents WHERE doc_id % 4 <> 0""")
def incremental_split(spark, sf):
    changed, reused = C.incremental_split(files_now(spark, sf), cached(spark, sf), VERSIONS)
    return changed.select(F.lit("changed").alias("side"), "engine", "path").unionByName(
        reused.select(F.lit("cached").alias("side"), "engine", "path"))


@query("content_hash", "SELECT 'd' || doc_id AS path, sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf):
    return files_now(spark, sf)


@query("prune_deleted", """SELECT e AS engine, 'd' || doc_id AS path FROM documents,
    (VALUES ('cipherscope'), ('semgrep')) AS v(e) WHERE doc_id % 10 <> 9""")
def prune_deleted(spark, sf):
    return C.prune_deleted(cached(spark, sf), files_now(spark, sf, deleted=True)).select("engine", "path")


@query("updated_cache", """SELECT e AS engine, 'd' || doc_id AS path,
        CASE WHEN e = 'semgrep' AND doc_id % 3 = 0 THEN '1' WHEN e = 'semgrep' THEN '0' ELSE '2' END AS engine_version
    FROM documents, (VALUES ('cipherscope'), ('semgrep')) AS v(e) WHERE doc_id % 10 <> 9""")
def updated_cache(spark, sf):
    old = cached(spark, sf)
    number = F.regexp_extract("path", "([0-9]+)", 1).cast("int")
    fresh = old.where((F.col("engine") == "semgrep") & (number % 3 == 0)).withColumn("engine_version", F.lit("1"))
    return C.updated_cache(old, fresh, files_now(spark, sf, deleted=True)).select("engine", "path", "engine_version")


@query("union_cached_fresh", """SELECT 'cached' AS side, count(*) AS n FROM documents
    UNION ALL SELECT 'fresh', count(*) FROM documents WHERE doc_id % 3 = 0""")
def union_cached_fresh(spark, sf):
    old = C.cached_findings(cached(spark, sf).where("engine = 'semgrep'")).withColumn("side", F.lit("cached"))
    number = F.regexp_extract("path", "([0-9]+)", 1).cast("int")
    fresh = old.where(number % 3 == 0).withColumn("side", F.lit("fresh")).drop("line")
    return C.union_cached_fresh(old, fresh).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@query("engines", f"""SELECT * FROM (VALUES {', '.join(f"('{n}', {t}, {i})" for i, (n, t) in enumerate(files.FEEDS))})
    AS f(engine, tier, engine_rank) WHERE engine IN (SELECT source_engine FROM {V.duck(V.FINDINGS)})""")
def engines(spark, sf):
    from shoreline.operators.filters import engines_dim

    seen = V.view(spark, sf, V.FINDINGS).select(F.col("source_engine").alias("engine")).distinct()
    return engines_dim(spark).join(seen, "engine", "left_semi")


# --- streams --------------------------------------------------------------------
def _folder(spark) -> str:
    """A fresh folder for one stream, on the shared folder the session names."""
    return new_folder(spark, "stream")


def _log_files(spark, sf, folder):
    """Rotated logs: a file for each partition of the lines, so that a file and its task stay small at any size."""
    NQ.eve_lines(spark, sf).select("line").write.text(f"{folder}/in")
    return f"{folder}/in"


def _drain(df, folder, name):
    """Run a stream over what is there and read its output back."""
    out = f"{folder}/{name}"
    run = df.writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", f"{folder}/{name}-checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(out)


@query("stream_tls_logs", f"SELECT dest_ip, dest_port, cipher, version, sni, ja3s FROM {NQ._EVE_ROWS}")
def stream_tls_logs(spark, sf):
    folder = _folder(spark)
    rows = T.stream_tls_logs(spark, _log_files(spark, sf, folder))
    return _drain(rows, folder, "records").select("dest_ip", "dest_port", "cipher", "version", "sni", "ja3s")


@query("stream_dedup", f"SELECT DISTINCT dest_ip, dest_port, cipher, version, sni FROM {NQ._EVE_ROWS}")
def stream_dedup(spark, sf):
    folder = _folder(spark)
    rows = T.stream_tls_logs(spark, _log_files(spark, sf, folder))
    return _drain(T.stream_dedup(rows, T.KEYS["eve"]), folder, "first").select(
        "dest_ip", "dest_port", "cipher", "version", "sni")


@query("stream_findings", f"""SELECT '(suricata-log)/' || target || '#' || cipher AS file, cipher AS name,
    count(DISTINCT (dest_ip, dest_port, version, sni)) AS n FROM {NQ._EVE_CLEAN} WHERE cipher IS NOT NULL GROUP BY 1, 2""")
def stream_findings(spark, sf):
    """Findings for ciphers; groups of a key come from whichever record was first."""
    folder = _folder(spark)
    rows = T.stream_tls_logs(spark, _log_files(spark, sf, folder))
    run = T.stream_findings(rows, f"{folder}/out", f"{folder}/checkpoint", trigger={"availableNow": True})
    run.awaitTermination()
    found = spark.read.parquet(f"{folder}/out").where(
        F.col("algorithm.primitive").isin("key-agree", "asymmetric", "symmetric", "signature")
        & (F.col("algorithm.name").startswith("TLS_") | (F.col("algorithm.name") == "ECDSA-ONLY")))
    return found.groupBy("file", F.col("algorithm.name").alias("name")).agg(F.count(F.lit(1)).alias("n"))

