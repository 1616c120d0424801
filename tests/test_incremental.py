"""Incremental scans against full ones, the cache's files, counts, and sinks that write once."""

import os

import pytest
from pyspark.sql import functions as F

from shoreline import schema
from shoreline.operators import cache as C
from shoreline.operators import metrics
from shoreline.plans import scan
from shoreline.sinks import cache_store, writers
from shoreline.sources import sensor_logs
from shoreline.streaming import tls_stream as T

FEEDS = {"alpha": "1", "beta": "1"}


def files_of(spark, texts):
    return spark.createDataFrame(list(texts.items()), "path string, content string")


def findings_in(files):
    """Both feeds name the same algorithm in each line of a file."""
    rows = files.select("engine", "path", F.posexplode(F.split("content", " ")).alias("i", "name"))
    return rows.select(
        "engine", "path", F.col("path").alias("file"), (F.col("i") + 1).alias("line"),
        schema.algorithm(F.col("name")).alias("algorithm"), F.lit("medium").alias("confidence"),
        F.col("engine").alias("source_engine"), F.col("i").cast("bigint").alias("seq"))


def run(spark, texts, folder, feeds=FEEDS, options=None):
    files, scanned = files_of(spark, texts), []

    def changed_only(changed):
        scanned.extend((r["engine"], r["path"]) for r in changed.collect())
        return findings_in(files.join(changed.select("engine", "path"), "path"))

    hashed = C.content_hash(files)
    out = scan.incremental_scan(hashed, cache_store.read_cache(spark, folder), feeds, changed_only,
                                options or scan.ScanOptions(snippets=False))
    cache_store.refresh_cache(out.entries, hashed, folder, buckets=8)
    return sorted((r["file"], r["line"], r["algorithm"]["name"], r["confidence"], tuple(r["corroborated_by"] or ()))
                  for r in out.findings.collect()), sorted(scanned)


def stamps(folder):
    out = {}
    for top, _, names in os.walk(folder):
        out[os.path.relpath(top, folder)] = sorted((n, os.stat(os.path.join(top, n)).st_mtime_ns) for n in names if n.endswith(".parquet"))
    return {k: v for k, v in out.items() if v}


def test_incremental_scan_equals_a_full_one(spark, tmp_path):
    folder = str(tmp_path / "cache")
    texts = {f"f{i}": f"RSA AES-{128 if i % 2 else 256} SHA-{i}" for i in range(12)}
    first, scanned = run(spark, texts, folder)
    assert len(scanned) == 24 and len(first) == 36 and all(r[4] == ("beta",) for r in first)
    before = stamps(folder)
    # one file changes, one goes, one is new, one has nothing any more
    texts = {**texts, "f3": "DES", "new": "MD5 MD4", "f5": ""}
    del texts["f7"]
    second, scanned = run(spark, texts, folder)
    assert scanned == sorted((e, p) for e in FEEDS for p in ("f3", "f5", "new"))
    full, _ = run(spark, texts, str(tmp_path / "other"))
    assert second == full
    after = stamps(folder)
    bucket = {p: b for p, b in spark.createDataFrame([(p,) for p in [*texts, "f7"]], "p string").select(
        "p", cache_store.bucket_of(F.col("p"), 8)).collect()}
    touched = {f"engine={e}/bucket={bucket[p]}" for e in FEEDS for p in ("f3", "f5", "f7", "new")}
    assert {k for k in before if k not in touched} and all(after[k] == v for k, v in before.items() if k not in touched)
    assert all(after.get(k) != v for k, v in before.items() if k in touched)
    kept = cache_store.read_cache(spark, folder).select("engine", "path").collect()
    assert sorted(map(tuple, kept)) == sorted((e, p) for e in FEEDS for p in texts)
    # nothing changed: nothing is scanned and nothing written
    again, scanned = run(spark, texts, folder)
    assert again == full and scanned == [] and stamps(folder) == after
    # a new version of a feed: its files are scanned again, the other's come from the cache
    newer, scanned = run(spark, texts, folder, {"alpha": "2", "beta": "1"})
    assert newer == full and scanned == sorted(("alpha", p) for p in texts)


def test_files_are_hashed_once_and_merged_when_read(spark, tmp_path):
    folder, runs = str(tmp_path / "cache"), spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(x):
        runs.add(1)
        return x

    options = scan.ScanOptions(snippets=False, cut_lineage=False)
    texts = {f"f{i}": f"RSA AES SHA-{i}" for i in range(6)}
    run(spark, texts, folder, options=options)
    texts = {**texts, "f3": "DES", "new": "TLS"}
    files = files_of(spark, texts)
    out = scan.incremental_scan(
        C.content_hash(files.withColumn("content", told("content"))), cache_store.read_cache(spark, folder), FEEDS,
        lambda changed: findings_in(files.join(changed.select("engine", "path"), "path")), options)
    assert "Aggregate" in out.findings._jdf.queryExecution().optimizedPlan().toString()
    # the files that the cached findings came from are replaced before the findings are read
    cache_store.refresh_cache(out.entries, out.files, folder, buckets=8)
    found = sorted((r["file"], r["line"], r["algorithm"]["name"], r["confidence"], tuple(r["corroborated_by"] or ()))
                   for r in out.findings.collect())
    assert runs.value == len(texts)
    full, _ = run(spark, texts, str(tmp_path / "other"))
    assert found == full and {r[0] for r in found} == set(texts)


def test_a_bucket_can_become_empty(spark, tmp_path):
    folder = str(tmp_path / "cache")
    run(spark, {"a": "RSA", "b": "DES"}, folder)
    found, _ = run(spark, {"a": "RSA"}, folder)
    assert [r[0] for r in found] == ["a"]
    assert {r["path"] for r in cache_store.read_cache(spark, folder).collect()} == {"a"}
    assert cache_store.read_cache(spark, folder, ["beta"]).select("engine").distinct().collect()[0][0] == "beta"
    assert cache_store.read_cache(spark, str(tmp_path / "none")).count() == 0


def test_scan_with_certificates_feeds_and_constants(spark):
    hidden = schema.conform(spark.createDataFrame(
        [("(tls-probe)/h.example:443#kex", 0, ("X25519", None, None, None, None), "tls-probe", True, "ECH_ENABLED", 0, 0),
         ("a.py", 1, ("RSA", None, None, None, None), "cryptoscan", False, None, 1, 0)],
        "file string, line int, algorithm struct<name:string,primitive:string,key_size:int,mode:string,curve:string>, "
        "source_engine string, partial_inventory boolean, partial_inventory_reason string, engine_rank int, seq long"
    ).withColumn("raw_identifier", F.lit("gen(RSA_BITS)")))
    certs = spark.createDataFrame([("H.example", "SHA256-RSA", None, 2048, None, "01"), ("z", "DSA", None, 1, None, "02")],
                                  "hostname string, sig_algorithm string, pub_key_algorithm string, pub_key_size int, "
                                  "pub_key_curve string, serial_number string")
    constants = schema.in_project(spark.createDataFrame(
        [("b.py", "b", "RSA_BITS", 3072)], "file string, scope string, name string, value long"), F.lit(None).cast("string"))
    found, _ = scan.scan([hidden], scan.ScanOptions(certificates=certs, constants=constants, snippets=False))
    got = {(r["source_engine"], r["algorithm"]["name"], r["algorithm"]["key_size"]) for r in found.collect()}
    assert ("ct-lookup", "SHA256-RSA", 2048) in {(e, n, s) for e, n, s in got} or any(e == "ct-lookup" for e, _, _ in got)
    assert ("cryptoscan", "RSA", 3072) in got
    only, _ = scan.scan([hidden], scan.ScanOptions(engines=["cryptoscan"], snippets=False))
    assert {r["source_engine"] for r in only.collect()} == {"cryptoscan"}


def test_counts_of_a_scan(spark, tmp_path):
    watch = metrics.Watch()
    good = schema.conform(spark.createDataFrame([("a", 1), ("b", 2), ("v/c", 3), ("d", 4)], "file string, line int").withColumns({
        "algorithm": schema.algorithm(F.lit("RSA")), "source_engine": F.lit("x"), "seq": F.col("line").cast("bigint")}))
    feeds = scan.run_feeds({"good": lambda: good, "bad": lambda: good.select(F.raise_error(F.lit("torn file")).alias("file")),
                            "missing": lambda: spark.read.schema("a int").parquet(str(tmp_path / "no"))}, watch)
    assert len(feeds) == 1 and [s for s, _ in watch.errors] == ["feed bad", "feed missing"]
    marks = schema.in_project(spark.createDataFrame([("a", 1, [])], "file string, line int, algorithms array<string>"),
                              F.lit(None).cast("string"))
    options = scan.ScanOptions(ignore_patterns=["v/**"], directives=marks, snippets=False, watch=watch, exclude=["b"])
    found, _ = scan.scan(feeds, options)
    found.write.format("noop").mode("overwrite").save()
    counts = watch.counts()
    assert {s: c["rows"] for s, c in counts.items()} == {
        "feed good": 4, "collected": 4, "selected": 3, "merged": 3, "not suppressed by path": 2, "not suppressed by marker": 1}
    table = {(r["step"], r["measure"]): r["value"] for r in watch.table(spark).collect()}
    assert table[("feed bad", "errors")] == 1 and table[("collected", "rows")] == 4
    with pytest.raises(ValueError):
        watch(good, "merged")


def test_malformed_lines_are_counted(spark, tmp_path):
    watch = metrics.Watch()
    lines = ['{"uid": "1"}', '{"uid": ', "", "  ", "noise", '{"uid": "2", "established": "F"}']
    df = spark.createDataFrame([("s", 0, i, x) for i, x in enumerate(lines)], "src_file string, src_block long, row_no long, line string")
    assert sensor_logs.parse_ssl_json(df, watch).count() == 1
    assert watch.counts() == {"lines": {"rows": 6, "malformed": 2}}
    # a stream tells the same in its progress
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(lines))
    rows = T.stream_tls_logs(spark, str(tmp_path / "in"), "ssl", metrics.Watch())
    query = rows.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert metrics.stream_counts(query)["lines"]["malformed"] == 2


def test_outputs_come_from_one_table(spark, tmp_path):
    runs = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(x):
        runs.add(1)
        return x

    rows = spark.range(20).select(F.concat(F.lit("f"), "id").alias("file"), F.lit(1).alias("line"),
                                  schema.algorithm(F.lit("RSA")).alias("algorithm"), F.col("id").alias("seq"), F.lit(0).alias("engine_rank"))
    df = schema.conform(rows.withColumn("raw_identifier", told("file")), derived=True)
    writers.write_all(df, str(tmp_path / "out"))
    assert runs.value == 20
    assert spark.read.json(str(tmp_path / "out" / "json" / "findings")).count() == 20
    assert spark.read.json(str(tmp_path / "out" / "sarif" / "results")).count() == 20
    writers.write_findings_json(df, str(tmp_path / "one"))
    assert runs.value == 40
