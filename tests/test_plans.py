"""Whole scans, writers, streams and policies."""

import json

import pytest
from pyspark.sql import functions as F

from shoreline import schema
from shoreline.functions import output as X
from shoreline.functions.text import glob_to_regex
from shoreline.operators import classify as C
from shoreline.operators import compliance, inventory, policy, score, suppress
from shoreline.operators.filters import exclude_globs
from shoreline.plans import scan as S
from shoreline.plans import verdict
from shoreline.plans.checkpoints import cut
from shoreline.sinks import writers
from shoreline.sources import text_files
from shoreline.sources.history import load_cache_snapshot
from shoreline.streaming import tls_stream as T

ROWS = ("file string, line int, name string, primitive string, key_size int, library string, seq long, "
        "message string")


def feed(spark, engine, rows):
    df = spark.createDataFrame(rows, ROWS)
    flow = F.when(F.col("message").isNotNull(), F.array(F.struct(
        F.lit("s.go").alias("file"), F.lit(1).alias("line"), F.lit(1).alias("col"), "message")))
    return schema.conform(df.withColumns({
        "algorithm": F.when(F.col("name").isNotNull(), schema.algorithm(
            F.col("name"), F.col("primitive"), F.col("key_size"))),
        "dependency": F.when(F.col("library").isNotNull(), F.struct(
            "library", F.lit(None).cast("string").alias("version"))),
        "data_flow_path": flow, "source_engine": F.lit(engine), "confidence": F.lit("medium"),
        "reachable": F.lit("unknown"), "raw_identifier": F.lit("raw"),
    }))


@pytest.fixture(scope="module")
def scanned(spark):
    one = feed(spark, "cipherscope", [
        ("src/a.go", 1, "aes_256_gcm", None, 256, None, 0, None), ("src/a.go", 2, "RSA", "signature", 2048, None, 1,
                                                                  "jwt.Sign VARCHAR(100)"),
        ("src/a.go", 3, "MD5", "hash", None, None, 2, None), ("vendor/x.go", 1, "DES", None, None, None, 3, None),
        ("src/a_test.go", 1, "SHA-1", "hash", None, None, 4, None), ("src/a.go", 9, "AES", None, None, None, 5, None)])
    two = feed(spark, "cryptoscan", [
        ("src/a.go", 1, "AES-256-GCM", "ae", 256, None, 0, None), ("src/a.go", 3, "md5", "hash", None, None, 1, None),
        ("go.mod", 0, None, None, None, "openssl", 2, None)])
    lines = spark.createDataFrame([("src/a.go", 3, "h := md5() // crypto:ignore[MD5]")],
                                  "file string, line_no int, text string")
    constants = spark.createDataFrame([("src/a.go", "AES_KEY_BITS", 128)], "file string, name string, value long")
    options = S.ScanOptions(exclude=["vendor/**"], directives=suppress.extract_directives(lines),
                            constants=constants, impact=True)
    findings, zones = S.scan([one, two], options)
    return cut(findings), cut(zones)


def test_scan(scanned):
    findings, zones = scanned
    got = {(r["file"], r["line"]): (r["algorithm"] and r["algorithm"]["name"], r["quantum_risk"], r["priority"],
                                    r["corroborated_by"]) for r in findings.collect()}
    assert got == {
        ("src/a.go", 1): ("AES-256-GCM", "quantum-resistant", "P4", ["cryptoscan"]),
        ("src/a.go", 2): ("RSA-2048", "quantum-vulnerable", "P3", None),
        ("src/a.go", 9): ("AES", "quantum-weakened", "P4", None),
        ("src/a_test.go", 1): ("SHA-1", "deprecated", "P4", None),
        ("go.mod", 0): (None, "unknown", "P4", None),
    }
    assert {r["to_algorithm"] for r in zones.collect()} == {"ML-DSA-65", "ML-DSA-87"}


def test_scan_order(scanned):
    order = [(r["priority"], r["severity"], r["file"]) for r in scanned[0].collect()]
    rank = ["critical", "high", "medium", "low", "info"]
    assert order == sorted(order, key=lambda o: (o[0], rank.index(o[1]), o[2]))


def test_blast_radius_raises_effort(scanned):
    findings, zones = scanned
    rsa = findings.where("line = 2 and file = 'src/a.go'").collect()[0]
    best = zones.where("target_no = 0").collect()[0]
    assert rsa["blast_radius"] == best["blast_radius_score"]
    assert rsa["migration_snippet"]["language"] == "go"
    assert "ML-DSA-65" in rsa["migration_snippet"]["after"]


def test_writers(scanned, spark, tmp_path):
    findings, zones = scanned
    writers.write_findings_json(findings, str(tmp_path / "json"))
    summary = spark.read.json(str(tmp_path / "json" / "summary")).collect()[0]
    assert summary["total_findings"] == findings.count() and summary["grade"]
    writers.write_findings_csv(findings.withColumn("file", F.lit("=cmd")), str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("*.csv")).read_bytes()
    assert text.startswith(b"severity,confidence,algorithm,") and b"\r\n" in text and b"'=cmd" in text
    writers.write_cbom_components(findings, str(tmp_path / "cbom"), zones)
    assert spark.read.json(str(tmp_path / "cbom" / "components")).count() == 5
    writers.write_sarif_rows(findings, str(tmp_path / "sarif"))
    assert spark.read.json(str(tmp_path / "sarif" / "results")).count() == findings.count()
    violations = compliance.compliance_eval(findings)
    writers.write_compliance_summary(findings, violations, str(tmp_path / "comp"))
    assert spark.read.parquet(str(tmp_path / "comp" / "algorithms")).select("framework").distinct().count() >= 6
    record = spark.createDataFrame([("p", 1, 70)], "project string, scan_seq long, score int")
    writers.append_scan_history(record, str(tmp_path / "hist"))
    writers.append_scan_history(record, str(tmp_path / "hist"))
    assert spark.read.json(str(tmp_path / "hist")).count() == 2


def test_cache_snapshot(spark, tmp_path):
    def entries(rows):
        df = spark.createDataFrame(rows, "engine string, engine_version string, path string, content_hash string")
        return df.withColumn("findings", F.array(F.struct(F.lit("f").alias("file"), F.lit(1).alias("line"))))

    old = entries([("a", "1", "x", "h1"), ("a", "1", "gone", "h2"), ("b", "1", "x", "h1")])
    fresh = entries([("a", "1", "x", "h9"), ("a", "1", "deleted-meanwhile", "h")])
    paths = spark.createDataFrame([("x",)], "path string")
    for mode, expected in (("full", [("a", "x", "h9"), ("b", "x", "h1")]),
                           ("diff", [("a", "gone", "h2"), ("a", "x", "h9"), ("b", "x", "h1")])):
        out = str(tmp_path / mode)
        writers.write_cache_snapshot(old, fresh, paths, out, mode)
        got = load_cache_snapshot(spark, out, ["a", "b"]).select("engine", "path", "content_hash").collect()
        assert sorted(tuple(r) for r in got) == expected


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    event = {"event_type": "tls", "dest_ip": "1", "dest_port": 443,
             "tls": {"cipher_suite": "TLS_AES_128_GCM_SHA256", "groups": "X25519MLKEM768"}}
    (tmp_path / "in" / "1.json").write_text("\n".join([json.dumps(event)] * 3) + '\n{"torn')
    records = T.stream_tls_logs(spark, str(tmp_path / "in"))
    for _ in range(2):
        run = T.stream_findings(records, str(tmp_path / "out"), str(tmp_path / "ckpt"),
                                trigger={"availableNow": True})
        run.awaitTermination()
        # a second file repeats the record: the state drops it
        (tmp_path / "in" / "2.json").write_text(json.dumps(event))
    got = spark.read.parquet(str(tmp_path / "out")).select("algorithm.name", "quantum_risk").collect()
    assert sorted(tuple(r) for r in got) == [
        ("TLS_AES_128_GCM_SHA256", "quantum-resistant"), ("X25519MLKEM768", "quantum-safe")]


def test_log_files_stay_small(spark, tmp_path, monkeypatch):
    # four files for any number of lines before, each sorted whole in one task
    from queries import network, records

    lines = spark.range(0, 900, 1, 9).select(F.lit("eve0").alias("src_file"), F.col("id").alias("row_no"),
                                             F.col("id").cast("string").alias("line"))
    monkeypatch.setattr(network, "eve_lines", lambda spark, sf: lines)
    folder = records._log_files(spark, "", str(tmp_path))
    sizes = [len(f.read_text().split()) for f in (tmp_path / "in").glob("part-*")]
    assert sizes == [100] * 9 and spark.read.text(folder).distinct().count() == 900


def test_scores(spark):
    empty = C.classify_findings(feed(spark, "x", []))
    assert [tuple(r) for r in score.qrs(empty).collect()] == [(100, "A+")]
    rows = [("f", i, "RSA", "kem", 2048, None, i, None) for i in range(10)]
    found = C.classify_findings(feed(spark, "x", rows))
    assert [tuple(r) for r in score.qrs(found).collect()] == [(80, "B")]
    assert [tuple(r) for r in score.qrs_lifetime(found, 20).collect()] == [(77, "B")]
    assert [tuple(r) for r in score.qrs_lifetime(found, 2).collect()] == [(83, "B")]


def test_policy(spark):
    rows = [("f", 1, "TLSv1.2", None, None, None, 0, None), ("f", 2, "AES-256", None, 256, None, 1, None)]
    found = C.classify_findings(feed(spark, "x", rows))
    got = verdict.policy_verdict(found, level="medium", allowed=["aes*"], blocked=["tls"], require_pqc=True,
                                 max_vulnerable=0, min_score=100)
    assert sorted(r["rule"] for r in got.collect()) == [
        "allowed-algorithms", "blocked-algorithm", "fail-on", "max-quantum-vulnerable", "min-qrs"]
    with pytest.raises(ValueError):
        policy.policy_aggregate_rules(found, max_vulnerable=-1)


def test_pci_without_findings(spark):
    got = compliance.pci_inventory_evidence(C.classify_findings(feed(spark, "x", []))).collect()
    assert [r["reason"] for r in got] == ["no findings"]


@pytest.mark.parametrize("glob,path,hit", [
    ("*.go", "a.go", True), ("*.go", "d/a.go", False), ("a?c", "abc", True), ("[a-c]x", "bx", True),
    ("[^a]x", "bx", True), ("[", "[", False), ("a\\*", "a*", True), ("a.c", "abc", False),
])
def test_globs(glob, path, hit):
    import re

    regex = glob_to_regex(glob)
    assert bool(regex and re.fullmatch(regex, path)) == hit


def test_paths(spark):
    files = ["vendor/a.go", "x/vendor/b.go", "a.min.js", "d/A.MIN.js", "src/keep/z", "src/q", "src"]
    df = spark.createDataFrame([(f,) for f in files], "file string")
    left = [r[0] for r in exclude_globs(df, ["vendor/*", "*.min.js"]).collect()]
    assert left == ["src/keep/z", "src/q", "src"]
    left = [r[0] for r in suppress.suppress_by_path(df, ["src/**", "!src/keep/**"]).collect()]
    assert left == ["vendor/a.go", "x/vendor/b.go", "a.min.js", "d/A.MIN.js", "src/keep/z"]


def test_redaction_and_formula(spark):
    df = spark.createDataFrame([(1,)], "i int").withColumn("properties", F.array(
        F.struct(F.lit("crypto:codeSnippet").alias("name"), F.lit("x").alias("value"))))
    assert inventory.redact_cbom(df).collect()[0]["properties"] == []
    got = df.select(*[X.neutralize_formula(F.lit(s)) for s in ("=a", "+a", "-a", "@a", "\ta", "a=", "")]).collect()
    assert list(got[0]) == ["'=a", "'+a", "'-a", "'@a", "'\ta", "a=", ""]


def test_constants_of_languages(spark):
    files = [("a.java", "static final int K = 1_024;\nstatic final int X = 09;"), ("b.go", "var x = 3\nconst Y = 0x10"),
             ("c.c", "#define A 1\n#define A 2\nconst int A = 3;"), ("d.txt", "A = 1")]
    got = text_files.extract_constants(spark.createDataFrame(files, "file string, content string"))
    got = got.select("file", "name", "value")
    assert sorted(tuple(r) for r in got.collect()) == [("a.java", "K", 1024), ("b.go", "Y", 16), ("c.c", "A", 2)]


def test_sizes_spelled_in_names(spark):
    from shoreline.functions import compliance

    names = {"AES-128-GCM": 128, "AES256": 256, "XAES_192": None, "AES_192": 192, "AES 128": None, "AES_128_GCM": None,
             "AES-KW-AES-256": 256}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r[0]: r[1] for r in df.select("n", compliance._spelled(F.col("n"), compliance._AES_SPELLINGS)).collect()}
    assert got == names
    names = {"SHA-256": 256, "SHA3-384": 384, "SHA-3-512": 512, "SHA--224": 224, "HMAC-SHA512": 512, "SHA/256": None}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r[0]: r[1] for r in df.select("n", compliance._spelled(F.col("n"), compliance._SHA_SPELLINGS)).collect()}
    assert got == names


def test_markers_are_read_piece_by_piece(spark):
    want = {
        "x = 1 // crypto:ignore": ([], None), "# crypto:ignore[RSA, ,AES] -- old key": (["RSA", "AES"], "old key"),
        "/* crypto:ignore: later */": ([], "later"), "<!-- crypto:ignore[] \u2014 why -->": ([], "why"),
        "# crypto:ignore because": None, "crypto:ignore": None, "# crypto:ignore[RSA": None, "# crypto:ignore:": None,
        '"# crypto:ignore"': None, "# crypto:ignore no // crypto:ignore[DSA]": (["DSA"], None),
    }
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(want)], "file string, line_no int, text string")
    got = {r["line"]: (r["algorithms"], r["reason"]) for r in suppress.extract_directives(lines).collect()}
    assert got == {i: w for i, w in enumerate(want.values()) if w}


def test_identifiers_meet_constants_by_all_their_tokens(spark):
    from shoreline.operators import enrich

    constants = spark.createDataFrame(
        [(f"p.KEY_C{i}", 1000 + i) for i in range(300)] + [("p.KEY", 7), ("p._", 9), ("p.KEY-C1", 8)], "name string, value long")
    ids = {"f(KEY_C7)": 1007, "KEY_C7_X+KEY": 1007, "aKEY_C7": None, "KEY.C7": 7, "KEY-C1": 8, "a ___ b": 9, "": None, None: None}
    found = spark.createDataFrame(
        [(("RSA", None, None, None, None), x) for x in ids],
        "algorithm struct<name:string,primitive:string,key_size:int,mode:string,curve:string>, raw_identifier string")
    out = enrich.enrich_key_size_by_identifier(found, constants)
    assert {r["raw_identifier"]: r["algorithm"]["key_size"] for r in out.collect()} == ids
    assert enrich.enrich_key_size_by_identifier(found, constants.where("false")).count() == len(ids)


def test_constants_are_read_once(spark):
    # names, and the longest of them, were each worked out from the sources
    from shoreline.operators import enrich

    count = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(name):
        count.add(1)
        return name

    constants = spark.createDataFrame([("RSA_BITS", 2048), ("AES_KEY", 256)], "name string, value long").select(
        F.lit(None).cast("string").alias("project"), read.asNondeterministic()("name").alias("name"), "value")
    found = feed(spark, "x", [("f", 1, "RSA", "kem", None, None, 1, None)]).withColumn("raw_identifier", F.lit("use(RSA_BITS)"))
    out = enrich.enrich_key_size_by_identifier(found, constants)
    assert [r[0] for r in out.select("algorithm.key_size").collect()] == [2048]
    assert count.value == 2


def test_zones_are_worked_out_once_for_a_score(spark):
    # the protocols of the first zone and the average radius each followed all flow paths
    from shoreline.operators.impact import impact_zones

    count = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(name):
        count.add(1)
        return name

    rows = [("f", i, "RSA-2048", "pke", 2048, None, i, "tls.Dial") for i in range(3)]
    found = C.classify_findings(feed(spark, "x", rows))
    zones = impact_zones(found)
    want = zones.count()
    watched = zones.where(read.asNondeterministic()("from_algorithm").isNotNull())
    assert want > 0
    for operator in (lambda z: score.qrs_impact(found, z), lambda z: score.qrs_full(found, z, 20)):
        plain = operator(zones).collect()
        before = count.value
        assert operator(watched).collect() == plain
        assert count.value - before == want
