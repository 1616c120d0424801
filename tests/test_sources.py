"""Readers over real files."""

import gzip
import json

from pyspark.sql import functions as F

from shoreline.sources import certificates, history, ids_log, scanners, sensor_logs, text_files
from shoreline.sources.lines import detect_log_format, read_lines

SSL = """#separator \\x09
#set_separator\t,
#empty_field\t(empty)
#unset_field\t-
#path\tssl
#fields\tts\tuid\tid.resp_h\tid.resp_p\tversion\tcipher\tcurve\tserver_name\testablished\tpqc_key_share
1.0\tC1\t10.0.0.1\t443\tTLSv13\tTLS_AES_128_GCM_SHA256\tx25519\ta.example\tT\t0x11ec,001d
# a comment between rows
1.1\tC2\t10.0.0.1\t443\tTLSv12\tX\t-\t-\tF\t-
1.2\tC3\t10.0.0.2\t8443\tTLSv12\tTLS_RSA_WITH_AES_128_CBC_SHA\t(empty)\t-\tT
#fields\tcipher\tuid\testablished
LATER\tC4\tT
"""


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_ssl_tsv_with_late_header(spark, tmp_path):
    (tmp_path / "ssl.log").write_text(SSL)
    df = sensor_logs.scan_zeek_ssl_tsv(spark, str(tmp_path / "ssl.log")).orderBy("uid")
    assert rows(df, "uid", "resp_host", "resp_port", "version", "cipher", "curve", "server_name",
                "pqc_key_share") == [
        ("C1", "10.0.0.1", "443", "1.3", "TLS_AES_128_GCM_SHA256", "X25519", "a.example", "0x11ec,001d"),
        ("C3", "10.0.0.2", "8443", "1.2", "TLS_RSA_WITH_AES_128_CBC_SHA", None, None, None),
        ("C4", None, None, None, "LATER", None, None, None),
    ]


def test_large_log_split_over_tasks(spark, tmp_path):
    head, line = SSL.split("1.0\t")[0], "1.0\tC{0}\th\t{0}\tTLSv12\tX\t-\t-\tT\t-\n"
    (tmp_path / "ssl.log").write_text(head + "".join(line.format(i) for i in range(20000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        df = sensor_logs.scan_zeek_ssl_tsv(spark, str(tmp_path / "ssl.log"))
        assert read_lines(spark, str(tmp_path / "ssl.log")).rdd.getNumPartitions() > 3
        assert df.count() == 20000
        order = df.orderBy("src_block", "row_no").select("resp_port").collect()
        assert [int(r[0]) for r in order] == list(range(20000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_gzip_and_format_fallback(spark, tmp_path):
    with gzip.open(tmp_path / "a.log.gz", "wt") as f:
        f.write(SSL)
    (tmp_path / "b.log").write_text(
        json.dumps({"uid": "J1", "id.resp_h": "h", "id.resp_p": 443, "established": True}) + "\n\n{torn\n"
        + json.dumps({"uid": "J2", "established": "F"}) + "\n")
    (tmp_path / "c.log").write_text("junk\n" + json.dumps({"uid": "J3", "id.resp_p": "25"}) + "\n")
    path = str(tmp_path)
    formats = {r["src_file"].rsplit("/", 1)[1]: r["fmt"]
               for r in detect_log_format(read_lines(spark, path)).collect()}
    assert formats == {"a.log.gz": "tsv", "b.log": "json", "c.log": "unknown"}
    uids = sorted(r[0] for r in sensor_logs.scan_zeek_ssl(spark, path).select("uid").collect())
    assert uids == ["C1", "C3", "C4", "J1", "J3"]


def test_x509_nested_json_gives_no_rows(spark, tmp_path):
    lines = [
        {"id": "F1", "certificate": {"sig_alg": "x", "key_alg": "y"}},
        {"id": "F2", "certificate.sig_alg": "unknown 2.16.840.1.101.3.4.3.18",
         "certificate.key_length": 2048, "san.dns": ["a.example", "b"], "certificate.curve": "-"},
        {"id": "F3", "certificate.key_alg": "rsa", "certificate.key_length": "abc", "san.dns": "c,d"},
    ]
    (tmp_path / "x509.log").write_text("\n".join(map(json.dumps, lines)))
    df = sensor_logs.scan_zeek_x509(spark, str(tmp_path / "x509.log")).orderBy("id")
    assert rows(df, "id", "key_length", "curve", "san_dns") == [
        ("F2", 2048, None, "a.example"), ("F3", 0, None, "c,d")]


def test_eve(spark, tmp_path):
    events = [
        {"event_type": "dns", "dest_ip": "1"}, {"event_type": "tls"},
        {"event_type": "tls", "dest_ip": "2", "dest_port": 443, "tls": {
            "cipher_suite": "X", "version": "TLS 1.3", "sni": "s", "ja3": {"hash": "A" * 32},
            "ja3s": {"hash": "0" * 32}, "groups": "x25519"}},
    ]
    text = "\n".join(map(json.dumps, events)) + '\n{"event_type": "tls", "tls": {"ver'
    (tmp_path / "eve.json").write_text(text)
    df = ids_log.scan_suricata_eve(spark, str(tmp_path / "eve.json"))
    assert rows(df, "dest_ip", "dest_port", "ja3", "ja3s", "groups") == [
        ("2", "443", None, "0" * 32, "x25519")]


def test_certificate_times(spark, tmp_path):
    times = ["2024-01-02T03:04:05", "2024-01-02T03:04:05.5", "2024-01-02 03:04:05", "2024-01-02", "nope"]
    (tmp_path / "ct.json").write_text("\n".join(json.dumps({"id": i, "not_before": t})
                                                for i, t in enumerate(times)))
    df = certificates.load_ct_certificates(spark, str(tmp_path / "ct.json")).orderBy("id")
    got = [r[0] for r in df.select(F.date_format("not_before", "HH:mm:ss")).collect()]
    assert got == ["03:04:05", "03:04:05", "03:04:05", "00:00:00", None]


def test_tool_files(spark, tmp_path):
    def put(name, value):
        (tmp_path / name).write_text(value if isinstance(value, str) else json.dumps(value, indent=1))
        return str(tmp_path / name)

    ast = put("ast.jsonl", json.dumps({"assetType": "algorithm", "identifier": "AES-256-GCM", "path": "a.go",
                                       "evidence": {"line": 3, "column": 4}, "metadata": {"keysize": 128}}))
    got = scanners.load_scanner_jsonl(spark, ast).select("algorithm.*", "line").collect()[0]
    assert (got["key_size"], got["mode"], got["line"]) == (128, "GCM", 3)
    pattern = put("p.json", {"findings": [{"findingType": "algorithm", "algorithm": "RSA", "primitive": "pke",
                                           "confidence": "HIGH"}, {"findingType": "x"}]})
    got = scanners.load_pattern_findings(spark, pattern).select("algorithm.primitive", "confidence").collect()
    assert [tuple(r) for r in got] == [("asymmetric", "high")]
    sbom = put("bom.json", {"components": [{"type": "library", "name": "n", "version": "1", "purl": "",
                                            "group": "g", "properties": []}, {"type": "file", "name": "x"}]})
    got = scanners.load_sbom_components(spark, sbom).select("dependency.library", "raw_identifier").collect()
    assert [tuple(r) for r in got] == [("g:n", "n@1")]
    assert scanners.load_sbom_purl_ns(spark, sbom).count() == 1
    assets = put("assets.json", {"assets": [{"type": "certificate", "algorithm": "RSA", "keySize": 2048}]})
    got = scanners.load_cbom_assets(spark, assets).select("file", "algorithm.primitive").collect()
    assert [tuple(r) for r in got] == [("cbom://certificate", "asymmetric")]
    deps = put("deps.json", {"dependencies": [{"name": "d", "version": "1", "cryptoUsages": [
        {"algorithm": "RSA", "reachable": False}, {"algorithm": ""}]}]})
    got = scanners.load_dependency_usages(spark, deps).select("raw_identifier", "reachable").collect()
    assert sorted(tuple(r) for r in got) == [("RSA", "no"), ("d@1", "unknown")]
    matches = put("m.json", [{"file": "f", "ruleId": "go-rsa", "message": "m", "severity": "error",
                              "range": {"start": {"line": 0, "column": 0}}}])
    got = scanners.load_astgrep_matches(spark, matches).select("algorithm.name", "line", "col").collect()
    assert [tuple(r) for r in got] == [("RSA", 1, 1)]
    sarif = put("s.sarif", {"runs": [{"tool": {"driver": {"rules": [
        {"id": "r1", "properties": {"algorithm": "AES", "primitive": "symmetric"}}]}}, "results": [
        {"ruleId": "r1", "locations": [{"physicalLocation": {"artifactLocation": {"uri": "file://a.go"},
                                                             "region": {"startLine": 7}}}],
         "codeFlows": [{"threadFlows": [{"locations": [{"location": {"physicalLocation": {
             "artifactLocation": {"uri": "b.go"}}}, "message": {"text": "m"}}]}]}]}]}]})
    got = scanners.load_sarif_taint(spark, sarif).select(
        "file", "line", "algorithm.name", "reachable", "data_flow_path").collect()[0]
    assert (got["file"], got["line"], got["name"], got["reachable"]) == ("a.go", 7, "AES", "yes")
    assert got["data_flow_path"][0]["message"] == "m"


def test_source_files_and_artifacts(spark, tmp_path):
    (tmp_path / "vendor").mkdir()
    (tmp_path / "vendor" / "x.py").write_text("KEY_BITS = 1")
    (tmp_path / "a.py").write_text("# c\r\nKEY_BITS = 2048\n")
    (tmp_path / "big.py").write_text("x" * 2000)
    lines = text_files.load_source_lines(spark, str(tmp_path), max_bytes=1000).orderBy("line_no").collect()
    assert [(r["line_no"], r["text"]) for r in lines] == [(1, "# c"), (2, "KEY_BITS = 2048"), (3, "")]
    assert text_files.load_artifact_bytes(spark, str(tmp_path), 1000).count() == 2
    (tmp_path / "ignore").write_text("# no\n\n src/** \n!src/keep/**\n")
    patterns = text_files.load_ignore_patterns(spark, str(tmp_path / "ignore"))
    assert [r["pattern"] for r in patterns.orderBy("src_block", "row_no").collect()] == ["src/**", "!src/keep/**"]


def test_history(spark, tmp_path):
    (tmp_path / "h.json").write_text("\n".join(
        json.dumps({"project": "p", "scan_seq": i, "score": i}) for i in range(5)))
    got = history.load_scan_history(spark, str(tmp_path / "h.json"), limit=2).collect()
    assert [(r["scan_seq"], r["total"]) for r in got] == [(3, 0), (4, 0)]


def test_without_a_limit_large_files_are_read_and_with_one_they_are_listed(spark, tmp_path):
    (tmp_path / "big.py").write_text("x = 1\n" * 300_000)
    (tmp_path / "small.py").write_text("y = 2\n")
    assert text_files.load_source_files(spark, str(tmp_path)).count() == 2
    left_out = text_files.skipped_files(spark, str(tmp_path), 1000).collect()
    assert [(r["file"].rsplit("/", 1)[1], r["length"]) for r in left_out] == [("big.py", 1_800_000)]


def test_lists_are_cut_as_the_format_says(spark):
    from shoreline.operators import records

    df = spark.createDataFrame([(",".join(f"g{i}" for i in range(200)),)], "groups string")
    sizes = df.select(F.size(records.split_list(F.col("groups"))), F.size(records.split_list(F.col("groups"), None)))
    assert tuple(sizes.first()) == (64, 200)
