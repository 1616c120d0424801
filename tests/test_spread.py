"""Long files stay spread: state maps over blocks of lines, log layouts by block, unpacked logs."""

import gzip
import random
import re

from pyspark.sql import functions as F

from shoreline.sources import config_text, sensor_logs
from shoreline.sources.lines import read_lines
from shoreline.sources.spread import BLOCK


def sequential(lines, comments, sections):
    """The reader of continued entries, line by line."""
    out, inside, section, entry = [], False, None, None
    for number, text in enumerate(lines, 1):
        stripped = text.strip()
        skipped = stripped == "" or stripped[0] in comments or (sections and stripped.startswith("["))
        if inside:
            entry[2].append(re.sub(r"\\$", "", text.lstrip(" \t")))
            goes_on = text.endswith("\\")
        elif skipped:
            if sections and re.match(r"\[[^\]]*\]", stripped):
                section = re.match(r"\[([^\]]*)\]", stripped)[1].strip()
            continue
        else:
            entry = [number, section, [re.sub(r"\\$", "", stripped)]]
            out.append(entry)
            goes_on = stripped.endswith("\\")
        inside = goes_on
    return [(n, s, "".join(p)) for n, s, p in out]


def entries(df, fmt):
    rows = config_text._entries(df, config_text.COMMENTS[fmt], fmt == "ini").collect()
    return sorted((r["line_no"], r["section"] if fmt == "ini" else None, r["text"]) for r in rows)


KINDS = ["k=v", "k = a \\", "  more \\", "more", "# c", "; c \\", "# c \\", "[s]", "[ t ] \\", "[x", "", "   ", "v \\  ", "\\"]


def test_small_files_like_the_sequential_reader(spark, monkeypatch):
    rng = random.Random(5)
    files = {f"f{i}": [rng.choice(KINDS) + str(j % 3) * (rng.random() < 0.3) for j in range(rng.randrange(60))] for i in range(40)}
    rows = [(f, n, t) for f, lines in files.items() for n, t in enumerate(lines, 1)]
    df = spark.createDataFrame(rows, "file string, line_no int, text string")
    # blocks of a few lines, so that every state crosses them
    real = config_text.in_blocks
    monkeypatch.setattr(config_text, "in_blocks", lambda lines: real(lines, 4))
    for fmt, comments in (("ini", "#;"), ("properties", "#!")):
        got = config_text._entries(df, config_text.COMMENTS[fmt], fmt == "ini").collect()
        want = {(f, n, s if fmt == "ini" else None, t) for f, lines in files.items()
                for n, s, t in sequential(lines, comments, fmt == "ini")}
        assert {(r["file"], r["line_no"], r["section"] if fmt == "ini" else None, r["text"]) for r in got} == want
    sections = config_text.config_sections(df).collect()
    for f, lines in files.items():
        now, want = None, []
        for text in lines:
            head = re.match(r"\[([^\]]*)\]", text.strip())
            now = head[1].strip() if head else now
            want.append(now)
        assert [r["section"] for r in sorted((r for r in sections if r["file"] == f), key=lambda r: r["line_no"])] == want


def test_one_file_of_a_million_lines(spark):
    n = 1_000_000
    # an entry that goes on over a block's end, a section that holds for many blocks
    kind = F.when(F.col("id") == 5, "[far]").when(F.col("id") % BLOCK == BLOCK - 1, "k=begun \\").when(
        F.col("id") % BLOCK == 0, F.concat(F.lit("  ended "), F.col("id").cast("string"))).when(
        F.col("id") % 7 == 3, "# c \\").otherwise(F.concat(F.lit("k"), F.col("id").cast("string"), F.lit(" = v")))
    lines = spark.range(n).select(F.lit("big.ini").alias("file"), (F.col("id") + 1).cast("int").alias("line_no"), kind.alias("text"))
    text = [r[0] for r in lines.orderBy("line_no").select("text").collect()]
    got = config_text._entries(lines, config_text.COMMENTS["ini"], True)
    want = sequential(text, "#;", True)
    assert got.count() == len(want)
    assert got.agg(F.sum(F.xxhash64("line_no", "section", "text") % 1_000_003)).collect() == spark.createDataFrame(
        want, "line_no int, section string, text string").agg(F.sum(F.xxhash64("line_no", "section", "text") % 1_000_003)).collect()
    # lines are sorted by file and block; by file alone only the blocks' summaries are
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.split("\n"):
        if "Window [" in line and "_b#" not in line.split("windowspecdefinition(")[1].split(" ASC")[0].rsplit(",", 1)[0]:
            assert "line_no#" not in line, line


HEAD = "#separator \\x09\n#unset_field\t-\n#fields\tuid\tid.resp_h\tcipher\testablished\n"


def test_layouts_cross_blocks_without_a_shuffle_by_file(spark, tmp_path):
    rows = [f"U{i}\th{i % 9}\tX{i % 4}\tT" for i in range(6000)]
    later = [f"X{i % 4}\tT\tV{i}\t(none)" for i in range(6000)]
    text = HEAD + "\n".join(rows) + "\n#unset_field\t(none)\n#fields\tcipher\testablished\tuid\tid.resp_h\n" + "\n".join(later) + "\n"
    (tmp_path / "ssl.log").write_text(text)
    (tmp_path / "other.log").write_text("#fields\tuid\tcipher\testablished\nO1\tY\tT\nO2\t-\tT\n")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = read_lines(spark, str(tmp_path))
        assert lines.select("src_block").distinct().count() > 8
        df = sensor_logs.parse_ssl_tsv(lines)
        got = {r["uid"]: (r["resp_host"], r["cipher"]) for r in df.collect()}
        want = {f"U{i}": (f"h{i % 9}", f"X{i % 4}") for i in range(6000)} | {f"V{i}": (None, f"X{i % 4}") for i in range(6000)}
        assert got == want | {"O1": (None, "Y"), "O2": (None, None)}
        # what is dealt by file alone are the blocks' summaries, never lines
        plan = df._jdf.queryExecution().executedPlan().toString()
        whole = re.findall(r"Exchange hashpartitioning\(src_file#\d+, \d+\).*", plan)
        lines_dealt = re.findall(r"Exchange hashpartitioning\(src_file#\d+, src_block#\d+L?, \d+\)", plan)
        assert lines_dealt
        for exchange in whole:
            below = plan[plan.index(exchange):].split("\n", 4)[1:4]
            assert any("Aggregate" in x or "Project" in x for x in below)
            assert "line#" not in exchange
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_unpacked_logs_are_dealt_over_tasks(spark, tmp_path, monkeypatch):
    from shoreline.sources import lines as L

    monkeypatch.setattr(L, "GZIP_ROWS", 100)
    with gzip.open(tmp_path / "ssl.log.gz", "wt") as f:
        f.write(HEAD + "".join(f"U{i}\th\tX\tT\n" for i in range(3000)))
    lines = read_lines(spark, str(tmp_path / "ssl.log.gz"))
    assert lines.select("src_block").distinct().count() == 31
    # few rows are put together again; without that the blocks are in many tasks
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert lines.groupBy(F.spark_partition_id()).count().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = sensor_logs.scan_zeek_ssl(spark, str(tmp_path)).orderBy("src_block", "row_no").select("uid").collect()
    assert [r[0] for r in got] == [f"U{i}" for i in range(3000)]


def test_limits_past_the_former_ones(spark):
    """Lists of more than 64 entries, paths of more than 10 hops, serials that begin alike."""
    from shoreline import schema
    from shoreline.operators import impact, records

    groups = ",".join(f"g{i}" for i in range(100))
    eve = spark.createDataFrame([("s", 0, 0, "1.2.3.4", "443", "C", None, groups)],
                                "src_file string, src_block long, row_no long, dest_ip string, dest_port string, "
                                "cipher string, sigalgs string, groups string").withColumns(
        {"ja3s": F.lit(None).cast("string"), "sni": F.lit(None).cast("string")})
    assert records.eve_record_to_findings(eve).count() == 101
    assert records.eve_record_to_findings(eve, max_list=64).count() == 65
    flow = [(f"f{i}", i, 0, "x") for i in range(25)]
    found = schema.conform(spark.createDataFrame(
        [("a", 1, ("RSA-2048", None, None, None, None), flow, 0, 0)],
        "file string, line int, algorithm struct<name:string,primitive:string,key_size:int,mode:string,curve:string>, "
        "data_flow_path array<struct<file:string,line:int,col:int,message:string>>, engine_rank int, seq long"))
    assert impact.hop_edges(found).count() == 25
    assert {r["hop_count"] for r in impact.impact_zones(found).collect()} == {25}
    assert {r["hop_count"] for r in impact.impact_zones(found, max_hops=10).collect()} == {10}
    certs = spark.createDataFrame([("h", "RSA", None, 2048, None, f"0011223344{i}") for i in range(3)],
                                  "hostname string, sig_algorithm string, pub_key_algorithm string, pub_key_size int, "
                                  "pub_key_curve string, serial_number string")
    assert records.ct_record_to_finding(certs).select("file").distinct().count() == 3
    assert records.ct_record_to_finding(certs, serial_chars=8).select("file").distinct().count() == 1
