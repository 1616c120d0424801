"""Projects stay apart: keys, constants, markers and readers."""

import pytest
from pyspark.sql import functions as F

from shoreline import schema
from shoreline.operators import dedupe, enrich, suppress
from shoreline.sources import config_text, text_files

ALGORITHM = "struct<name:string,primitive:string,key_size:int,mode:string,curve:string>"


def findings(spark, rows):
    """(project, file, line, name, identifier) as findings of one feed each."""
    data = [(p, f, n, (a, None, None, None, None), r, "medium", f"e{i}", i, i) for i, (p, f, n, a, r) in enumerate(rows)]
    return schema.conform(spark.createDataFrame(
        data, f"project string, file string, line int, algorithm {ALGORITHM}, raw_identifier string, "
        "confidence string, source_engine string, engine_rank int, seq long"))


def test_keys_do_not_depend_on_how_their_parts_are_written(spark):
    rows = [("a|b", "c", 1, "RSA", None), ("a", "b|c", 1, "RSA", None), (None, "a|b|c", 1, "RSA", None),
            (None, "a|b|c", 1, "RSA", None)]
    df = findings(spark, rows)
    merged = dedupe.dedupe_findings(df, n_feeds=4)
    assert sorted((r["project"] or "", r["file"]) for r in merged.collect()) == [("", "a|b|c"), ("a", "b|c"), ("a|b", "c")]
    ordinals = dedupe.dedupe_ordinals(df)
    assert ordinals.select("finding_key").distinct().count() == 3
    assert ordinals.where("is_duplicate").count() == 1
    # in a join an absent project meets an absent one only
    keyed = df.select(schema.finding_key().alias("k"), "seq")
    other = keyed.select(F.col("k").alias("k2"), F.col("seq").alias("seq2"))
    pairs = keyed.join(other, F.col("k") == F.col("k2")).where("seq < seq2").collect()
    assert [(r["seq"], r["seq2"]) for r in pairs] == [(2, 3)]
    assert [r[0] for r in df.orderBy("seq").select(schema.key_text(schema.finding_key())).collect()] == [
        "a|b|c|1|alg|RSA", "a|b|c|1|alg|RSA", "a|b|c|1|alg|RSA", "a|b|c|1|alg|RSA"]


def test_sizes_come_from_the_own_project(spark):
    files = spark.createDataFrame(
        [("p1", "x.py", "RSA_BITS = 2048"), ("p2", "x.py", "RSA_BITS = 4096"), (None, "x.py", "RSA_BITS = 1024")],
        "project string, file string, content string")
    constants = text_files.extract_constants(files)
    assert sorted((r["project"] or "", r["value"]) for r in constants.collect()) == [("", 1024), ("p1", 2048), ("p2", 4096)]
    df = findings(spark, [(p, "x.py", 1, "RSA", "gen(RSA_BITS)") for p in ("p1", "p2", None, "p3")])
    for operator in (enrich.enrich_key_size, enrich.enrich_key_size_by_identifier):
        got = {r["project"]: r["algorithm"]["key_size"] for r in operator(df, constants).collect()}
        assert got == {"p1": 2048, "p2": 4096, None: 1024, "p3": None}, operator.__name__


def test_markers_count_in_their_project(spark):
    lines = spark.createDataFrame(
        [("p1", "a.go", 1, "x // crypto:ignore"), ("p2", "a.go", 1, "x"), (None, "a.go", 2, "# crypto:ignore[RSA] : old")],
        "project string, file string, line_no int, text string")
    marks = suppress.extract_directives(lines)
    assert sorted((r["project"] or "", r["line"], r["reason"]) for r in marks.collect()) == [("", 2, "old"), ("p1", 1, None)]
    df = findings(spark, [(p, "a.go", n, "RSA", None) for p in ("p1", "p2", None) for n in (1, 2, 3)])
    left = sorted((r["project"] or "", r["line"]) for r in suppress.suppress_inline(df, marks).collect())
    assert left == [("", 1), ("p1", 3), ("p2", 1), ("p2", 2), ("p2", 3)]


def test_a_side_without_projects_is_refused(spark):
    df = findings(spark, [("p1", "x.py", 1, "RSA", "RSA_BITS")])
    constants = spark.createDataFrame([("x.py", "RSA_BITS", 2048)], "file string, name string, value long")
    marks = spark.createDataFrame([("x.py", 1, [])], "file string, line int, algorithms array<string>")
    for call in (lambda: enrich.enrich_key_size(df, constants), lambda: enrich.enrich_key_size_by_identifier(df, constants),
                 lambda: suppress.suppress_inline(df, marks),
                 lambda: enrich.enrich_key_size(df.drop("project"), schema.in_project(constants, "p1"))):
        with pytest.raises(ValueError, match="project"):
            call()
    # neither side: one scan
    assert suppress.suppress_inline(df.drop("project"), marks).count() == 0


def test_readers_name_projects_from_paths(spark, tmp_path):
    for project, size in (("alpha", 1024), ("beta", 4096)):
        (tmp_path / project).mkdir()
        (tmp_path / project / "k.py").write_text(f"RSA_BITS = {size}\n# crypto:ignore\n")
        (tmp_path / project / "app.ini").write_text(f"[tls]\nbits={size}\n")
    own = F.regexp_extract("file", "([^/]+)/[^/]+$", 1)
    files = text_files.load_source_files(spark, str(tmp_path), project=own)
    assert {r["project"]: r["value"] for r in text_files.extract_constants(files).collect()} == {"alpha": 1024, "beta": 4096}
    lines = text_files.load_source_lines(spark, str(tmp_path), project=own)
    assert sorted(r["project"] for r in suppress.extract_directives(lines).collect()) == ["alpha", "beta"]
    settings = config_text.read_config_kv(files.where("file like '%.ini'"), "ini")
    assert {(r["project"], r["key"], r["value"]) for r in settings.collect()} == {
        ("alpha", "tls.bits", "1024"), ("beta", "tls.bits", "4096")}
    one = text_files.load_source_files(spark, str(tmp_path), project="fleet")
    assert {r["project"] for r in one.collect()} == {"fleet"}
