"""Patterns as data against the projection, path by path."""

import random
import re

from pyspark.sql import functions as F

from shoreline import schema
from shoreline.functions.text import glob_to_regex
from shoreline.operators import impact, suppress
from shoreline.operators.path_patterns import containing, glob_regex, path_regex

GLOBS = ["*.go", "a?c", "[a-c]x", "[^a]x", "[", "a\\*", "a.c", "", "x[&^~]y", "\\", "[]", "é*", "a[b", "[\\]]q"]
PATTERNS = ["src/**", "!src/core/**", "*.go", "!kex.ts", "lib/*/auth.go", "**/m1?/*.py", "!conf/m[0-4]*/*", "**", "a/**/b", "**/x",
            "a/**/**", "/abs", "docs", "!docs/keep.md", "[", "x\\*y", "*", "m??", "**/[a-c]*", "a**b", "dir/", "src/**/test/**"]


def test_globs_in_columns(spark):
    df = spark.createDataFrame([(g,) for g in GLOBS], "g string")
    got = {r["g"]: r["r"] for r in df.select("g", glob_regex(F.col("g")).alias("r")).collect()}
    texts = ["a.go", "d/a.go", "abc", "a*", "bx", "dx", "ax", "a.c", "", "x&y", "x^y", "é1", "]q", "[", "a[b"]
    for g in GLOBS:
        want = glob_to_regex(g)
        assert (got[g] is None) == (want is None), g
        for t in texts if want is not None else []:
            assert bool(re.fullmatch(got[g], t, re.S)) == bool(re.fullmatch(want, t, re.S)), (g, t)


def _paths(n, seed):
    rng = random.Random(seed)
    parts = ["src", "core", "a", "b", "x", "docs", "keep.md", "m1a", "m12", "z.py", "lib", "auth.go", "kex.ts", "conf", "m3", "x*y", "test"]
    return sorted({"/".join(rng.choices(parts, k=rng.randint(1, 5))) for _ in range(n)} | {"/abs", "dir", "dir/q"})


def test_path_regexes_in_columns(spark):
    paths = _paths(400, 1)
    df = spark.createDataFrame([(p.lstrip("!"),) for p in PATTERNS], "p string")
    for r in df.select("p", path_regex(F.col("p")).alias("r")).collect():
        want = suppress._path_regex(r["p"])
        assert (r["r"] is None) == (want is None), r["p"]
        for path in paths if want is not None else []:
            assert bool(re.fullmatch(r["r"], path, re.S)) == bool(re.fullmatch(want, path, re.S)), (r["p"], path)


def test_patterns_as_a_table_like_a_list(spark):
    paths = _paths(600, 2)
    df = spark.createDataFrame([("/w/" + p,) for p in paths], "file string")
    for seed in range(3):
        listed = random.Random(seed).sample(PATTERNS, 14)
        table = spark.createDataFrame([(0, i, p) for i, p in enumerate(listed)], "src_block long, row_no long, pattern string")
        want = sorted(r[0] for r in suppress.suppress_by_path(df, listed, "/w").collect())
        assert sorted(r[0] for r in suppress.suppress_by_path(df, table, "/w").collect()) == want
    assert suppress.suppress_by_path(df, table.where("false"), "/w").count() == len(paths)


def test_patterns_of_a_project(spark):
    df = spark.createDataFrame([("p1", "src/a"), ("p2", "src/a"), (None, "src/a")], "project string, file string")
    table = spark.createDataFrame([("p1", 0, 0, "src/**"), (None, 0, 0, "!src/**")],
                                  "project string, src_block long, row_no long, pattern string")
    left = sorted(r["project"] or "" for r in suppress.suppress_by_path(df, table).collect())
    assert left == ["", "p2"]


def test_many_patterns(spark):
    """Twenty thousand patterns, past the former limit; each path meets few of them."""
    n = 20_000
    patterns = spark.range(n).select(F.lit(0).cast("long").alias("src_block"), F.col("id").alias("row_no"),
                                     F.concat(F.lit("d"), F.col("id"), F.lit("/**")).alias("pattern"))
    df = spark.range(3 * n).select(F.concat(F.lit("d"), F.col("id"), F.lit("/f.go")).alias("file"))
    out = suppress.suppress_by_path(df, patterns)
    assert out.count() == 2 * n


def test_words_in_texts(spark):
    texts = ["tls.Dial now", "ssh", "x", "", None, "jwt.Sign(tls.Dial)", "ab"]
    words = [("TLS", "tls.Dial"), ("TLS", "Dial"), ("JWT", "jwt.Sign"), ("X", "x"), ("AB", "ab"), ("none", ""), ("long", "tls.Dialer")]
    table = spark.createDataFrame(words, "protocol string, call string")
    df = spark.createDataFrame([(t,) for t in texts], "message string")
    got = {(r["message"], r["call"]) for r in containing(df, table, "message", "call").collect()}
    assert got == {(t, w) for t in texts for _, w in words if t and w and w in t}
    steps = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0])], "hop int, message string")
    found = impact.protocol_boundaries(steps, table).collect()
    assert sorted((r["hop"], r["protocol"]) for r in found) == [
        (0, "TLS"), (0, "TLS"), (2, "X"), (5, "JWT"), (5, "TLS"), (6, "AB")]
    assert schema.scope_columns(df) == []
