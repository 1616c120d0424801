"""The merge against a row-by-row restatement, and on hot keys."""

import random

from pyspark.sql import functions as F

from shoreline import schema
from shoreline.operators import dedupe
from shoreline.operators.normalize import normalize_algorithm
from shoreline.rules.quantum import CONFIDENCE_ORDER

ENGINES = ["a", "b", "c", "a"]
TYPES = ("file string, line int, name string, primitive string, key_size int, reachable string, "
         "confidence string, engine_rank int, source_engine string, seq long")


def frame(spark, rows):
    df = spark.createDataFrame(rows, TYPES)
    return schema.conform(df.withColumn("algorithm", schema.algorithm(
        F.col("name"), F.col("primitive"), F.col("key_size"))))


def by_hand(rows):
    """Walk the rows in feed order, as a reader of the rules would."""
    seen = {}
    for f, line, name, prim, size, reach, conf, rank, engine, seq in sorted(rows, key=lambda r: (r[7], r[9])):
        key = (f, line, name)
        if key not in seen:
            seen[key] = dict(prim=prim, size=size, reach=reach, conf=conf, engine=engine, others=[], seq=seq)
            continue
        w = seen[key]
        if engine != w["engine"] and engine not in w["others"]:
            w["others"].append(engine)
        w["prim"] = w["prim"] or prim
        if size and (not w["size"] or size < w["size"]):
            w["size"] = size
        if reach == "yes" or (w["reach"] == "no" and reach == "unknown"):
            w["reach"] = reach if w["reach"] != "yes" else "yes"
        if w["others"] and w["conf"] in CONFIDENCE_ORDER:
            w["conf"] = CONFIDENCE_ORDER[min(4, CONFIDENCE_ORDER.index(w["conf"]) + 1)]
    return {(w["seq"], k[2], w["prim"], w["size"], w["reach"], w["conf"], tuple(w["others"]))
            for k, w in seen.items()}


def merged(spark, rows):
    out = dedupe.dedupe_findings(frame(spark, rows), n_feeds=4)
    return {(r["seq"], r["algorithm"]["name"], r["algorithm"]["primitive"], r["algorithm"]["key_size"],
             r["reachable"], r["confidence"], tuple(r["corroborated_by"] or ())) for r in out.collect()}


def random_rows(n, places, seed):
    rng = random.Random(seed)
    out = []
    for seq in range(n):
        rank = rng.randrange(4)
        out.append((f"f{rng.randrange(places)}", rng.randrange(2), rng.choice(["AES", "RSA"]),
                    rng.choice([None, "symmetric", "kem"]), rng.choice([None, 128, 256]),
                    rng.choice(["yes", "no", "unknown"]), rng.choice(CONFIDENCE_ORDER + ["odd"]), rank,
                    ENGINES[rank], seq))
    return out


def test_random_rows(spark):
    for seed in range(3):
        rows = random_rows(120, 6, seed)
        assert merged(spark, rows) == by_hand(rows)


def test_order_of_input_does_not_matter(spark):
    rows = random_rows(60, 4, 9)
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    assert merged(spark, rows) == merged(spark, shuffled)


def test_one_feed_merges_nothing(spark):
    rows = random_rows(20, 1, 3)
    assert dedupe.dedupe_findings(frame(spark, rows), n_feeds=1).count() == 20


def test_hot_key_is_combined_before_the_shuffle(spark):
    """A key with all rows leaves each task as one row per feed."""
    hot = spark.range(50000).select(
        F.lit("f").alias("file"), F.lit(1).alias("line"), (F.col("id") % 3).cast("int").alias("engine_rank"),
        F.concat(F.lit("e"), (F.col("id") % 3).cast("string")).alias("source_engine"), F.col("id").alias("seq"),
        F.lit("low").alias("confidence"), schema.algorithm(F.lit("AES")).alias("algorithm"))
    df = dedupe.dedupe_findings(schema.conform(hot), n_feeds=3)
    row = df.collect()
    assert len(row) == 1 and row[0]["seq"] == 0 and row[0]["confidence"] == "high"
    assert row[0]["corroborated_by"] == ["e1", "e2"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "Window" not in plan


def test_generic_name_needs_exactly_one_version(spark):
    rows = [("f", 1, "TLS", None, None, "no", "low", 0, "a", 0), ("f", 1, "TLSv1.2", None, None, "no", "low", 1, "b", 1),
            ("g", 1, "TLS", None, None, "no", "low", 0, "a", 2), ("g", 1, "TLSv1.2", None, None, "no", "low", 1, "b", 3),
            ("g", 1, "TLSv1.3", None, None, "no", "low", 2, "c", 4)]
    names = sorted(n for _, n, *_ in merged(spark, rows))
    assert names == ["TLS", "TLSv1.2", "TLSv1.2", "TLSv1.3"]


def test_projects_are_kept_apart(spark):
    from pyspark.sql import functions as F

    from shoreline import schema
    from shoreline.operators import dedupe, suppress

    one = spark.createDataFrame(
        [("a.py", 3, "RSA", "ast", 0, 0), ("a.py", 3, "RSA", "pattern", 1, 0)],
        "file string, line int, name string, source_engine string, engine_rank int, seq long",
    ).withColumn("algorithm", schema.algorithm(F.col("name")))
    both = one.withColumn("project", F.lit("p")).unionByName(one.withColumn("project", F.lit("q")))
    merged = dedupe.dedupe_findings(schema.conform(both))
    assert sorted(r["project"] for r in merged.collect()) == ["p", "q"]
    marks = spark.createDataFrame([("p", "a.py", 3, [])], "project string, file string, line int, algorithms array<string>")
    left = suppress.suppress_inline(schema.conform(both), marks)
    assert {r["project"] for r in left.collect()} == {"q"}


def test_names_are_not_worked_out_again_in_filters(spark):
    df = schema.conform(spark.createDataFrame([("f", "aes_128")], "file string, name string").withColumn(
        "algorithm", schema.algorithm(F.col("name"))))
    plan = dedupe.dedupe_findings(normalize_algorithm(df))._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter " in line]
    assert filters and not any("regexp_extract" in line for line in filters)
