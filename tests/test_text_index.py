"""JSON by tokens, and the vocabulary as an inverted index."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from shoreline.operators import config_match
from shoreline.rules import config
from shoreline.sources import json_text
from shoreline.sources.text_files import flatten_json_kv


def flat(value, key=""):
    if isinstance(value, dict):
        for k, v in value.items():
            yield from flat(v, k if key == "" else f"{key}.{k}")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from flat(v, f"{key}[{i}]")
    elif value is not None and key:
        yield key, value if isinstance(value, str) else {True: "true", False: "false"}.get(value, str(value)) if isinstance(
            value, bool) else str(value)


def rows(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "file int, content string").withColumn("file", F.col("file").cast("string"))
    out = {}
    for r in flatten_json_kv(df).collect():
        out.setdefault(int(r["file"]), []).append((r["key"], r["value"]))
    return out


@pytest.mark.parametrize("run", [3, 400])
def test_json_like_a_reader(spark, monkeypatch, run):
    monkeypatch.setattr(json_text, "RUN", run)
    rng = random.Random(run)

    def value(depth):
        kind = rng.randrange(8 if depth else 5)
        if kind < 5:
            return rng.choice(["", "x", 'q"u\\ote', "é\n\t/", "{[,:]}", 0, -12, 1.5, 1e30, True, False, None, "\U0001f600"])
        if kind < 7:
            return {rng.choice(["a", "b.c", "", "k k", "é", '"'] ) + str(i): value(depth - 1) for i in range(rng.randrange(5))}
        return [value(depth - 1) for _ in range(rng.randrange(5))]

    texts, want = [], {}
    for i in range(60):
        v = value(4)
        texts.append(json.dumps(v, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5))
        leaves = sorted(flat(v))
        if leaves:
            want[i] = leaves
    assert {i: sorted(r) for i, r in rows(spark, *texts).items()} == want


def test_what_is_no_json_gives_nothing(spark):
    bad = ["", " ", "{", '{"a":1', '{"a":1}}', "[1,]", '{"a":1,}', '{"a" 1}', "{a:1}", '{"a":01}', '{"a":tru}', '["x" "y"]', "[1]2",
           '{"a":"x}', "]", '{"a":1]', '[}', ",", '{"a",1}', "nan", "5", '"s"', "null", "{}", "[]"]
    assert rows(spark, *bad) == {}
    assert flatten_json_kv(spark.createDataFrame([("f", None)], "file string, content string")).count() == 0
    assert rows(spark, '[{"n": 12345678901234567890.10}]') == {0: [("[0].n", "12345678901234567890.10")]}


def test_deep_and_wide_documents(spark):
    depth, width = 5_000, 30_000
    deep = '{"a":[' * (depth // 2) + "7" + "]}" * (depth // 2)
    wide = "{" + ",".join(f'"k{i}": "v{i}"' for i in range(width)) + "}"
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.cteRecursionRowLimit", "spark.sql.cteRecursionLevelLimit")}
    got = rows(spark, deep, wide)
    assert got[0] == [(".".join(["a[0]"] * (depth // 2)), "7")]
    assert got[1] == [(f"k{i}", f"v{i}") for i in range(width)]
    assert before == {k: spark.conf.get(k, None) for k in before}
    # only asked for, a depth leaves something out
    df = spark.createDataFrame([("f", '{"a": 1, "b": {"c": 2, "d": {"e": 3}}}')], "file string, content string")
    assert {r["key"] for r in flatten_json_kv(df, max_depth=2).collect()} == {"a", "b.c"}


def _holds(text, literal):
    return re.search(r"(?<![A-Za-z0-9])" + re.escape(literal) + r"(?![A-Za-z0-9])", text) is not None


def by_rules(key, value):
    """Every rule for itself, in order."""
    dotted = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", ".", key).lower()
    parts = [p for p in re.split(r"[.\[\]_-]+", dotted) if p]
    glued = {"".join(parts[i:i + n]) for n in (2, 3, 4) for i in range(len(parts) - n + 1)}
    for n, pattern, hints, *_ in config.vocabulary():
        split = any(c in pattern for c in "-_.")
        fits = _holds(dotted, pattern) or (_holds(dotted, pattern + "s") if split else bool(glued & {pattern, pattern + "s"}))
        if fits and (not hints or any(_holds(value.lower(), h) for h in hints)):
            return n
    return None


def test_vocabulary_like_rule_by_rule(spark):
    rng = random.Random(7)
    patterns = sorted({r[1] for r in config.vocabulary()})
    hints = sorted({h for r in config.vocabulary() for h in r[2] or []})
    data = []
    for i in range(1500):
        key = rng.choice(["", "app.", "x_", "tlsServer", "a[0]."]) + rng.choice(patterns) + rng.choice(["", "s", "X", ".y", "-z", "[1]", "2"])
        if rng.random() < 0.3:
            key = re.sub(r"[-_.](\w)", lambda m: m[1].upper(), key)
        value = rng.choice(["", "x ", "(", "é", "a-"]) + rng.choice(hints) + rng.choice(["", ",", "-b", " and " + rng.choice(hints), "9"])
        data.append((f"f{i}", i, key, value.upper() if rng.random() < 0.3 else value))
    df = spark.createDataFrame(data, "file string, line int, key string, value string")
    got = {r["line"]: r["rule_no"] for r in config_match.config_vocab_match(df).collect()}
    assert got == {i: n for _, i, k, v in data if (n := by_rules(k, v)) is not None}
    plan = config_match.config_vocab_match(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") < 12
