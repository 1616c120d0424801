"""Match configuration settings against the crypto vocabulary."""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoreline import schema
from shoreline.functions.text import alternatives, has_word, let, lookup, lookup_list, strip
from shoreline.operators.known import once
from shoreline.rules import config as rules


def segmented(key: Column) -> Column:
    """Key with dots at camel-case borders, lower case: ``sslProtocol`` gives ``ssl.protocol``."""
    dotted = F.regexp_replace(key, "(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", ".")
    return F.lower(dotted)


#: Segments that a name without separators may be glued of.
GLUED = 4


def _words_and_signs(text: Column) -> Column:
    """Words of ASCII letters and digits, and what stands between them, in order."""
    return F.regexp_extract_all(text, F.lit("[a-z0-9]+|[^a-z0-9]+"), F.lit(0))


def runs_of_words(text: Column, most: int) -> Column:
    """Every run of up to ``most`` words of a lower-case text, with the signs between them.

    A literal that begins and ends with a letter or digit stands in the text as whole
    words if, and only if, it is one of these runs.
    """
    def of(parts: Column) -> Column:
        return F.flatten(F.transform(parts, lambda p, i: F.when(p.rlike("^[a-z0-9]"), F.transform(
            F.sequence(F.lit(0), F.least(F.lit(most - 1), F.floor((F.size(parts) - 1 - i) / 2).cast("int"))),
            lambda n: F.array_join(F.slice(parts, i + 1, 2 * n + 1), ""))).otherwise(
            F.array().cast("array<string>"))))

    return let(_words_and_signs(text), of)


def glued_segments(segments: Column) -> Column:
    """The segments in a row: every run of two to ``GLUED``, written without separators."""
    parts = F.filter(F.split(segments, r"[.\[\]_-]+"), lambda s: s != "")
    return let(parts, lambda p: F.flatten(F.transform(p, lambda _, i: F.transform(
        F.filter(F.sequence(F.lit(2), F.lit(GLUED)), lambda n: i + n <= F.size(p)),
        lambda n: F.array_join(F.slice(p, i + 1, n), "")))))


def _words(literal: str) -> int:
    return len(re.findall("[a-z0-9]+", literal))


def _plain(literal: str) -> bool:
    return bool(re.fullmatch("[a-z0-9](?:.*[a-z0-9])?", literal, re.S))


def _postings(rows: list) -> tuple[dict, dict, int, int]:
    """What a run of the key, a glued run of the key and a run of the value mean.

    Returns the patterns by run and by glued run, and the most words of a pattern and of a
    hint.  A pattern with separators also matches its plural, one without also matches
    glued segments and their plural.
    """
    by_run, by_glue = {}, {}
    for pattern in dict.fromkeys(r[1] for r in rows):
        by_run.setdefault(pattern, []).append(pattern)
        target = by_run if any(ch in pattern for ch in "-_.") else by_glue
        target.setdefault(pattern + "s", []).append(pattern)
        if target is by_glue:
            by_glue.setdefault(pattern, []).append(pattern)
    hints = [h for r in rows for h in r[2] or []]
    return by_run, by_glue, max(map(_words, by_run)), max(map(_words, hints), default=1)


def parse_bits(value: Column) -> Column:
    """Number of bits in ``256``, ``256 bits`` or ``256b``; NULL outside 1 to 65536."""
    text = F.lower(strip(value))
    digits = strip(F.regexp_replace(text, "(?:bits|bit|b)$", ""))
    n = F.when(digits.rlike("^[+-]?[0-9]{1,9}$"), digits.cast("int"))
    return F.when((n > 0) & (n <= rules.KEY_SIZE_MAX), n)


def first_match(df: DataFrame, key: list, order: str) -> DataFrame:
    """The row of each key whose ``order`` is lowest, combined on the map side."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_m")).select(
        *key, *[F.col("_m")[c].alias(c) for c in rest]
    )


def config_vocab_match(kv: DataFrame, vocabulary: list | None = None) -> DataFrame:
    """Findings for the settings ``(file, key, value, line)`` that name crypto.

    The first rule in order wins.  The vocabulary is an inverted index: a key's runs of
    words are looked up and give its patterns, and a pattern with a run of the value's words
    gives the first rule that has both.  A setting costs its words, however many rules there
    are; no rule is tested for itself, and nothing is joined.  ``project`` is kept.
    """
    rows = rules.vocabulary() if vocabulary is None else vocabulary
    by_run, by_glue, key_words, value_words = _postings(rows)
    first: dict[str, int] = {}
    odd = []
    for n, pattern, hints, *_ in rows:
        for hint in hints or [""]:
            first.setdefault(f"{pattern}\n{hint}", n)
            if hint and not _plain(hint):
                odd.append(hint)
    # a cheap test first: most settings hold no key pattern at all
    letters = sorted({re.sub("[-_.]", "", p) for p in by_run})
    squeezed = F.regexp_replace(F.lower(F.col("key")), r"[.\[\]_-]", "")
    staged = once(kv.where(squeezed.rlike(alternatives(letters))), segmented(F.col("key")), "_segments")

    def patterns_of(runs, index):
        return F.flatten(F.array_compact(F.transform(runs, lambda r: lookup_list(r, index))))

    found = F.array_distinct(F.concat(
        patterns_of(runs_of_words(F.col("_segments"), key_words), by_run),
        patterns_of(glued_segments(F.col("_segments")), by_glue)))
    held = once(staged, found, "_patterns").where(F.size("_patterns") > 0)
    value = F.lower("value")
    # hints that end in a sign are no runs of words
    others = F.array_compact(F.array(*[F.when(has_word(value, [h]), h) for h in sorted(set(odd))])) if odd else F.array().cast(
        "array<string>")
    said = F.concat(F.array(F.lit("")), F.array_distinct(F.concat(runs_of_words(value, value_words), others)))
    named = once(held, said, "_said")
    rule_no = F.array_min(F.flatten(F.transform("_patterns", lambda p: F.transform(
        "_said", lambda h: lookup(F.concat(p, F.lit("\n"), h), first)))))
    matched = once(named, rule_no, "rule_no").where(F.col("rule_no").isNotNull())

    def of_rule(i, cast):
        pairs = [F.lit(x) for r in rows if r[i] is not None for x in (r[0], r[i])]
        return F.try_element_at(F.create_map(*pairs), F.col("rule_no")).cast(cast)

    sized = [r[0] for r in rows if r[1] in rules.KEY_SIZE_PATTERNS]
    size = F.coalesce(
        of_rule(5, "int"), F.when(F.col("rule_no").isin(sized), parse_bits(F.col("value")))
    )
    return matched.select(
        *schema.scope_columns(kv), "file", "line", "key", "value", "rule_no",
        schema.algorithm(of_rule(3, "string"), of_rule(4, "string"), size, of_rule(6, "string"))
        .alias("algorithm"),
        F.lit("medium").alias("confidence"), F.lit("config-scanner").alias("source_engine"),
        F.lit("unknown").alias("reachable"),
        F.concat("key", F.lit("="), "value").alias("raw_identifier"),
    )
