"""Ordered path patterns and search words as tables, joined with what they are looked for in.

A pattern is compiled by column expressions and known by an anchor, a piece of literal
text that every path it matches must have: a whole segment, or else three characters that
stand together.  Paths are taken apart into the same pieces, so a pattern meets only paths
that have its anchor, and is tested on those.  Any number of patterns will do; nothing
goes through the driver.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoreline import schema
from shoreline.functions.text import let

#: Characters of an anchor that is no whole segment.
GRAM = 3
#: Parts over which the paths are dealt for patterns without any anchor.
PARTS = 32
_GLOB = "\u0000"
_TOKEN = r"(?s)\\.|\[\^?(?:\\.|[^\]\\])+\]|[^\\\[]|[\\\[]"


def _quoted(char: Column) -> Column:
    return F.regexp_replace(char, "([^A-Za-z0-9_])", r"\\$1")


def _tokens(glob: Column) -> Column:
    return F.regexp_extract_all(glob, F.lit(_TOKEN), F.lit(0))


def _is_class(token: Column) -> Column:
    return token.startswith("[") & (F.length(token) > 1)


def _token_regex(t: Column) -> Column:
    body = F.regexp_replace(F.regexp_replace(t, r"(?s)^\[\^?|\]$", ""), r"([\[&^~])", r"\\$1")
    return (
        F.when(t == "*", "[^/]*").when(t == "?", "[^/]").when(t == "[^]", r"\^")
        .when(_is_class(t), F.concat(F.when(t.startswith("[^"), "[^").otherwise("["), body, F.lit("]")))
        .when(t.startswith("\\"), _quoted(F.substr(t, F.lit(2)))).otherwise(_quoted(t)))


def glob_regex(glob: Column) -> Column:
    """Regex of a shell glob whose signs stop at ``/``; NULL for a malformed one."""
    return let(_tokens(glob), lambda ts: F.when(
        ~F.exists(ts, lambda t: t.isin("\\", "[")), F.array_join(F.transform(ts, _token_regex), "")))


def path_regex(pattern: Column) -> Column:
    """Regex of an ignore pattern over a whole relative path; NULL for a malformed one.

    Without ``**`` a pattern matches a path or its last parts; ``**`` stands for any
    number of folders, and at the end for all that is below, the folder itself included.
    """
    def of(segments: Column) -> Column:
        # from the first of the last segments that are all "**" on, everything fits
        last = F.size(segments)
        rest = F.coalesce(F.get(F.filter(F.sequence(F.lit(1), last), lambda i: F.forall(
            F.slice(segments, i, last), lambda s: s == "**")), F.lit(0)), last + 1)

        def piece(s: Column, i: Column) -> Column:
            ends = F.when(i + 1 == last, "").when(i + 2 == rest, "(?:/.*)?").otherwise("/")
            return F.when(i + 1 >= rest, F.when((i + 1 == 1) | (last == 1), "(?:.*)?").otherwise("")).when(
                s == "**", "(?:[^/]*/)*").otherwise(F.concat(glob_regex(s), ends))

        pieces = F.transform(segments, piece)
        return F.when(~F.exists(pieces, lambda p: p.isNull()), F.array_join(pieces, ""))

    return F.when(pattern.contains("**"), let(F.split(pattern, "/"), of)).otherwise(
        F.concat(F.lit("(?:.*/)?"), glob_regex(pattern)))


def _anchor(pattern: Column) -> Column:
    """The longest literal segment, or three characters of the longest literal run, or nothing."""
    literal = F.array_join(F.transform(_tokens(pattern), lambda t: F.when(
        t.isin("*", "?") | _is_class(t), _GLOB).when(t.startswith("\\"), F.substr(t, F.lit(2))).otherwise(t)), "")

    def longest(pieces: Column) -> Column:
        best = F.array_max(F.transform(pieces, lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))
        return best["p"]

    def of(text: Column) -> Column:
        segment = longest(F.filter(F.split(text, "/"), lambda s: (s != "") & ~s.contains(_GLOB)))
        run = longest(F.split(text, f"[/{_GLOB}]"))
        return F.when(segment.isNotNull(), F.struct(F.lit("segment").alias("kind"), segment.alias("text"))).when(
            F.length(run) >= GRAM, F.struct(F.lit("gram").alias("kind"), F.substring(run, 1, GRAM).alias("text"))).otherwise(
            F.struct(F.lit("none").alias("kind"), F.lit("").alias("text")))

    return let(literal, of)


def grams(text: Column, n: int = GRAM) -> Column:
    """The distinct runs of ``n`` characters of a text."""
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, F.lit(n))))).otherwise(
        F.array().cast("array<string>"))


def ignored_paths(paths: DataFrame, patterns: DataFrame) -> DataFrame:
    """The distinct ``(project, path)`` of ``paths`` that the patterns leave out.

    ``patterns`` is ``(pattern, ordinal)``; the last one that matches decides, and ``!`` in
    front of one takes a path back in.  Both have a column ``project`` or neither has.
    """
    scope = schema.scope_of(paths, patterns, "ignore patterns")
    keep = F.col("pattern").startswith("!")
    bare = F.when(keep, F.substr("pattern", F.lit(2))).otherwise(F.col("pattern"))
    compiled = patterns.select(scope.alias("_in"), "ordinal", keep.alias("keep"), bare.alias("_p")).select(
        "_in", "ordinal", "keep", F.concat(F.lit("(?s)^(?:"), path_regex(F.col("_p")), F.lit(")$")).alias("regex"),
        _anchor(F.col("_p")).alias("anchor")).where("regex is not null")
    known = paths.select(scope.alias("project"), "path").distinct()
    cut = F.pmod(F.xxhash64("path"), F.lit(PARTS)).cast("string")
    pieces = {
        "segment": F.array_distinct(F.split("path", "/")), "gram": grams(F.col("path")), "none": F.array(cut)}
    every = F.explode(F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda i: i.cast("string")))
    hits = None
    for kind, of_path in pieces.items():
        mine = compiled.where(F.col("anchor.kind") == kind)
        mine = mine.withColumn("at", every) if kind == "none" else mine.withColumn("at", F.col("anchor.text"))
        met = known.withColumn("has", F.explode(of_path)).join(
            mine, (F.col("has") == F.col("at")) & F.col("project").eqNullSafe(F.col("_in")))
        found = met.where(F.expr("rlike(path, regex)")).select("project", "path", "ordinal", "keep")
        hits = found if hits is None else hits.unionByName(found)
    last = hits.groupBy("project", "path").agg(F.max_by("keep", "ordinal").alias("keep"))
    return last.where("not keep").select("project", "path")


def containing(texts: DataFrame, words: DataFrame, text: str = "text", word: str = "word") -> DataFrame:
    """Distinct pairs of a text and a row of ``words`` whose word stands anywhere in it."""
    known = texts.select(F.col(text).alias("_text")).where("_text is not null").distinct()
    found = None
    asked = words.where(F.col(word) != "")
    for n in range(1, GRAM + 1):
        mine = asked.where(F.length(word) >= n) if n == GRAM else asked.where(F.length(word) == n)
        mine = mine.withColumn("_at", F.substring(word, 1, n))
        met = known.withColumn("_has", F.explode(grams(F.col("_text"), n))).join(mine, F.col("_has") == F.col("_at"))
        pairs = met.where(F.col("_text").contains(F.col(word))).drop("_has", "_at")
        found = pairs if found is None else found.unionByName(pairs)
    return found.withColumnRenamed("_text", text)
