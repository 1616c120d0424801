"""Leave out findings that somebody marked as accepted.

The inline marker is ``<tag>:ignore``, e.g. ``# crypto:ignore[RSA] -- reason``.
"""

import functools
import operator
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoreline import schema
from shoreline.functions.text import (
    blank_to_null,
    covers_version,
    glob_to_regex,
    relative_to,
    strip,
)
from shoreline.operators.known import once
from shoreline.operators.path_patterns import ignored_paths

TAG = "crypto"
COMMENT_OPENERS = ["//", "#", "/*", "<!--"]


def strip_string_literals(text: Column) -> Column:
    """Text without quoted strings; an unclosed one runs to the end of the line."""
    return F.regexp_replace(
        text, r""""(?:\\.|[^"\\])*(?:"|\\?$)|'(?:\\.|[^'\\])*(?:'|\\?$)|`[^`]*(?:`|$)""", ""
    )


def _without_end(text: Column) -> Column:
    """Text without the end of a comment, and without blanks around what is left."""
    out = text
    for end in ("-->", "*/"):
        out = F.when(text.endswith(end), F.substr(text, F.lit(1), F.length(text) - len(end))).otherwise(out)
    return strip(out)


def _listed(m: Column) -> Column:
    """Where the list in brackets ends, 0 without one."""
    return F.struct(m["opened"].alias("opened"), m["rest"].alias("rest"), F.when(m["rest"].startswith("["), F.locate("]", m["rest"])).otherwise(0).alias("close"))


def _parted(m: Column) -> Column:
    """The names of the list, and what comes behind it."""
    names = F.split(F.when(m["close"] > 0, F.substr(m["rest"], F.lit(2), m["close"] - 2)).otherwise(""), ",")
    body = strip(F.when(m["close"] > 0, F.substr(m["rest"], m["close"] + 1)).otherwise(m["rest"]))
    return F.struct(m["opened"].alias("opened"), F.filter(F.transform(names, strip), lambda n: n != "").alias("algorithms"), body.alias("body"))


def _introduced(m: Column) -> Column:
    """What a colon or dashes introduce; of nothing but dashes the last one is the reason."""
    body, dashes = m["body"], m["body"].startswith("-")
    said = strip(F.when(dashes, F.regexp_replace(body, "^-+", "")).when(
        body.startswith(":") | body.startswith("—"), F.substr(body, F.lit(2))))
    said = F.when((F.length(body) > 1) & body.rlike("^-+$"), F.lit("-")).otherwise(said)
    return F.struct(m["opened"].alias("opened"), m["algorithms"].alias("algorithms"), body.alias("body"), said.alias("said"))


def _judged(m: Column) -> Column:
    """The reason without the end of the comment, and whether the marker can be read."""
    open_ = _without_end(m["said"])
    reason = F.when(open_ != "", open_).otherwise(m["said"])
    fits = F.when(m["said"].isNotNull(), m["said"] != "").otherwise(_without_end(m["body"]) == "")
    return F.struct((m["opened"] & fits).alias("fits"), m["algorithms"].alias("algorithms"), blank_to_null(reason).alias("reason"))


def extract_directives(lines: DataFrame, tag: str = TAG) -> DataFrame:
    """Markers in lines ``(file, line_no, text)``: ``(file, line, algorithms, reason)``.

    A marker opens a comment: ``<tag>:ignore``, then a list in brackets, then a reason
    after a colon or dashes, both optional, then the end of the line.  An empty
    algorithm list covers every algorithm.  Markers inside string literals do not
    count; of several on a line the first readable one does.  A column ``project`` is
    kept.  The steps follow each other over an array of a line's markers, so each is
    worked out once.
    """
    marker = f"{tag}:ignore"
    # the substring test spares most lines the rest
    hits = lines.where(F.col("text").contains(marker))
    bare = once(hits, strip_string_literals(strip(F.col("text"))), "_t").where(F.col("_t").contains(marker))
    cut = once(bare, F.split("_t", re.escape(marker)), "_pieces")
    pieces = F.col("_pieces")

    def at(i):
        before = strip(F.get(pieces, i - 1))
        opened = functools.reduce(operator.or_, [before.endswith(c) for c in COMMENT_OPENERS])
        rest = F.array_join(F.slice(pieces, i + 1, F.size(pieces)), marker)
        return F.struct(opened.alias("opened"), rest.alias("rest"))

    found = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), at)
    for step in (_listed, _parted, _introduced, _judged):
        found = F.transform(found, step)
    first = F.slice(F.filter(found, lambda m: m["fits"]), 1, 1)
    read = cut.select(*schema.scope_columns(lines), "file", F.col("line_no").alias("line"), F.explode(first).alias("_m"))
    return read.select(*schema.scope_columns(lines), "file", "line", "_m.algorithms", "_m.reason")


def suppress_inline(df: DataFrame, directives: DataFrame) -> DataFrame:
    """Drop findings with a matching marker on their line or the line above.

    ``directives`` is ``(file, line, algorithms)``, with ``project`` where findings have
    it; a marker counts in its own project.  The anti join is on project, file and line,
    so both sides are partitioned by place.
    """
    project = schema.scope_of(df, directives, "directives")
    marks = directives.select(
        project.alias("_project"), F.col("file").alias("_f"), F.explode(F.array("line", F.col("line") + 1)).alias("_l"),
        F.transform("algorithms", lambda a: F.lower(a)).alias("_algs"),
    )
    name = F.lower(F.coalesce(F.col("algorithm.name"), F.lit("")))
    covered = (
        (F.size("_algs") == 0)
        | F.array_contains("_algs", F.col("_name"))
        | (F.array_contains("_algs", "tls") & covers_version(F.lit("tls"), F.col("_name")))
        | (F.array_contains("_algs", "ssl") & covers_version(F.lit("ssl"), F.col("_name")))
    )
    return df.withColumn("_name", name).join(
        marks,
        (F.col("file") == F.col("_f")) & (F.col("line") == F.col("_l")) & covered
        & project.eqNullSafe(F.col("_project")),
        "left_anti",
    ).drop("_name")


def _path_regex(pattern: str) -> str | None:
    """Regex for one ignore pattern over a relative path."""
    if "**" in pattern:
        out = ""
        segments = pattern.split("/")
        for i, segment in enumerate(segments):
            last = i == len(segments) - 1
            if segment == "**":
                out += "(?:.*)?" if last else "(?:[^/]*/)*"
            else:
                piece = glob_to_regex(segment)
                if piece is None:
                    return None
                out += piece
                if last:
                    continue
                # "a/**" also matches what is right at "a"
                rest_is_any = all(s == "**" for s in segments[i + 1:])
                out += "(?:/.*)?" if rest_is_any else "/"
                if rest_is_any:
                    return out
        return out
    piece = glob_to_regex(pattern)
    # the path itself or any of its trailing parts
    return None if piece is None else "(?:.*/)?" + piece


def ignored_by_patterns(path: Column, patterns: list) -> Column:
    """The last matching pattern decides; ``!`` in front of one takes a path back in.

    Neighbouring patterns of the same kind share one regex, and the check stops
    at the first hit from the end.
    """
    groups = []
    for p in patterns:
        keep = p.startswith("!")
        regex = _path_regex(p[1:] if keep else p)
        if regex is None:
            continue
        if groups and groups[-1][0] == keep:
            groups[-1][1].append(regex)
        else:
            groups.append((keep, [regex]))
    out = F.when(F.lit(False), F.lit(False))
    for keep, regexes in reversed(groups):
        out = out.when(
            path.rlike("(?s)^(?:" + "|".join(f"(?:{r})" for r in regexes) + ")$"), F.lit(not keep)
        )
    return out.otherwise(F.lit(False))


def suppress_by_path(df: DataFrame, patterns, base: str | None = None) -> DataFrame:
    """Drop findings in ignored paths; the last pattern that matches a path decides.

    ``patterns`` is a list, which becomes part of the projection, or the rows of
    :func:`load_ignore_patterns` in any number, which are joined by their literal pieces;
    these may have a column ``project`` and then count in their own project.
    """
    path = relative_to(F.col("file"), base)
    if not isinstance(patterns, DataFrame):
        return df.where(~F.coalesce(ignored_by_patterns(path, list(patterns)), F.lit(False)))
    scope = schema.scope_columns(patterns)
    ordered = patterns.select(*scope, "pattern", F.struct("src_block", "row_no").alias("ordinal"))
    paths = df.select(*[F.col(c) for c in scope], path.alias("path")).where("path is not null")
    gone = ignored_paths(paths, ordered).select(F.col("project").alias("_in"), F.col("path").alias("_gone"))
    same = path == F.col("_gone")
    return df.join(gone, same & F.col(scope[0]).eqNullSafe(F.col("_in")) if scope else same, "left_anti")
