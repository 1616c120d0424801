"""Small Column builders shared by the other modules."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lookup(c: Column, table: dict) -> Column:
    """Value of ``c`` in a fixed table, NULL when it is not there.

    The map is one literal, so this stays a projection: no join and no shuffle.
    """
    pairs = ", ".join(sql_literal(x) for item in table.items() for x in item)
    return F.try_element_at(F.expr(f"map({pairs})"), c)


def lookup_list(c: Column, table: dict) -> Column:
    """The list of ``c`` in a fixed table of lists, NULL when it is not there."""
    pairs = ", ".join(
        f"{sql_literal(k)}, array({', '.join(map(sql_literal, v))})" for k, v in table.items())
    return F.try_element_at(F.expr(f"map({pairs})"), c)


def sql_literal(value) -> str:
    """A Python text, number, flag or None as SQL.

    Long literals are handed over as one text: building them from single
    columns costs a call into the JVM per entry.
    """
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(value).upper()


def literal_array(values) -> Column:
    return F.expr("array(" + ", ".join(sql_literal(v) for v in values) + ")")


def lookup_spelling(c: Column, groups: dict) -> Column:
    """Key of the group of spellings that holds ``c``, NULL when none does."""
    return lookup(c, {s: name for name, spellings in groups.items() for s in spellings})


def alternatives(words) -> str:
    """One regex for a list of literal words, longest first."""
    return "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))


def longest_prefix(upper: Column, words) -> Column:
    """The longest word (given upper case) that ``upper`` starts with, else NULL.

    Regex alternatives are tried in order, so listing them longest first makes
    one pass over the string enough.
    """
    return blank_to_null(F.regexp_extract(upper, "^(" + alternatives(words) + ")", 1))


def starts_with_any(c: Column, prefixes) -> Column:
    return c.rlike("^(?:" + alternatives(prefixes) + ")")


def contains_any(c: Column, words) -> Column:
    return c.rlike(alternatives(words))


def ends_with_any(c: Column, suffixes) -> Column:
    return c.rlike("(?:" + alternatives(suffixes) + ")$")


def has_word(c: Column, words) -> Column:
    """``c`` holds one of the words, not glued to an ASCII letter or digit."""
    return c.rlike(r"(?<![A-Za-z0-9])(?:" + alternatives(words) + r")(?![A-Za-z0-9])")


def glob_to_regex(pattern: str) -> str | None:
    """Regex of a shell glob, where ``*`` and ``?`` stop at ``/``.

    A malformed glob (open class, trailing backslash) gives None: it matches
    nothing.
    """
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "*":
            out.append("[^/]*")
        elif ch == "?":
            out.append("[^/]")
        elif ch == "\\":
            i += 1
            if i == len(pattern):
                return None
            out.append(re.escape(pattern[i]))
        elif ch == "[":
            close = re.match(r"\[(\^?)((?:\\.|[^\]\\])+)\]", pattern[i:])
            if close is None:
                return None
            body = re.sub(r"([\[&^~])", r"\\\1", close.group(2))
            out.append("[" + close.group(1) + body + "]")
            i += close.end() - 1
        else:
            out.append(re.escape(ch))
        i += 1
    return "".join(out)


def matches_regexes(c: Column, regexes) -> Column:
    """``c`` matches one of the regexes as a whole; an empty list matches nothing."""
    regexes = [r for r in regexes if r is not None]
    if not regexes:
        return F.lit(False)
    return c.rlike("(?s)^(?:" + "|".join("(?:" + r + ")" for r in regexes) + ")$")


def covers_version(generic: Column, name: Column) -> Column:
    """Lower-case ``tls``/``ssl`` covers names such as ``tlsv1.2`` and ``ssl 3``."""
    return generic.isin("tls", "ssl") & F.substring(name, 1, 3).eqNullSafe(generic) & (
        F.substring(name, 4, 2).rlike("^(?:[0-9]|[v ][0-9])")
    )


def base_name_of_path(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def extension(path: Column) -> Column:
    """Extension with its dot, of the last path segment; empty when there is none."""
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def relative_to(path: Column, base: str | None) -> Column:
    """``path`` without a leading ``base`` folder."""
    if not base or base == ".":
        return F.regexp_replace(path, r"^\./", "")
    return F.regexp_replace(path, "^" + re.escape(base.rstrip("/")) + "/", "")


_SPACE = " \t\n\r\x0b\x0c"


def strip(c: Column) -> Column:
    """Without white space at both ends (Spark's ``trim`` alone removes blanks only)."""
    return F.trim(c, F.lit(_SPACE))


def strip_left(c: Column, chars: str = _SPACE) -> Column:
    return F.ltrim(c, F.lit(chars))


def strip_right(c: Column, chars: str = _SPACE) -> Column:
    return F.rtrim(c, F.lit(chars))
