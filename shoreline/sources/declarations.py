"""Integer constants of source files, read from their tokens.

A file is cut into tokens once, line by line, by one rule for all languages: words,
numbers, directives and single signs.  Declarations are then read around an equals
sign: what stands before it must be a name, a type the language allows and the word
that makes it a constant, what follows must be a number.  Looking a token up is one
step, so a file costs its tokens and a little more for each equals sign in it.

Go is read by a state machine instead, one fold over the file: only declarations
outside functions count, a group lists many, names and values come in lists, and a
value counts if it is a single number.  Its tokens keep texts and comments whole.

A file is one row, read in one task: its size is that of a source file.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoreline import schema
from shoreline.functions.text import extension
from shoreline.operators.known import once
from shoreline.rules import constants as rules

_WORD, _NUMBER = r"[A-Za-z_]\w*", r"[0-9][\w']*"
TOKEN = rf"{_WORD}|{_NUMBER}|#\w*|\S"
# texts and comments are one token; what is inside a loop never gives back what it took
GO_TOKEN = (
    r"//[^\n]*+|/\*[^*]*+(?:\*(?!/)[^*]*+)*+\*/"
    r'|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|`[^`]*+`|' r"'(?:\\.|[^'\\\n])[^'\n]*+'"
    rf"|{_WORD}|[0-9][\w.]*+|\n|\S"
)
_FOUND = "array<struct<rank:int,pos:int,scope:string,name:string,raw:string>>"
_UPPER_NAME = "^[A-Z][A-Z0-9_]+$"


def _integer(raw: Column) -> Column:
    """Value of an integer literal (decimal, hex, octal or binary), NULL if malformed."""
    digits = F.regexp_replace(raw, "[_']", "")
    prefix = F.lower(F.substring(digits, 1, 2))
    after2 = F.substr(digits, F.lit(3))
    octal = F.regexp_replace(digits, "^0[oO]?", "")
    value = (
        F.when(prefix == "0x", F.conv(after2, 16, 10))
        .when(prefix == "0b", F.conv(after2, 2, 10))
        .when(digits.rlike("^0[oO]?[0-7]+$"), F.conv(octal, 8, 10))
        .when(digits.rlike("^(?:0|[1-9][0-9]*)$"), digits)
    )
    return value.try_cast("bigint")


def _leading(token: Column, binary: bool = False) -> Column:
    """The number a token starts with; binary ones only where the language has them."""
    kinds = "0[xX][0-9a-fA-F_']+|" + ("0[bB][01_']+|" if binary else "") + "[0-9][0-9_']*"
    return F.regexp_extract(token, f"^(?:{kinds})", 0)


def _is_number(token: Column) -> Column:
    return F.coalesce(token.rlike("^[0-9]"), F.lit(False))


def _is_name(token: Column) -> Column:
    return F.coalesce(token.rlike("^[A-Za-z_]"), F.lit(False))


def _entry(rank: int, pos: Column, scope: Column, name: Column, raw: Column) -> Column:
    return F.struct(F.lit(rank).alias("rank"), pos.cast("int").alias("pos"), scope.alias("scope"),
                    name.alias("name"), raw.alias("raw"))


def _none() -> Column:
    return F.array().cast(_FOUND)


def _at_equals(tokens: Column, test, entry) -> Column:
    """An entry for each place i with an equals sign for which ``test(i)`` holds."""
    places = F.filter(F.sequence(F.lit(0), F.size(tokens)), lambda i: F.coalesce(
        (F.get(tokens, i) == "=") & test(i), F.lit(False)))
    return F.transform(places, entry)


def _module(file: Column) -> Column:
    """The file's name without folders and extension."""
    return F.regexp_replace(F.substring_index(file, "/", -1), r"\.[^.]*$", "")


def _java(tokens: Column, file: Column) -> Column:
    def at(i, back):
        return F.get(tokens, i - back)

    # the first class of the file, or the file's name
    classes = F.filter(F.sequence(F.lit(0), F.size(tokens)), lambda i: F.coalesce(
        (F.get(tokens, i) == "class") & _is_name(F.get(tokens, i + 1)), F.lit(False)))
    scope = F.coalesce(F.get(tokens, F.get(classes, F.lit(0)) + 1), _module(file))
    return _at_equals(
        tokens,
        lambda i: (at(i, 2) == "int") & (at(i, 3) == "final") & (at(i, 4) == "static")
        & _is_name(at(i, 1)) & _is_number(at(i, -1)),
        lambda i: _entry(0, i, scope, at(i, 1), _leading(at(i, -1))))


def _typescript(tokens: Column, file: Column) -> Column:
    def at(i, back):
        return F.get(tokens, i - back)

    def typed(i):
        return (at(i, 1) == "number") & (at(i, 2) == ":")

    def name(i):
        return F.when(typed(i), at(i, 3)).otherwise(at(i, 1))

    return _at_equals(
        tokens,
        lambda i: name(i).rlike(_UPPER_NAME) & _is_number(at(i, -1))
        & (F.when(typed(i), at(i, 4)).otherwise(at(i, 2)) == "const"),
        lambda i: _entry(0, i, _module(file), name(i), _leading(at(i, -1))))


def _python(lines: Column, file: Column) -> Column:
    """Lines that are not indented: a name in capitals, an equals sign, a number."""
    fits = F.filter(
        F.transform(lines, lambda line, i: F.struct(i.alias("i"), line["tokens"].alias("t"), line["indented"].alias("in"))),
        lambda x: F.coalesce(
            ~x["in"] & F.get(x["t"], F.lit(0)).rlike(_UPPER_NAME) & (F.get(x["t"], F.lit(1)) == "=")
            & _is_number(F.get(x["t"], F.lit(2))), F.lit(False)))
    return F.transform(fits, lambda x: _entry(
        0, x["i"], _module(file), F.get(x["t"], F.lit(0)), _leading(F.get(x["t"], F.lit(2)))))


def _c_number(token: Column) -> Column:
    """Whether a token is a whole number with at most three letters behind it."""
    rest = F.substr(token, F.length(_leading(token, True)) + 1)
    return _is_number(token) & rest.rlike("^[uUlL]{0,3}$")


def _cpp(lines: Column, tokens: Column) -> Column:
    nowhere = F.lit("")

    # macros: one line, the name and a number; a name that any macro continues on the next line is none
    defines = F.filter(
        F.transform(lines, lambda line, i: F.struct(i.alias("i"), line["tokens"].alias("t"))),
        lambda x: F.get(x["t"], F.lit(0)) == "#define")
    continued = F.transform(
        F.filter(defines, lambda x: F.element_at(x["t"], -1) == "\\"), lambda x: F.get(x["t"], F.lit(1)))
    macros = F.transform(
        F.filter(defines, lambda x: (F.size(x["t"]) == 3) & _is_name(F.get(x["t"], F.lit(1)))
                 & _c_number(F.get(x["t"], F.lit(2))) & ~F.array_contains(continued, F.get(x["t"], F.lit(1)))),
        lambda x: _entry(0, x["i"], nowhere, F.get(x["t"], F.lit(1)), _leading(F.get(x["t"], F.lit(2)), True)))

    def at(i, back):
        return F.get(tokens, i - back)

    types = rules.C_TYPES

    def is_type(token):
        return token.isin(types) | token.rlike("^u?int[0-9]*_t$")

    def declared(i, word):
        # const, then at most one "unsigned" and one type, then the name
        plain = at(i, 2) == word
        one = is_type(at(i, 2)) & (at(i, 3) == word)
        two = is_type(at(i, 2)) & (at(i, 3) == "unsigned") & (at(i, 4) == word)
        long = (at(i, 2) == "long") & (at(i, 3) == "long")
        longs = long & ((at(i, 4) == word) | ((at(i, 4) == "unsigned") & (at(i, 5) == word)))
        return F.coalesce(plain, F.lit(False)) | F.coalesce(one, F.lit(False)) | F.coalesce(
            two, F.lit(False)) | F.coalesce(longs, F.lit(False))

    def declarations(rank, word):
        return _at_equals(
            tokens,
            lambda i: _is_name(at(i, 1)) & (at(i, -2) == ";") & _c_number(at(i, -1)) & declared(i, word),
            lambda i: _entry(rank, i, nowhere, at(i, 1), _leading(at(i, -1), True)))

    parts = [macros, declarations(1, "const"), declarations(2, "constexpr")]

    # the bodies of enumerations, from the brace to the next closing one
    def body(j):
        head = F.slice(tokens, j + 2, 7)
        opened = F.array_position(head, "{")
        plain = F.forall(F.slice(head, F.lit(1), F.greatest(opened.cast("int") - 1, F.lit(0))), lambda t: _is_name(t) | (t == ":"))
        rest = F.slice(tokens, j + 2 + opened.cast("int"), F.size(tokens))
        closed = F.array_position(rest, "}").cast("int")
        return F.struct(
            ((opened > 0) & plain & (closed > 0)).alias("ok"), (j + opened.cast("int") + 1).alias("low"),
            (j + opened.cast("int") + closed).alias("high"))

    starts = F.filter(F.sequence(F.lit(0), F.size(tokens)), lambda j: F.coalesce(F.get(tokens, j) == "enum", F.lit(False)))
    bodies = F.filter(F.transform(starts, body), lambda b: b["ok"])
    parts.append(F.flatten(F.transform(bodies, lambda b: F.transform(
        F.filter(F.sequence(b["low"], F.greatest(b["low"], b["high"])), lambda i: F.coalesce(
            (i < b["high"]) & (F.get(tokens, i) == "=") & _is_name(at(i, 1)) & _is_number(at(i, -1)), F.lit(False))),
        lambda i: _entry(3, i, nowhere, at(i, 1), _leading(at(i, -1), True))))))
    return F.concat(*parts)


_GO_STATE = (
    "struct<depth:int,mode:int,base:int,names:array<string>,right:boolean,nth:int,width:int,value:string,"
    "prev:string,package:string,n:int,out:array<struct<rank:int,pos:int,scope:string,name:string,raw:string>>>"
)


def _go(text: Column) -> Column:
    """One fold over the tokens; the state says what the next token can mean.

    ``mode`` is 0 outside declarations, 1 behind ``const``, 2 in a declaration.  A
    declaration ends at a line end, a semicolon or the group's parenthesis, on its own
    depth ``base``; a line end after a sign that wants more does not end it.
    """
    tokens = F.filter(F.regexp_extract_all(text, F.lit(GO_TOKEN), F.lit(0)),
                      lambda t: ~t.startswith("//") & ~(t.startswith("/*") & ~t.contains("\n")))
    start = F.struct(
        F.lit(0).alias("depth"), F.lit(0).alias("mode"), F.lit(0).alias("base"),
        F.array().cast("array<string>").alias("names"), F.lit(False).alias("right"), F.lit(0).alias("nth"),
        F.lit(0).alias("width"), F.lit("").alias("value"), F.lit("\n").alias("prev"), F.lit("").alias("package"),
        F.lit(0).alias("n"), _none().alias("out")).cast(_GO_STATE)

    def step(s, t):
        breaks = (t == "\n") | t.startswith("/*")
        opens, closes = t.isin("(", "[", "{"), t.isin(")", "]", "}")
        here = s["depth"] == s["base"]
        # a line ends a statement behind a name, a value or a closing sign
        complete = s["prev"].rlike("^[\\w\"'`]") | s["prev"].isin(")", "]", "}")
        group_closes = (s["mode"] == 2) & (s["base"] == 1) & here & (t == ")")
        ends = (s["mode"] == 2) & here & ((breaks & complete) | (t == ";") | group_closes)
        comma = (s["mode"] == 2) & here & (t == ",")
        value_done = (ends | comma) & s["right"]
        counts = value_done & (s["width"] == 1) & s["value"].rlike("^[0-9][0-9a-zA-Z_]*$") & (s["nth"] < F.size(s["names"]))
        grouped = (s["mode"] == 1) & (t == "(")
        begins = (s["mode"] == 1) & ~grouped & ~breaks
        keyword = (s["depth"] == 0) & (s["mode"] == 0) & (t == "const") & s["prev"].isin("\n", ";", "}", ")")
        reading = ((s["mode"] == 2) | begins) & ~ends & ~breaks
        # the left side lists names until a type or the equals sign; a name after a comma is one more
        first_name = reading & ~s["right"] & _is_name(t) & (
            begins | (here & ((F.size(s["names"]) == 0) | (s["prev"] == ","))))
        equals = reading & here & ~s["right"] & (t == "=")
        in_value = reading & s["right"] & ~(here & comma)
        names = F.when(ends, F.array().cast("array<string>")).when(
            first_name, F.concat(s["names"], F.array(t))).otherwise(s["names"])
        depth = s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        mode = (
            F.when(keyword, 1).when(grouped, 2).when(begins, 2).when(group_closes, 0)
            .when(ends & (s["base"] == 0), 0).otherwise(s["mode"]))
        base = F.when(grouped, 1).when(group_closes, 0).otherwise(s["base"])
        out = F.when(counts, F.concat(s["out"], F.array(_entry(
            0, s["n"], s["package"], F.get(s["names"], s["nth"]), s["value"])))).otherwise(s["out"])
        return F.struct(
            depth.alias("depth"), mode.alias("mode"), base.alias("base"), names.alias("names"),
            F.when(ends, F.lit(False)).when(equals, F.lit(True)).otherwise(s["right"]).alias("right"),
            F.when(ends | equals, 0).when(comma & s["right"], s["nth"] + 1).otherwise(s["nth"]).alias("nth"),
            F.when(ends | equals | comma, 0).when(in_value, s["width"] + 1).otherwise(s["width"]).alias("width"),
            F.when(in_value, t).otherwise(s["value"]).alias("value"),
            F.when(~breaks, t).when(complete, F.lit("\n")).otherwise(s["prev"]).alias("prev"),
            F.when((s["package"] == "") & (s["prev"] == "package"), t).otherwise(s["package"]).alias("package"),
            (s["n"] + 1).alias("n"), out.alias("out")).cast(_GO_STATE)

    # a last line end ends the last declaration
    return F.aggregate(F.concat(tokens, F.array(F.lit("\n"))), start, step)["out"]


def extract_constants(df: DataFrame) -> DataFrame:
    """Integer constants of source files ``(file, content)``: ``(file, scope, name, value)``.

    The extension picks the language.  ``scope`` is the class (Java), the module (Python,
    TypeScript), the package (Go) or empty (C).  Of a name defined twice the last one
    counts; in C macros come first, then constants, of which the first one counts.  A
    column ``project`` is kept: the files of two projects have constants of their own.
    Null contents have none.
    """
    ext = extension(F.col("file"))
    known = [e for extensions in rules.EXTENSIONS.values() for e in extensions]
    keep = schema.scope_columns(df)
    files = df.where(ext.isin(known) & F.col("content").isNotNull()).select(*keep, "file", "content", ext.alias("_e"))
    is_go = F.col("_e").isin(rules.EXTENSIONS["go"])
    lines = F.transform(
        F.split(F.when(is_go, F.lit("")).otherwise(F.col("content")), r"\r\n|\r|\n"),
        lambda line: F.struct((line.startswith(" ") | line.startswith("\t")).alias("indented"),
                              F.regexp_extract_all(line, F.lit(TOKEN), F.lit(0)).alias("tokens")))
    cut = once(files, lines, "_lines")
    cut = once(cut, F.flatten(F.transform("_lines", lambda x: x["tokens"])), "_tokens")
    lines, tokens, file = F.col("_lines"), F.col("_tokens"), F.col("file")
    readers = {
        "java": _java(tokens, file), "python": _python(lines, file), "typescript": _typescript(tokens, file),
        "cpp": _cpp(lines, tokens), "go": _go(F.regexp_replace("content", r"\r\n?", "\n")),
    }
    found = F.when(F.lit(False), _none())
    for language, reader in readers.items():
        found = found.when(F.col("_e").isin(rules.EXTENSIONS[language]), reader.cast(_FOUND))
    each = cut.select(*keep, "file", "_e", F.explode(found).alias("_c"))
    is_cpp = F.col("_e").isin(rules.EXTENSIONS["cpp"])
    values = each.select(
        *keep, "file", "_c.scope", "_c.name", _integer(F.col("_c.raw")).alias("value"),
        F.col("_c.rank").alias("_rank"), F.col("_c.pos").alias("_pos"), is_cpp.alias("_cpp"),
    ).where(F.col("value").isNotNull())
    order = F.struct(
        F.when(F.col("_cpp"), -F.col("_rank")).otherwise(F.col("_rank")),
        F.when(F.col("_cpp") & (F.col("_rank") > 0), -F.col("_pos")).otherwise(F.col("_pos")),
    )
    return values.groupBy(*keep, "file", "scope", "name").agg(F.max_by("value", order).alias("value"))
