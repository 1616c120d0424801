"""JSON documents as dotted keys and values, read from their tokens inside the row.

One rule cuts a document into strings, signs and other words.  A fold over the tokens
knows which containers are open, the path of each and what may come next; a value gets
the path that was known when it began.  A document can be nested as deep as it likes and
is never walked level by level.  Entries are collected per run of tokens, so a document
of very many keys does not copy what it has found at every key.

A document is one row, read in one task.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoreline import schema
from shoreline.functions.text import let
from shoreline.operators.known import once

# loops do not give back what they took, so long strings need no stack
TOKEN = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"|[{}\[\],:]|[^\s{}\[\],:"]++|"'
NUMBER = r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?$"
#: Tokens folded before their entries are put away.
RUN = 400

_ENTRIES = "array<struct<key:string,value:string>>"
_STATE = f"struct<kinds:string,paths:array<string>,places:array<int>,mode:int,key:string,good:boolean,out:{_ENTRIES}>"
# what may come next
_VALUE, _KEY_OR_END, _COLON, _COMMA_OR_END, _KEY, _VALUE_OR_END, _NOTHING = range(7)


def _string(token: Column) -> Column:
    """The text of a string token."""
    return F.when(token.contains("\\"), F.get_json_object(F.concat(F.lit("["), token, F.lit("]")), "$[0]")).otherwise(
        F.substr(token, F.lit(2), F.length(token) - 2))


def _step(max_depth: int | None):
    def step(s: Column, t: Column) -> Column:
        def decide(known: Column) -> Column:
            top, depth, is_text = known["top"], known["depth"], known["is_text"]
            mode, in_object = s["mode"], known["top"] == "{"
            wants_value = mode.isin(_VALUE, _VALUE_OR_END)
            opens = wants_value & t.isin("{", "[")
            scalar = wants_value & (is_text | t.isin("true", "false", "null") | t.rlike(NUMBER))
            named = mode.isin(_KEY_OR_END, _KEY) & is_text
            closes = ((t == "}") & in_object & mode.isin(_KEY_OR_END, _COMMA_OR_END)) | (
                (t == "]") & (top == "[") & mode.isin(_VALUE_OR_END, _COMMA_OR_END))
            comma = (mode == _COMMA_OR_END) & (t == ",")
            colon = (mode == _COLON) & (t == ":")
            path, place = F.element_at(s["paths"], depth), F.element_at(s["places"], depth)
            outer = F.when(known["depth"] - F.when(closes, 1).otherwise(0) > 0, _COMMA_OR_END).otherwise(_NOTHING)
            deep = F.lit(True) if max_depth is None else depth <= max_depth
            counts = scalar & (t != "null") & (s["key"] != "") & deep
            entry = F.struct(s["key"].alias("key"), F.when(is_text, _string(t)).otherwise(t).alias("value"))
            key = (
                F.when(opens & (t == "["), F.concat(s["key"], F.lit("[0]")))
                .when(named, F.when(path == "", _string(t)).otherwise(F.concat(path, F.lit("."), _string(t))))
                .when(comma & ~in_object, F.concat(path, F.lit("["), (place + 1).cast("string"), F.lit("]")))
                .otherwise(s["key"]))
            places = (
                F.when(opens, F.concat(s["places"], F.array(F.lit(0))))
                .when(closes, F.slice(s["places"], F.lit(1), depth - 1))
                .when(comma & ~in_object, F.concat(F.slice(s["places"], F.lit(1), depth - 1), F.array(place + 1)))
                .otherwise(s["places"]))
            return F.struct(
                F.when(opens, F.concat(s["kinds"], t)).when(closes, F.substr(s["kinds"], F.lit(1), depth - 1))
                .otherwise(s["kinds"]).alias("kinds"),
                F.when(opens, F.concat(s["paths"], F.array(s["key"]))).when(closes, F.slice(s["paths"], F.lit(1), depth - 1))
                .otherwise(s["paths"]).alias("paths"),
                places.alias("places"),
                F.when(opens, F.when(t == "{", _KEY_OR_END).otherwise(_VALUE_OR_END)).when(scalar | closes, outer)
                .when(named, _COLON).when(colon, _VALUE).when(comma, F.when(in_object, _KEY).otherwise(_VALUE))
                .otherwise(mode).alias("mode"),
                key.alias("key"),
                (s["good"] & (opens | scalar | named | closes | comma | colon)).alias("good"),
                F.when(counts, F.concat(s["out"], F.array(entry))).otherwise(s["out"]).alias("out"),
            ).cast(_STATE)

        return let(F.struct(
            F.right(s["kinds"], F.lit(1)).alias("top"), F.length(s["kinds"]).alias("depth"),
            (t.startswith('"') & (F.length(t) > 1)).alias("is_text")), decide)

    return step


def _entries(tokens: Column, max_depth: int | None) -> Column:
    """Entries of a document, NULL if it is not one JSON value."""
    strings = F.array().cast("array<string>")
    start = F.struct(
        F.lit("").alias("kinds"), strings.alias("paths"), F.array().cast("array<int>").alias("places"),
        F.lit(_VALUE).alias("mode"), F.lit("").alias("key"), F.lit(True).alias("good"),
        F.array().cast(_ENTRIES).alias("out")).cast(_STATE)
    whole = f"struct<state:{_STATE},found:array<{_ENTRIES}>>"
    first = F.struct(start.alias("state"), F.array().cast(f"array<{_ENTRIES}>").alias("found")).cast(whole)

    def run(s: Column, begin: Column) -> Column:
        after = F.when(s["state"]["good"], F.aggregate(
            F.slice(tokens, begin + 1, F.lit(RUN)),
            s["state"].withField("out", F.array().cast(_ENTRIES)).cast(_STATE), _step(max_depth))).otherwise(s["state"])
        return let(after, lambda a: F.struct(
            a.alias("state"), F.concat(s["found"], F.array(a["out"])).alias("found")).cast(whole))

    begins = F.sequence(F.lit(0), F.greatest(F.size(tokens) - 1, F.lit(0)), F.lit(RUN))
    return let(F.aggregate(begins, first, run), lambda s: F.when(
        s["state"]["good"] & (s["state"]["mode"] == _NOTHING), F.flatten(s["found"])))


def flatten_json_kv(df: DataFrame, max_depth: int | None = None) -> DataFrame:
    """JSON documents ``(file, content)`` to ``(file, key, value)``.

    Object keys are joined with dots, array entries are ``[i]``.  Numbers stay as written,
    nulls are dropped, and so is a value without a key (a document that is one scalar).  Of
    a repeated key each value counts.  A document that is not one JSON value gives nothing.
    ``max_depth`` leaves out values inside more containers.  A column ``project`` is kept.
    """
    keep = [*schema.scope_columns(df), "file"]
    tokens = F.regexp_extract_all(F.col("content"), F.lit(TOKEN), F.lit(0))
    cut = once(df.where(F.col("content").isNotNull()).select(*keep, "content"), tokens, "_tokens").drop("content")
    return cut.select(*keep, F.explode(_entries(F.col("_tokens"), max_depth)).alias("_e")).select(*keep, "_e.key", "_e.value")
