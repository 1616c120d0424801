"""TLS and certificate logs of a network sensor, tab-separated or NDJSON.

``scan_*`` read files; the ``parse_*`` they use take any DataFrame of lines
``(src_file, src_block, row_no, line)``, batch or streaming for NDJSON.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shoreline import schema
from shoreline.functions import tls as X
from shoreline.functions.text import blank_to_null, let, strip
from shoreline.operators.known import once
from shoreline.operators.metrics import unwatched
from shoreline.sources.lines import PLACE, first_sign, format_of, read_lines

SSL_FIELDS = [
    "uid", "id.resp_h", "id.resp_p", "version", "cipher", "curve", "server_name",
    "established", "pqc_key_share",
]
X509_FIELDS = [
    "id", "certificate.sig_alg", "certificate.key_alg", "certificate.key_type",
    "certificate.key_length", "certificate.curve", "san.dns",
]


def _block_table(lines: DataFrame, names: list) -> DataFrame:
    """Per file and block: the file's format, the layout it starts with and those it sets.

    One pass over the lines reduces every block to its directives (a few lines of a file,
    however large it is) and its first character; the blocks of a file, one row each,
    are then read in order, and what a directive sets holds in the blocks below it until
    another sets it anew.  A layout is the separator, the texts for absent values and the
    position of each named column.
    """
    separator = _argument("#separator")
    directive = F.struct(
        F.col("row_no").alias("at"),
        F.when(separator.isin("\\x09", "\\t"), F.lit("\t"))
        .when(F.length(separator) == 1, separator).alias("separator"),
        _argument("#unset_field").alias("unset"),
        _argument("#empty_field").alias("empty"),
        F.when(
            F.col("line").startswith("#fields") & F.col("line").contains("\t"),
            F.split(F.col("line"), "\t"),
        ).alias("fields"),
    )
    set_ = F.coalesce(
        directive["separator"], directive["unset"], directive["empty"],
        F.when(directive["fields"].isNotNull(), "f"))
    sign = first_sign()
    blocks = lines.groupBy("src_file", "src_block").agg(
        F.array_sort(F.collect_list(F.when(F.col("line").startswith("#") & set_.isNotNull(), directive))).alias("_d"),
        F.min_by(sign, F.when(sign.isNotNull(), F.col("row_no"))).alias("_sign"),
    )

    def latest(field, upto):
        values = F.transform(F.slice("_d", F.lit(1), upto), lambda d: d[field])
        return F.try_element_at(F.filter(values, lambda v: v.isNotNull()), F.lit(-1))

    def position(fields, name):
        # "#fields" itself is the first entry, so names are one place late; of two
        # columns with the same name the last one counts
        back = F.array_position(F.reverse(fields), F.lit(name))
        return F.when(back > 0, (F.size(fields) - back).cast("int"))

    parts = ["separator", "unset", "empty", "fields"]
    absent = {"separator": F.lit("\t"), "unset": F.lit("-"), "empty": F.lit("(empty)"), "fields": F.lit(None)}
    above = W.partitionBy("src_file").orderBy("src_block").rowsBetween(W.unboundedPreceding, -1)
    carried = blocks.withColumns({f"_{p}": latest(p, F.size("_d")) for p in parts}).withColumns({
        **{f"_{p}_in": F.last(f"_{p}", ignorenulls=True).over(above) for p in parts},
        "_first": F.first("_sign", ignorenulls=True).over(
            W.partitionBy("src_file").orderBy("src_block").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)),
    })

    def layout(at, value):
        got = {p: F.coalesce(value(p), F.col(f"_{p}_in"), absent[p].cast(carried.schema[f"_{p}_in"].dataType)) for p in parts}
        return F.struct(
            at.cast("bigint").alias("at"),
            F.concat(F.lit("\\Q"), got["separator"], F.lit("\\E")).alias("separator"),
            got["unset"].alias("unset"), got["empty"].alias("empty"),
            F.when(got["fields"].isNotNull(), F.array(*[position(got["fields"], n) for n in names])).alias("at_column"),
        )

    start = layout(F.lit(None), lambda p: F.lit(None).cast(carried.schema[f"_{p}_in"].dataType))
    own = F.transform("_d", lambda d, i: layout(d["at"], lambda p: latest(p, i + 1)))
    layouts = F.filter(F.concat(F.array(start), own), lambda x: x["at_column"].isNotNull())
    return carried.select(
        F.col("src_file").alias("_file"), F.col("src_block").alias("_block"),
        format_of(F.col("_first")).alias("fmt"), layouts.alias("layouts"))


def _argument(directive):
    """Argument of a directive line such as ``#unset_field -``."""
    words = F.split(strip(F.col("line")), r"\s+")
    return F.when(F.col("line").startswith(directive) & (F.size(words) == 2), words[1])


def _placed(lines: DataFrame, names: list) -> DataFrame:
    """Lines with their file's format and their block's layouts.

    The join is on file and block, so a log of any size stays as spread as it was read.
    """
    table = _block_table(lines, names)
    same = (lines["src_file"] == table["_file"]) & lines["src_block"].eqNullSafe(table["_block"])
    return lines.join(table, same).drop("_file", "_block")


def _kept(lines: DataFrame) -> list[str]:
    """Columns that go from lines to records as they are."""
    return ["src_file", *PLACE, *[c for c in (*schema.scope_columns(lines), "ts_received") if c in lines.columns]]


def _tsv_cells(names: list) -> tuple[Column, Column]:
    """Whether a placed line is a row under a layout, and its named columns as a struct."""
    data = (F.col("line") != "") & ~F.col("line").startswith("#")
    layout = F.try_element_at(F.filter(
        "layouts", lambda x: x["at"].isNull() | (x["at"] < F.col("row_no"))), F.lit(-1))

    def row(x):
        cells = F.split(F.col("line"), x["separator"])

        def cell(values, i):
            value = F.get(values, F.get(x["at_column"], F.lit(i)) - 1)
            return F.when((value != x["unset"]) & (value != x["empty"]), blank_to_null(value))

        return let(cells, lambda values: F.struct(*[cell(values, i).alias(n) for i, n in enumerate(names)]))

    return data & layout.isNotNull(), let(layout, row)


def _json_cells(names: list) -> Column:
    """The named columns of an NDJSON line as a struct, NULL for a malformed one.

    Keys are flat and dotted, and every value is read as text, since ports and
    flags come as numbers or booleans from some sensors and as strings from others.
    """
    ddl = ", ".join(f"`{c}` string" for c in names) + ", `_bad` string"
    text = strip(F.col("line"))
    read = F.from_json(text, ddl, {"columnNameOfCorruptRecord": "_bad"})
    return F.when(text.startswith("{"), let(read, lambda r: F.when(
        r["_bad"].isNull(), F.struct(*[blank_to_null(r[c]).alias(c) for c in names]))))


def _records(lines: DataFrame, cells: Column, names: list, *more: str, watch=unwatched) -> DataFrame:
    told = (strip(F.col("line")) != "") & ~F.col("line").startswith("#")
    read = watch(once(lines, cells, "_r"), "lines", malformed=told & F.col("_r").isNull()).where(F.col("_r").isNotNull())
    return read.select(*_kept(lines), *more, *[F.col(f"_r.`{c}`").alias(c) for c in names])


def _tsv_columns(lines: DataFrame, names: list) -> DataFrame:
    """Rows of a tab-separated log with the named columns, absent as NULL.

    Each row uses the directives above it, so a header that changes inside a
    file is honoured.
    """
    fits, cells = _tsv_cells(names)
    return _records(_placed(lines, names).where(fits), cells, names)


def _json_columns(lines: DataFrame, names: list, watch=unwatched) -> DataFrame:
    """Rows of an NDJSON log; malformed lines are dropped, and counted by a watch."""
    return _records(lines, _json_cells(names), names, watch=watch)


def _mixed_columns(lines: DataFrame, names: list, watch=unwatched) -> DataFrame:
    """Rows of logs of either format, each file read as its first character asks, in one pass.

    ``_kind`` is the format a row was read as and ``_fmt`` that of its file; the lines of
    an ``unknown`` file are read as NDJSON where they look so, else as tab-separated text.
    """
    fits, cells = _tsv_cells(names)
    is_json = (F.col("fmt") == "json") | ((F.col("fmt") == "unknown") & strip(F.col("line")).startswith("{"))
    placed = _placed(lines, names).withColumn("_kind", F.when(is_json, "json").otherwise("tsv")).withColumn("_fmt", F.col("fmt"))
    either = F.when(F.col("_kind") == "json", _json_cells(names)).otherwise(F.when(fits, cells))
    return _records(placed, either, names, "_kind", "_fmt", watch=watch)


def _established(c: Column) -> Column:
    return ~F.coalesce(c.isin("F", "false"), F.lit(False))


def _marks(df: DataFrame) -> list[str]:
    return [c for c in ("_kind", "_fmt") if c in df.columns]


def _ssl_records(df: DataFrame) -> DataFrame:
    return df.where(_established(F.col("established"))).select(
        *_kept(df), *_marks(df), "uid",
        F.col("`id.resp_h`").alias("resp_host"),
        # JSON numbers may be written 443.0
        F.regexp_replace(F.col("`id.resp_p`"), r"\.0+$", "").alias("resp_port"),
        X.normalize_tls_version(F.col("version")).alias("version"),
        "cipher",
        X.curve_to_group(F.col("curve")).alias("curve"),
        "server_name", "pqc_key_share",
    )


def _x509_records(df: DataFrame, san: Column, length: Column) -> DataFrame:
    return df.select(
        *_kept(df), *_marks(df), "id",
        F.col("`certificate.sig_alg`").alias("sig_alg"),
        F.col("`certificate.key_alg`").alias("key_alg"),
        F.col("`certificate.key_type`").alias("key_type"),
        F.coalesce(length.try_cast("int"), F.lit(0)).alias("key_length"),
        F.nullif(F.col("`certificate.curve`"), F.lit("-")).alias("curve"),
        san.alias("san_dns"),
    ).where(F.col("sig_alg").isNotNull() | F.col("key_alg").isNotNull())


def parse_ssl_tsv(lines: DataFrame) -> DataFrame:
    return _ssl_records(_tsv_columns(lines, SSL_FIELDS))


def parse_ssl_json(lines: DataFrame, watch=unwatched) -> DataFrame:
    return _ssl_records(_json_columns(lines, SSL_FIELDS, watch))


def parse_x509_tsv(lines: DataFrame) -> DataFrame:
    return _x509_records(
        _tsv_columns(lines, X509_FIELDS), F.col("`san.dns`"), F.col("`certificate.key_length`")
    )


def _json_x509(df: DataFrame) -> tuple[Column, Column]:
    raw = F.col("`san.dns`")
    first = F.when(
        raw.startswith("["), F.from_json(raw, "array<string>")[0]
    ).otherwise(raw)
    # JSON numbers may be written 2048.0
    return first, F.regexp_replace(F.col("`certificate.key_length`"), r"\.\d+$", "")


def parse_x509_json(lines: DataFrame) -> DataFrame:
    df = _json_columns(lines, X509_FIELDS)
    return _x509_records(df, *_json_x509(df))


def scan_zeek_ssl_tsv(spark: SparkSession, path) -> DataFrame:
    return parse_ssl_tsv(read_lines(spark, path))


def scan_zeek_ssl_json(spark: SparkSession, path) -> DataFrame:
    return parse_ssl_json(read_lines(spark, path))


def scan_zeek_x509_tsv(spark: SparkSession, path) -> DataFrame:
    return parse_x509_tsv(read_lines(spark, path))


def scan_zeek_x509_json(spark: SparkSession, path) -> DataFrame:
    return parse_x509_json(read_lines(spark, path))


def _of_their_format(records: DataFrame) -> DataFrame:
    """Records of mixed logs without what a file of unknown format gave as tab-separated text,
    where it gave NDJSON records too."""
    both = records.where((F.col("_fmt") == "unknown") & (F.col("_kind") == "json")).select(
        F.col("src_file").alias("_file")).distinct()
    doubtful = (F.col("src_file") == F.col("_file")) & (F.col("_fmt") == "unknown") & (F.col("_kind") == "tsv")
    return records.join(both, doubtful, "left_anti").drop("_kind", "_fmt")


def parse_ssl(lines: DataFrame, watch=unwatched) -> DataFrame:
    """Records of logs of either format; a file that starts with neither ``#`` nor ``{`` is
    tried as NDJSON, and as tab-separated text only if that gave no records."""
    return _of_their_format(_ssl_records(_mixed_columns(lines, SSL_FIELDS, watch)))


def parse_x509(lines: DataFrame, watch=unwatched) -> DataFrame:
    df = _mixed_columns(lines, X509_FIELDS, watch)
    is_json, (san, length) = F.col("_kind") == "json", _json_x509(df)
    return _of_their_format(_x509_records(
        df, F.when(is_json, san).otherwise(F.col("`san.dns`")),
        F.when(is_json, length).otherwise(F.col("`certificate.key_length`"))))


def scan_zeek_ssl(spark: SparkSession, path) -> DataFrame:
    return parse_ssl(read_lines(spark, path))


def scan_zeek_x509(spark: SparkSession, path) -> DataFrame:
    return parse_x509(read_lines(spark, path))
