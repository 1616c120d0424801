"""Queries over source text, configuration and binary artifacts."""

from pyspark.sql import functions as F

from queries import oracle as O
from queries import views as V
from queries.registry import query
from queries.views import div, pick, string
from shoreline.functions import scanners as SF
from shoreline.operators import binary_match as B
from shoreline.operators import config_match as CM
from shoreline.operators import enrich, suppress
from shoreline.rules import binaries, config, constants, formats
from shoreline.sources import config_text, text_files
from shoreline.tables import literal_table

# --- source lines ---------------------------------------------------------------
@query("load_source_lines", """SELECT 'd' || doc_id AS file, CAST(i AS INT) AS line_no, length(t) AS chars
    FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS t
          FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))""")
def load_source_lines(spark, sf):
    docs = V.table(spark, sf, "documents").select(
        F.concat(F.lit("d"), "doc_id").alias("file"), F.col("text").alias("content"))
    return text_files.split_lines(docs).select(
        "file", "line_no", F.length("text").cast("bigint").alias("chars"))


def lines(spark, sf):
    """Lines of code and of the documents' whole texts."""
    return text_files.split_lines(V.view(spark, sf, V.FILES).drop("doc_id"))


_LINES = V.lines_of(V.FILES)
DIRECTIVES = [("", ""), ("MD5,SHA-1", "legacy"), None, ("TLS", "old peers"), ("AES", ">"), None, None, None]
_DIR = f"""(SELECT project, file, line_no AS line, algs, reason FROM (SELECT *,
    {pick('n', [None if d is None else d[0] for d in DIRECTIVES])} AS algs,
    NULLIF({pick('n', ['' if d is None else d[1] for d in DIRECTIVES])}, '') AS reason
    FROM (SELECT *, list_position({O.array(V.CODE)}, text) - 1 AS n FROM {_LINES}))
    WHERE algs IS NOT NULL)"""


@query("extract_directives", f"SELECT * FROM {_DIR}")
def extract_directives(spark, sf):
    out = suppress.extract_directives(lines(spark, sf))
    return out.select("project", "file", "line", F.array_join("algorithms", ",").alias("algs"), "reason")


def code_findings(spark, sf):
    """Findings in the files of two projects, in their first lines."""
    found = V.findings(spark, sf)
    return found.withColumns({
        "project": F.concat(F.lit("p"), (F.col("seq") % 2).cast("string")),
        "file": F.concat(F.lit("d"), (F.col("place") % 600).cast("string")),
        "line": (1 + F.col("seq") % 3).cast("int"),
    })


@query("suppress_inline", f"""SELECT seq FROM (SELECT seq, 'p' || seq % 2 AS project, 'd' || place % 600 AS file,
        1 + seq % 3 AS line, lower(COALESCE(alg_name, '')) AS n FROM {V.duck(V.FINDINGS)}) AS f
    WHERE NOT EXISTS (SELECT 1 FROM {_DIR} AS d WHERE d.project = f.project AND d.file = f.file
        AND f.line IN (d.line, d.line + 1)
        AND (d.algs = '' OR list_contains(string_split(lower(d.algs), ','), f.n)
             OR (d.algs = 'TLS' AND regexp_full_match(f.n, 'tls([0-9]|v[0-9]| [0-9]).*'))))""")
def suppress_inline(spark, sf):
    marks = suppress.extract_directives(lines(spark, sf))
    return suppress.suppress_inline(code_findings(spark, sf), marks).select("seq")


IGNORES = ["src/**", "!src/core/**", "*.go", "!kex.ts", "lib/*/auth.go", "**/m1?/*.py", "!conf/m[0-4]*/*"]
_IGNORED = """CASE WHEN regexp_full_match(file, '(.*/)?conf/m[0-4][^/]*/[^/]*') THEN FALSE
    WHEN regexp_full_match(file, '([^/]*/)*m1[^/]/[^/]*\\.py') THEN TRUE
    WHEN regexp_full_match(file, '(.*/)?lib/[^/]*/auth\\.go') THEN TRUE
    WHEN regexp_full_match(file, '(.*/)?kex\\.ts') THEN FALSE
    WHEN regexp_full_match(file, '(.*/)?[^/]*\\.go') THEN TRUE
    WHEN regexp_full_match(file, 'src/core(/.*)?') THEN FALSE
    WHEN regexp_full_match(file, 'src(/.*)?') THEN TRUE ELSE FALSE END"""


@query("suppress_by_path", f"SELECT seq, file FROM {V.duck(V.FINDINGS)} WHERE NOT {_IGNORED}")
def suppress_by_path(spark, sf):
    return suppress.suppress_by_path(V.findings(spark, sf), IGNORES).select("seq", "file")


@query("suppress_by_path_rows", f"SELECT seq, file FROM {V.duck(V.FINDINGS)} WHERE NOT {_IGNORED}")
def suppress_by_path_rows(spark, sf):
    """The same patterns as rows of a table."""
    rows = literal_table(spark, [(0, i, p) for i, p in enumerate(IGNORES)], "src_block int, row_no int, pattern string")
    return suppress.suppress_by_path(V.findings(spark, sf), rows).select("seq", "file")


@query("load_ignore_patterns", f"""SELECT project, file AS src_file, line_no AS row_no, trim(text) AS pattern
    FROM {_LINES} WHERE trim(text) <> '' AND NOT starts_with(trim(text), '#')""")
def load_ignore_patterns(spark, sf):
    rows = lines(spark, sf).select(
        "project", F.col("file").alias("src_file"), F.lit(0).cast("bigint").alias("src_block"),
        F.col("line_no").alias("row_no"), F.concat(F.lit("  "), "text", F.lit("\t")).alias("line"))
    return text_files.parse_ignore_patterns(rows).drop("src_block")


# --- constants ------------------------------------------------------------------
SOURCES = {
    "A.java": "class A {\n  public static final int RSA_KEY_SIZE = 2_048;\n  static final int H = 0x10;\n"
              "  static final int OCT = 010; static final int BAD = 089;\n}",
    "b.py": "RSA_BITS = 3072\n  INDENTED = 5\nAES_KEY_LEN = 0x80\nlower = 3\nRSA_BITS = 4096",
    "c.ts": "export const KEY_SIZE: number = 256;\nconst AES_SIZE = 128\nlet X1 = 5",
    "d.c": "#define KEY_BITS 1'024u\n#define MULTI 5 \\\n  + 6\nstatic const int AES_KEY = 192;\n"
           "enum Sizes { EC_BITS = 384, RSA = 2048 };\nconst int KEY_BITS = 7;",
    "e.go": "package sizes\nconst KeySize = 256 // bits\nconst (\n  RsaBits = 0b100000000000\n  Octal int = 0o17\n)\nvar x = 9\n",
    "f.txt": "KEY = 5",
}
# Projects with odd numbers give other values to some of the same names.
OTHER_VALUES = {"2_048": "3_072", "4096": "1024", "0x80": "0x100", "256": "0x80", "192": "256", "384": "521"}
CONSTANTS = {
    "A.java": {"RSA_KEY_SIZE": (2048, 3072), "H": (16, 16), "OCT": (8, 8)},
    "b.py": {"RSA_BITS": (4096, 1024), "AES_KEY_LEN": (128, 256)},
    "c.ts": {"KEY_SIZE": (256, 128), "AES_SIZE": (128, 128)},
    "d.c": {"KEY_BITS": (1024, 1024), "AES_KEY": (192, 256), "EC_BITS": (384, 521), "RSA": (2048, 2048)},
    "e.go": {"KeySize": (256, 128), "RsaBits": (2048, 2048), "Octal": (15, 15)},
}
SCOPES = {"A.java": "A", "b.py": "b", "c.ts": "c", "d.c": "", "e.go": "sizes"}
_FILES = list(SOURCES)
_CONST_ROWS = ", ".join(
    f"('{f}', '{SCOPES[f]}', '{n}', {v[0]}, {v[1]})" for f, cs in CONSTANTS.items() for n, v in cs.items())
#: Documents 2k and 2k + 1 are the same file in two neighbouring projects of five.
_K = div("doc_id", 2)
_OWNER = f"({_K} + doc_id % 2) % 5"


def _other(text):
    for old, new in OTHER_VALUES.items():
        text = text.replace(f"= {old}", f"= {new}")
    return text


def source_files(spark, sf):
    """Declarations and then the document's whole text, in a file of each language."""
    which = f"{_K} % {len(_FILES)}"
    texts = [F.array(*[F.lit(change(SOURCES[f])) for f in _FILES]) for change in (str, _other)]
    declared = F.get(F.when(V.expr(f"{_OWNER} % 2 = 1"), texts[1]).otherwise(texts[0]), V.expr(which).cast("int"))
    return V.table(spark, sf, "documents").select(
        F.concat(F.lit("p"), V.expr(string(_OWNER))).alias("project"),
        F.concat(F.lit("d"), V.expr(string(_K)), F.lit("/"), V.expr(pick(which, _FILES))).alias("file"),
        F.concat(declared, F.lit("\n"), F.coalesce("text", F.lit(""))).alias("content"))


_DOC_CONST = f"""(SELECT 'p' || {_OWNER} AS project, 'd' || {_K} || '/' || c.f AS file, c.scope, c.name,
        CAST(CASE WHEN {_OWNER} % 2 = 1 THEN c.odd ELSE c.even END AS BIGINT) AS value
    FROM documents JOIN (VALUES {_CONST_ROWS}) AS c(f, scope, name, even, odd)
    ON c.f = {pick(f'{_K} % {len(_FILES)}', _FILES)})"""


@query("extract_constants", f"SELECT * FROM {_DOC_CONST}")
def extract_constants(spark, sf):
    return text_files.extract_constants(source_files(spark, sf))


_FOUND_IN = f"'p' || (place % 600 + seq % 3) % 5"


def sized_findings(spark, sf):
    file = V.expr(f"'d' || CAST(place % 600 AS STRING) || '/' || {pick(f'place % 600 % {len(_FILES)}', _FILES)}")
    return V.findings(spark, sf).withColumns({"file": file, "project": F.expr(
        "concat('p', CAST((place % 600 + seq % 3) % 5 AS STRING))")})


_PLAUSIBLE = f"""CASE WHEN {O.isin('tok', constants.SYMMETRIC_TOKENS)} THEN value IN (128, 192, 256, 512)
    WHEN {O.isin('tok', constants.RSA_TOKENS)} THEN {O.isin('value', constants.RSA_SIZES)}
    WHEN {O.isin('tok', constants.EC_TOKENS)} THEN {O.isin('value', constants.EC_SIZES)}
    ELSE {O.isin('value', constants.SYMMETRIC_SIZES + constants.RSA_SIZES + constants.EC_SIZES)} END"""
_SEGMENTS = """string_split(regexp_replace(upper(regexp_replace(name, '([a-z])([A-Z])', '\\1 \\2', 'g')),
    '[^A-Z0-9]+', ' ', 'g'), ' ')"""


@query("enrich_key_size", f"""
    WITH f AS (SELECT seq, alg_name, key_size, {_FOUND_IN} AS project, 'd' || place % 600 || '/' ||
            {pick(f'place % 600 % {len(_FILES)}', _FILES)} AS file,
            regexp_extract(upper(alg_name), '^([A-Z0-9]*)', 1) AS tok FROM {V.duck(V.FINDINGS)}),
    e AS (SELECT f.seq, value, tok <> '' AND regexp_matches(regexp_replace(upper(name), '[^A-Z0-9]', ' ', 'g'),
            '(^| )' || tok || '( |$)') AS named
        FROM f JOIN {_DOC_CONST} AS c ON c.file = f.file AND c.project = f.project
        WHERE alg_name IS NOT NULL AND COALESCE(key_size, 0) = 0 AND value >= 8 AND {_PLAUSIBLE}
            AND ((tok <> '' AND regexp_matches(regexp_replace(upper(name), '[^A-Z0-9]', ' ', 'g'),
                '(^| )' || tok || '( |$)')) OR list_has_any({_SEGMENTS}, {O.array(constants.KEY_WORDS)}))),
    a AS (SELECT seq, CASE WHEN count(*) = 1 THEN max(value) WHEN count(*) FILTER (named) = 1
            THEN max(value) FILTER (named) END AS found FROM e GROUP BY seq)
    SELECT f.seq, f.alg_name, COALESCE(f.key_size, a.found) AS key_size FROM f LEFT JOIN a USING (seq)""")
def enrich_key_size(spark, sf):
    consts = text_files.extract_constants(source_files(spark, sf))
    out = enrich.enrich_key_size(sized_findings(spark, sf), consts)
    return out.select("seq", F.col("algorithm.name").alias("alg_name"), F.col("algorithm.key_size").alias("key_size"))


IDENTIFIERS = ["use(RSA_BITS)", "AES_KEY_LEN+RSA_BITS", "xRSA_BITS", "a.KeySize", "KEY_BITS2", "nothing",
               "(EC_BITS)", "RSA"]
IDENT_NAME = ["RSA_BITS", "AES_KEY_LEN", None, "KeySize", None, None, "EC_BITS", "RSA"]


@query("enrich_key_size_by_identifier", f"""
    WITH c AS (SELECT project, name, max(value) AS value FROM {_DOC_CONST} GROUP BY project, name)
    SELECT seq, CASE WHEN alg_name IS NOT NULL THEN COALESCE(key_size, c.value) END AS key_size
    FROM (SELECT *, {pick(f'seq % {len(IDENTIFIERS)}', IDENT_NAME)} AS named, {_FOUND_IN} AS own
          FROM {V.duck(V.FINDINGS)}) AS f LEFT JOIN c ON c.project = f.own AND c.name = f.named""")
def enrich_key_size_by_identifier(spark, sf):
    raw = V.expr(pick(f"seq % {len(IDENTIFIERS)}", IDENTIFIERS))
    found = sized_findings(spark, sf).withColumn("raw_identifier", raw)
    consts = text_files.extract_constants(source_files(spark, sf)).select(
        "project", F.concat("scope", F.lit("."), "name").alias("name"), "value")
    out = enrich.enrich_key_size_by_identifier(found, consts)
    return out.select("seq", F.col("algorithm.key_size").alias("key_size"))


# --- configuration --------------------------------------------------------------
CONF = {
    "properties": ("# note\n! more\nalgorithm=AES-256-GCM\nlong = one \\\n   two\\\n  three\nkey: RSA\n"
                   "nothing\n# c \\\nalg=x\n=empty\n",
                   [("algorithm", "AES-256-GCM", 3), ("long", "one twothree", 4), ("key", "RSA", 7),
                    ("alg", "x", 10), ("", "empty", 11)]),
    "env": ("export A=1 # c\nB='x # y' z\nC=\"open\nexport  D : v\n#no\nE=\n",
            [("A", "1", 1), ("B", "x # y", 2), ("C", "open", 3), ("D", "v", 4), ("E", "", 6)]),
    "ini": ("top=1\n[tls]\n; c\ncipher = \"AES ; 1\" x\nv=1 ; c\nw=2 # d\n[]\nu=3\n[a b] x\nlong=a\\\n[not]\\\nb\n=x\n",
            [("top", "1", 1), ("tls.cipher", "AES ; 1", 4), ("tls.v", "1", 5), ("tls.w", "2", 6),
             ("u", "3", 8), ("a b.long", "a[not]b", 10)]),
}


_CONF_FILES = f"""SELECT doc_id, 'p' || {string('doc_id % 3')} AS project, 'd' || {string('doc_id')} AS file,
    COALESCE(text, '') AS content FROM {{documents}}"""
# what a key and a value are in the lines of a document, which has no continuations
_PAIR = r"""trim(regexp_extract(t, '(?s)^([^=:]*)[=:]', 1), {b}) AS key,
    trim(regexp_extract(t, '(?s)^[^=:]*[=:](.*)$', 1), {b}) AS value"""
_BLANK = "' ' || chr(9) || chr(11) || chr(12) || chr(13) || chr(160) || chr(133)"
_COMMENTS = {"properties": "'#', '!'", "env": "'#'", "ini": "'#', ';', '['"}


def _conf_oracle(fmt):
    rows = ", ".join(f"({V.text(k)}, {V.text(v)}, {n})" for k, v, n in CONF[fmt][1])
    offset = CONF[fmt][0].count("\n") + (not CONF[fmt][0].endswith("\n"))
    t = f"trim(text, {_BLANK})"
    if fmt == "env":
        t = f"trim(regexp_replace({t}, '(?i)^export ', ''), {_BLANK})"
    section = CONF_SECTION if fmt == "ini" else ""
    cut = {"ini": [";", "#"], "env": ["#"]}.get(fmt, [])
    plain = "value"
    for mark in reversed(cut):
        plain = f"CASE WHEN contains(value, ' {mark}') THEN trim(split_part(value, ' {mark}', 1), {_BLANK}) ELSE {plain} END"
    for q in ('"', "''") if cut else ():
        closed = f"regexp_matches(value, '(?s)^{q}[^{q}]*{q}')"
        opened = "substr(value, 2)" if fmt == "env" else "value"
        plain = f"""CASE WHEN length(value) >= 2 AND starts_with(value, '{q}') THEN
            CASE WHEN {closed} THEN regexp_extract(value, '(?s)^{q}([^{q}]*){q}', 1) ELSE {opened} END ELSE {plain} END"""
    return f"""SELECT project, file, c.key, c.value, c.line FROM {V.duck(_CONF_FILES)},
        (VALUES {rows}) AS c(key, value, line)
    UNION ALL SELECT project, file, {'CASE WHEN key = ' + "''" + f" THEN NULL ELSE {V.text(section)} || key END" if fmt == 'ini' else 'key'},
        {plain}, line_no + {offset}
    FROM (SELECT project, file, line_no, {_PAIR.format(b=_BLANK)} FROM (
        SELECT *, {t} AS t FROM {V.lines_of(_CONF_FILES)})
        WHERE t <> '' AND trim(text, {_BLANK}) <> '' AND substr(trim(text, {_BLANK}), 1, 1) NOT IN ({_COMMENTS[fmt]})
            AND regexp_matches(t, '[=:]'))
    {"WHERE key <> ''" if fmt == 'ini' else ''}"""


#: the section that the lines behind the settings are in
CONF_SECTION = "a b."


def _conf_query(fmt):
    def run(spark, sf):
        files = V.view(spark, sf, _CONF_FILES).drop("doc_id").withColumn(
            "content", F.concat(F.lit(CONF[fmt][0]), "content"))
        return config_text.read_config_kv(files, fmt)

    return run


for _fmt in CONF:
    query(f"load_config_kv_{_fmt}", _conf_oracle(_fmt))(_conf_query(_fmt))


@query("config_sections", f"""SELECT project, file, line_no, last_value(CASE WHEN text = 'plain text' THEN 'plain'
        WHEN starts_with(text, 'const KEY') THEN '' WHEN regexp_matches(trim(text), '^\\[[^\\]]*\\]')
        THEN trim(regexp_extract(trim(text), '^\\[([^\\]]*)\\]', 1)) END IGNORE NULLS) OVER
        (PARTITION BY project, file ORDER BY line_no) AS section
    FROM {_LINES}""")
def config_sections(spark, sf):
    text = F.when(F.col("text") == "plain text", "[ plain ] x").when(
        F.col("text").startswith("const KEY"), "[]").otherwise(F.col("text"))
    return config_text.config_sections(lines(spark, sf).withColumn("text", text)).select(
        "project", "file", "line_no", "section")


_TREE = '{"a": {"b": [1, {"c": "x"}], "n": null}, "t": true, "f": 1.5, "s": "q"}'


@query("flatten_json_kv", """SELECT 'e' || event_id AS file, key, value FROM (
    SELECT event_id, unnest(['k', 'a.b[0]', 'a.b[1].c', 't', 'f', 's']) AS key,
        unnest([json_extract_string(props, '$.k'), '1', 'x', 'true', '1.5', 'q']) AS value FROM events)
    WHERE event_id % 10 = 0 OR key = 'k'""")
def flatten_json_kv(spark, sf):
    merged = F.concat(F.expr("substr(props, 1, length(props) - 1)"), F.lit(", "), F.lit(_TREE[1:]))
    docs = V.table(spark, sf, "events").select(
        F.concat(F.lit("e"), "event_id").alias("file"),
        F.when(F.col("event_id") % 10 == 0, merged).otherwise(F.col("props")).alias("content"))
    return text_files.flatten_json_kv(docs)


def _vocab_sql():
    """First matching rule per setting, by joining the distinct keys and values with the rules."""
    patterns = sorted({r[1] for r in config.vocabulary()})
    keys = ", ".join(f"({V.text(k)}, {V.text(p)})" for k in V.KEYS for p in patterns if _key_hit(k, p))
    rows = ", ".join(
        f"({r[0]}, {V.text(r[1])}, {V.text(h)}, {V.text(r[3])}, {V.text(r[4])}, {V.text(r[5])}, {V.text(r[6])})"
        for r in config.vocabulary() for h in (r[2] or [None]))
    hit = "(r.hint IS NULL OR regexp_matches(lower(s.value), '(^|[^A-Za-z0-9])' || " \
          "regexp_replace(r.hint, '([^A-Za-z0-9])', '\\\\\\1', 'g') || '($|[^A-Za-z0-9])'))"
    bits = """TRY_CAST(trim(regexp_replace(lower(trim(s.value)), '(bits|bit|b)$', '')) AS INT)"""
    return f"""SELECT file, line, key, value, alg AS alg_name, prim AS primitive,
        COALESCE(size, CASE WHEN {O.isin('pattern', config.KEY_SIZE_PATTERNS)}
            AND bits BETWEEN 1 AND 65536 THEN bits END) AS key_size, mode FROM (
        SELECT s.file, s.line, s.key, s.value, r.*, {bits} AS bits,
            row_number() OVER (PARTITION BY s.file, s.line ORDER BY r.no) AS rn
        FROM {V.duck(V.SETTINGS)} AS s JOIN (VALUES {keys}) AS k(key, pattern) ON k.key = s.key
        JOIN (VALUES {rows}) AS r(no, pattern, hint, alg, prim, size, mode) ON r.pattern = k.pattern AND {hit})
    WHERE rn = 1"""


def _key_hit(key, pattern):
    """Whether a key holds a pattern, by hand: split at camel case, then compare words."""
    import re

    dotted = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", ".", key).lower()
    forms = [pattern, pattern + "s"] if re.search("[-_.]", pattern) else [pattern]
    if any(re.search(r"(?<![a-z0-9])" + re.escape(f) + r"(?![a-z0-9])", dotted) for f in forms):
        return True
    words = [w for w in re.split(r"[.\[\]_-]+", dotted) if w]
    runs = {"".join(words[i:j]) for i in range(len(words)) for j in range(i + 2, min(i + 5, len(words) + 1))}
    return not re.search("[-_.]", pattern) and bool(runs & {pattern, pattern + "s"})


@query("config_vocab_match", _vocab_sql())
def config_vocab_match(spark, sf):
    a = F.col("algorithm")
    return CM.config_vocab_match(V.view(spark, sf, V.SETTINGS)).select(
        "file", "line", "key", "value", a["name"].alias("alg_name"), a["primitive"].alias("primitive"),
        a["key_size"].alias("key_size"), a["mode"].alias("mode"))


@query("first_match", """SELECT user_id, arg_min(event_type, event_id) AS event_type, min(event_id) AS event_id
    FROM events GROUP BY user_id""")
def first_match(spark, sf):
    rows = V.table(spark, sf, "events").select("user_id", "event_id", "event_type")
    return CM.first_match(rows, ["user_id"], "event_id")


# --- binaries -------------------------------------------------------------------
SYMBOL_NAMES = ["_EVP_sha256", "RSA_public_encrypt", "__aws_lc_mlkem_keygen", "main", "AES_encrypt",
                "OQS_KEM_kyber_768_new", "CCHmac", "md5_init", "printf", "BCryptSignHash", "ec_key_new"]
LIBS = ["libssl.so.3", "/usr/lib/LIBCRYPTO.so", "libc.so.6", "bcrypt.dll", "libopenssl-fake", "libsodium.23"]
SYMBOLS = f"""SELECT p_partkey, 'bin' || {string('p_partkey % 300')} AS artifact,
    {pick(f'p_partkey % {len(SYMBOL_NAMES)}', SYMBOL_NAMES)} AS symbol, p_size % 2 = 0 AS is_dynamic,
    {pick(f'{div("p_partkey", 2)} % {len(LIBS)}', LIBS)} AS library FROM {{part}}"""
_SYM = ", ".join(f"({V.text(s)}, {V.text(lib)}, {V.text(a)}, {V.text(p)})" for s, lib, a, p in binaries.symbols())
_SYM_MATCH = f"""(SELECT p_partkey, artifact, k.symbol, is_dynamic, k.library, algorithm, primitive
    FROM {V.duck(SYMBOLS)} AS s JOIN (VALUES {_SYM}) AS k(symbol, library, algorithm, primitive)
    ON k.symbol = lower(ltrim(s.symbol, '_')))"""


@query("symbol_kb_match", f"SELECT artifact, symbol, is_dynamic, library, algorithm, primitive FROM {_SYM_MATCH}")
def symbol_kb_match(spark, sf):
    return B.symbol_kb_match(V.view(spark, sf, SYMBOLS).select("artifact", "symbol", "is_dynamic"))


_LIB_MATCH = f"""(SELECT p_partkey, artifact, library, split_part(m, '|', 1) AS algorithm,
    split_part(m, '|', 2) AS primitive FROM (SELECT *, CASE """ + " ".join(
    f"WHEN contains(lower(library), '{n}') THEN '{a}|{p}'" for n, a, p in binaries.LIBRARIES) + f""" END AS m
    FROM {V.duck(SYMBOLS)}) WHERE m IS NOT NULL)"""


@query("dynlib_kb_match", f"SELECT artifact, library, algorithm, primitive FROM {_LIB_MATCH}")
def dynlib_kb_match(spark, sf):
    return B.dynlib_kb_match(V.view(spark, sf, SYMBOLS).select("artifact", "library"))


MODULE_PATHS = [m[0] for m in binaries.GO_MODULES][:9] + ["example.com/x", "golang.org/x/net"]
MODULES = f"""SELECT 'go' || {string('p_partkey % 200')} AS artifact,
    {pick(f'p_partkey % {len(MODULE_PATHS)}', MODULE_PATHS)} AS path,
    CASE WHEN p_size % 3 = 0 THEN '' ELSE 'v1.' || {string('p_size')} END AS version,
    CASE WHEN p_partkey % 5 = 0 THEN 'crypto/md5' WHEN p_partkey % 7 = 0 THEN 'example.com/y' END AS replace_path,
    CASE WHEN p_partkey % 5 = 0 THEN 'v9' END AS replace_version FROM {{part}}"""
_MODS = ", ".join(f"({V.text(m)}, {V.text(a)}, {V.text(p)})" for m, a, p in binaries.GO_MODULES)


@query("module_kb_match", f"""SELECT artifact, path, algorithm, primitive, path || COALESCE('@' || NULLIF(v, ''), '')
    AS library FROM (SELECT *, COALESCE(replace_path, path) AS m,
        CASE WHEN replace_path IS NOT NULL THEN replace_version ELSE version END AS v FROM {V.duck(MODULES)})
    JOIN (VALUES {_MODS}) AS k(module, algorithm, primitive) ON k.module = m""")
def module_kb_match(spark, sf):
    return B.module_kb_match(V.view(spark, sf, MODULES))


PY_LINES = ["Requires-Dist: PyJWT (>=2.0)", "import hashlib, os", "from Crypto.Cipher import AES", "import os",
            "Requires-Dist: requests", "  import ssl", "Requires-Dist: argon2_cffi;extra", "from jose import jwt",
            "import paramiko"]
PY_META = ["PyJWT", None, None, None, None, None, "argon2-cffi", None, None]
PY_CODE = [None, "hashlib", "Crypto", None, None, None, None, None, "paramiko"]
PYTHON = f"""SELECT p_partkey, 'w' || {string('p_partkey % 50')} AS artifact,
    CASE WHEN p_size % 2 = 0 THEN 'a.dist-info/METADATA' ELSE 'pkg/m' || {string('p_size % 9')} || '.py' END
        AS inner_path, {pick(f'p_partkey % {len(PY_LINES)}', PY_LINES)} AS line_text FROM {{part}}"""


@query("python_pkg_match", f"""SELECT DISTINCT artifact, inner_path, library FROM (SELECT artifact, inner_path,
    CASE WHEN ends_with(inner_path, 'METADATA') THEN {pick(f'p_partkey % {len(PY_LINES)}', PY_META)}
        ELSE {pick(f'p_partkey % {len(PY_LINES)}', PY_CODE)} END AS library FROM {V.duck(PYTHON)})
    WHERE library IS NOT NULL""")
def python_pkg_match(spark, sf):
    return B.python_pkg_match(V.view(spark, sf, PYTHON))


TYPES = [t[0] for t in binaries.dotnet_types()]
_TYPE_ROWS = ", ".join(f"({V.text(n)}, {V.text(a)}, {V.text(p)})" for n, a, p in binaries.dotnet_types())
DOTNET = f"""SELECT page_id, html || ' ' || COALESCE({pick(f'page_id % {len(TYPES) + 5}', TYPES + [None] * 5)}, '')
    || ' ' || COALESCE({pick(f'page_id % 7', [TYPES[0], None, TYPES[30], None, None, TYPES[1], None])}, '') AS body
    FROM {{pages}}"""


@query("dotnet_type_match", f"""SELECT CAST(page_id AS STRING) AS path, k.name AS type_name, algorithm, primitive
    FROM {V.duck(DOTNET)} AS d JOIN (VALUES {_TYPE_ROWS}) AS k(name, algorithm, primitive)
    ON contains(d.body, k.name)""")
def dotnet_type_match(spark, sf):
    rows = V.view(spark, sf, DOTNET).select(
        F.col("page_id").cast("string").alias("path"), F.col("body").cast("binary").alias("content"))
    return B.dotnet_type_match(rows)


_SIGS = [s[3] for s in binaries.SIGNATURES]
BYTES = f"""SELECT page_id, {pick(f'page_id % {len(_SIGS) + 3}', _SIGS + [None] * 3)} AS s1,
    {pick(f'{div("page_id", 2)} % {len(_SIGS) + 1}', _SIGS + [None])} AS s2 FROM {{pages}}"""
_SIG_ROWS = ", ".join(f"({i}, {V.text(n)}, {V.text(a)}, {V.text(p)}, {V.text(h)})"
                      for i, (n, a, p, h) in enumerate(binaries.SIGNATURES))


@query("byte_signature_match", f"""
    WITH b AS (SELECT d.page_id, hex(encode(html)) || COALESCE(s1, '') || '0F' || COALESCE(s2, '') AS h
        FROM {V.duck(BYTES)} AS d JOIN pages USING (page_id)),
    m AS (SELECT page_id, k.*, (instr(h, pat) - 1) / 2 AS off FROM b JOIN (VALUES {_SIG_ROWS})
        AS k(no, name, algorithm, primitive, pat) ON contains(h, pat))
    SELECT CAST(page_id AS STRING) AS path, name AS pattern_name, algorithm, primitive, CAST(off AS BIGINT) AS "offset"
    FROM (SELECT *, row_number() OVER (PARTITION BY page_id, algorithm ORDER BY no) AS rn FROM m) WHERE rn = 1""")
def byte_signature_match(spark, sf):
    none = F.lit(b"")
    rows = V.view(spark, sf, BYTES).join(V.table(spark, sf, "pages"), "page_id").select(
        F.col("page_id").cast("string").alias("path"),
        F.concat(
            F.col("html").cast("binary"), F.coalesce(F.unhex("s1"), none), F.lit(b"\x0f"),
            F.coalesce(F.unhex("s2"), none),
        ).alias("content"))
    return B.byte_signature_match(rows).drop("row_no")


_MATCHES = f"""(SELECT artifact, 'symbol' AS kind, is_dynamic, algorithm FROM {_SYM_MATCH}
    UNION ALL SELECT artifact, 'library', NULL, algorithm FROM {_LIB_MATCH} WHERE p_partkey % 3 = 0
    UNION ALL SELECT DISTINCT artifact, 'constant', CAST(NULL AS BOOLEAN), 'AES' FROM {V.duck(SYMBOLS)}
        WHERE p_partkey % 4 = 1)"""


@query("binary_signal_confidence", f"""SELECT m.artifact, m.kind, m.algorithm, CASE WHEN own OR
        (CASE WHEN c THEN 1 ELSE 0 END + CASE WHEN st THEN 1 ELSE 0 END + CASE WHEN own THEN 1 ELSE 0 END
         + CASE WHEN l THEN 1 ELSE 0 END) >= 3 THEN 'medium' ELSE 'low' END AS confidence
    FROM (SELECT m.*, a.*, CASE WHEN m.kind = 'symbol' THEN m.is_dynamic ELSE a.dy END AS own
        FROM {_MATCHES} AS m JOIN (SELECT artifact AS art, bool_or(kind = 'constant') AS c,
            bool_or(kind = 'symbol' AND NOT is_dynamic) IS TRUE AS st,
            bool_or(kind = 'symbol' AND is_dynamic) IS TRUE AS dy, bool_or(kind = 'library') AS l
            FROM {_MATCHES} GROUP BY 1) AS a ON a.art = m.artifact) AS m""")
def binary_signal_confidence(spark, sf):
    symbols = V.view(spark, sf, SYMBOLS)
    nothing = F.lit(None).cast("boolean").alias("is_dynamic")
    rows = B.symbol_kb_match(symbols.select("artifact", "symbol", "is_dynamic")).select(
        "artifact", F.lit("symbol").alias("kind"), "is_dynamic", "algorithm"
    ).unionByName(B.dynlib_kb_match(symbols.where("p_partkey % 3 = 0").select("artifact", "library")).select(
        "artifact", F.lit("library").alias("kind"), nothing, "algorithm")
    ).unionByName(symbols.where("p_partkey % 4 = 1").select(
        "artifact", F.lit("constant").alias("kind"), nothing, F.lit("AES").alias("algorithm")).distinct())
    return B.binary_signal_confidence(rows).drop("is_dynamic")


@query("dedup_artifact_findings", f"""SELECT artifact, algorithm, primitive, symbol AS raw_identifier, seq FROM (
    SELECT *, p_partkey AS seq, row_number() OVER (PARTITION BY artifact, algorithm, primitive, symbol
        ORDER BY p_partkey) AS rn FROM {_SYM_MATCH}) WHERE rn = 1""")
def dedup_artifact_findings(spark, sf):
    rows = V.view(spark, sf, SYMBOLS).select(
        B.normalize_symbol(F.col("symbol")).alias("symbol"), "artifact", F.col("p_partkey").alias("seq"))
    found = rows.join(B.symbols_kb(spark).drop("library"), "symbol").withColumnRenamed("symbol", "raw_identifier")
    return B.dedup_artifact_findings(found)


JCA = ["AES/GCM/NoPadding", "aes/x", "HmacSHA256", "SHA256withRSA", "TLSv1.2", "PBKDF2WithHmacSHA1", "java.util",
       "SHA-512", "RSA", "X25519", "DESede/CBC/PKCS5Padding", "ChaCha20-Poly1305", "a b", "main", "SSL", "Blowfish",
       "AES", "HmacMD5", "EC", "Foo", "RC4/ECB", "SSLv3"]
JCA_OUT = ["AES|GCM|ae", None, "HMAC|SHA-256|mac", "SHA256withRSA||signature", "TLS|1.2|protocol",
           "PBKDF2WithHmacSHA1||kdf", None, "SHA-512||hash", "RSA||pke", "X25519||key-exchange",
           "DESede|CBC|symmetric", "ChaCha20-Poly1305||ae", None, None, "TLS||protocol", "Blowfish||symmetric",
           "AES||symmetric", "HMAC||mac", "EC||signature", None, "RC4|ECB|symmetric", "TLS|3|protocol"]


@query("jca_transform", f"""SELECT event_id, {pick(f'event_id % {len(JCA)}', JCA_OUT)} AS out FROM events""")
def jca_transform(spark, sf):
    s = V.expr(pick(f"event_id % {len(JCA)}", JCA))
    rows = V.table(spark, sf, "events").select("event_id", SF.jca_transform(s).alias("j"))
    return rows.select("event_id", F.when(F.col("j").isNotNull(), F.concat_ws(
        "|", "j.name", F.coalesce("j.mode", F.lit("")), "j.primitive")).alias("out"))


RULES = ["go-rsa-keygen", "py.crypto.md5-use", "java-triple-des", "x_sha256_y", "tls-config", "use-ec-key-ec",
         "aes-mac", "custom-kdf", "plain", "ecdsa.sign", "sha1-hmac", "des-cipher"]


def _rule_sql(expr):
    prim = "CASE " + " ".join(
        f"WHEN {O.any_part(expr, parts)}" + "".join(f" OR ends_with({expr}, '{e}')" for e in ends) + f" THEN '{p}'"
        for parts, ends, p in formats.RULE_ID_PRIMITIVES) + " END"
    tokens = f"string_split(regexp_replace({expr}, '[-_./]+', ' ', 'g'), ' ')"
    alg = "CASE " + " ".join(
        f"WHEN list_has_any({tokens}, {O.array(words)})"
        + (f" OR contains({expr}, 'triple-des')" if a == "DES" else "") + f" THEN '{a}'"
        for words, a in formats.RULE_ID_ALGORITHMS) + " END"
    return alg, prim


_RULE_ALG, _RULE_PRIM = _rule_sql("lower(r)")


@query("infer_from_rule_id", f"""SELECT event_id, {_RULE_ALG} AS algorithm, {_RULE_PRIM} AS primitive
    FROM (SELECT event_id, {pick(f'event_id % {len(RULES)}', RULES)} AS r FROM events)""")
def infer_from_rule_id(spark, sf):
    rule = V.expr(pick(f"event_id % {len(RULES)}", RULES))
    rows = V.table(spark, sf, "events").select("event_id", SF.infer_from_rule_id(rule).alias("i"))
    return rows.select("event_id", "i.*")
