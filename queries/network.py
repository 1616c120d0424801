"""Queries over sensor logs, endpoints and certificates."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queries import oracle as O
from queries import views as V
from queries.registry import query
from queries.views import div, pick, string
from shoreline.functions import tls as X
from shoreline.operators import classify as C
from shoreline.operators import records as R
from shoreline.operators import score
from shoreline.plans import network as N
from shoreline.plans.checkpoints import cut
from shoreline.rules import tls as rules
from shoreline.sources import certificates as certs
from shoreline.sources import ids_log, sensor_logs
from shoreline.sources.lines import detect_log_format
from shoreline.tables import literal_table

# --- TLS sensor log -----------------------------------------------------------
SSL_A = ["ts", "uid", "id.resp_h", "id.resp_p", "version", "cipher", "curve", "server_name",
         "established", "pqc_key_share"]
SSL_B = ["uid", "pqc_key_share", "id.resp_p", "id.resp_h", "curve", "cipher", "version", "extra",
         "established", "server_name"]


def _ssl_cells(names):
    cells = {
        "ts": F.col("event_id").cast("string"), "uid": F.col("uid"), "id.resp_h": F.col("host"),
        "id.resp_p": F.col("port"), "version": F.col("version"), "cipher": F.col("cipher"),
        "curve": F.col("curve"), "server_name": F.col("server_name"),
        "established": F.when(F.col("established"), "T").otherwise("F"),
        "pqc_key_share": F.nullif(F.col("shares"), F.lit("")), "extra": F.lit("x"),
    }
    empty = F.when(F.col("shares") == "", "(empty)").otherwise("-")
    return F.concat_ws("\t", *[
        F.coalesce(cells[n], empty if n == "pqc_key_share" else F.lit("-")) for n in names
    ])


def _with_headers(rows: DataFrame, headers: dict) -> DataFrame:
    """Log lines plus header lines at given row numbers of every file."""
    files = rows.select("src_file").distinct()
    lines = F.array(*[
        F.struct(F.lit(n).cast("bigint").alias("row_no"), F.lit(t).alias("line"))
        for n, t in headers.items()
    ])
    head = files.select("src_file", F.inline(lines)).withColumn(
        "src_block", F.lit(0).cast("bigint")
    )
    return rows.unionByName(head.select(*rows.columns))


def _line(df, file, text):
    """Log lines; written out, as a sensor would, so that readers see plain text."""
    return cut(df.select(
        file.alias("src_file"), F.lit(0).cast("bigint").alias("src_block"),
        (F.col("event_id") + 100).alias("row_no"), text.alias("line"),
    ))


def ssl_tsv_lines(spark, sf):
    """A log whose column order changes at row 1999, read in blocks of 700 rows."""
    tls = V.view(spark, sf, V.TLS)
    text = F.when(F.col("event_id") + 100 < 1000, _ssl_cells(SSL_A)).otherwise(_ssl_cells(SSL_B))
    rows = _line(tls, F.col("log_no"), text).withColumn("row_no", 2 * F.col("row_no"))
    return _with_headers(
        rows,
        {0: "#separator \\x09", 1: "#set_separator\t,", 2: "#empty_field\t(empty)",
         3: "#unset_field\t-", 4: "#path\tssl", 5: "#fields\t" + "\t".join(SSL_A),
         6: "#types\tx", 1999: "#fields\t" + "\t".join(SSL_B)},
    ).withColumn("src_block", F.floor(F.col("row_no") / 700))


def ssl_json_lines(spark, sf):
    """NDJSON with torn and blank lines, and flags as booleans or texts."""
    tls = V.view(spark, sf, V.TLS)
    fields = [
        F.col("uid").alias("uid"), F.col("host").alias("id.resp_h"),
        F.col("version").alias("version"), F.col("cipher").alias("cipher"),
        F.col("curve").alias("curve"), F.col("server_name").alias("server_name"),
        F.col("shares").alias("pqc_key_share"),
    ]
    as_number = F.to_json(F.struct(
        *fields, F.col("port").cast("int").alias("id.resp_p"),
        F.col("established").alias("established"),
    ))
    as_text = F.to_json(F.struct(
        *fields, F.col("port").alias("id.resp_p"),
        F.when(F.col("established"), "T").otherwise("F").alias("established"),
    ))
    whole = F.when(F.col("event_id") % 2 == 0, as_number).otherwise(as_text)
    text = F.when(F.col("event_id") % 17 == 5, F.expr("substr(w, 1, length(w) - 9)")).when(
        F.col("event_id") % 29 == 3, F.lit("  ")
    ).otherwise(F.concat(F.lit(" "), F.col("w")))
    return _line(tls.withColumn("w", whole), F.col("log_no"), text)


_SSL_RECORD = f"""SELECT log_no AS src_file, event_id + 100 AS row_no, uid, host AS resp_host,
    port AS resp_port, {O.tls_version('version')} AS version, cipher, {O.curve_group('curve')} AS curve,
    server_name, NULLIF(shares, '') AS pqc_key_share
    FROM {V.duck(V.TLS)} AS t WHERE established"""


@query("scan_zeek_ssl_tsv", _SSL_RECORD.replace("event_id + 100 AS row_no", "2 * (event_id + 100) AS row_no"))
def scan_zeek_ssl_tsv(spark, sf):
    return sensor_logs.parse_ssl_tsv(ssl_tsv_lines(spark, sf)).drop("src_block")


@query("scan_zeek_ssl_json", f"{_SSL_RECORD} AND event_id % 17 <> 5 AND event_id % 29 <> 3")
def scan_zeek_ssl_json(spark, sf):
    return sensor_logs.parse_ssl_json(ssl_json_lines(spark, sf)).drop("src_block")


# --- certificate log ----------------------------------------------------------
SIG_ALGS = ["sha256WithRSAEncryption", "ecdsa-with-SHA384", "2.16.840.1.101.3.4.3.18",
            "unknown 2.16.840.1.101.3.4.3.20", None, "1.2.3", "md5WithRSAEncryption"]
KEY_ALGS = ["rsaEncryption", "id-ecPublicKey", "2.16.840.1.101.3.4.4.2", None]
KEY_TYPES = ["rsa", "EC", "ml-kem", None, "dsa"]
LENGTHS = ["2048", "256", "abc", None, "4096"]
SANS = ["a.example,b.example", None, "c/d.example", "e.example", None]
CERTS = f"""
    SELECT event_id, 'x' || {string('user_id % 4')} AS log_no,
           'F' || {string('event_id % 100')} AS id,
           {pick('event_id % 7', SIG_ALGS)} AS sig_alg, {pick('event_id % 4', KEY_ALGS)} AS key_alg,
           {pick('event_id % 5', KEY_TYPES)} AS key_type,
           {pick(f'{div("event_id", 2)} % 5', LENGTHS)} AS key_length,
           CASE WHEN event_id % 6 = 1 THEN 'secp384r1' END AS curve,
           {pick(f'{div("event_id", 3)} % 5', SANS)} AS san
    FROM {{events}}
"""
_X509 = f"""SELECT log_no AS src_file, event_id + 100 AS row_no, id, sig_alg, key_alg, key_type,
    COALESCE(TRY_CAST(key_length AS INT), 0) AS key_length, curve, {{san}} AS san_dns
    FROM {V.duck(CERTS)} AS t WHERE (sig_alg IS NOT NULL OR key_alg IS NOT NULL)"""
X509_FIELDS = ["ts", "id", "certificate.key_alg", "certificate.sig_alg", "certificate.key_type",
               "certificate.key_length", "certificate.curve", "san.dns"]


def x509_tsv_lines(spark, sf):
    cells = ["id", "id", "key_alg", "sig_alg", "key_type", "key_length", "curve", "san"]
    text = F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("<none>")) for c in cells])
    rows = _line(V.view(spark, sf, CERTS), F.col("log_no"), text)
    return _with_headers(rows, {
        0: "#separator |", 1: "#unset_field <none>", 2: "#fields\t" + "\t".join(X509_FIELDS),
    })


def x509_json_lines(spark, sf):
    c = V.view(spark, sf, CERTS)
    fields = [
        F.col("id").alias("id"), F.col("sig_alg").alias("certificate.sig_alg"),
        F.col("key_alg").alias("certificate.key_alg"),
        F.col("key_type").alias("certificate.key_type"),
        F.coalesce("curve", F.lit("-")).alias("certificate.curve"),
    ]
    as_number = F.to_json(F.struct(
        *fields, F.col("key_length").try_cast("double").alias("certificate.key_length"),
        F.split("san", ",").alias("san.dns"),
    ))
    as_text = F.to_json(F.struct(
        *fields, F.col("key_length").alias("certificate.key_length"), F.col("san").alias("san.dns"),
    ))
    return _line(c, F.col("log_no"), F.when(F.col("event_id") % 3 == 0, as_number).otherwise(as_text))


@query("scan_zeek_x509_tsv", _X509.format(san="san"))
def scan_zeek_x509_tsv(spark, sf):
    return sensor_logs.parse_x509_tsv(x509_tsv_lines(spark, sf)).drop("src_block")


@query("scan_zeek_x509_json", _X509.format(
    san="CASE WHEN event_id % 3 = 0 THEN split_part(san, ',', 1) ELSE san END"))
def scan_zeek_x509_json(spark, sf):
    return sensor_logs.parse_x509_json(x509_json_lines(spark, sf)).drop("src_block")


# --- IDS log ------------------------------------------------------------------
SIGALGS = ["rsa_pss_rsae_sha256, ecdsa_sha1,,mldsa65", None, "ed25519", "x\ty, RSA "]
GROUPS = ["x25519,X25519MLKEM768", None, "secp256r1, ,Kyber768", "many"]
HASHES = ["0123456789abcdef0123456789abcdef", "ABCDEF6789abcdef0123456789abcdef", None, "short",
          "ffffffffffffffffffffffffffffffff"]
EVE = f"""
    SELECT event_id, 'eve' || {string('user_id % 3')} AS log_no, event_type <> 'view' AS is_tls,
           event_id % 13 = 4 AS no_tls, event_id % 19 = 6 AS torn,
           '10.1.0.' || {string('event_id % 9')} AS dest_ip, CAST(443 + event_id % 2 AS INT) AS dest_port,
           {pick('event_id % 10', V.CIPHERS)} AS cipher, {pick('event_id % 6', V.VERSIONS)} AS version,
           CASE WHEN event_id % 4 = 1 THEN 's' || {string('event_id % 11')} || '.example?q' END AS sni,
           {pick(f'{div("event_id", 2)} % 5', HASHES)} AS ja3,
           {pick(f'{div("event_id", 3)} % 5', HASHES)} AS ja3s,
           {pick(f'{div("event_id", 5)} % 4', SIGALGS)} AS sigalgs,
           {pick(f'{div("event_id", 7)} % 4', GROUPS)} AS groups
    FROM {{events}}
"""
_MANY = ",".join(f"g{i}" for i in range(70))


def eve_lines(spark, sf):
    e = V.view(spark, sf, EVE)
    groups = F.when(F.col("groups") == "many", F.lit(_MANY)).otherwise(F.col("groups"))
    body = F.struct(
        "version", F.col("cipher").alias("cipher_suite"), "sni",
        F.struct(F.col("ja3").alias("hash"), F.lit("771,1").alias("string")).alias("ja3"),
        F.when(F.col("ja3s").isNotNull(), F.struct(F.col("ja3s").alias("hash"))).alias("ja3s"),
        "sigalgs", groups.alias("groups"),
    )
    whole = F.to_json(F.struct(
        F.lit("2024-01-01T00:00:00.0+0000").alias("timestamp"), F.col("event_id").alias("flow_id"),
        F.when(F.col("is_tls"), "tls").otherwise("dns").alias("event_type"), "dest_ip",
        "dest_port", F.when(~F.col("no_tls"), body).alias("tls"),
    ))
    text = F.when(F.col("torn"), F.expr("substr(w, 1, 60)")).otherwise(F.col("w"))
    return _line(e.withColumn("w", whole), F.col("log_no"), text)


_EVE_ROWS = f"""(SELECT log_no AS src_file, event_id + 100 AS row_no, dest_ip,
    CAST(dest_port AS STRING) AS dest_port, cipher, version, sni,
    CASE WHEN regexp_full_match(ja3, '[0-9a-f]{{32}}') THEN ja3 END AS ja3,
    CASE WHEN regexp_full_match(ja3s, '[0-9a-f]{{32}}') THEN ja3s END AS ja3s, sigalgs,
    CASE WHEN groups = 'many' THEN '{_MANY}' ELSE groups END AS groups
    FROM {V.duck(EVE)} AS t WHERE is_tls AND NOT no_tls AND NOT torn)"""


def eve_records(spark, sf):
    return ids_log.parse_eve(eve_lines(spark, sf))


@query("scan_suricata_eve", f"SELECT * FROM {_EVE_ROWS}")
def scan_suricata_eve(spark, sf):
    return eve_records(spark, sf).drop("src_block", "event_time")


@query("detect_log_format", f"""
    SELECT 'tsv-' || log_no AS src_file, 'tsv' AS fmt FROM {V.duck(V.TLS)} GROUP BY log_no
    UNION ALL SELECT 'json-' || log_no, 'json' FROM {V.duck(V.TLS)} GROUP BY log_no
    UNION ALL SELECT 'other-' || log_no, 'unknown' FROM {V.duck(V.TLS)} GROUP BY log_no""")
def detect_format(spark, sf):
    def renamed(df, kind):
        return df.withColumn("src_file", F.concat(F.lit(kind + "-"), "src_file"))

    other = _line(V.view(spark, sf, V.TLS), F.col("log_no"), F.coalesce("cipher", F.lit("")))
    lines = renamed(ssl_tsv_lines(spark, sf), "tsv").unionByName(
        renamed(ssl_json_lines(spark, sf), "json")
    ).unionByName(renamed(other, "other"))
    return detect_log_format(lines)


@query("log_format_fallback", f"""SELECT log_no AS src_file, count(*) AS n
    FROM {V.duck(V.TLS)} AS t WHERE established GROUP BY log_no
    UNION ALL SELECT 'j' || log_no, count(*) FROM {V.duck(V.TLS)} AS t
    WHERE established AND event_id % 17 <> 5 AND event_id % 29 <> 3 GROUP BY log_no""")
def log_format_fallback(spark, sf):
    """Files of both kinds, each read by the right reader."""
    lines = ssl_tsv_lines(spark, sf).unionByName(
        ssl_json_lines(spark, sf).withColumn("src_file", F.concat(F.lit("j"), "src_file"))
    )
    rows = sensor_logs.parse_ssl(lines)
    return rows.groupBy("src_file").agg(F.count(F.lit(1)).alias("n"))


# --- field expressions ----------------------------------------------------------
@query("sanitize_field", """SELECT event_id,
    'a' || event_id % 7 || 'b/c?d#e' AS field, 'a' || event_id % 7 || 'bcde' AS target FROM events""")
def sanitize_field(spark, sf):
    raw = F.concat(
        F.lit("a\x00\x1f"), (F.col("event_id") % 7).cast("string"), F.lit("b/\x7fc?\td#e\n")
    )
    return V.table(spark, sf, "events").select(
        "event_id", X.sanitize_field(raw).alias("field"), X.sanitize_target(raw).alias("target")
    )


@query("normalize_tls_version", f"""SELECT event_id, version,
    {O.tls_version('version')} AS normal FROM {V.duck(V.TLS)}""")
def normalize_tls_version(spark, sf):
    return V.view(spark, sf, V.TLS).select(
        "event_id", "version", X.normalize_tls_version(F.col("version")).alias("normal")
    )


@query("curve_to_group", f"""SELECT event_id, curve, {O.curve_group('curve')} AS group_name
    FROM {V.duck(V.TLS)}""")
def curve_to_group(spark, sf):
    return V.view(spark, sf, V.TLS).select(
        "event_id", "curve", X.curve_to_group(F.col("curve")).alias("group_name")
    )


_ZEEK_PRIM = """CASE WHEN contains(upper({c}), 'ECDH') OR contains(upper({c}), 'DHE') THEN 'key-agree'
    WHEN contains(upper({c}), 'RSA') THEN 'asymmetric'
    WHEN upper({c}) LIKE 'TLS\\_AES\\_%' ESCAPE '\\' OR upper({c}) LIKE 'TLS\\_CHACHA20\\_%' ESCAPE '\\'
    THEN 'ae' END"""
_SURI_PRIM = """CASE WHEN contains(upper({c}), 'DHE') OR contains(upper({c}), 'DH_') THEN 'key-agree'
    WHEN contains(upper({c}), 'RSA') THEN 'asymmetric'
    WHEN contains(upper({c}), 'ECDSA') THEN 'signature' ELSE 'symmetric' END"""


@query("cipher_primitive", f"""SELECT event_id, cipher, {_ZEEK_PRIM.format(c='cipher')} AS zeek,
    {_SURI_PRIM.format(c='cipher')} AS suricata FROM {V.duck(V.TLS)}""")
def cipher_primitive(spark, sf):
    c = F.col("cipher")
    return V.view(spark, sf, V.TLS).select(
        "event_id", "cipher", X.cipher_primitive_zeek(c).alias("zeek"),
        X.cipher_primitive_suricata(c).alias("suricata"),
    )


@query("key_type_primitive", f"""SELECT event_id, key_type,
    {O.mapping('lower(key_type)', rules.KEY_TYPE_PRIMITIVES)} AS primitive FROM {V.duck(CERTS)}""")
def key_type_primitive(spark, sf):
    return V.view(spark, sf, CERTS).select(
        "event_id", "key_type", X.key_type_primitive(F.col("key_type")).alias("primitive")
    )


@query("valid_ja3", f"""SELECT event_id,
    CASE WHEN regexp_full_match(ja3, '[0-9a-f]{{32}}') THEN ja3 END AS ja3 FROM {V.duck(EVE)}""")
def valid_ja3(spark, sf):
    return V.view(spark, sf, EVE).select("event_id", X.valid_ja3(F.col("ja3")).alias("ja3"))


_TARGET = O.sanitize_target("COALESCE(server_name, host || ':' || port)")


@query("target_of_record", f"""SELECT event_id, {_TARGET} AS target,
    '(zeek-log)/' || {_TARGET} || '#' || cipher AS file FROM {V.duck(V.TLS)}""")
def target_of_record(spark, sf):
    target = X.target_of_record(F.col("server_name"), F.col("host"), F.col("port"))
    return V.view(spark, sf, V.TLS).select(
        "event_id", target.alias("target"),
        X.synthetic_file("zeek-log", target, F.col("cipher")).alias("file"),
    )


# --- records to findings --------------------------------------------------------
def ssl_records(spark, sf):
    return V.view(spark, sf, V.TLS).where("established").select(
        F.col("log_no").alias("src_file"), F.lit(0).cast("bigint").alias("src_block"),
        F.col("event_id").alias("row_no"), "uid", F.col("host").alias("resp_host"),
        F.col("port").alias("resp_port"),
        X.normalize_tls_version(F.col("version")).alias("version"), "cipher",
        X.curve_to_group(F.col("curve")).alias("curve"), "server_name",
        F.nullif("shares", F.lit("")).alias("pqc_key_share"),
    )


_SSL_BASE = f"""(SELECT event_id AS row_no, {_TARGET} AS target, cipher,
    {O.curve_group('curve')} AS curve, shares FROM {V.duck(V.TLS)} AS t WHERE established)"""
_NAMED = ", ".join(f"({V.text(n)})" for n in rules.NAMED_GROUPS)
_SSL_FINDINGS = f"""
    SELECT row_no, 'ssl.log/cipher' AS observed_in, '(zeek-log)/' || target || '#' || cipher AS file,
        cipher AS name, {_ZEEK_PRIM.format(c='cipher')} AS primitive, CAST(NULL AS INT) AS negotiated_group,
        CAST(NULL AS STRING) AS group_name, CAST(NULL AS BOOLEAN) AS pqc, CAST(NULL AS STRING) AS maturity
    FROM {_SSL_BASE} WHERE cipher IS NOT NULL
    UNION ALL
    SELECT row_no, 'ssl.log/curve', '(zeek-log)/' || target || '#' || curve, curve, 'key-agree', NULL,
        g.name, g.pqc, g.maturity
    FROM {_SSL_BASE} AS r LEFT JOIN (SELECT * FROM {O.group_values()} WHERE name IN
        (SELECT * FROM (VALUES {_NAMED}))) AS g ON g.name = r.curve WHERE curve IS NOT NULL
    UNION ALL
    SELECT row_no, 'ssl.log/pqc_key_share', '(zeek-log)/' || target || '#' || g.name, g.name,
        'key-agree', g.id, g.name, g.pqc, g.maturity
    FROM (SELECT *, regexp_replace(trim(unnest(string_split(shares, ','))), '^0x', '') AS h
          FROM {_SSL_BASE}) AS r
    JOIN {O.group_values()} ON lower(lpad(to_hex(g.id), 4, '0')) = lower(lpad(h, 4, '0'))
    WHERE h <> ''
"""


@query("ssl_record_to_findings", _SSL_FINDINGS)
def ssl_record_to_findings(spark, sf):
    return R.ssl_record_to_findings(ssl_records(spark, sf)).select(
        "row_no", "observed_in", "file", F.col("algorithm.name").alias("name"),
        F.col("algorithm.primitive").alias("primitive"), "negotiated_group",
        F.col("negotiated_group_name").alias("group_name"), F.col("pqc_present").alias("pqc"),
        F.col("pqc_maturity").alias("maturity"),
    )


def x509_records(spark, sf):
    return V.view(spark, sf, CERTS).where("sig_alg IS NOT NULL OR key_alg IS NOT NULL").select(
        F.col("log_no").alias("src_file"), F.lit(0).cast("bigint").alias("src_block"),
        F.col("event_id").alias("row_no"), "id", "sig_alg", "key_alg", "key_type",
        F.coalesce(F.col("key_length").try_cast("int"), F.lit(0)).alias("key_length"), "curve",
        F.col("san").alias("san_dns"),
    )


_X509_TARGET = O.sanitize_target("COALESCE(NULLIF(split_part(san, ',', 1), ''), id)")


@query("x509_record_to_findings", f"""
    WITH r AS (SELECT *, {_X509_TARGET} AS target,
        COALESCE({O.oid_name('sig_alg')}, sig_alg) AS sig, COALESCE({O.oid_name('key_alg')}, key_alg) AS k
        FROM {V.duck(CERTS)})
    SELECT event_id AS row_no, '(zeek-log)/' || target || '#' || sig AS file, sig AS name,
        'signature' AS primitive, CAST(NULL AS INT) AS key_size FROM r WHERE sig IS NOT NULL
    UNION ALL SELECT event_id, '(zeek-log)/' || target || '#' || k, k,
        {O.mapping('lower(key_type)', rules.KEY_TYPE_PRIMITIVES)},
        NULLIF(COALESCE(TRY_CAST(key_length AS INT), 0), 0) FROM r WHERE k IS NOT NULL""")
def x509_record_to_findings(spark, sf):
    return R.x509_record_to_findings(x509_records(spark, sf)).select(
        "row_no", "file", F.col("algorithm.name").alias("name"),
        F.col("algorithm.primitive").alias("primitive"), F.col("algorithm.key_size").alias("key_size"),
    )


_JA3S = [("0123456789abcdef0123456789abcdef", True, "X25519MLKEM768"),
         ("ffffffffffffffffffffffffffffffff", True, ""), ("00", False, "x")]
_JA3S_VALUES = "(VALUES " + ", ".join(
    f"({V.text(h)}, {V.text(p)}, {V.text(x)})" for h, p, x in _JA3S
) + ") AS j(ja3s, pqc_present, label)"
_LIST = "list_filter(list_transform(string_split({c}, ','), lambda s: trim(s)), lambda s: s <> '')"
_EVE_TARGET = O.sanitize_target("COALESCE(sni, dest_ip || ':' || dest_port)")
_EVE_CLEAN = f"""(SELECT * REPLACE (replace(sigalgs, chr(9), '') AS sigalgs), {_EVE_TARGET} AS target
    FROM {_EVE_ROWS})"""


def ja3s_dim(spark):
    return literal_table(spark, _JA3S, "ja3s string, pqc_present boolean, label string")


@query("eve_record_to_findings", f"""
    SELECT src_file, row_no, 'eve.json/cipher_suite' AS observed_in,
        '(suricata-log)/' || target || '#' || cipher AS file, cipher AS name,
        {_SURI_PRIM.format(c='cipher')} AS primitive, cipher AS raw_identifier,
        CAST(NULL AS BOOLEAN) AS pqc_present FROM {_EVE_CLEAN} WHERE cipher IS NOT NULL
    UNION ALL
    SELECT src_file, row_no, 'eve.json/ja3s', '(suricata-log)/' || target || '#' || l, l, 'key-agree',
        'suricata-ja3s:' || ja3s, TRUE
    FROM (SELECT e.*, COALESCE(NULLIF(label, ''), 'MLKEM768') AS l FROM {_EVE_CLEAN} AS e
          JOIN {_JA3S_VALUES} ON j.ja3s = e.ja3s AND j.pqc_present)
    UNION ALL
    SELECT src_file, row_no, 'eve.json/sigalgs', '(suricata-log)/' || target || '#' || s, s, 'signature', s, NULL
    FROM (SELECT *, unnest({_LIST.format(c='sigalgs')}) AS s FROM {_EVE_CLEAN})
    UNION ALL
    SELECT src_file, row_no, 'eve.json/groups', '(suricata-log)/' || target || '#' || s, s, 'key-agree', s, NULL
    FROM (SELECT *, unnest({_LIST.format(c='groups')}) AS s FROM {_EVE_CLEAN})""")
def eve_record_to_findings(spark, sf):
    return R.eve_record_to_findings(eve_records(spark, sf), ja3s_dim(spark)).select(
        "src_file", "row_no", "observed_in", "file", F.col("algorithm.name").alias("name"),
        F.col("algorithm.primitive").alias("primitive"), "raw_identifier", "pqc_present",
    )


@query("ja3s_lookup", f"""SELECT e.src_file, e.row_no, e.ja3s,
    COALESCE(NULLIF(label, ''), 'MLKEM768') AS ja3s_label FROM {_EVE_ROWS} AS e
    JOIN {_JA3S_VALUES} ON j.ja3s = e.ja3s AND j.pqc_present""")
def ja3s_lookup(spark, sf):
    return R.ja3s_lookup(eve_records(spark, sf), ja3s_dim(spark)).select(
        "src_file", "row_no", "ja3s", "ja3s_label"
    )


@query("cap_list", f"""SELECT src_file, row_no, len({_LIST.format(c='groups')}) AS n,
    array_to_string(({_LIST.format(c='groups')})[1:3], '|') AS head
    FROM {_EVE_CLEAN} WHERE groups IS NOT NULL""")
def cap_list(spark, sf):
    groups = R.split_list(F.col("groups"))
    return eve_records(spark, sf).where(F.col("groups").isNotNull()).select(
        "src_file", "row_no", F.size(groups).cast("bigint").alias("n"),
        F.array_join(R.cap_list(groups, 3), "|").alias("head"),
    )


def _first(keys, columns, source):
    ks = ", ".join(keys)
    return f"""SELECT {', '.join(columns)} FROM (SELECT *, row_number() OVER (
        PARTITION BY {ks} ORDER BY row_no) AS rn FROM {source}) WHERE rn = 1"""


_SSL_REC = f"""(SELECT log_no AS src_file, event_id AS row_no, uid, host AS resp_host, port AS resp_port,
    cipher, {O.curve_group('curve')} AS curve, NULLIF(shares, '') AS pqc_key_share
    FROM {V.duck(V.TLS)} AS t WHERE established)"""


@query("dedup_ssl", _first(
    ["src_file", "resp_host", "resp_port", "cipher", "curve", "pqc_key_share"],
    ["src_file", "row_no", "uid", "resp_host", "resp_port", "cipher", "curve", "pqc_key_share"],
    _SSL_REC))
def dedup_ssl(spark, sf):
    return R.dedup_ssl(ssl_records(spark, sf)).drop("src_block", "version", "server_name")


@query("dedup_x509", _first(
    ["src_file", "sig_alg", "key_alg", "key_type", "key_length", "curve"],
    ["src_file", "row_no", "id", "sig_alg", "key_alg", "key_type", "key_length", "curve", "san_dns"],
    f"""(SELECT log_no AS src_file, event_id AS row_no, id, sig_alg, key_alg, key_type,
        COALESCE(TRY_CAST(key_length AS INT), 0) AS key_length, curve, san AS san_dns
        FROM {V.duck(CERTS)} AS t WHERE sig_alg IS NOT NULL OR key_alg IS NOT NULL)"""))
def dedup_x509(spark, sf):
    return R.dedup_x509(x509_records(spark, sf)).drop("src_block")


@query("dedup_eve", _first(
    ["src_file", "dest_ip", "dest_port", "cipher", "version", "sni"],
    ["src_file", "row_no", "dest_ip", "dest_port", "cipher", "version", "sni", "ja3s", "groups"],
    _EVE_ROWS))
def dedup_eve(spark, sf):
    return R.dedup_eve(eve_records(spark, sf)).drop("src_block", "event_time", "ja3", "sigalgs")


# --- endpoints ------------------------------------------------------------------
def endpoints(spark, sf):
    """Observations with the group lists of the enumeration filled in."""
    lists = F.when(F.col("event_id") % 4 < 2, F.array(F.lit(4588), F.lit(29))).cast("array<int>")
    retry = F.when(F.col("event_id") % 5 == 0, F.array(F.lit(4589))).otherwise(
        F.array().cast("array<int>")
    )
    return V.view(spark, sf, V.ENDPOINTS).withColumns({
        "accepted_groups": lists, "hrr_groups": retry,
        "sig_algs": F.when(F.col("event_id") % 3 == 1, F.array(F.lit(0x0905), F.lit(0x0804))),
    })


def _suite_parts(name):
    """SQL list of ``name|primitive|size|mode`` for a suite name."""
    bulk = "CASE " + " ".join(
        f"WHEN starts_with(_rest, '{p}') THEN '{a}|symmetric|{s}|{m or ''}'"
        for p, a, s, m in rules.BULK_CIPHERS) + " END"
    digest = "CASE " + " ".join(
        f"WHEN ends_with(_rest, '{s}') THEN '{a}|hash||'" for s, a in rules.SUITE_HASHES) + " END"
    return f"""list_filter([
        CASE WHEN _kex IS NOT NULL THEN split_part(_kex, '_', 1) || '|key-exchange||' END,
        CASE WHEN _kex IS NOT NULL THEN CASE WHEN contains(_kex, '_')
            THEN substr(_kex, instr(_kex, '_') + 1) ELSE _kex END || '|signature||' END,
        {bulk}, {digest}], lambda p: p IS NOT NULL)"""


_SUITE = O.mapping("cipher_suite", rules.CIPHER_SUITES, "'0x' || lpad(to_hex(cipher_suite), 4, '0')")
_SUITES = f"""(SELECT *, CASE WHEN contains(_body, '_WITH_') THEN split_part(_body, '_WITH_', 1) END AS _kex,
    CASE WHEN contains(_body, '_WITH_') THEN split_part(_body, '_WITH_', 2) ELSE _body END AS _rest
    FROM (SELECT *, regexp_replace(suite_name, '^TLS_', '') AS _body
          FROM (SELECT *, {_SUITE} AS suite_name FROM {V.duck(V.ENDPOINTS)})))"""
_PARTS = f"""(SELECT *, split_part(_p, '|', 1) AS name, split_part(_p, '|', 2) AS primitive,
    TRY_CAST(split_part(_p, '|', 3) AS INT) AS key_size, NULLIF(split_part(_p, '|', 4), '') AS mode
    FROM (SELECT *, unnest({_suite_parts('suite_name')}) AS _p FROM {_SUITES}))"""


@query("decompose_cipher_suite", f"""SELECT event_id, cipher_suite, suite_name, name, primitive,
    key_size, mode FROM {_PARTS}""")
def decompose_cipher_suite(spark, sf):
    return R.decompose_cipher_suite(
        V.view(spark, sf, V.ENDPOINTS).select("event_id", "cipher_suite")
    )


_KNOWN = "(g.pqc IS TRUE)"
_OBSERVED = f"""
    WITH o AS (SELECT s.*, g.name AS group_name, g.pqc IS TRUE AS pqc, g.maturity,
        bytes_in + bytes_out AS total
        FROM {_SUITES} AS s LEFT JOIN {O.group_values()} ON g.id = s.negotiated_group),
    f AS (
        SELECT event_id, CASE split_part(_p, '|', 2) WHEN 'key-exchange' THEN '#kex' WHEN 'signature'
                THEN '#sig' WHEN 'symmetric' THEN '#sym' ELSE '#mac' END AS suffix,
            split_part(_p, '|', 1) AS name, split_part(_p, '|', 2) AS primitive,
            TRY_CAST(split_part(_p, '|', 3) AS INT) AS key_size,
            split_part(_p, '|', 2) || ':' || split_part(_p, '|', 1) || '|' || suite_name AS raw
        FROM (SELECT *, unnest({_suite_parts('suite_name')}) AS _p FROM o)
        UNION ALL SELECT event_id, '#cert', leaf_cert_key_algo, 'signature', leaf_cert_key_size,
            'cert:' || leaf_cert_key_algo FROM o WHERE leaf_cert_key_algo <> ''
        UNION ALL SELECT event_id, '#cert-sig', leaf_cert_sig_algo, 'digital-signature', NULL,
            'cert-sig:' || leaf_cert_sig_algo FROM o WHERE leaf_cert_sig_algo <> ''
        UNION ALL SELECT event_id, '#kex', CASE WHEN pqc THEN group_name ELSE 'ECDHE' END,
            'key-exchange', NULL, 'kex:' || CASE WHEN pqc THEN group_name ELSE 'ECDHE' END
            FROM o WHERE tls_version = 772
        UNION ALL SELECT event_id, '#tls12-fallback', 'TLS_1.2_Fallback', 'key-exchange', NULL,
            'tls12-fallback:' || COALESCE(tls12_cipher_suite, '') FROM o WHERE accepted_tls12 AND pqc)
    SELECT f.event_id, '(tls-probe)/' || target || suffix AS file, f.name, f.primitive, f.key_size,
        raw || '|' || target AS raw_identifier, group_name, pqc AS pqc_present, maturity,
        CASE WHEN total < 7000 THEN 'classical' WHEN total < 12000 THEN 'hybrid-kem'
             WHEN total > 20000 THEN 'full-pqc' ELSE 'unknown' END AS volume,
        NULLIF(total, 0) AS handshake_bytes,
        ech_detected OR truncated AS partial_inventory,
        CASE WHEN ech_detected AND truncated
                THEN 'ECH_ENABLED+' || COALESCE(truncation_reason, 'ENUMERATION_TRUNCATED')
             WHEN ech_detected THEN 'ECH_ENABLED'
             WHEN truncated THEN COALESCE(truncation_reason, 'ENUMERATION_TRUNCATED') END AS reason,
        CASE WHEN f.name = 'TLS_1.2_Fallback' THEN 'high' END AS severity
    FROM f JOIN o USING (event_id)"""


@query("tls_observation_to_findings", _OBSERVED)
def tls_observation_to_findings(spark, sf):
    return R.tls_observation_to_findings(endpoints(spark, sf)).select(
        "event_id", "file", F.col("algorithm.name").alias("name"),
        F.col("algorithm.primitive").alias("primitive"), F.col("algorithm.key_size").alias("key_size"),
        "raw_identifier", F.col("negotiated_group_name").alias("group_name"), "pqc_present",
        F.col("pqc_maturity").alias("maturity"), F.col("handshake_volume_class").alias("volume"),
        "handshake_bytes", "partial_inventory", F.col("partial_inventory_reason").alias("reason"),
        "severity",
    )


@query("tls12_downgrade", f"""SELECT event_id, target, 'quantum-vulnerable' AS quantum_risk,
    'high' AS severity, 'immediate' AS hndl_risk FROM {V.duck(V.ENDPOINTS)} AS e
    JOIN {O.group_values()} ON g.id = e.negotiated_group WHERE accepted_tls12 AND g.pqc""")
def tls12_downgrade(spark, sf):
    return R.tls12_downgrade(endpoints(spark, sf)).select(
        "event_id", "target", "quantum_risk", "severity", "hndl_risk"
    )


_ACC = "CASE WHEN event_id % 4 < 2 THEN '4588,29' ELSE '' END"
_HRR = "CASE WHEN event_id % 5 = 0 THEN '4589' ELSE '' END"
_MODE = """CASE WHEN COALESCE(pref_forward, 0) = 0 OR COALESCE(pref_reverse, 0) = 0
    THEN 'indeterminate' WHEN pref_forward = pref_reverse THEN 'server-fixed' ELSE 'client-order' END"""


@query("merge_supported_groups", f"""
    SELECT event_id, kex, CASE WHEN on_ THEN NULLIF(concat_ws(',', NULLIF({_ACC}, ''), NULLIF({_HRR}, '')), '')
            END AS supported_groups,
        CASE WHEN on_ AND event_id % 3 = 1 THEN '2309,2052' END AS sig_algs,
        CASE WHEN on_ AND {_MODE} <> 'indeterminate' THEN pref_forward END AS preferred,
        CASE WHEN on_ THEN {_MODE} END AS mode
    FROM (SELECT *, kex AND enumeration_mode IS NOT NULL AS on_
          FROM (SELECT *, unnest([TRUE, FALSE]) AS kex FROM {V.duck(V.ENDPOINTS)}))""")
def merge_supported_groups(spark, sf):
    rows = endpoints(spark, sf).withColumn("kex", F.explode(F.array(F.lit(True), F.lit(False))))
    rows = rows.withColumn("algorithm", F.struct(
        F.when(F.col("kex"), "key-exchange").otherwise("hash").alias("primitive")
    ))
    return R.merge_supported_groups(rows).select(
        "event_id", "kex", F.array_join("supported_groups", ",").alias("supported_groups"),
        F.array_join("supported_sig_algs", ",").alias("sig_algs"),
        F.col("server_preferred_group").alias("preferred"),
        F.col("server_preference_mode").alias("mode"),
    )


@query("handshake_volume_class", """SELECT event_id, CASE WHEN b < 7000 THEN 'classical'
    WHEN b < 12000 THEN 'hybrid-kem' WHEN b > 20000 THEN 'full-pqc' ELSE 'unknown' END AS volume
    FROM (SELECT event_id, event_id * 997 % 25000 AS b FROM events)""")
def handshake_volume_class(spark, sf):
    size = F.col("event_id") * 997 % 25000
    return V.table(spark, sf, "events").select(
        "event_id", X.handshake_volume_class(size).alias("volume")
    )


@query("server_preference", f"SELECT event_id, {_MODE} AS mode FROM {V.duck(V.ENDPOINTS)}")
def server_preference(spark, sf):
    return V.view(spark, sf, V.ENDPOINTS).select(
        "event_id", X.server_preference(F.col("pref_forward"), F.col("pref_reverse")).alias("mode")
    )


_LENGTHS = ", ".join(f"({g}, {c}, {s})" for g, c, s in rules.KEY_SHARE_LENGTHS)


@query("key_share_length_check", f"""
    SELECT event_id, group_id, side, length, CASE WHEN group_id IN (4587, 4588, 4589, 4590) THEN 'hybrid-kem'
        WHEN group_id IN (512, 513, 514) THEN 'pure-pq' ELSE 'classical' END AS family,
        CASE side WHEN 'client' THEN k.c ELSE k.s END AS expected_length,
        CASE side WHEN 'client' THEN k.c ELSE k.s END = length AS length_ok
    FROM (SELECT event_id, group_id, CASE WHEN event_id % 2 = 0 THEN 'client' ELSE 'server' END AS side,
        CASE WHEN event_id % 3 = 0 THEN 1216 ELSE 32 END AS length FROM {V.duck(V.TLS)}) AS t
    LEFT JOIN (VALUES {_LENGTHS}) AS k(id, c, s) ON k.id = t.group_id""")
def key_share_length_check(spark, sf):
    rows = V.view(spark, sf, V.TLS).select(
        "event_id", F.col("group_id").alias("group"),
        F.when(F.col("event_id") % 2 == 0, "client").otherwise("server").alias("side"),
        F.when(F.col("event_id") % 3 == 0, 1216).otherwise(32).alias("length"),
    )
    return R.key_share_length_check(rows).withColumnRenamed("group", "group_id")


@query("tls_group_lookup", f"""SELECT event_id, group_id, g.name AS group_name,
    g.pqc IS TRUE AS group_pqc, g.maturity AS group_maturity FROM {V.duck(V.TLS)} AS t
    LEFT JOIN {O.group_values()} ON g.id = t.group_id""")
def tls_group_lookup(spark, sf):
    return R.tls_group_lookup(
        V.view(spark, sf, V.TLS).select("event_id", "group_id"), "group_id"
    )


@query("sig_alg_oid", f"""SELECT event_id, sig_alg, {O.oid_name('sig_alg')} AS oid_name
    FROM {V.duck(CERTS)}""")
def sig_alg_oid(spark, sf):
    return R.sig_alg_oid(V.view(spark, sf, CERTS).select("event_id", "sig_alg"), "sig_alg")


_SCHEMES = sorted(rules.SIGNATURE_SCHEMES) + [0x0001, 0xFE00]


@query("sig_scheme_name", f"""SELECT event_id, scheme, {O.mapping('scheme', rules.SIGNATURE_SCHEMES,
    "'0x' || lpad(lower(to_hex(scheme)), 4, '0')")} AS scheme_name
    FROM (SELECT event_id, unnest([{pick(f'event_id % {len(_SCHEMES)}', _SCHEMES)}, 2309]) AS scheme
          FROM events)""")
def sig_scheme_name(spark, sf):
    ids = V.expr(pick(f"event_id % {len(_SCHEMES)}", _SCHEMES))
    rows = V.table(spark, sf, "events").select(
        "event_id", F.array(ids, F.lit(2309)).alias("scheme")
    )
    return R.sig_scheme_name(rows, "scheme")


METHODS = ["mlkem768x25519-sha256", "sntrup761x25519-sha512@openssh.com", "curve25519-sha256",
           "diffie-hellman-group14-sha1", "x-FrodoKEM-640", "ecdh-sha2-nistp256", ""]
SSH = f"""SELECT event_id, 'h' || {string('user_id % 50')} || ':22' AS target,
    {pick(f'event_id % {len(METHODS)}', METHODS)} AS m1,
    {pick(f'{div("event_id", 2)} % {len(METHODS)}', METHODS)} AS m2 FROM {{events}}"""
_MATURITY = f"""COALESCE({O.mapping('method', rules.SSH_PQC_METHODS)},
    CASE WHEN {O.any_part('lower(method)', rules.SSH_PQC_HINTS)} THEN 'draft' END)"""
_SSH_ROWS = f"""(SELECT event_id, target, unnest([m1, m2]) AS method FROM {V.duck(SSH)})"""


def ssh_offers(spark, sf):
    rows = V.view(spark, sf, SSH).select("event_id", "target", F.array("m1", "m2").alias("kex_methods"))
    return certs.load_ssh_kex(rows)


@query("load_ssh_kex", f"SELECT * FROM {_SSH_ROWS} WHERE method <> ''")
def load_ssh_kex(spark, sf):
    return ssh_offers(spark, sf)


@query("ssh_kex_lookup", f"""SELECT event_id, target, method, {_MATURITY} IS NOT NULL AS pqc_present,
    {_MATURITY} AS pqc_maturity FROM {_SSH_ROWS} WHERE method <> ''""")
def ssh_kex_lookup(spark, sf):
    return R.ssh_kex_lookup(ssh_offers(spark, sf))


@query("ssh_kex_to_findings", f"""SELECT event_id, '(ssh-probe)/' || target || '#kex' AS file,
    method AS name, CASE WHEN {_MATURITY} IS NOT NULL THEN 'quantum-safe' END AS quantum_risk,
    'ssh-kex:' || method || '|' || target AS raw_identifier FROM {_SSH_ROWS} WHERE method <> ''""")
def ssh_kex_to_findings(spark, sf):
    return R.ssh_kex_to_findings(ssh_offers(spark, sf)).select(
        "event_id", "file", F.col("algorithm.name").alias("name"), "quantum_risk", "raw_identifier"
    )


# --- certificates ---------------------------------------------------------------
TIMES = ["2024-03-01T10:20:30", "2024-03-01T10:20:30.125", "2024-03-01 10:20:30", "2024-03-01", "x"]
CT = f"""SELECT o_orderkey AS id, 'H' || {string('o_custkey % 50')} || '.Example.:443' AS hostname,
    {pick(f'o_orderkey % {len(TIMES)}', TIMES)} AS not_before,
    'AB' || {string('o_orderkey * 7919')} || 'CDEF01' AS serial_number,
    CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN 'RSA' END AS sig_algorithm,
    {pick('o_orderkey % 4', ['RSA', 'ECDSA', 'Ed25519', 'unknown'])} AS pub_key_algorithm,
    {pick('o_orderkey % 4', [2048, 256, 256, 0])} AS pub_key_size,
    CASE WHEN o_orderkey % 4 = 1 THEN 'P-256' END AS pub_key_curve FROM {{orders}}"""
CT_TIMES = ["2024-03-01 10:20:30.000", "2024-03-01 10:20:30.125", "2024-03-01 10:20:30.000",
            "2024-03-01 00:00:00.000", None]


@query("load_ct_certificates", f"""SELECT id, {pick(f'id % {len(TIMES)}', CT_TIMES)} AS not_before
    FROM {V.duck(CT)}""")
def load_ct_certificates(spark, sf):
    rows = V.view(spark, sf, CT).withColumn("not_after", F.col("not_before"))
    return certs.with_cert_times(rows).select(
        "id", F.date_format("not_before", "yyyy-MM-dd HH:mm:ss.SSS").alias("not_before")
    )


@query("ct_record_to_finding", f"""SELECT id,
    '(ct-lookup)/' || hostname || '#cert:' || serial_number AS file, n AS name,
    NULLIF(pub_key_size, 0) AS key_size, pub_key_curve AS curve,
    'ct-cert:' || hostname || '|' || n || '|' || serial_number AS raw_identifier
    FROM (SELECT *, COALESCE(NULLIF(sig_algorithm, ''), pub_key_algorithm) AS n FROM {V.duck(CT)})""")
def ct_record_to_finding(spark, sf):
    return R.ct_record_to_finding(V.view(spark, sf, CT)).select(
        "id", "file", F.col("algorithm.name").alias("name"),
        F.col("algorithm.key_size").alias("key_size"), F.col("algorithm.curve").alias("curve"),
        "raw_identifier",
    )


HOSTS = ["Example.COM:443", "a.b.", "[2001:db8::1]:8443", "...", "plain", "x:y:z", ":443", "UP.case.."]
CANONICAL = ["example.com", "a.b", "2001:db8::1", None, "plain", "x:y:z", None, "up.case"]


@query("canonical_hostname", f"""SELECT event_id, {pick(f'event_id % {len(HOSTS)}', CANONICAL)} AS host
    FROM events""")
def canonical_hostname(spark, sf):
    raw = V.expr(pick(f"event_id % {len(HOSTS)}", HOSTS))
    return V.table(spark, sf, "events").select("event_id", X.canonical_hostname(raw).alias("host"))


@query("ech_hosts_to_ct", f"""
    WITH hosts AS (SELECT DISTINCT 'h' || user_id % 50 AS host FROM events WHERE event_id % 7 = 0
        UNION SELECT 'h49.example')
    SELECT c.id, h.host FROM {V.duck(CT)} AS c
    JOIN hosts AS h ON h.host = regexp_replace(lower(split_part(c.hostname, ':', 1)), '\\.+$', '')""")
def ech_hosts_to_ct(spark, sf):
    found = R.tls_observation_to_findings(endpoints(spark, sf))
    extra = V.table(spark, sf, "events").where("event_id = 0").select(
        F.lit("H49.example:443").alias("host")
    )
    return N.ech_hosts_to_ct(found, V.view(spark, sf, CT), extra).select("id", "host")


# --- whole plans ----------------------------------------------------------------
_LOG = O.classified(f"({_SSL_FINDINGS})", "s.name", "s.primitive", "CAST(NULL AS INT)")


@query("classified_log_findings", f"""SELECT c_risk AS quantum_risk, c_severity AS severity, name,
    count(*) AS n FROM {_LOG} GROUP BY 1, 2, 3""")
def classified_log_findings(spark, sf):
    found = C.classify_findings(R.ssl_record_to_findings(ssl_records(spark, sf)))
    return found.groupBy("quantum_risk", "severity", F.col("algorithm.name").alias("name")).agg(
        F.count(F.lit(1)).alias("n")
    )


_READY = O.classified(f"({_OBSERVED})", "s.name", "s.primitive", "s.key_size")


@query("host_readiness", f"""
    SELECT host, score, {O.grade('score')} AS grade FROM (
        SELECT host, CAST(round(least(greatest(100 - sum({O.penalty('c_risk', 'c_severity')})
            + 0.5 * count(*) FILTER (c_risk = 'quantum-safe'), 0), 100)) AS INT) AS score
        FROM (SELECT *, regexp_extract(file, '/([^#:]*)', 1) AS host FROM {_READY}) GROUP BY host)""")
def host_readiness(spark, sf):
    """Flagship: endpoint observations to a readiness score per host."""
    found = N.endpoint_findings(endpoints(spark, sf))
    hosts = found.withColumn("host", F.regexp_extract("file", "/([^#:]*)", 1))
    return score.qrs(hosts, by=("host",))
