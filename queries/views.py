"""Views that give the driver's tables the columns of our inputs.

The tables hold no crypto data, so every view derives it from ids with integer
arithmetic.  The SQL below is written in the common part of Spark SQL and DuckDB
and used by both; ``{events}`` and the like stand for the tables.
"""

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoreline import schema

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def text(value) -> str:
    """SQL literal; None is NULL."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + value.replace("'", "''") + "'"


def pick(expr: str, values) -> str:
    """The value at place ``expr`` of a list.

    Lists are written differently in the two dialects, so this leaves marks that
    :func:`for_spark` and :func:`for_duck` replace.
    """
    return "«" + ", ".join(text(v) for v in values) + "¦" + expr + "»"


def for_spark(sql: str) -> str:
    return sql.replace("«", "get(array(").replace("¦", "), CAST(").replace("»", " AS INT))")


def for_duck(sql: str) -> str:
    return sql.replace("«", "list_element([").replace("¦", "], 1 + CAST(").replace("»", " AS INT))")


def expr(sql: str):
    """A Column from the common dialect."""
    return F.expr(for_spark(sql))


def div(expr: str, n: int) -> str:
    """Integer quotient of a number that is not negative."""
    return f"CAST(floor(({expr}) / {n}) AS BIGINT)"


def string(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


# --- findings ----------------------------------------------------------------
# raw name, primitive, size
ALGORITHMS = [
    ("AES-256-GCM", "symmetric", 256), ("aes_128_cbc", "symmetric", 128), ("AES", None, None),
    ("RSA", "signature", 2048), ("RSA-2048", "pke", 2048), ("rsa", "key-exchange", 4096),
    ("RSASSA-PSS", None, None), ("RSA-OAEP", None, None), ("ECDSA", "signature", 521),
    ("ecdsa-p256", "signature", None), ("ECDHE", "key-exchange", None), ("ECDH", "kem", 384),
    ("X25519", "key-agree", None), ("X448", "key-agree", None), ("DH-2048", None, 2048),
    ("Ed25519", "signature", None), ("DSA", "digital-signature", 1024),
    ("EC-KCDSA-P256", "signature", None), ("SM2", "signature", None), ("SM4-GCM", "ae", None),
    ("GOST R 34.10-2012", "signature", None), ("MD5", "hash", None), ("sha1", "hash", None),
    ("SHA-256", "hash", None), ("SHA3-512", "hash", None), ("SHA224", "hash", None),
    ("HmacSHA1", "mac", None), ("HMAC-SHA256", "mac", None), ("HMAC", "mac", None),
    ("3DES", "symmetric", 168), ("DES-CBC", "symmetric", 56), ("RC4_128", "stream-cipher", None),
    ("ChaCha20-Poly1305", "ae", None), ("SEED-128-ECB", "symmetric", None),
    ("LSH-256-224", "hash", None), ("LSH-512-512", "hash", None), ("ARIA-192", "symmetric", 192),
    ("ML-KEM-768", "kem", None), ("ml_kem_512", "kem", None), ("MLKEM1024", "kem", None),
    ("X25519MLKEM768", "kem", None), ("X25519-MLKEM-768", "kem", None),
    ("SecP384r1MLKEM1024", "key-exchange", None), ("X25519Kyber768Draft00", "kem", None),
    ("Kyber512", "kem", None), ("dilithium3", "signature", None), ("ML-DSA-44", "signature", None),
    ("ML-DSA-87", "signature", None), ("mldsa65", "signature", None),
    ("SLH-DSA-SHA2-128s", "signature", None), ("slhdsa-shake-256f", "signature", None),
    ("HashML-DSA-65", "signature", None), ("Falcon-512", "signature", None), ("HQC-128", "kem", None),
    ("XMSS-SHA2-10-256", "signature", None), ("SMAUG-T-128", "kem", None),
    ("NCC-Sign-2", "signature", None), ("A256GCM", "pke", None), ("TLS", "protocol", None),
    ("TLSv1.2", "protocol", None), ("TLS 1.3", "protocol", None), ("SSL", "protocol", None),
    ("SSLv3", "protocol", None), ("tls1.0", "protocol", None), ("CSPRNG", "rng", None),
    ("Argon2id", "kdf", None), ("FooCipher", None, None), ("FooKex", "key-agree", None),
    ("TLS_AES_128_GCM_SHA256", "ae", None), ("BLAKE2b-160", "hash", None),
    ("Camellia-128", "symmetric", None), ("Twofish", "symmetric", 64),
]
ENGINES = ["cipherscope", "cryptoscan", "semgrep", "config-scanner", "tls-probe"]
FOLDERS = ["src/core", "src/test", "lib/gen", "vendor/acme", "conf", "cmd/tool/testdata"]
LEAVES = ["auth.go", "sign_test.py", "Cipher.java", "mock_tls.go", "application.yml", "kex.ts",
          "nginx.conf", "api.pb.go", "Main.cs", "lib.rs"]
CONFIDENCES = ["low", "medium-low", "medium", "medium-high", "high"]
REACHABLE = ["unknown", "no", "yes", "unknown"]
LIBRARIES = ["openssl", "bcprov", "libsodium", "pycryptodome", "ring", "golang.org/x/crypto"]
CURVES = ["secp256r1", "P-384", "1.3.132.0.35", "Curve25519", "djb/Ed448", "nope"]


def _findings(event: str, place: str, source: str) -> str:
    """Findings from two numbers: one per row, and one that several rows share."""
    n = len(ALGORITHMS)
    # rows of one place use three names, each seen by several feeds
    which = f"(({place}) * 5 + ({event}) % 3) % {n}"
    kind = (
        f"CASE WHEN ({place}) % 11 = 10 THEN 'lib' WHEN ({place}) % 13 = 12 THEN 'raw' "
        "ELSE 'alg' END"
    )
    engine = f"(({event}) % 3 + {div(event, 4)}) % {len(ENGINES)}"
    return f"""
    SELECT seq, place, kind, engine_rank, project,
           {pick('engine_rank', ENGINES)} AS source_engine,
           {pick(f'place % {len(FOLDERS)}', FOLDERS)} || '/m' || {string('place % 997')} || '/' ||
               {pick(f'{div("place", 6)} % {len(LEAVES)}', LEAVES)} AS file,
           CAST(1 + place % 40 AS INT) AS line, CAST(seq % 7 AS INT) AS col,
           CASE WHEN place % 19 = 3 THEN 'inner/A.class' END AS inner_path,
           CASE WHEN kind = 'alg' THEN {pick('alg_no', [a[0] for a in ALGORITHMS])} END AS alg_name,
           CASE WHEN kind = 'alg' AND seq % 5 <> 4
                THEN {pick('alg_no', [a[1] for a in ALGORITHMS])} END AS primitive,
           CASE WHEN kind = 'alg' AND seq % 4 <> 3
                THEN {pick('alg_no', [a[2] for a in ALGORITHMS])} END AS key_size,
           CASE WHEN kind = 'alg' AND seq % 9 = 4 THEN 'gcm' END AS mode,
           CASE WHEN kind = 'alg' AND seq % 8 = 5 THEN {pick(f'seq % {len(CURVES)}', CURVES)} END
               AS curve,
           CASE WHEN kind = 'lib' THEN {pick(f'place % {len(LIBRARIES)}', LIBRARIES)} END AS library,
           CASE WHEN kind = 'lib' AND seq % 3 = 0 THEN '1.' || {string('place % 4')} END AS version,
           {pick(f'seq % {len(CONFIDENCES)}', CONFIDENCES)} AS confidence,
           {pick(f'{div("seq", 3)} % {len(REACHABLE)}', REACHABLE)} AS reachable,
           'raw-' || {string('place % 37')} AS raw_identifier
    FROM (SELECT {event} AS seq, {place} AS place, {which} AS alg_no, {kind} AS kind,
                 CAST({engine} AS INT) AS engine_rank,
                 'p' || {string(f'({place}) % 23')} AS project
          FROM {source}) AS t
    """


FINDINGS = _findings("event_id", div("event_id", 6), "{events}")
FINDINGS_BIG = _findings(
    "l_orderkey * 8 + l_linenumber", "l_partkey * 7 + l_suppkey % 7", "{lineitem}"
)

# --- TLS records -------------------------------------------------------------
CIPHERS = [
    "TLS_AES_128_GCM_SHA256", "TLS_AES_256_GCM_SHA384", "TLS_CHACHA20_POLY1305_SHA256",
    "TLS_ECDHE_RSA_WITH_AES_128_GCM_SHA256", "TLS_ECDHE_ECDSA_WITH_AES_256_GCM_SHA384",
    "TLS_RSA_WITH_AES_128_CBC_SHA", "TLS_RSA_WITH_3DES_EDE_CBC_SHA", "TLS_DHE_RSA_WITH_RC4_128_SHA",
    "ECDSA-ONLY", None,
]
SUITE_IDS = [0x1301, 0x1302, 0x1303, 0xC02F, 0xC02C, 0x002F, 0x000A, 0xCCA9, 0xC012, 0x4242]
VERSIONS = ["TLSv12", "TLSv13", "TLS 1.1", "tls10", "SSLv3", "DTLSv12"]
CURVE_NAMES = ["secp256r1", "x25519", "X25519MLKEM768", "prime256v1", "-", "brainpoolP256r1",
               "mlkem1024", "ffdhe2048"]
GROUP_IDS = [0x11EC, 0x001D, 0x0017, 0x6399, 0x0201, 0x11ED, 0x4588, 0x0100, 0x11EB, 0]
SHARES = ["0x11ec,001d", None, "0017", "11ED, 0x0201,zzzz", "ffff,0x6399", ""]

TLS = f"""
    SELECT event_id, user_id, ts, 'log' || {string('user_id % 4')} AS log_no,
           'uid' || {string('event_id % 50')} AS uid,
           '10.0.' || {string('user_id % 5')} || '.' || {string('event_id % 6')} AS host,
           {string('443 + user_id % 3')} AS port,
           {pick('event_id % 6', VERSIONS)} AS version,
           {pick('event_id % 10', CIPHERS)} AS cipher,
           {pick(f'{div("event_id", 2)} % 8', CURVE_NAMES)} AS curve,
           CASE WHEN event_id % 3 = 0 THEN 'h' || {string('user_id % 50')} || '.example/x' END
               AS server_name,
           {pick(f'{div("event_id", 3)} % 6', SHARES)} AS shares,
           event_type <> 'error' AS established,
           {pick('event_id % 10', SUITE_IDS)} AS suite_id,
           {pick(f'{div("event_id", 5)} % 10', GROUP_IDS)} AS group_id
    FROM {{events}}
"""

# --- endpoints ---------------------------------------------------------------
LEAF_KEYS = ["RSA", "ECDSA", "Ed25519", "ML-DSA-65", None]
LEAF_SIZES = [2048, 256, None, None, None]
LEAF_SIGS = ["SHA256-RSA", "ECDSA-SHA384", "", "mldsa87", "RSA"]

ENDPOINTS = f"""
    SELECT event_id, 'h' || {string('user_id % 50')} || ':443' AS target,
           CASE WHEN event_id % 3 = 0 THEN 771 ELSE 772 END AS tls_version,
           {pick('event_id % 10', SUITE_IDS)} AS cipher_suite,
           {pick(f'{div("event_id", 5)} % 10', GROUP_IDS)} AS negotiated_group,
           {pick('event_id % 5', LEAF_KEYS)} AS leaf_cert_key_algo,
           {pick('event_id % 5', LEAF_SIZES)} AS leaf_cert_key_size,
           {pick(f'{div("event_id", 2)} % 5', LEAF_SIGS)} AS leaf_cert_sig_algo,
           event_id % 7 = 0 AS ech_detected,
           CAST(event_id % 5 * 4000 AS BIGINT) AS bytes_in,
           CAST(event_id % 3 * 3500 AS BIGINT) AS bytes_out,
           event_id % 4 = 0 AS accepted_tls12,
           CASE WHEN event_id % 8 = 0 THEN 'TLS_RSA_WITH_AES_128_CBC_SHA' END AS tls12_cipher_suite,
           CASE WHEN event_id % 6 < 3 THEN 'full' END AS enumeration_mode,
           event_id % 10 = 0 AS truncated,
           CASE WHEN event_id % 20 = 0 THEN 'TIME_LIMIT' END AS truncation_reason,
           {pick('event_id % 3', [29, 0, 4588])} AS pref_forward,
           {pick(f'{div("event_id", 3)} % 3', [29, 23, 4588])} AS pref_reverse
    FROM {{events}}
"""

# --- source text -------------------------------------------------------------
CODE = [
    "x := rsa.New() // crypto:ignore", "h = md5() # crypto:ignore[MD5, SHA-1] -- legacy",
    's := "# crypto:ignore" + y', "/* crypto:ignore[TLS] : old peers */",
    "<!-- crypto:ignore[AES] -->", "const KEY_BITS = 2048", "# crypto:ignored", "plain text",
]
# Every document is a file of two lines of code and then its whole text.  Documents 2k and
# 2k + 1 are the same file in two projects, with lines of their own.
_FIRST, _SECOND = pick(f"doc_id % {len(CODE)}", CODE), pick(f"{div('doc_id', 3)} % {len(CODE)}", CODE)
FILES = f"""
    SELECT doc_id, 'p' || {string('doc_id % 2')} AS project, 'd' || {string(div('doc_id', 2))} AS file,
           {_FIRST} || chr(10) || {_SECOND} || chr(10) || COALESCE(text, '') AS content
    FROM {{documents}}
"""


def lines_of(files: str) -> str:
    """The lines of whole files, for DuckDB."""
    return f"""(SELECT project, file, CAST(i AS INT) AS line_no, t AS text FROM (
        SELECT project, file, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS t
        FROM (SELECT project, file, string_split(content, chr(10)) AS l FROM {duck(files)})))"""


# --- history -----------------------------------------------------------------
HISTORY = f"""
    SELECT 'p' || {string('o_custkey % 40')} AS project, o_orderkey AS scan_seq,
           '2024-01-' || lpad({string('1 + o_orderkey % 28')}, 2, '0') || 'T' ||
               lpad({string('o_orderkey % 24')}, 2, '0') || ':00:00Z' AS timestamp,
           CAST(o_orderkey * 7 % 101 AS INT) AS score,
           {pick('o_orderkey % 4', ['A+', 'A', 'B', 'F'])} AS grade,
           CAST(o_orderkey % 60 AS BIGINT) AS total, CAST(o_orderkey % 5 AS BIGINT) AS critical,
           CAST(o_orderkey % 7 AS BIGINT) AS high, CAST(o_orderkey % 3 AS BIGINT) AS medium,
           CAST(o_orderkey % 2 AS BIGINT) AS low, CAST(o_orderkey % 4 AS BIGINT) AS info,
           CASE WHEN o_orderkey % 6 = 0 THEN CAST(0 AS BIGINT)
                ELSE CAST(o_orderkey % 11 AS BIGINT) END AS vulnerable,
           CAST(0 AS BIGINT) AS weakened,
           CASE WHEN o_orderkey % 6 = 0 THEN CAST(0 AS BIGINT)
                ELSE CAST(o_orderkey % 9 AS BIGINT) END AS safe,
           CAST(0 AS BIGINT) AS resistant,
           CASE WHEN o_orderkey % 6 = 0 THEN CAST(0 AS BIGINT)
                ELSE CAST(o_orderkey % 8 AS BIGINT) END AS deprecated
    FROM {{orders}}
"""

# --- configuration -----------------------------------------------------------
KEYS = ["algorithm", "app.encryptionAlgorithm", "sslProtocol", "server.ssl.cipher-suites",
        "cipherSuites", "expectedAlgorithms[0]", "key.size", "keyLength", "jwt.alg", "tls.groups",
        "hashing", "hash", "signature", "kex", "user.name", "digest", "SSLProtocol", "key_exchange"]
VALUES = ["AES-256-GCM", "aes", "TLSv1.2", "TLS 1.3", "ECDHE-RSA", "2048 bits", "256", "RS256",
          "x25519mlkem768", "x25519", "sha256", "SHA-1", "desktop", "des", "rsa", "99999",
          "aesgcm", "HS512", "mlkem"]
SETTINGS = f"""
    SELECT 'conf/f' || {string(div('event_id', 40))} || '.yml' AS file,
           CAST(event_id % 40 AS INT) AS line,
           {pick(f'event_id % {len(KEYS)}', KEYS)} AS key,
           {pick(f'event_id * 7 % {len(VALUES)}', VALUES)} AS value
    FROM {{events}}
"""


def tables_of(sql: str) -> list:
    return [t for t in TABLES if re.search(r"\{" + t + r"\}", sql)]


def duck(sql: str) -> str:
    """The view for DuckDB, as a subquery."""
    return "(" + for_duck(sql.format(**{t: t for t in tables_of(sql)})) + ")"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The view in Spark."""
    tables = {t: table(spark, sf_dir, t) for t in tables_of(sql)}
    return spark.sql(for_spark(sql), **tables)


def findings(spark: SparkSession, sf_dir: str, sql: str = FINDINGS) -> DataFrame:
    """The findings view with our findings schema; ``project`` and ``place`` stay."""
    flat = view(spark, sf_dir, sql)
    is_alg = F.col("alg_name").isNotNull()
    nested = flat.withColumns({
        "algorithm": F.when(is_alg, schema.algorithm(
            F.col("alg_name"), F.col("primitive"), F.col("key_size"), F.col("mode"), F.col("curve")
        )),
        "dependency": F.when(F.col("library").isNotNull(), F.struct("library", "version")),
    })
    conformed = schema.FINDING
    have = set(nested.columns)
    return nested.select(
        "place",
        *[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in conformed.items()],
    )
