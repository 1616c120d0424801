"""Expressions over TLS, SSH and certificate fields."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from shoreline.functions.text import blank_to_null, contains_any, lookup, lookup_spelling, strip
from shoreline.rules import quantum, tls

# Control characters below 0x20 and 0x7F; targets also lose URL delimiters.
_CONTROL = r"[\x00-\x1F\x7F]"
_CONTROL_AND_URL = r"[\x00-\x1F\x7F/?#]"


def sanitize_field(c: Column) -> Column:
    return F.regexp_replace(c, _CONTROL, "")


def sanitize_target(c: Column) -> Column:
    return F.regexp_replace(c, _CONTROL_AND_URL, "")


def normalize_tls_version(c: Column) -> Column:
    """``TLSv1.2``, ``TLS 1.2`` and ``tls12`` give ``1.2``; others stay."""
    key = F.lower(F.replace(c, F.lit(" "), F.lit("")))
    return F.coalesce(lookup_spelling(key, tls.TLS_VERSIONS), c)


def curve_to_group(c: Column) -> Column:
    """Group name of a curve spelling; blank and ``-`` give NULL."""
    return F.coalesce(
        lookup(F.lower(c), tls.CURVE_GROUPS), F.nullif(blank_to_null(c), F.lit("-"))
    )


def cipher_primitive_zeek(c: Column) -> Column:
    up = F.upper(c)
    return (
        F.when(up.contains("ECDH") | up.contains("DHE"), "key-agree")
        .when(up.contains("RSA"), "asymmetric")
        .when(up.startswith("TLS_AES_") | up.startswith("TLS_CHACHA20_"), "ae")
    )


def cipher_primitive_suricata(c: Column) -> Column:
    up = F.upper(c)
    return (
        F.when(up.contains("DHE") | up.contains("DH_"), "key-agree")
        .when(up.contains("RSA"), "asymmetric")
        .when(up.contains("ECDSA"), "signature")
        .otherwise("symmetric")
    )


def key_type_primitive(c: Column) -> Column:
    return lookup(F.lower(c), tls.KEY_TYPE_PRIMITIVES)


def valid_ja3(c: Column) -> Column:
    """The fingerprint without control characters if it is 32 lower-case hex digits."""
    clean = sanitize_field(c)
    return F.when(clean.rlike("^[0-9a-f]{32}$"), clean)


def target_of_record(name: Column, host: Column, port: Column) -> Column:
    """The server name if there is one, else ``host:port``."""
    fallback = F.concat(F.coalesce(host, F.lit("")), F.lit(":"), F.coalesce(port, F.lit("")))
    return sanitize_target(F.coalesce(blank_to_null(name), fallback))


def synthetic_file(engine: str, target: Column, name: Column) -> Column:
    """Findings without a file live at ``(engine)/target#algorithm``."""
    return F.concat(F.lit(f"({engine})/"), target, F.lit("#"), sanitize_field(name))


def resolve_oid(c: Column) -> Column:
    """Name of a post-quantum OID, also when written ``unknown <oid>``; NULL if none."""
    oid = strip(F.regexp_replace(strip(c), "^unknown ", ""))
    names = {tls.SIGNATURE_OID_ARC + str(n): v for n, v in tls.SIGNATURE_OIDS.items()}
    names.update({tls.KEM_OID_ARC + str(n): v for n, v in tls.KEM_OIDS.items()})
    return lookup(oid, names)


def group_name(codepoint: Column) -> Column:
    return lookup(codepoint, {g[0]: g[1] for g in quantum.TLS_GROUPS})


def group_is_pqc(codepoint: Column) -> Column:
    """TRUE or FALSE for known groups, NULL otherwise."""
    return lookup(codepoint, {g[0]: g[2] for g in quantum.TLS_GROUPS})


def group_maturity(codepoint: Column) -> Column:
    return lookup(codepoint, {g[0]: g[3] for g in quantum.TLS_GROUPS if g[3]})


def group_codepoint(name: Column) -> Column:
    """Codepoint of a group name as logs write it."""
    return lookup(name, {g[1]: g[0] for g in quantum.TLS_GROUPS if g[1] in tls.NAMED_GROUPS})


def hex_codepoint(c: Column) -> Column:
    """A 16-bit number from hex text with or without ``0x``; NULL if it is not one."""
    digits = F.regexp_replace(strip(c), "^0x", "")
    return F.when(
        digits.rlike("^0*[0-9a-fA-F]{1,4}$"), F.conv(digits, 16, 10).cast("int")
    )


def signature_scheme(codepoint: Column) -> Column:
    """Name of a TLS SignatureScheme, else its number in hex."""
    return F.coalesce(
        lookup(codepoint, tls.SIGNATURE_SCHEMES),
        F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(codepoint)), 4, "0")),
    )


def ssh_kex_maturity(method: Column) -> Column:
    """``final`` or ``draft`` for post-quantum SSH methods, NULL for classical ones."""
    return F.coalesce(
        lookup(method, tls.SSH_PQC_METHODS),
        F.when(contains_any(F.lower(method), tls.SSH_PQC_HINTS), "draft"),
    )


def handshake_volume_class(total: Column) -> Column:
    """Kind of handshake by its size; sizes between the bounds are unknown."""
    return (
        F.when(total < tls.VOLUME_CLASSICAL_BELOW, "classical")
        .when(total < tls.VOLUME_HYBRID_BELOW, "hybrid-kem")
        .when(total > tls.VOLUME_FULL_PQC_ABOVE, "full-pqc")
        .otherwise("unknown")
    )


def server_preference(forward: Column, reverse: Column) -> Column:
    """Who orders the groups, from the groups chosen for an order and its reverse."""
    known = (F.coalesce(forward, F.lit(0)) != 0) & (F.coalesce(reverse, F.lit(0)) != 0)
    return (
        F.when(~known, "indeterminate")
        .when(forward == reverse, "server-fixed")
        .otherwise("client-order")
    )


def preferred_group(forward: Column, reverse: Column) -> Column:
    return F.when(server_preference(forward, reverse) != "indeterminate", forward)


def canonical_hostname(c: Column) -> Column:
    """Lower case, without port and trailing dots; NULL when nothing is left."""
    host = F.lower(c)
    bracketed = F.regexp_extract(host, r"^\[([^\]]*)\]:[^:]*$", 1)
    plain = F.regexp_replace(host, r"^([^:\[\]]*):[^:]*$", "$1")
    host = F.coalesce(blank_to_null(bracketed), plain)
    return blank_to_null(F.regexp_replace(host, r"\.+$", ""))


def suite_name(codepoint: Column) -> Column:
    """IANA name of a suite codepoint, else the number as ``0x%04X``."""
    return F.coalesce(
        lookup(codepoint, tls.CIPHER_SUITES),
        F.concat(F.lit("0x"), F.lpad(F.hex(codepoint), 4, "0")),
    )


def suite_components(name: Column) -> Column:
    """Parts of a cipher suite: key exchange, authentication, cipher, digest.

    Reads the name's grammar ``TLS_<kex>[_<auth>]_WITH_<cipher>_<hash>``; suites
    of TLS 1.3 have no ``_WITH_`` and give cipher and digest only.
    """
    body = F.regexp_replace(name, "^TLS_", "")
    has_kex = body.contains("_WITH_")
    kex_auth = F.regexp_extract(body, "^(.*?)_WITH_", 1)
    rest = F.when(has_kex, F.regexp_extract(body, "^.*?_WITH_(.*)$", 1)).otherwise(body)
    kex = F.substring_index(kex_auth, "_", 1)
    auth = F.when(kex_auth.contains("_"), F.regexp_replace(kex_auth, "^[^_]*_", "")).otherwise(kex)

    def part(n, primitive, size=None, mode=None):
        return F.struct(
            n.alias("name"), F.lit(primitive).alias("primitive"),
            F.lit(size).cast("int").alias("key_size"), F.lit(mode).cast("string").alias("mode"),
        )

    cipher = F.when(F.lit(False), part(F.lit(""), "symmetric"))
    for prefix, algorithm, size, mode in tls.BULK_CIPHERS:
        cipher = cipher.when(
            rest.startswith(prefix), part(F.lit(algorithm), "symmetric", size, mode)
        )
    digest = F.when(F.lit(False), part(F.lit(""), "hash"))
    for suffix, algorithm in tls.SUITE_HASHES:
        digest = digest.when(rest.endswith(suffix), part(F.lit(algorithm), "hash"))
    return F.array_compact(F.array(
        F.when(has_kex, part(kex, "key-exchange")),
        F.when(has_kex, part(auth, "signature")),
        cipher, digest,
    ))


def key_share_family(codepoint: Column) -> Column:
    return (
        F.when(codepoint.isin(tls.HYBRID_GROUPS), "hybrid-kem")
        .when(codepoint.isin(tls.PURE_PQ_GROUPS), "pure-pq")
        .otherwise("classical")
    )


def expected_key_share(codepoint: Column, side: Column) -> Column:
    """Bytes a key share of this group must have on the client or server side."""
    return F.when(
        side == "client", lookup(codepoint, {g: c for g, c, _ in tls.KEY_SHARE_LENGTHS})
    ).when(side == "server", lookup(codepoint, {g: s for g, _, s in tls.KEY_SHARE_LENGTHS}))
