"""Expressions that read identifiers of scanning tools."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from shoreline.functions.text import (
    blank_to_null,
    contains_any,
    ends_with_any,
    lookup,
    lookup_spelling,
    starts_with_any,
)
from shoreline.rules import files, formats


def parse_algorithm_columns(identifier: Column) -> Column:
    """Size, mode and curve in ``AES-256-GCM``.

    The first number of at least 64 is the size; of modes and curves the last
    one counts.  Digits of post-quantum names are parameter sets, not sizes.
    """
    whole = contains_any(F.upper(identifier), formats.ID_PQC_NAMES)
    parts = F.split(identifier, "-")
    tail = F.when(~whole & (F.size(parts) > 1), F.slice(parts, F.lit(2), F.size(parts)))
    numbers = F.filter(
        F.transform(tail, lambda p: F.when(p.rlike("^[+-]?[0-9]{1,9}$"), p.cast("int"))),
        lambda n: n >= 64,
    )
    upper = F.transform(tail, lambda p: F.upper(p))

    def last_of(words):
        return F.try_element_at(F.filter(upper, lambda p: p.isin(words)), F.lit(-1))

    return F.struct(
        F.get(numbers, F.lit(0)).alias("key_size"),
        last_of(formats.ID_MODES).alias("mode"),
        last_of(formats.ID_CURVES).alias("curve"),
    )


def primitive_from_rule_id(rule_id: Column) -> Column:
    lower = F.lower(rule_id)
    out = F.when(F.lit(False), F.lit(""))
    for parts, endings, primitive in formats.RULE_ID_PRIMITIVES:
        hit = contains_any(lower, parts)
        if endings:
            hit = hit | ends_with_any(lower, endings)
        out = out.when(hit, primitive)
    return out


def infer_from_rule_id(rule_id: Column) -> Column:
    """Algorithm and primitive that the tokens of a rule id point to."""
    lower = F.lower(rule_id)
    tokens = F.split(lower, "[-_./]+")
    name = F.when(F.lit(False), F.lit(""))
    for words, algorithm in formats.RULE_ID_ALGORITHMS:
        hit = F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in words]))
        if algorithm == "DES":
            hit = hit | lower.contains("triple-des")
        name = name.when(hit, algorithm)
    return F.struct(
        name.alias("algorithm"), primitive_from_rule_id(rule_id).alias("primitive")
    )


def purl_namespace(purl: Column) -> Column:
    """Namespace of a package URL, NULL when it has none."""
    rest = F.substring_index(F.regexp_replace(purl, "^[^/]*/", ""), "@", 1)
    return F.when(purl.contains("/") & rest.contains("/"), F.substring_index(rest, "/", 1))


def purl_manifest(purl: Column, base: str) -> Column:
    """Manifest file that a package of this type is listed in."""
    kind = F.regexp_extract(purl, "^pkg:([^/]*)/", 1)
    manifest = lookup(kind, files.PURL_MANIFESTS)
    folder = "" if base in ("", ".") else base.rstrip("/") + "/"
    return F.coalesce(F.concat(F.lit(folder), manifest), F.lit(base))


def jca_transform(s: Column) -> Column:
    """Name, mode and primitive of a Java security string, NULL if it is none.

    Reads ``AES/GCM/NoPadding``, ``HmacSHA256``, ``SHA256withRSA``, ``TLSv1.2``.
    """
    up = F.upper(s)
    none = F.lit(None).cast("string")

    def found(name, primitive, mode=none):
        primitive = primitive if isinstance(primitive, Column) else F.lit(primitive)
        return F.struct(
            name.alias("name"), mode.alias("mode"), primitive.alias("primitive")
        )

    is_version = up.startswith("TLSV") | up.startswith("SSLV")
    head = F.substring_index(s, "/", 1)
    mode = blank_to_null(F.get(F.split(s, "/", 3), F.lit(1)))
    kind = lookup_spelling(F.upper(head), formats.JCA_TRANSFORMS)
    kind = F.when(
        (F.upper(head) == "AES") & F.upper(mode).isin(formats.JCA_AEAD_MODES), "ae"
    ).otherwise(kind)
    not_crypto = (
        s.contains(" ") | (F.length(s) <= 1) | (s.contains(".") & ~is_version)
        | s.rlike("^[a-z][^/]*/") | starts_with_any(up, formats.JCA_NOT_CRYPTO)
    )
    inner = F.regexp_replace(F.regexp_replace(up, "^HMAC", ""), "^WITH", "")
    hmac_mode = F.when(
        up.contains("SHA"), F.coalesce(lookup(inner, formats.JCA_HMAC_HASHES), blank_to_null(inner))
    )
    is_hash = up.isin(formats.JCA_HASHES) | starts_with_any(up, formats.JCA_HASH_PREFIXES)
    return (
        F.when(F.coalesce(s, F.lit("")) == "", None)
        .when(not_crypto, None)
        .when(
            is_version | up.isin("TLS", "SSL"),
            found(F.lit("TLS"), "protocol",
                  F.when(is_version, blank_to_null(F.substr(s, F.lit(5))))),
        )
        .when(up.startswith("PBKDF2") | up.isin(formats.JCA_KDFS), found(s, "kdf"))
        .when(up.startswith("HMAC"), found(F.lit("HMAC"), "mac", hmac_mode))
        .when(up.startswith("CHACHA20"), found(s, "ae"))
        .when(s.contains("/"), F.when(kind.isNotNull(), found(head, kind, mode)))
        .when(
            up.isin(formats.JCA_SIGNATURES) | contains_any(up, formats.JCA_SIGNATURE_PARTS),
            found(s, "signature"),
        )
        .when(is_hash, found(s, "hash"))
        .when(up.isin(formats.JCA_KEY_EXCHANGES), found(s, "key-exchange"))
        .when(up == "AES", found(F.lit("AES"), "symmetric"))
        .when(up.isin(formats.JCA_CIPHERS), found(s, "symmetric"))
        .when(up == "RSA", found(F.lit("RSA"), "pke"))
    )
