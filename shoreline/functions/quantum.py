"""Quantum-risk classification as Column expressions.

What a name alone decides (family, sizes spelled in it, targets) is one struct,
:func:`name_facts`; :func:`outcome` adds primitive and key size.  The struct is
costly string work, so :mod:`shoreline.operators.known` looks it up for names it
knows and works it out for the others.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from shoreline.functions.text import (
    blank_to_null,
    let,
    literal_array,
    longest_prefix,
    lookup,
    lookup_spelling,
    starts_with_any,
)
from shoreline.rules import advice
from shoreline.rules import quantum as rules

CLASSIFICATION_TYPE = (
    "struct<risk:string,severity:string,hndl:string,advice:string,"
    "target:string,standard:string>"
)


def _by_upper(names):
    return {n.upper(): n for n in names}


def _prefix(upper, names):
    """The entry of ``names`` that is the longest prefix of ``upper``."""
    return lookup(longest_prefix(upper, [n.upper() for n in names]), _by_upper(names))


def base_name(name: Column) -> Column:
    """Family of an algorithm name: ``AES-256-GCM`` gives ``AES``.

    Tables are asked in order and the first answer counts.  Keyed digests
    (``HMAC-SHA1``, ``HmacSHA1``) are read as their inner digest.
    """
    inner = F.regexp_replace(name, r"(?is)^(?:HMAC-(?=.)|HMAC(?=.))+", "")
    upper = F.upper(inner)
    dashless = F.replace(upper, F.lit("-"), F.lit(""))
    # longest original name first, compared without hyphens
    safe = sorted(rules.PQC_SAFE, key=len, reverse=True)
    dashless_safe = {}
    for n in safe:
        dashless_safe.setdefault(n.upper().replace("-", ""), n)
    eliminated = F.regexp_extract(
        upper, r"(?s)^(" + "|".join(n.upper() for n in rules.ELIMINATED) + r")(?:-.*)?$", 1
    )
    return F.coalesce(
        _prefix(upper, rules.WHOLE_NAMES),
        lookup(upper, rules.JOSE_NAMES),
        lookup(F.replace(upper, F.lit(" "), F.lit("")), rules.PROTOCOL_NAMES),
        _prefix(upper, rules.PQC_SAFE),
        F.when(dashless != upper, lookup(longest_prefix(dashless, dashless_safe), dashless_safe)),
        lookup(upper, _by_upper(rules.DEPRECATED)),
        _prefix(upper, rules.PRE_STANDARD),
        _prefix(upper, rules.VULNERABLE),
        lookup(blank_to_null(eliminated), _by_upper(rules.ELIMINATED)),
        blank_to_null(F.regexp_extract(inner, "([^-_]+)", 1)),
        inner,
    )


def normalize_primitive(primitive: Column) -> Column:
    lower = F.lower(F.coalesce(primitive, F.lit("")))
    return F.coalesce(lookup_spelling(lower, rules.PRIMITIVE_SYNONYMS), lower)


def is_likely_symmetric(upper: Column) -> Column:
    return starts_with_any(upper, rules.SYMMETRIC_PREFIXES)


def is_likely_hash(upper: Column) -> Column:
    return starts_with_any(upper, rules.HASH_PREFIXES)


def _size_in_name(upper, sizes):
    return F.coalesce(
        *[F.when(upper.contains(str(n)), F.lit(n)) for n in sizes], F.lit(0)
    )


def hash_output_size(base: Column, upper: Column, size: Column) -> Column:
    """Digest bits: the given size, else digits in the name, else the family's."""
    base_up = F.upper(base)
    in_name = _size_in_name(upper, rules.HASH_SIZES_IN_NAME)
    return (
        F.when(size > 0, size)
        .when(in_name > 0, in_name)
        .when(base_up == "MD5", F.lit(128))
        .when(base_up.isin("SHA-1", "SHA1", "HAS-160"), F.lit(160))
        .otherwise(F.lit(0))
    )


def symmetric_key_size(upper: Column) -> Column:
    """Key bits from the name; 256 is looked for first, even in ``..._SHA256``."""
    return (
        F.when(upper.contains("CHACHA20"), F.lit(256))
        .when(upper.contains("SM4"), F.lit(128))
        .otherwise(_size_in_name(upper, rules.KEY_SIZES_IN_NAME))
    )


def migration_target(base: Column) -> Column:
    """Replacement of a family as ``struct<algorithm, standard>``."""
    upper = F.upper(base)
    algorithms = {n: alg for (alg, _), names in rules.MIGRATION_TARGETS.items() for n in names}
    standards = {
        n: std for (_, std), names in rules.MIGRATION_TARGETS.items() for n in names if std
    }
    return F.struct(
        lookup(upper, algorithms).alias("algorithm"),
        lookup(upper, standards).alias("standard"),
    )


def migration_target_for_size(facts: Column, size: Column) -> Column:
    """Replacement by name facts and key size: the larger parameter set for large keys."""
    short_aes = (F.upper(facts["base"]) == "AES") & size.between(1, 255)
    large = size >= facts["large_from"]
    return F.struct(
        F.when(short_aes, "AES-256").when(large, facts["large_algorithm"])
        .otherwise(facts["target_algorithm"]).alias("algorithm"),
        F.when(short_aes, None).when(large, facts["large_standard"])
        .otherwise(facts["target_standard"]).alias("standard"),
    )


# Outcomes of classification: risk, severity, HNDL risk, advice, fixed target.
# A target in capitals names the rule that picks it.
OUTCOMES = {
    "deprecated": ("deprecated", "critical", None, "retired", "SIZED"),
    "tls12": ("quantum-vulnerable", "medium", "immediate", "tls12-no-pqc", "TLS 1.3"),
    "tls13": ("quantum-resistant", "info", None, "tls13-check-group", None),
    "hqc": ("quantum-safe", "info", None, "hqc-draft", None),
    "falcon": ("quantum-safe", "info", None, "falcon-draft", None),
    "safe": ("quantum-safe", "info", None, None, None),
    "eliminated": ("quantum-vulnerable", "medium", None, "eliminated", "PLAIN"),
    "exchange": ("quantum-vulnerable", "critical", "immediate", "key-exchange", "EXCHANGE"),
    "signature": ("quantum-vulnerable", "high", "deferred", "signature", "SIZED"),
    "asymmetric": ("quantum-vulnerable", "high", "immediate", "asymmetric", "SIZED"),
    "new-signature": ("quantum-vulnerable", "high", "deferred", "unknown-signature", "PLAIN"),
    "new-exchange": (
        "quantum-vulnerable", "critical", "immediate", "unknown-key-exchange", "PLAIN"),
    "rng": ("quantum-resistant", "info", None, "csprng", None),
    "seed-ecb": ("deprecated", "critical", None, "seed-ecb", None),
    "seed": ("quantum-weakened", "low", None, "seed-128", None),
    "lsh-short": ("quantum-weakened", "low", None, "lsh-short", None),
    "lsh-256": ("quantum-weakened", "low", None, "lsh-256", None),
    "hash-short": ("quantum-weakened", "low", None, "hash-short", "SHA-256"),
    "key-tiny": ("quantum-weakened", "medium", None, "key-too-small", "AES-256"),
    "key-128": ("quantum-weakened", "low", None, "key-128", "AES-256"),
    "key-unknown": ("unknown", "low", None, "key-size-unknown", None),
    "resistant": ("quantum-resistant", "info", None, None, None),
    "unknown": ("unknown", "low", None, None, None),
}
_NUMBER = {name: i for i, name in enumerate(OUTCOMES)}


def _outcome(name: str) -> Column:
    return F.lit(_NUMBER[name])


def name_facts(name: Column) -> Column:
    """Everything classification needs to know about a trimmed name."""
    return let(base_name(name), lambda base: _facts(name, base))


def _facts(name: Column, base: Column) -> Column:
    target = migration_target(base)
    upper, base_up = F.upper(name), F.upper(base)
    kind = (
        F.when(base.isin(rules.DEPRECATED) | name.isin(rules.DEPRECATED), "deprecated")
        .when(base == "TLSv1.2", "tls12").when(base == "TLSv1.3", "tls13")
        .when(base == "HQC", "hqc").when(base == "Falcon", "falcon")
        .when(base.isin(rules.PQC_SAFE), "safe")
        .when(base.isin(rules.ELIMINATED), "eliminated")
        .when(base.isin(rules.VULNERABLE), "vulnerable")
        .otherwise("other")
    )
    tiers = {n: (at, alg, std) for names, at, alg, std in rules.SIZE_TIERS for n in names}
    zero = F.lit(0)
    return F.struct(
        base.alias("base"),
        kind.alias("kind"),
        lookup_spelling(base_up, advice.DEPRECATED_ADVICE).alias("code"),
        target["algorithm"].alias("target_algorithm"),
        target["standard"].alias("target_standard"),
        lookup(base_up, {n: t[0] for n, t in tiers.items()}).alias("large_from"),
        lookup(base_up, {n: t[1] for n, t in tiers.items()}).alias("large_algorithm"),
        lookup(base_up, {n: t[2] for n, t in tiers.items()}).alias("large_standard"),
        (is_likely_symmetric(base_up) | is_likely_symmetric(upper)).alias("looks_symmetric"),
        (is_likely_hash(base_up) | is_likely_hash(upper)).alias("looks_hash"),
        hash_output_size(base, upper, zero).alias("digest_bits"),
        symmetric_key_size(upper).alias("key_bits"),
        base_up.startswith("LSH").alias("is_lsh"),
        (base_up == "SEED").alias("is_seed"),
        upper.contains("ECB").alias("is_ecb"),
        base_up.isin(rules.RESISTANT_HASHES).alias("is_resistant"),
    )


def symmetric_outcome(facts: Column, size: Column, is_hash: Column) -> Column:
    """Outcome of a cipher by key size, or of a digest by output size."""
    digest = F.when(size > 0, size).otherwise(facts["digest_bits"])
    key = F.when(size > 0, size).otherwise(facts["key_bits"])
    weak_digest = digest.between(1, 255)
    lsh, seed = facts["is_lsh"], facts["is_seed"]
    return (
        F.when(seed & facts["is_ecb"], _outcome("seed-ecb"))
        .when(seed, _outcome("seed"))
        .when(lsh & (digest >= 512), _outcome("resistant"))
        .when(lsh & weak_digest, _outcome("lsh-short"))
        .when(lsh & (digest == 256), _outcome("lsh-256"))
        .when(is_hash & weak_digest, _outcome("hash-short"))
        .when(is_hash & (facts["is_resistant"] | (digest >= 256)), _outcome("resistant"))
        .when(is_hash, _outcome("unknown"))
        .when(key <= 0, _outcome("key-unknown"))
        .when(key < 128, _outcome("key-tiny"))
        .when(key < 256, _outcome("key-128"))
        .otherwise(_outcome("resistant"))
    )


def outcome(facts: Column, primitive: Column, size: Column) -> Column:
    """Place in :data:`OUTCOMES` from name facts, normalised primitive and size (0 unknown)."""
    kind = facts["kind"]
    exchange = primitive.isin("pke", "key-agree", "kem")
    digest_primitive = primitive.isin("hash", "xof", "mac", "kdf")
    cipher_primitive = primitive.isin("symmetric", "ae")
    looks = facts["looks_symmetric"] | facts["looks_hash"]
    is_hash = digest_primitive | (
        ~cipher_primitive & ~facts["looks_symmetric"] & facts["looks_hash"]
    )
    vulnerable = kind == "vulnerable"
    out = F.when(vulnerable & exchange, _outcome("exchange")).when(
        vulnerable & (primitive == "signature"), _outcome("signature")
    ).when(vulnerable, _outcome("asymmetric"))
    for same in ("deprecated", "safe", "tls12", "tls13", "hqc", "falcon", "eliminated"):
        out = out.when(kind == same, _outcome(same))
    return (
        out.when(primitive == "signature", _outcome("new-signature"))
        .when(primitive == "rng", _outcome("rng"))
        .when(
            digest_primitive | cipher_primitive | looks, symmetric_outcome(facts, size, is_hash)
        )
        .when(exchange, _outcome("new-exchange"))
        .otherwise(_outcome("unknown"))
    )


def classification(number: Column, facts: Column, size: Column) -> Column:
    """The classification struct of an outcome."""
    def field(i):
        return F.get(literal_array([o[i] for o in OUTCOMES.values()]), number)

    target = field(4)
    rule = target.isin("SIZED", "PLAIN", "EXCHANGE")
    large = rule & (target != "PLAIN") & (size >= facts["large_from"])
    algorithm = F.when(large, facts["large_algorithm"]).otherwise(facts["target_algorithm"])
    standard = F.when(large, facts["large_standard"]).otherwise(facts["target_standard"])
    # a signature scheme used to exchange keys goes to ML-KEM
    to_kem = (target == "EXCHANGE") & (standard == "FIPS 204")
    return F.struct(
        field(0).alias("risk"), field(1).alias("severity"), field(2).alias("hndl"),
        F.when(number == _outcome("deprecated"), F.coalesce(facts["code"], field(3)))
        .otherwise(field(3)).alias("advice"),
        F.when(to_kem, "ML-KEM-768").when(rule, algorithm).otherwise(target).alias("target"),
        F.when(to_kem, "FIPS 203").when(rule, standard).alias("standard"),
    )


def migration_effort(risk: Column, primitive: Column, is_config: Column) -> Column:
    """``simple``, ``moderate`` or ``complex``; NULL when there is nothing to do."""
    p = normalize_primitive(primitive)
    return (
        F.when(risk == "deprecated", "simple")
        .when(
            risk == "quantum-weakened",
            F.when(p.isin("hash", "xof", "mac", "kdf") | is_config, "simple")
            .otherwise("moderate"),
        )
        .when(
            risk == "quantum-vulnerable",
            F.when(p == "signature", "moderate")
            .when(p.isin("key-agree", "kem", "pke") & is_config, "moderate")
            .otherwise("complex"),
        )
    )


def upgrade_effort(effort: Column, blast: Column) -> Column:
    """One level up when the blast radius is over 70."""
    raised = F.when(effort == "simple", "moderate").when(effort == "moderate", "complex")
    return F.when(blast > 70, F.coalesce(raised, effort)).otherwise(effort)


def advice_text(code: Column) -> Column:
    """Wording of an advice code."""
    return lookup(code, advice.ADVICE)
