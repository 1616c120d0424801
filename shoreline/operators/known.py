"""Facts about algorithm names: looked up for known names, worked out for others.

Judging a name takes many string scans, and the same few hundred names make up
nearly all rows.  The known names come from our own rule tables, so their facts
are a table of fixed size that is safe to broadcast; a row with a known name costs
one hash lookup.  Rows with other names take the long way inside the same
projection.  Nothing is shuffled either way.
"""

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoreline.rules import config, impact, quantum, registry, tls
from shoreline.tables import literal_table

# Names that certificates use for signature and key algorithms.
_CERTIFICATE_NAMES = [
    "MD2-RSA", "MD5-RSA", "SHA1-RSA", "SHA256-RSA", "SHA384-RSA", "SHA512-RSA", "SHA256-RSAPSS",
    "SHA384-RSAPSS", "SHA512-RSAPSS", "DSA-SHA1", "DSA-SHA256", "DSA-SHA384", "DSA-SHA512",
    "ECDSA-SHA1", "ECDSA-SHA256", "ECDSA-SHA384", "ECDSA-SHA512", "md5WithRSAEncryption",
    "sha1WithRSAEncryption", "sha256WithRSAEncryption", "sha384WithRSAEncryption",
    "sha512WithRSAEncryption", "ecdsa-with-SHA1", "ecdsa-with-SHA256", "ecdsa-with-SHA384",
    "ecdsa-with-SHA512", "rsaEncryption", "id-ecPublicKey",
]


@cache
def known_names() -> tuple:
    """Names of the rule tables in their usual spellings; about two thousand."""
    names = {n for n, _, _ in registry.patterns()} | set(registry.families())
    names |= {*quantum.PQC_SAFE, *quantum.ELIMINATED, *quantum.VULNERABLE, *quantum.DEPRECATED}
    names |= {*quantum.JOSE_NAMES, *quantum.PROTOCOL_NAMES, *quantum.PROTOCOL_NAMES.values()}
    names |= {g[1] for g in quantum.TLS_GROUPS} | set(tls.SIGNATURE_SCHEMES.values())
    names |= {*tls.CURVE_GROUPS, *tls.SSH_PQC_METHODS, *tls.CIPHER_SUITES.values()}
    names |= {r[3] for r in config.vocabulary()} | {s[0] for s in impact.SIZES}
    names |= {*impact.TARGETS, *quantum.GENERIC_PROTOCOLS, "TLS_1.2_Fallback", "EC", "SHA"}
    names |= set(_CERTIFICATE_NAMES)
    spelled = names | {n.lower() for n in names} | {n.upper() for n in names}
    return tuple(sorted(spelled | {n.replace("-", "_") for n in spelled}))


def with_facts(
    df: DataFrame, name: Column, facts: Callable[[Column], Column], out: str
) -> DataFrame:
    """Add ``out``, the value or struct ``facts(name)``; NULL where the name is NULL."""
    table = literal_table(df.sparkSession, [(n,) for n in known_names()], "_known string")
    table = F.broadcast(table.select("_known", facts(F.col("_known")).alias("_known_facts")))
    joined = df.withColumn("_asked", name).join(
        table, F.col("_asked") == F.col("_known"), "left"
    )
    # Inside a lambda the long way stays out of the generated code of the
    # projection, which would otherwise be too large for the JVM to compile.
    worked_out = F.get(F.transform(F.array("_asked"), facts), F.lit(0))
    result = F.when(F.col("_known").isNotNull(), F.col("_known_facts")).when(
        F.col("_asked").isNotNull(), worked_out
    )
    return once(joined, result, out).drop("_asked", "_known", "_known_facts")


def once(df: DataFrame, value: Column, out: str) -> DataFrame:
    """Add ``out``, worked out once per row.

    The optimizer copies the definition of an ordinary column into every later
    filter and projection that names it, which multiplies long definitions.  It
    does not do so with the output of a generator, here of an array of one.
    """
    return df.select("*", F.explode(F.array(value)).alias(out))
