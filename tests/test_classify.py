"""Specimens for classification, effort, targets and groups."""

from pyspark.sql import functions as F

from shoreline.functions import quantum as Q
from shoreline.operators import classify as C

# name, primitive, size, risk, severity, hndl, effort
SPECIMENS = [
    ("RSA-2048", "signature", 2048, "quantum-vulnerable", "high", "deferred", "moderate"),
    ("RSA-2048", "kem", 2048, "quantum-vulnerable", "critical", "immediate", "complex"),
    ("ECDH", "key-exchange", None, "quantum-vulnerable", "critical", "immediate", "complex"),
    ("ECDSA", "signature", None, "quantum-vulnerable", "high", "deferred", "moderate"),
    ("X25519", "key-exchange", None, "quantum-vulnerable", "critical", "immediate", "complex"),
    ("X25519MLKEM768", "kem", None, "quantum-safe", "info", None, None),
    ("X25519-MLKEM-768", "kem", None, "quantum-safe", "info", None, None),
    ("SecP256r1MLKEM768", "kem", None, "quantum-safe", "info", None, None),
    ("ML-KEM-768", "kem", None, "quantum-safe", "info", None, None),
    ("ML-KEM-512", "kem", None, "quantum-safe", "info", None, None),
    ("ML-DSA-65", "signature", None, "quantum-safe", "info", None, None),
    ("SLH-DSA-128s", "signature", None, "quantum-safe", "info", None, None),
    ("SMAUG-T-128", "kem", None, "quantum-safe", "info", None, None),
    ("HAETAE-3", "signature", None, "quantum-safe", "info", None, None),
    ("AES-256-GCM", "symmetric", 256, "quantum-resistant", "info", None, None),
    ("AES-128-CBC", "symmetric", 128, "quantum-weakened", "low", None, "moderate"),
    ("SHA-256", "hash", 256, "quantum-resistant", "info", None, None),
    ("MD5", "hash", None, "deprecated", "critical", None, "simple"),
    ("DES", "symmetric", 56, "deprecated", "critical", None, "simple"),
    # further cases
    (" RSA ", None, None, "quantum-vulnerable", "high", "immediate", "complex"),
    ("HmacSHA1", "mac", None, "deprecated", "critical", None, "simple"),
    ("HMAC-SHA256", "mac", None, "quantum-resistant", "info", None, None),
    ("Kyber512", "kem", None, "deprecated", "critical", None, "simple"),
    ("X25519Kyber768Draft00", "kem", None, "deprecated", "critical", None, "simple"),
    ("A256GCM", "pke", None, "quantum-resistant", "info", None, None),
    ("RSA-OAEP", None, None, "quantum-vulnerable", "high", "immediate", "complex"),
    ("tls 1.2", "protocol", None, "quantum-vulnerable", "medium", "immediate", "complex"),
    ("TLSv1.3", "protocol", None, "quantum-resistant", "info", None, None),
    ("NCC-Sign-1", None, None, "quantum-vulnerable", "medium", None, "complex"),
    ("SEED-ECB", "symmetric", None, "deprecated", "critical", None, "simple"),
    ("LSH-256-256", "hash", 256, "quantum-weakened", "low", None, "simple"),
    ("TLS_AES_128_GCM_SHA256", "ae", None, "quantum-resistant", "info", None, None),
    ("ML_KEM_768", "kem", None, "quantum-vulnerable", "critical", "immediate", "complex"),
    ("FooSig", "signature", None, "quantum-vulnerable", "high", "deferred", "moderate"),
    ("CSPRNG", "rng", None, "quantum-resistant", "info", None, None),
    ("GOST", None, None, "unknown", "low", None, None),
    ("GOST R 34.10-2012", None, None, "quantum-vulnerable", "high", "immediate", "complex"),
    ("Falcon512", None, None, "quantum-safe", "info", None, None),
    ("AES", "symmetric", None, "unknown", "low", None, None),
    ("DES3X", "symmetric", 64, "quantum-weakened", "medium", None, "moderate"),
]


def test_specimens(spark):
    df = spark.createDataFrame(
        [(i, s[0], s[1], s[2]) for i, s in enumerate(SPECIMENS)],
        "id int, name string, primitive string, key_size int",
    )
    out = C.classify_algorithm(df).withColumn(
        "effort",
        Q.migration_effort(F.col("quantum_risk"), F.col("primitive"), F.lit(False)),
    ).orderBy("id").collect()
    got = [(r["name"], r["primitive"], r["key_size"], r["quantum_risk"], r["severity"],
            r["hndl_risk"], r["effort"]) for r in out]
    assert got == SPECIMENS


def test_base_names(spark):
    cases = {
        "AES-256-GCM": "AES", "SHA-256": "SHA", "smaug-t-128": "SMAUG-T", "NTRU+-576": "NTRU+",
        "EC-KCDSA-P256": "EC-KCDSA", "slhdsa-sha2-128s": "slhdsa-sha2-128s",
        "SLHDSA128": "SLHDSA128", "SLH-DSA-SHA2-128s": "SLH-DSA", "MLKEM768": "MLKEM768",
        "HMAC-HMAC-MD5": "MD5", "HMAC": "HMAC", "SSL 3.0": "SSLv3", "ECDHE-RSA": "ECDHE",
        "RSASSA-PSS-x": "RSASSA-PSS", "--": "--", "_x-y": "x", "SPHINCS+-128s": "SPHINCS+",
        "mldsa65": "mldsa65", "ML-DSA65": "ML-DSA", "3DES-CBC": "3DES",
    }
    df = spark.createDataFrame([(k,) for k in cases], "name string")
    got = {r[0]: r[1] for r in df.select("name", Q.base_name(F.col("name"))).collect()}
    assert got == cases


def test_targets_by_size(spark):
    df = spark.createDataFrame(
        [("RSA", 4096), ("RSA", 2048), ("ECDSA", 521), ("ECDH", 384), ("AES", 128), ("AES", 256),
         ("MD5", 0), ("X448", 0)],
        "name string, key_size int",
    )
    got = [(r["target_algorithm"], r["target_standard"])
           for r in C.migration_target(df).collect()]
    assert got == [
        ("ML-DSA-87", "FIPS 204"), ("ML-DSA-65", "FIPS 204"), ("ML-DSA-87", "FIPS 204"),
        ("ML-KEM-1024", "FIPS 203"), ("AES-256", None), (None, None), ("SHA-256", None),
        ("ML-KEM-1024", "FIPS 203"),
    ]
