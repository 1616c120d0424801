"""Fixed values for quantum-risk classification."""

# --- fixed values -----------------------------------------------------------

# Families counted as quantum safe: FIPS 203/204/205, selected NIST schemes,
# Korean finalists, IETF hybrid groups and the short names certificates use.
PQC_SAFE = [
    "ML-KEM", "ML-DSA", "SLH-DSA", "HQC", "XMSS", "LMS", "Falcon", "FN-DSA",
    "SMAUG-T", "HAETAE", "AIMer", "NTRU+",
    "X25519MLKEM768", "SecP256r1MLKEM768", "SecP384r1MLKEM1024", "curveSM2MLKEM768",
    "MLKEM512", "MLKEM768", "MLKEM1024",
    "mldsa44", "mldsa65", "mldsa87",
    "slhdsa-sha2-128s", "slhdsa-sha2-128f", "slhdsa-sha2-192s",
    "slhdsa-sha2-192f", "slhdsa-sha2-256s", "slhdsa-sha2-256f",
    "slhdsa-shake-128s", "slhdsa-shake-128f", "slhdsa-shake-192s",
    "slhdsa-shake-192f", "slhdsa-shake-256s", "slhdsa-shake-256f",
]

# Korean candidates that were eliminated.
ELIMINATED = ["GCKSign", "NCC-Sign", "SOLMAE", "TiGER", "PALOMA", "REDOG"]

# Asymmetric families broken by Shor's algorithm.
VULNERABLE = [
    "RSA", "RSASSA-PKCS1", "RSASSA-PSS", "RSAES-PKCS1", "RSAES-OAEP",
    "DSA", "ECDSA", "ECDH", "ECDHE", "EdDSA", "Ed25519", "Ed448",
    "X25519", "X448", "FFDH", "DH", "Diffie-Hellman", "ElGamal", "ECIES",
    "MQV", "ECMQV", "KCDSA", "EC-KCDSA", "SM2", "GOST R 34.10", "GOST3410",
]

# Broken or superseded whatever quantum computers do.
DEPRECATED = [
    "MD5", "MD4", "MD2", "SHA-1", "SHA1",
    "DES", "3DES", "DES-EDE3", "Triple-DES", "TDEA", "RC2", "RC4", "RC5",
    "Blowfish", "HAS-160", "TLSv1.0", "TLSv1.1", "SSLv3", "SSLv2",
    "X25519Kyber768Draft00", "X25519Kyber512Draft00", "X25519Kyber1024Draft00",
    "Kyber", "Dilithium", "SPHINCS+", "SPHINCS",
]

# Pre-standard names that also match as a prefix (Kyber512, Dilithium3).
PRE_STANDARD = ["Kyber", "Dilithium", "SPHINCS+", "SPHINCS"]

# Multi-part names taken whole before anything else is tried.
WHOLE_NAMES = ["SMAUG-T", "NTRU+", "EC-KCDSA", "HAS-160", "NCC-Sign"]

# JOSE tokens (RFC 7518), upper case.
JOSE_NAMES = {
    "RSA-OAEP": "RSAES-OAEP", "RSA-OAEP-256": "RSAES-OAEP", "RSA1_5": "RSAES-PKCS1",
    "A128GCM": "AES", "A192GCM": "AES", "A256GCM": "AES",
    "A128CBC-HS256": "AES", "A192CBC-HS384": "AES", "A256CBC-HS512": "AES",
    "A128KW": "AES", "A192KW": "AES", "A256KW": "AES",
    "A128GCMKW": "AES", "A192GCMKW": "AES", "A256GCMKW": "AES",
}

# Protocol versions, upper case and without blanks.
PROTOCOL_NAMES = {
    "TLSV1.0": "TLSv1.0", "TLS1.0": "TLSv1.0",
    "TLSV1.1": "TLSv1.1", "TLS1.1": "TLSv1.1",
    "TLSV1.2": "TLSv1.2", "TLS1.2": "TLSv1.2",
    "TLSV1.3": "TLSv1.3", "TLS1.3": "TLSv1.3",
    "SSLV3": "SSLv3", "SSL3": "SSLv3", "SSL3.0": "SSLv3",
    "SSLV2": "SSLv2", "SSL2": "SSLv2", "SSL2.0": "SSLv2",
}

# Names folded together by the duplicate merge.
GENERIC_PROTOCOLS = ["TLS", "SSL"]
VERSIONED_PROTOCOLS = ["TLSv1.0", "TLSv1.1", "TLSv1.2", "TLSv1.3", "SSLv2", "SSLv3"]

# Prefixes (upper case) that mark a name as a symmetric cipher or a hash.
SYMMETRIC_PREFIXES = [
    "AES", "CHACHA", "CAMELLIA", "ARIA", "SEED", "LEA", "ASCON", "TWOFISH",
    "SERPENT", "SM4", "GOST 28147", "GOST28147", "GOST R 34.12", "KUZNYECHIK", "MAGMA",
]
HASH_PREFIXES = [
    "SHA", "BLAKE", "MD5", "MD4", "RIPEMD", "WHIRLPOOL", "LSH", "HMAC", "HKDF",
    "PBKDF", "ARGON", "SCRYPT", "BCRYPT", "SM3", "GOST R 34.11", "GOST3411", "STREEBOG",
]

# Hash and KDF families (upper case) that are resistant when no size is known.
RESISTANT_HASHES = [
    "SHA-3", "SHA3", "BLAKE2", "BLAKE2B", "BLAKE2S", "BLAKE3", "ARGON2", "SCRYPT",
    "HKDF", "PBKDF2", "SHA-2", "SHA-256", "SHA-384", "SHA-512", "SHA256", "SHA384",
    "SHA512", "LSH", "SM3", "GOST R 34.11", "GOST3411", "STREEBOG",
]

# Digits looked for in a name when the size is not given, in this order.
HASH_SIZES_IN_NAME = [512, 384, 256, 224, 160, 128]
KEY_SIZES_IN_NAME = [256, 192, 128]

# Spellings of each primitive, lower case.
PRIMITIVE_SYNONYMS = {
    "pke": ["pke", "public-key", "public_key", "encryption", "jwe", "key-encryption"],
    "kem": ["kem", "key-encapsulation"],
    "key-agree": ["key-agree", "key-exchange", "key_exchange", "keyexchange", "dh"],
    "signature": ["signature", "sign", "digital-signature"],
    "hash": ["hash", "digest"],
    "mac": ["mac", "hmac"],
    "kdf": ["kdf", "key-derivation"],
    "symmetric": ["symmetric", "block-cipher", "block_cipher", "stream-cipher", "stream_cipher"],
    "ae": ["ae", "aead"],
    "xof": ["xof"],
    "rng": ["rng", "prng", "csprng", "random"],
}

# Replacement by base name (upper case): algorithm, standard.
MIGRATION_TARGETS = {
    ("ML-DSA-65", "FIPS 204"): [
        "RSA", "RSASSA-PKCS1", "RSASSA-PSS", "DSA", "ECDSA", "EDDSA", "ED25519",
        "KCDSA", "EC-KCDSA", "DILITHIUM", "SM2", "GOST R 34.10", "GOST3410",
    ],
    ("ML-DSA-87", "FIPS 204"): ["ED448"],
    ("ML-KEM-768", "FIPS 203"): [
        "RSAES-PKCS1", "RSAES-OAEP", "ECDH", "ECDHE", "X25519", "DH", "FFDH",
        "DIFFIE-HELLMAN", "ELGAMAL", "ECIES", "MQV", "ECMQV", "KYBER",
    ],
    ("ML-KEM-1024", "FIPS 203"): ["X448"],
    ("SHA-256", ""): ["MD5", "MD4", "MD2", "SHA-1", "SHA1", "HAS-160"],
    ("AES-256-GCM", ""): [
        "DES", "3DES", "DES-EDE3", "TRIPLE-DES", "TDEA", "RC2", "RC4", "RC5", "BLOWFISH",
    ],
    ("TLS 1.3", ""): ["TLSV1.0", "TLSV1.1", "TLSV1.2", "SSLV3", "SSLV2"],
    ("SLH-DSA-SHA2-128f", "FIPS 205"): ["SPHINCS+", "SPHINCS"],
}

# From this size on the larger parameter set is the target.
SIZE_TIERS = [
    (["RSA", "RSASSA-PKCS1", "RSASSA-PSS"], 4096, "ML-DSA-87", "FIPS 204"),
    (["ECDSA"], 521, "ML-DSA-87", "FIPS 204"),
    (["ECDH", "ECDHE"], 384, "ML-KEM-1024", "FIPS 203"),
]

# TLS named groups: codepoint, name, holds ML-KEM, maturity.
TLS_GROUPS = [
    (0x11EB, "SecP256r1MLKEM768", True, "final"),
    (0x11EC, "X25519MLKEM768", True, "final"),
    (0x11ED, "SecP384r1MLKEM1024", True, "final"),
    (0x11EE, "curveSM2MLKEM768", True, "final"),
    (0x0200, "MLKEM512", True, "final"),
    (0x0201, "MLKEM768", True, "final"),
    (0x0202, "MLKEM1024", True, "final"),
    (0x6399, "X25519Kyber768Draft00", True, "draft"),
    (0x636D, "X25519Kyber768Draft00", True, "draft"),
    (0x0017, "secp256r1", False, ""),
    (0x0018, "secp384r1", False, ""),
    (0x0019, "secp521r1", False, ""),
    (0x001D, "X25519", False, ""),
    (0x001E, "X448", False, ""),
    (0x0100, "ffdhe2048", False, ""),
    (0x0101, "ffdhe3072", False, ""),
    (0x0102, "ffdhe4096", False, ""),
    (0x0103, "ffdhe6144", False, ""),
    (0x0104, "ffdhe8192", False, ""),
]

# Years a sector's data must stay secret.
SECTOR_YEARS = {
    "medical": 30, "finance": 7, "state": 50, "infra": 20, "code": 5, "generic": 10,
}
DEFAULT_SECTOR_YEARS = 10
DEFAULT_LAG_YEARS = 5
CRQC_YEAR = 2031

# Score multipliers by protocol (lower case).
PROTOCOL_MULTIPLIERS = {
    "tls": "1.2", "dtls": "1.2", "ssh": "1.1", "x.509": "1.15",
    "grpc": "1.1", "jwt": "1.0", "ocsp": "1.0", "s/mime": "0.9",
}

GRADES = [(95, "A+"), (85, "A"), (70, "B"), (50, "C"), (30, "D")]

SEVERITY_ORDER = ["critical", "high", "medium", "low", "info"]
CONFIDENCE_ORDER = ["low", "medium-low", "medium", "medium-high", "high"]
