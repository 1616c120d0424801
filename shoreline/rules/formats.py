"""Fixed values of the output formats and of tool vocabularies."""

# --- fixed values -----------------------------------------------------------

CSV_COLUMNS = [
    "severity", "confidence", "algorithm", "primitive", "keySize", "risk",
    "pqcPresent", "pqcMaturity", "negotiatedGroupName", "handshakeVolumeClass",
    "handshakeBytes", "file", "line", "sourceEngine", "reachable",
    "partialInventory", "partialInventoryReason", "dedupeKey",
]
FORMULA_STARTS = "=+-@\t\r"

CDX_PRIMITIVES = {
    "block-cipher": ["symmetric", "block-cipher"],
    "stream-cipher": ["stream-cipher"],
    "ae": ["ae", "aead"],
    "pke": ["asymmetric", "pke", "public-key"],
    "signature": ["signature", "sign"],
    "hash": ["hash", "digest"],
    "mac": ["mac", "hmac"],
    "kdf": ["kdf", "key-derivation"],
    "key-agree": ["key-exchange", "key-agree", "keyexchange"],
    "kem": ["kem", "key-encapsulation"],
    "xof": ["xof"],
    "drbg": ["rng", "random", "prng", "csprng", "drbg"],
    "key-wrap": ["key-wrap", "kw"],
    "combiner": ["combiner"],
}
CDX_MODES = ["cbc", "ecb", "ccm", "gcm", "cfb", "ofb", "ctr", "other", "unknown"]

# Families of component names, first match wins.
COMPONENT_FAMILIES = [
    "ML-KEM", "ML-DSA", "SLH-DSA", "XMSS", "LMS",
    "AES", "ChaCha20", "Camellia", "ARIA", "SEED", "LEA", "Ascon",
    "RSA", "ECDSA", "ECDH", "EdDSA", "Ed25519", "Ed448", "X25519", "X448",
    "SHA-3", "SHA-2", "SHA-1", "BLAKE2", "BLAKE3",
    "HMAC", "HKDF", "PBKDF2", "Argon2", "scrypt", "bcrypt", "DES", "3DES", "MD5",
]

SARIF_SEVERITY_LEVELS = {
    "critical": "error", "high": "warning", "medium": "warning", "low": "note", "info": "none",
}
SARIF_WARNING_CONFIDENCES = ["high", "medium-high", "medium"]
RULE_ID_REPLACEMENTS = [
    (" ", "-"), ("/", "-"), (".", "-"), ("(", "-LP-"), (")", "-RP-"), ("<", "-LT-"),
    (">", "-GT-"), ('"', "-DQ-"), ("'", "-SQ-"), ("&", "-AMP-"), ("+", "PLUS"),
]

# Local names of component properties that must not leave the organisation.
SENSITIVE_PROPERTIES = ["codeSnippet", "sourceContext"]

# Primitive of a rule id: parts it contains, endings, primitive; first row wins.
RULE_ID_PRIMITIVES = [
    (["rsa", "ecdsa", "ecdh", "-ec-"], ["-ec"], "asymmetric"),
    (["aes", "cipher", "encrypt", "decrypt", "secret-key"], [], "symmetric"),
    (["hmac", "mac"], [], "mac"),
    (["sha", "md5", "digest", "hash"], [], "hash"),
    (["tls", "-ssl-"], ["-ssl"], "protocol"),
    (["kdf"], [], "kdf"),
]
# Algorithm of a rule id by token; first row wins.
RULE_ID_ALGORITHMS = [
    (["rsa"], "RSA"), (["ecdsa"], "ECDSA"), (["ecdh"], "ECDH"), (["aes"], "AES"),
    (["hmac"], "HMAC"), (["sha256"], "SHA-256"), (["sha512"], "SHA-512"), (["sha1"], "SHA-1"),
    (["sha"], "SHA"), (["md5"], "MD5"), (["tls"], "TLS"), (["des", "3des"], "DES"),
]

# Pattern scanner: primitives renamed on the way in.
SCANNER_PRIMITIVES = {
    "pke": "asymmetric", "aead": "symmetric", "block-cipher": "symmetric",
    "stream-cipher": "symmetric",
}
ASSET_PRIMITIVES = {
    "asymmetric": ["certificate", "private-key", "keystore", "ssh-key", "pgp-key"],
    "protocol": ["config"],
}

# AST scanner identifiers: modes, curves and post-quantum names kept whole.
ID_MODES = ["GCM", "CBC", "CTR", "ECB", "CFB", "OFB", "CCM", "XTS", "WRAP"]
ID_CURVES = ["P256", "P384", "P521", "CURVE25519", "ED25519", "ED448", "X25519", "X448"]
ID_PQC_NAMES = [
    "ML-KEM", "MLKEM", "ML-DSA", "MLDSA", "SLH-DSA", "SLHDSA", "HASH-ML-DSA", "HASHML-DSA",
    "HASHMLDSA", "KYBER", "DILITHIUM", "FALCON", "FN-DSA", "FNDSA", "SPHINCS", "HQC", "BIKE",
    "FRODOKEM", "FRODO-KEM", "CLASSICMCELIECE", "CLASSIC-MCELIECE", "XMSS", "LMS", "HSS",
]

# Java security strings.
JCA_KDFS = ["HKDF", "SCRYPT", "BCRYPT", "ARGON2"]
JCA_SIGNATURES = [
    "EC", "ECDSA", "ECDSAWITHSHA256", "ECDSAWITHSHA384", "ECDSAWITHSHA512",
    "EDDSA", "ED25519", "ED448", "DSA",
]
JCA_SIGNATURE_PARTS = ["WITHECDSA", "WITHEDDSA", "WITHDSA", "WITHRSA"]
JCA_HASHES = [
    "MD5", "MD2", "SHA1", "SHA-1", "SHA224", "SHA256", "SHA384", "SHA512", "RIPEMD160", "WHIRLPOOL",
]
JCA_HASH_PREFIXES = ["SHA-", "SHA2", "SHA3"]
JCA_KEY_EXCHANGES = ["DH", "ECDH", "X25519", "X448", "XDH"]
JCA_CIPHERS = [
    "DES", "DESEDE", "3DES", "TRIPLEDES", "BLOWFISH", "RC2", "RC4", "RC5", "CAST5", "CAST6",
    "CAMELLIA", "IDEA", "TWOFISH", "SERPENT", "SKIPJACK", "SEED", "ARIA", "LEA", "AES",
]
JCA_TRANSFORMS = {
    "symmetric": ["AES", "DESEDE", "DES", "3DES", "BLOWFISH", "RC2", "RC4"],
    "pke": ["RSA"],
    "signature": ["EC", "ECDSA"],
    "ae": ["CHACHA20"],
}
JCA_AEAD_MODES = ["GCM", "CCM", "EAX", "OCB"]
JCA_HMAC_HASHES = {
    "SHA1": "SHA-1", "SHA224": "SHA-224", "SHA256": "SHA-256", "SHA384": "SHA-384",
    "SHA512": "SHA-512", "SHA512/224": "SHA-512/224", "SHA512/256": "SHA-512/256",
}
JCA_NOT_CRYPTO = [
    "UTF-8", "UTF-16", "UTF-32", "ISO-8859", "ASCII", "LATIN1", "MAIN", "INIT", "<INIT>",
    "<CLINIT>", "CODE", "LINE", "STACK", "VOID", "BOOLEAN", "BYTE", "CHAR", "SHORT", "INT",
    "LONG", "FLOAT", "DOUBLE", "OBJECT", "STRING", "CLASS",
]
