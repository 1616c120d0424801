"""Fixed values for TLS, SSH and certificate records."""

# --- fixed values -----------------------------------------------------------

# Post-quantum algorithm OIDs: arc 2.16.840.1.101.3.4.3.N for signatures.
SIGNATURE_OID_ARC = "2.16.840.1.101.3.4.3."
SIGNATURE_OIDS = {
    17: "ML-DSA-44", 18: "ML-DSA-65", 19: "ML-DSA-87",
    20: "SLH-DSA-SHA2-128s", 21: "SLH-DSA-SHA2-128f", 22: "SLH-DSA-SHA2-192s",
    23: "SLH-DSA-SHA2-192f", 24: "SLH-DSA-SHA2-256s", 25: "SLH-DSA-SHA2-256f",
    26: "SLH-DSA-SHAKE-128s", 27: "SLH-DSA-SHAKE-128f", 28: "SLH-DSA-SHAKE-192s",
    29: "SLH-DSA-SHAKE-192f", 30: "SLH-DSA-SHAKE-256s", 31: "SLH-DSA-SHAKE-256f",
}
KEM_OID_ARC = "2.16.840.1.101.3.4.4."
KEM_OIDS = {1: "ML-KEM-512", 2: "ML-KEM-768", 3: "ML-KEM-1024"}

# Spellings of TLS versions, lower case and without blanks.
TLS_VERSIONS = {
    "1.3": ["tlsv13", "tls1.3", "tls13"],
    "1.2": ["tlsv12", "tls1.2", "tls12"],
    "1.1": ["tlsv11", "tls1.1", "tls11"],
    "1.0": ["tlsv10", "tls1.0", "tls10"],
}

# Curve spellings in sensor logs (lower case) and the group they name.
CURVE_GROUPS = {
    "secp256r1": "secp256r1", "prime256v1": "secp256r1",
    "secp384r1": "secp384r1", "secp521r1": "secp521r1",
    "x25519": "X25519", "x448": "X448",
    "x25519mlkem768": "X25519MLKEM768",
    "secp256r1mlkem768": "SecP256r1MLKEM768",
    "secp384r1mlkem1024": "SecP384r1MLKEM1024",
    "curvesm2mlkem768": "curveSM2MLKEM768",
    "mlkem512": "MLKEM512", "mlkem768": "MLKEM768", "mlkem1024": "MLKEM1024",
}

# Groups a log names; the draft group is known by codepoint only.
NAMED_GROUPS = [
    "X25519MLKEM768", "SecP256r1MLKEM768", "SecP384r1MLKEM1024", "curveSM2MLKEM768",
    "MLKEM512", "MLKEM768", "MLKEM1024", "secp256r1", "secp384r1", "secp521r1",
    "X25519", "X448", "ffdhe2048", "ffdhe3072", "ffdhe4096", "ffdhe6144", "ffdhe8192",
]

# Certificate key types (lower case).
KEY_TYPE_PRIMITIVES = {
    "rsa": "asymmetric", "ec": "signature", "ecdsa": "signature", "dh": "key-agree",
    "ml-dsa": "signature", "mldsa": "signature", "dilithium": "signature",
    "ml-kem": "key-encap", "mlkem": "key-encap", "kyber": "key-encap",
}

# TLS SignatureScheme codepoints.
SIGNATURE_SCHEMES = {
    0x0904: "mldsa44", 0x0905: "mldsa65", 0x0906: "mldsa87",
    0x0804: "rsa_pss_rsae_sha256", 0x0805: "rsa_pss_rsae_sha384", 0x0806: "rsa_pss_rsae_sha512",
    0x0403: "ecdsa_secp256r1_sha256", 0x0503: "ecdsa_secp384r1_sha384",
    0x0603: "ecdsa_secp521r1_sha512", 0x0807: "ed25519", 0x0808: "ed448",
    0x0401: "rsa_pkcs1_sha256", 0x0501: "rsa_pkcs1_sha384", 0x0601: "rsa_pkcs1_sha512",
    0x0809: "rsa_pss_pss_sha256", 0x080A: "rsa_pss_pss_sha384", 0x080B: "rsa_pss_pss_sha512",
    0x0201: "rsa_pkcs1_sha1", 0x0203: "ecdsa_sha1",
}

# Key-share lengths: group, client bytes, server bytes.
KEY_SHARE_LENGTHS = [
    (0x001D, 32, 32), (0x0017, 65, 65), (0x0018, 97, 97), (0x0019, 133, 133),
    (0x0200, 800, 768), (0x0201, 1184, 1088), (0x0202, 1568, 1568),
    (0x11EB, 1249, 1153), (0x11EC, 1216, 1120), (0x11ED, 1665, 1665), (0x11EE, 1249, 1153),
]
HYBRID_GROUPS = [0x11EB, 0x11EC, 0x11ED, 0x11EE]
PURE_PQ_GROUPS = [0x0200, 0x0201, 0x0202]

# Handshake bytes: below the first two bounds, above the last.
VOLUME_CLASSICAL_BELOW = 7000
VOLUME_HYBRID_BELOW = 12000
VOLUME_FULL_PQC_ABOVE = 20000

# Cipher-suite codepoints (IANA names).
CIPHER_SUITES = {
    0x0005: "TLS_RSA_WITH_RC4_128_SHA",
    0x000A: "TLS_RSA_WITH_3DES_EDE_CBC_SHA",
    0x002F: "TLS_RSA_WITH_AES_128_CBC_SHA",
    0x0035: "TLS_RSA_WITH_AES_256_CBC_SHA",
    0x003C: "TLS_RSA_WITH_AES_128_CBC_SHA256",
    0x009C: "TLS_RSA_WITH_AES_128_GCM_SHA256",
    0x009D: "TLS_RSA_WITH_AES_256_GCM_SHA384",
    0x1301: "TLS_AES_128_GCM_SHA256",
    0x1302: "TLS_AES_256_GCM_SHA384",
    0x1303: "TLS_CHACHA20_POLY1305_SHA256",
    0xC007: "TLS_ECDHE_ECDSA_WITH_RC4_128_SHA",
    0xC009: "TLS_ECDHE_ECDSA_WITH_AES_128_CBC_SHA",
    0xC00A: "TLS_ECDHE_ECDSA_WITH_AES_256_CBC_SHA",
    0xC011: "TLS_ECDHE_RSA_WITH_RC4_128_SHA",
    0xC012: "TLS_ECDHE_RSA_WITH_3DES_EDE_CBC_SHA",
    0xC013: "TLS_ECDHE_RSA_WITH_AES_128_CBC_SHA",
    0xC014: "TLS_ECDHE_RSA_WITH_AES_256_CBC_SHA",
    0xC023: "TLS_ECDHE_ECDSA_WITH_AES_128_CBC_SHA256",
    0xC027: "TLS_ECDHE_RSA_WITH_AES_128_CBC_SHA256",
    0xC02B: "TLS_ECDHE_ECDSA_WITH_AES_128_GCM_SHA256",
    0xC02C: "TLS_ECDHE_ECDSA_WITH_AES_256_GCM_SHA384",
    0xC02F: "TLS_ECDHE_RSA_WITH_AES_128_GCM_SHA256",
    0xC030: "TLS_ECDHE_RSA_WITH_AES_256_GCM_SHA384",
    0xCCA8: "TLS_ECDHE_RSA_WITH_CHACHA20_POLY1305_SHA256",
    0xCCA9: "TLS_ECDHE_ECDSA_WITH_CHACHA20_POLY1305_SHA256",
}

# Bulk ciphers of a suite: name starts with, algorithm, key size, mode.
BULK_CIPHERS = [
    ("AES_128_GCM", "AES", 128, "GCM"),
    ("AES_256_GCM", "AES", 256, "GCM"),
    ("AES_128_CBC", "AES", 128, "CBC"),
    ("AES_256_CBC", "AES", 256, "CBC"),
    ("CHACHA20_POLY1305", "ChaCha20-Poly1305", 256, None),
    ("3DES_EDE_CBC", "3DES", 168, "CBC"),
    ("RC4_128", "RC4", 128, None),
]
SUITE_HASHES = [("_SHA256", "SHA-256"), ("_SHA384", "SHA-384"), ("_SHA", "SHA-1")]

TLS13 = 0x0304

# SSH key-exchange methods known as post-quantum: name, maturity.
SSH_PQC_METHODS = {
    "mlkem768x25519-sha256": "final",
    "sntrup761x25519-sha512@openssh.com": "draft",
    "kyber-512-sha256@pqc.ssh": "draft",
    "kyber-768-sha256@pqc.ssh": "draft",
    "kyber-1024-sha256@pqc.ssh": "draft",
    "x25519-kyber-512-sha256@ietf.org": "draft",
    "x25519-kyber-768-sha256@ietf.org": "draft",
    "ntruprime-ntrulpr761x25519-sha512@openssh.com": "draft",
    "ntruprime-sntrup761x25519-sha512@openssh.com": "draft",
}
# Any other method holding one of these (lower case) counts as a draft.
SSH_PQC_HINTS = ["mlkem", "kyber", "sntrup", "frodo", "ntruprime", "bike", "hqc", "mceliece"]

# Timestamp layouts of certificate feeds, tried in this order.
CERT_TIME_FORMATS = [
    "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd",
]
