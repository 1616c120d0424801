"""Fixed values for the compliance frameworks."""

# --- fixed values -----------------------------------------------------------

# Framework id, title, key-exchange deadline, full deadline.
FRAMEWORKS = [
    ("cnsa-2.0", "CNSA 2.0", "2030-12-31", "2033-12-31"),
    ("asd-ism", "ASD ISM", "2030-01-01", "2035-12-31"),
    ("nist-ir-8547", "NIST IR 8547", "2030-12-31", "2030-12-31"),
    ("ncsc-uk", "NCSC UK", "2030-01-01", "2035-12-31"),
    ("bsi-tr-02102", "BSI TR-02102", "2030-01-01", "2035-12-31"),
    ("anssi-guide-pqc", "ANSSI Guide PQC", "2030-01-01", "2035-12-31"),
    ("pci-dss-4.0", "PCI DSS 4.0", "2025-03-31", "2030-12-31"),
]

HYBRID_PREFIXES = ["X25519MLKEM", "SECP256R1MLKEM", "SECP384R1MLKEM", "CURVESM2MLKEM"]
KEM_PRIMITIVES = ["kem", "key-exchange", "kex", "key_exchange"]
SIGNATURE_PRIMITIVES = ["signature", "digital-signature", "digital_signature", "sig"]
STATEFUL_SIGNATURES = ["LMS", "HSS", "XMSS"]

CNSA_OTHER_CIPHERS = ["ARIA", "CAMELLIA", "CHACHA", "SEED", "TWOFISH", "SERPENT"]
ASD_OTHER_CIPHERS = ["CHACHA", "CAMELLIA", "ARIA", "SEED", "SERPENT", "TWOFISH", "3DES"]
HASH_FAMILY_PREFIXES = [
    "SHA", "BLAKE", "HMAC", "MD5", "MD4", "MD2", "RIPEMD", "WHIRLPOOL", "HAS-160", "HAS160",
]
SHA2_NAMES = ["SHA256", "SHA384", "SHA512"]
SHA3_NAMES = ["SHA3", "SHA-3"]
HASH_DIGITS = [512, 384, 256, 224, 160, 128]

# Labels of the risk classes in the algorithm table.
RISK_LABELS = {
    "quantum-vulnerable": "Vulnerable",
    "quantum-weakened": "Weakened",
    "quantum-safe": "Safe",
    "quantum-resistant": "Resistant",
    "deprecated": "Deprecated",
}
# --- end of fixed values ----------------------------------------------------

# What to do about each rule (our wording); keyed by rule.
REMEDIATION = {
    "cnsa2-quantum-vulnerable": "Move to ML-KEM-1024 or ML-DSA-87.",
    "cnsa2-slh-dsa-excluded": "Use ML-DSA-87; SLH-DSA is outside CNSA 2.0.",
    "cnsa2-hashml-dsa-excluded": "Use ML-DSA-87; the pre-hash variant is outside CNSA 2.0.",
    "cnsa2-hqc-not-approved": "Use ML-KEM-1024; HQC is not approved yet.",
    "cnsa2-hybrid-sub-1024": "Use a hybrid whose ML-KEM part is ML-KEM-1024.",
    "cnsa2-ml-kem-key-size": "Use ML-KEM-1024.",
    "cnsa2-ml-dsa-param-set": "Use ML-DSA-87.",
    "cnsa2-kem-not-approved": "Use ML-KEM-1024.",
    "cnsa2-signature-not-approved": "Use ML-DSA-87, or LMS/XMSS for firmware.",
    "cnsa2-symmetric-unapproved": "Use AES-256.",
    "cnsa2-symmetric-key-size": "Use AES-256.",
    "cnsa2-hash-unapproved": "Use SHA-384 or SHA-512.",
    "cnsa2-hash-output-size": "Use SHA-384 or SHA-512.",
    "asd-quantum-vulnerable": "Move to ML-KEM-1024 or ML-DSA-87.",
    "asd-hybrid-sub-1024": "Use a hybrid whose ML-KEM part is ML-KEM-1024.",
    "asd-ml-kem-grade": "Use ML-KEM-1024.",
    "asd-ml-dsa-grade": "Use ML-DSA-87.",
    "asd-kem-not-approved": "Use ML-KEM-1024.",
    "asd-signature-not-approved": "Use ML-DSA-87 or SLH-DSA.",
    "asd-symmetric-unapproved": "Use AES-256.",
    "asd-aes-key-size": "Use AES-256.",
    "asd-hash-unapproved": "Use SHA-384 or SHA-512.",
    "asd-hash-output-size": "Use SHA-384 or SHA-512.",
    "nist8547-quantum-vulnerable": "Move to FIPS 203, 204 or 205 algorithms.",
    "ncsc-quantum-vulnerable": "Move to ML-KEM, ML-DSA or SLH-DSA.",
    "bsi-quantum-vulnerable": "Move to a hybrid key exchange or a post-quantum signature.",
    "bsi-hybrid-kem-required": "Pair ML-KEM with a classical group.",
    "anssi-quantum-vulnerable": "Move to a hybrid key exchange or a post-quantum signature.",
    "anssi-hybrid-kem-required": "Pair ML-KEM with a classical group.",
    "pci-no-inventory-evidence": "Run a scan that classifies the algorithms in scope.",
}
