"""Wording for the advice codes that classification returns."""

ADVICE = {
    "broken-hash": "Collision attacks are practical. Move to SHA-256 or SHA-3.",
    "broken-cipher": "Retired block cipher. Move to AES-256-GCM.",
    "broken-stream-cipher": "Broken RC-family cipher. Move to AES-256-GCM or ChaCha20-Poly1305.",
    "old-protocol": "Retired protocol version. Move to TLS 1.3 with a hybrid ML-KEM group.",
    "pre-standard-kem": "Draft name of ML-KEM. Move to the FIPS 203 parameter sets.",
    "pre-standard-signature": "Draft name of a signature now standardised in FIPS 204 or 205.",
    "retired": "Retired algorithm. Move to a current one.",
    "tls12-no-pqc": "TLS 1.2 cannot negotiate a post-quantum group. Move to TLS 1.3.",
    "tls13-check-group": "Current protocol version. Check that a hybrid ML-KEM group is negotiated.",
    "hqc-draft": "Selected by NIST; its standard is not final yet.",
    "falcon-draft": "Selected by NIST; FIPS 206 is not final yet.",
    "eliminated": "Eliminated candidate. Move to SMAUG-T (KEM) or HAETAE (signature).",
    "unknown-signature": "Unrecognised signature scheme: only future signatures are at risk. Review.",
    "unknown-key-exchange": "Unrecognised key exchange: recorded traffic may be decrypted later. Review.",
    "key-exchange": "Recorded traffic can be decrypted later. Move to ML-KEM, hybrid first.",
    "signature": "Future signatures can be forged. Move to ML-DSA or SLH-DSA.",
    "asymmetric": "Broken by Shor's algorithm. Move to ML-KEM or ML-DSA.",
    "csprng": "Random generators keep their strength.",
    "seed-ecb": "SEED in ECB mode. Move to ARIA-256-GCM or AES-256-GCM.",
    "seed-128": "SEED has 128-bit keys only. Move to ARIA-256-GCM or AES-256-GCM.",
    "lsh-short": "LSH output under 256 bits. Use LSH-512.",
    "lsh-256": "LSH-256 leaves about 128 bits against a quantum attacker. Consider LSH-512.",
    "hash-short": "Digest under 256 bits. Use SHA-256 or longer.",
    "key-too-small": "Key under 128 bits. Use 256-bit keys.",
    "key-128": "Grover's algorithm halves the strength. Use 256-bit keys.",
    "key-size-unknown": "Key size not known. Check that it is at least 256 bits.",
    "ssh-pqc": "Post-quantum key exchange is offered.",
    "tls12-downgrade": "TLS 1.2 is still accepted, so ML-KEM can be bypassed. Turn TLS 1.2 off.",
}

# Advice code of each deprecated base name (upper case).
DEPRECATED_ADVICE = {
    "broken-hash": ["MD5", "MD4", "MD2", "SHA-1", "SHA1", "HAS-160"],
    "broken-cipher": ["DES", "3DES", "DES-EDE3", "TRIPLE-DES", "TDEA", "BLOWFISH"],
    "broken-stream-cipher": ["RC2", "RC4", "RC5"],
    "old-protocol": ["TLSV1.0", "TLSV1.1", "SSLV3", "SSLV2"],
    "pre-standard-kem": ["KYBER"],
    "pre-standard-signature": ["DILITHIUM", "SPHINCS+", "SPHINCS"],
}
