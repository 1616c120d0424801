"""Migration examples (our wording), by language and use.

``{target}`` is replaced by the target algorithm and ``{alg}`` by the classical
one.  Uses: ``sign``, ``kem``; for ``config`` the kind of server comes first.
"""

# --- fixed values -----------------------------------------------------------
SIGN_FAMILIES = [
    "RSA", "RSASSA-PKCS1", "RSASSA-PSS", "DSA", "ECDSA", "EDDSA", "ED25519", "ED448",
    "KCDSA", "EC-KCDSA",
]
KEM_FAMILIES = [
    "ECDH", "ECDHE", "X25519", "X448", "DH", "FFDH", "DIFFIE-HELLMAN", "RSAES-PKCS1",
    "RSAES-OAEP", "ELGAMAL", "ECIES", "MQV", "ECMQV",
]
ALREADY_SAFE = ["ML-DSA", "ML-KEM", "SLH-DSA", "XMSS", "LMS", "HQC"]
SIGN_PRIMITIVES = ["signing", "signature"]
KEM_PRIMITIVES = ["kem", "key-exchange", "key-agree"]
# --- end of fixed values ----------------------------------------------------

TEMPLATES = [
    ("go", "sign", "rsa.SignPSS(rand.Reader, key, crypto.SHA256, digest, nil)  // {alg}",
     'scheme := schemes.ByName("{target}")\nsig := scheme.Sign(key, message, nil)'),
    ("go", "kem", "secret, err := ecdh.X25519().NewPrivateKey(seed)  // {alg}",
     'scheme := schemes.ByName("{target}")\nct, secret, err := scheme.Encapsulate(publicKey)'),
    ("python", "sign", "signature = private_key.sign(message)  # {alg}",
     'with oqs.Signature("{target}") as signer:\n    signature = signer.sign(message)'),
    ("python", "kem", "shared = private_key.exchange(peer_key)  # {alg}",
     'with oqs.KeyEncapsulation("{target}") as kem:\n    ct, shared = kem.encap_secret(peer_key)'),
    ("java", "sign", 'Signature.getInstance("SHA256withRSA")  // {alg}',
     'Signature.getInstance("{target}", "BC")'),
    ("java", "kem", 'KeyAgreement.getInstance("ECDH")  // {alg}',
     'KEM.getInstance("{target}", "BC")'),
    ("rust", "sign", "let sig = signing_key.sign(message); // {alg}",
     'let sig = Sig::new("{target}")?.sign(message, &key)?;'),
    ("rust", "kem", "let shared = secret.diffie_hellman(&public); // {alg}",
     'let (ct, shared) = Kem::new("{target}")?.encapsulate(&public)?;'),
    ("javascript", "sign", "crypto.sign('sha256', message, key) // {alg}",
     "crypto.sign(null, message, keyFor('{target}'))"),
    ("javascript", "kem", "crypto.diffieHellman({ privateKey, publicKey }) // {alg}",
     "crypto.encapsulate(keyFor('{target}'))"),
    ("c", "sign", "EVP_DigestSign(ctx, sig, &len, msg, msglen); /* {alg} */",
     'EVP_PKEY_CTX_new_from_name(NULL, "{target}", NULL);'),
    ("c", "kem", "EVP_PKEY_derive(ctx, secret, &len); /* {alg} */",
     'EVP_PKEY_CTX_new_from_name(NULL, "{target}", NULL);\nEVP_PKEY_encapsulate(ctx, ct, &n, s, &m);'),
    ("csharp", "sign", "rsa.SignData(data, HashAlgorithmName.SHA256, pad); // {alg}",
     'MLDsa.GenerateKey(ParameterSet("{target}")).SignData(data);'),
    ("csharp", "kem", "ecdh.DeriveKeyMaterial(peer); // {alg}",
     'MLKem.GenerateKey(ParameterSet("{target}")).Encapsulate(out var ct, out var secret);'),
    ("swift", "sign", "try key.signature(for: message) // {alg}",
     'try postQuantumKey("{target}").signature(for: message)'),
    ("swift", "kem", "try key.sharedSecretFromKeyAgreement(with: peer) // {alg}",
     'try postQuantumKey("{target}").encapsulate()'),
    ("config/nginx", "sign", "ssl_certificate /etc/tls/rsa.crt;",
     "ssl_certificate /etc/tls/{target}.crt;"),
    ("config/nginx", "kem", "ssl_ecdh_curve X25519;", "ssl_ecdh_curve X25519MLKEM768:X25519;"),
    ("config/apache", "sign", "SSLCertificateFile /etc/tls/rsa.crt",
     "SSLCertificateFile /etc/tls/{target}.crt"),
    ("config/apache", "kem", "SSLOpenSSLConfCmd Groups X25519",
     "SSLOpenSSLConfCmd Groups X25519MLKEM768:X25519"),
    ("config/haproxy", "sign", "bind *:443 ssl crt /etc/tls/rsa.pem",
     "bind *:443 ssl crt /etc/tls/{target}.pem"),
    ("config/haproxy", "kem", "bind *:443 ssl curves X25519",
     "bind *:443 ssl curves X25519MLKEM768:X25519"),
    ("config/ssh", "sign", "HostKeyAlgorithms rsa-sha2-512",
     "# no standard post-quantum host key yet; plan for {target}"),
    ("config/ssh", "kem", "KexAlgorithms curve25519-sha256",
     "KexAlgorithms mlkem768x25519-sha256,curve25519-sha256"),
    ("config/generic", "sign", "signature_algorithm = {alg}", "signature_algorithm = {target}"),
    ("config/generic", "kem", "key_exchange = {alg}", "key_exchange = {target}"),
]
