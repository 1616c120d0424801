"""SQL building blocks for the oracles (DuckDB dialect).

They restate the rules in another way than the Spark code: prefix searches filter
a list that is sorted by length, classification is one CASE that yields a packed
text, and merges use window functions.
"""

from queries import views as V
from queries.views import text
from shoreline.rules import advice, compliance
from shoreline.rules import quantum as Q
from shoreline.rules import registry, tls


def array(values) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


def mapping(expr: str, table: dict, default: str = "NULL") -> str:
    """CASE over the entries of a table."""
    if not table:
        return default
    cases = " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in table.items())
    return f"(CASE {expr} {cases} ELSE {default} END)"


def isin(expr: str, values) -> str:
    return f"({expr} IN ({', '.join(text(v) for v in values)}))"


def longest(names) -> list:
    return sorted(names, key=len, reverse=True)


def prefix_of(upper: str, names) -> str:
    """Longest name, any case, that ``upper`` starts with."""
    return f"list_filter({array(longest(names))}, lambda p: starts_with({upper}, upper(p)))[1]"


def any_prefix(upper: str, names) -> str:
    return "(" + " OR ".join(f"starts_with({upper}, {text(n)})" for n in names) + ")"


def any_part(s: str, names) -> str:
    return "(" + " OR ".join(f"contains({s}, {text(n)})" for n in names) + ")"


def base_name(name: str) -> str:
    """Family of a trimmed name."""
    inner = (
        f"(CASE WHEN starts_with(upper({name}), 'HMAC-') AND length({name}) > 5 "
        f"THEN substr({name}, 6) "
        f"WHEN starts_with(upper({name}), 'HMAC') AND length({name}) > 4 "
        f"THEN substr({name}, 5) ELSE {name} END)"
    )
    up = f"upper({inner})"
    dashless = f"replace({up}, '-', '')"
    eliminated = f"""list_filter({array(Q.ELIMINATED)}, lambda p:
        {up} = upper(p) OR starts_with({up}, upper(p) || '-'))[1]"""
    return f"""COALESCE(
        {prefix_of(up, Q.WHOLE_NAMES)},
        {mapping(up, Q.JOSE_NAMES)},
        {mapping(f"replace({up}, ' ', '')", Q.PROTOCOL_NAMES)},
        {prefix_of(up, Q.PQC_SAFE)},
        CASE WHEN {dashless} <> {up} THEN list_filter({array(longest(Q.PQC_SAFE))},
            lambda p: starts_with({dashless}, replace(upper(p), '-', '')))[1] END,
        {mapping(up, {n.upper(): n for n in Q.DEPRECATED})},
        {prefix_of(up, Q.PRE_STANDARD)},
        {prefix_of(up, Q.VULNERABLE)},
        {eliminated},
        NULLIF(regexp_extract({inner}, '([^-_]+)', 1), ''),
        {inner})"""


def primitive(expr: str) -> str:
    spelled = {s: n for n, ss in Q.PRIMITIVE_SYNONYMS.items() for s in ss}
    lower = f"lower(COALESCE({expr}, ''))"
    return mapping(lower, spelled, lower)


def target(base: str, size: str | None = None) -> str:
    """Packed ``algorithm|standard`` of a family, ``|`` when there is none."""
    plain = {n: f"{a}|{s}" for (a, s), names in Q.MIGRATION_TARGETS.items() for n in names}
    up = f"upper({base})"
    if size is None:
        return mapping(up, plain, "'|'")
    tiers = " ".join(
        f"WHEN {isin(up, names)} AND {size} >= {n} THEN {text(a + '|' + s)}"
        for names, n, a, s in Q.SIZE_TIERS
    )
    return (
        f"(CASE WHEN {up} = 'AES' AND {size} > 0 AND {size} < 256 THEN 'AES-256|' {tiers} "
        f"ELSE {mapping(up, plain, chr(39) + '|' + chr(39))} END)"
    )


def _size_in_name(up, sizes):
    return "CASE " + " ".join(f"WHEN contains({up}, '{n}') THEN {n}" for n in sizes) + " ELSE 0 END"


def classified(source: str, name: str, prim: str, size: str) -> str:
    """``source`` plus c_risk, c_severity, c_hndl, c_advice, c_target, c_standard."""
    codes = {n: c for c, names in advice.DEPRECATED_ADVICE.items() for n in names}
    hash_size = f"""CASE WHEN _size > 0 THEN _size
        WHEN ({_size_in_name('_up', Q.HASH_SIZES_IN_NAME)}) > 0
            THEN ({_size_in_name('_up', Q.HASH_SIZES_IN_NAME)})
        WHEN upper(_base) = 'MD5' THEN 128
        WHEN {isin('upper(_base)', ['SHA-1', 'SHA1', 'HAS-160'])} THEN 160 ELSE 0 END"""
    key_size = f"""CASE WHEN _size > 0 THEN _size WHEN contains(_up, 'CHACHA20') THEN 256
        WHEN contains(_up, 'SM4') THEN 128 ELSE ({_size_in_name('_up', Q.KEY_SIZES_IN_NAME)}) END"""
    looks_symmetric = any_prefix("upper(_base)", Q.SYMMETRIC_PREFIXES) + " OR " + any_prefix(
        "_up", Q.SYMMETRIC_PREFIXES)
    looks_hash = any_prefix("upper(_base)", Q.HASH_PREFIXES) + " OR " + any_prefix(
        "_up", Q.HASH_PREFIXES)
    return f"""(
    SELECT s4.* EXCLUDE (_name, _up, _base, _prim, _size, _kind, _hs, _ks, _packed, _parts),
           _parts[1] AS c_risk, _parts[2] AS c_severity, NULLIF(_parts[3], '') AS c_hndl,
           NULLIF(_parts[4], '') AS c_advice, NULLIF(_parts[5], '') AS c_target,
           NULLIF(_parts[6], '') AS c_standard
    FROM (
    SELECT s3.*, string_split(_packed, '|') AS _parts FROM (
    SELECT s2.*, CASE
        WHEN _name IS NULL THEN NULL
        WHEN {isin('_base', Q.DEPRECATED)} OR {isin('_name', Q.DEPRECATED)}
            THEN 'deprecated|critical||' || {mapping('upper(_base)', codes, "'retired'")} || '|'
                 || {target('_base', '_size')}
        WHEN _base = 'TLSv1.2' THEN 'quantum-vulnerable|medium|immediate|tls12-no-pqc|TLS 1.3|'
        WHEN _base = 'TLSv1.3' THEN 'quantum-resistant|info||tls13-check-group||'
        WHEN _base = 'HQC' THEN 'quantum-safe|info||hqc-draft||'
        WHEN _base = 'Falcon' THEN 'quantum-safe|info||falcon-draft||'
        WHEN {isin('_base', Q.PQC_SAFE)} THEN 'quantum-safe|info||||'
        WHEN {isin('_base', Q.ELIMINATED)}
            THEN 'quantum-vulnerable|medium||eliminated|' || {target('_base')}
        WHEN {isin('_base', Q.VULNERABLE)} THEN CASE
            WHEN _prim IN ('key-agree', 'kem', 'pke')
                THEN 'quantum-vulnerable|critical|immediate|key-exchange|' ||
                     CASE WHEN ends_with({target('_base', '_size')}, '|FIPS 204')
                          THEN 'ML-KEM-768|FIPS 203' ELSE {target('_base', '_size')} END
            WHEN _prim = 'signature'
                THEN 'quantum-vulnerable|high|deferred|signature|' || {target('_base', '_size')}
            ELSE 'quantum-vulnerable|high|immediate|asymmetric|' || {target('_base', '_size')} END
        WHEN _prim = 'signature'
            THEN 'quantum-vulnerable|high|deferred|unknown-signature|' || {target('_base')}
        WHEN _prim = 'rng' THEN 'quantum-resistant|info||csprng||'
        WHEN _kind = 'exchange'
            THEN 'quantum-vulnerable|critical|immediate|unknown-key-exchange|' || {target('_base')}
        WHEN _kind = 'none' THEN 'unknown|low||||'
        WHEN upper(_base) = 'SEED' AND contains(_up, 'ECB')
            THEN 'deprecated|critical||seed-ecb||'
        WHEN upper(_base) = 'SEED' THEN 'quantum-weakened|low||seed-128||'
        WHEN starts_with(upper(_base), 'LSH') AND _hs >= 512 THEN 'quantum-resistant|info||||'
        WHEN starts_with(upper(_base), 'LSH') AND _hs BETWEEN 1 AND 255
            THEN 'quantum-weakened|low||lsh-short||'
        WHEN starts_with(upper(_base), 'LSH') AND _hs = 256 THEN 'quantum-weakened|low||lsh-256||'
        WHEN _kind = 'hash' THEN CASE
            WHEN _hs BETWEEN 1 AND 255 THEN 'quantum-weakened|low||hash-short|SHA-256|'
            WHEN {isin('upper(_base)', Q.RESISTANT_HASHES)} OR _hs >= 256
                THEN 'quantum-resistant|info||||'
            ELSE 'unknown|low||||' END
        WHEN _ks BETWEEN 1 AND 127 THEN 'quantum-weakened|medium||key-too-small|AES-256|'
        WHEN _ks BETWEEN 128 AND 255 THEN 'quantum-weakened|low||key-128|AES-256|'
        WHEN _ks > 0 THEN 'quantum-resistant|info||||'
        ELSE 'unknown|low||key-size-unknown||' END AS _packed
    FROM (
    SELECT s1.*, {hash_size} AS _hs, {key_size} AS _ks, CASE
        WHEN _prim IN ('hash', 'xof', 'mac', 'kdf') THEN 'hash'
        WHEN _prim IN ('symmetric', 'ae') THEN 'cipher'
        WHEN {looks_symmetric} THEN 'cipher'
        WHEN {looks_hash} THEN 'hash'
        WHEN _prim IN ('pke', 'key-agree', 'kem') THEN 'exchange'
        ELSE 'none' END AS _kind
    FROM (
    SELECT s0.*, {base_name('_name')} AS _base, upper(_name) AS _up FROM (
    SELECT s.*, trim({name}) AS _name, {primitive(prim)} AS _prim,
           COALESCE({size}, 0) AS _size
    FROM {source} AS s) AS s0) AS s1) AS s2) AS s3) AS s4)"""


def effort(risk: str, prim: str, is_config: str) -> str:
    p = primitive(prim)
    return f"""CASE {risk} WHEN 'deprecated' THEN 'simple'
        WHEN 'quantum-weakened' THEN CASE WHEN {p} IN ('hash', 'xof', 'mac', 'kdf') OR {is_config}
            THEN 'simple' ELSE 'moderate' END
        WHEN 'quantum-vulnerable' THEN CASE WHEN {p} = 'signature' THEN 'moderate'
            WHEN {p} IN ('key-agree', 'kem', 'pke') AND {is_config} THEN 'moderate'
            ELSE 'complex' END END"""


def findings(view: str = V.FINDINGS) -> str:
    """The findings view with its classification, flat."""
    rows = classified(V.duck(view), "s.alg_name", "s.primitive", "s.key_size")
    is_config = "source_engine IN ('config-scanner', 'tls-probe')"
    return f"""(SELECT c.* EXCLUDE (c_risk, c_severity, c_hndl, c_advice, c_target, c_standard),
        CASE WHEN alg_name IS NOT NULL THEN c_risk WHEN library IS NOT NULL THEN 'unknown' END
            AS quantum_risk,
        CASE WHEN alg_name IS NOT NULL THEN c_severity WHEN library IS NOT NULL THEN 'info' END
            AS severity,
        c_hndl AS hndl_risk, c_advice AS recommendation, c_target AS target_algorithm,
        c_standard AS target_standard, {effort('c_risk', 'primitive', is_config)} AS migration_effort
        FROM {rows} AS c)"""


def place() -> str:
    return "file || CASE WHEN inner_path IS NOT NULL THEN '!' || inner_path ELSE '' END"


def finding_key(before_file: str = "") -> str:
    return f"""project || '|{before_file}' || CASE WHEN alg_name IS NOT NULL
            THEN {place()} || '|' || line || '|alg|' || alg_name
        WHEN library IS NOT NULL
            THEN {place()} || '|dep|' || library || COALESCE('@' || version, '')
        ELSE {place()} || '|' || line || '|' || raw_identifier || '|' || source_engine END"""


def grade(score: str) -> str:
    cases = " ".join(f"WHEN {score} >= {n} THEN '{g}'" for n, g in Q.GRADES)
    return f"CASE {cases} ELSE 'F' END"


def penalty(risk: str = "quantum_risk", severity: str = "severity") -> str:
    return f"""CASE {risk} WHEN 'quantum-vulnerable' THEN
        CASE {severity} WHEN 'critical' THEN 2.0 WHEN 'high' THEN 1.5 ELSE 1.0 END
        WHEN 'deprecated' THEN 1.5 WHEN 'quantum-weakened' THEN 0.5 ELSE 0.0 END"""


def normalized(source: str, name: str, size: str, mode: str, out: str) -> str:
    """``source`` plus canonical name ``<out>_name``, ``<out>_primitive``, ``<out>_match``."""
    rows = ", ".join(
        f"({text(n.upper())}, {text(n)}, {text(p)})" for n, _, p in registry.patterns()
    )
    fams = registry.families()
    clean = f"replace(trim({name}), '_', '-')"
    family = prefix_of(f"upper({clean})", list(fams))
    rest = f"trim(substr(upper({clean}), 5), '-_')"
    return f"""(
    SELECT s.* EXCLUDE (_family),
        CASE WHEN pc.canon IS NOT NULL THEN pc.canon WHEN pr.canon IS NOT NULL THEN pr.canon
             WHEN _family = 'HMAC' AND {rest} <> '' THEN 'HMAC-' || {rest}
             WHEN _family IS NOT NULL THEN _family
                || CASE WHEN {size} > 0 THEN '-' || {size} ELSE '' END
                || CASE WHEN {mode} <> '' THEN '-' || upper({mode}) ELSE '' END
             ELSE {name} END AS {out}_name,
        CASE WHEN pc.canon IS NOT NULL THEN pc.prim WHEN pr.canon IS NOT NULL THEN pr.prim
             ELSE {mapping('_family', fams)} END AS {out}_primitive,
        CASE WHEN {name} IS NULL THEN NULL
             WHEN pc.canon IS NOT NULL OR pr.canon IS NOT NULL THEN 'exact'
             WHEN _family IS NOT NULL THEN 'prefix' ELSE 'none' END AS {out}_match
    FROM (SELECT s.*, {family} AS _family FROM {source} AS s) AS s
    LEFT JOIN (VALUES {rows}) AS pc(pattern, canon, prim) ON pc.pattern = upper({clean})
    LEFT JOIN (VALUES {rows}) AS pr(pattern, canon, prim) ON pr.pattern = upper(trim({name})))"""


def curve(expr: str) -> str:
    names, aliases, oids = {}, {}, {}
    for family, name, oid, alias in registry.CURVES:
        names[name], names[f"{family}/{name}"] = name, f"{family}/{name}"
        oids[oid] = f"{family}/{name}"
        aliases.update({a.lower(): f"{family}/{name}" for a in alias})
    return (
        f"COALESCE({mapping(expr, names)}, {mapping(f'lower(trim({expr}))', aliases)}, "
        f"{mapping(expr, oids)}, {expr})"
    )


def group_values() -> str:
    """TLS groups as a table ``g(id, name, pqc, maturity)``."""
    rows = ", ".join(
        f"({i}, {text(n)}, {text(p)}, {text(m or None)})" for i, n, p, m in Q.TLS_GROUPS
    )
    return f"(VALUES {rows}) AS g(id, name, pqc, maturity)"


def tls_version(expr: str) -> str:
    spelled = {s: v for v, ss in tls.TLS_VERSIONS.items() for s in ss}
    return mapping(f"lower(replace({expr}, ' ', ''))", spelled, expr)


def curve_group(expr: str) -> str:
    return (
        f"COALESCE({mapping(f'lower({expr})', tls.CURVE_GROUPS)}, "
        f"NULLIF(NULLIF({expr}, ''), '-'))"
    )


def oid_name(expr: str) -> str:
    names = {tls.SIGNATURE_OID_ARC + str(n): v for n, v in tls.SIGNATURE_OIDS.items()}
    names.update({tls.KEM_OID_ARC + str(n): v for n, v in tls.KEM_OIDS.items()})
    return mapping(
        f"CASE WHEN starts_with(trim({expr}), 'unknown ') THEN trim(substr(trim({expr}), 9)) "
        f"ELSE trim({expr}) END", names)


def sanitize_target(expr: str) -> str:
    return f"regexp_replace({expr}, '[\\x00-\\x1F\\x7F/?#]', '', 'g')"


def severity_rank(expr: str) -> str:
    return mapping(expr, {s: i for i, s in enumerate(Q.SEVERITY_ORDER, 1)}, "6")


def confidence_rank(expr: str) -> str:
    return mapping(expr, {s: i for i, s in enumerate(Q.CONFIDENCE_ORDER, 1)}, "0")


def violations(source: str) -> str:
    """All compliance violations of flat classified findings, one row each."""
    d = {f: (kex, full) for f, _, kex, full in compliance.FRAMEWORKS}
    up, lvl = "upper(alg_name)", "_level"
    at_risk = "quantum_risk IN ('quantum-vulnerable', 'deprecated')"
    group = "upper(alg_name)"
    hybrid = any_prefix(f"replace({group}, '-', '')", compliance.HYBRID_PREFIXES)
    pure = f"({any_prefix(group, ['ML-KEM', 'MLKEM'])} AND NOT {hybrid})"
    kem = isin("lower(COALESCE(primitive, ''))", compliance.KEM_PRIMITIVES)
    sig = isin("lower(COALESCE(primitive, ''))", compliance.SIGNATURE_PRIMITIVES)
    mlkem, mldsa = any_prefix(up, ["ML-KEM", "MLKEM"]), any_prefix(up, ["ML-DSA", "MLDSA"])
    stateful = any_prefix(up, compliance.STATEFUL_SIGNATURES)
    sha3 = f"({any_prefix(up, ['SHA3-', 'SHA-3-'])} OR {isin(up, compliance.SHA3_NAMES)})"
    sha2 = (
        f"((({any_prefix(up, ['SHA-', 'SHA2'])} OR {isin(up, compliance.SHA2_NAMES)}) AND NOT {sha3})"
        f" OR (starts_with({up}, 'HMAC-SHA') AND NOT contains({up}, 'SHA3')))"
    )
    is_hash = any_prefix(up, compliance.HASH_FAMILY_PREFIXES)
    exchange = (
        f"(contains({up}, 'ECDH') OR starts_with({up}, 'DH-') OR {up} = 'DH' "
        f"OR contains({up}, 'DIFFIE') OR starts_with({up}, 'RSA'))"
    )
    below = "COALESCE({0}, 0) BETWEEN 1 AND {1}"

    def v(framework, rule, deadline, severity="error"):
        return f"'{framework}|{rule}|' || {deadline} || '|{severity}'"

    def q(s):
        return f"'{s}'"

    cnsa, asd = d["cnsa-2.0"], d["asd-ism"]
    by_hndl = f"CASE WHEN hndl_risk = 'immediate' THEN '{cnsa[0]}' ELSE '{cnsa[1]}' END"

    def library(framework, prefix, deadline):
        return f"""WHEN alg_name IS NULL THEN CASE WHEN quantum_risk = 'quantum-vulnerable'
            THEN {v(framework, prefix + '-quantum-vulnerable', deadline)} END"""

    cnsa_case = f"""CASE {library('cnsa-2.0', 'cnsa2', by_hndl)}
        WHEN {at_risk} THEN {v('cnsa-2.0', 'cnsa2-quantum-vulnerable', by_hndl)}
        WHEN starts_with({up}, 'SLH-DSA') THEN {v('cnsa-2.0', 'cnsa2-slh-dsa-excluded', q(cnsa[1]))}
        WHEN starts_with({up}, 'HASHML-DSA') OR {up} = 'HASH-ML-DSA'
            THEN {v('cnsa-2.0', 'cnsa2-hashml-dsa-excluded', q(cnsa[1]))}
        WHEN starts_with({up}, 'HQC') THEN {v('cnsa-2.0', 'cnsa2-hqc-not-approved', q(cnsa[0]))}
        WHEN {hybrid} THEN CASE WHEN {below.format(lvl, 1023)}
            THEN {v('cnsa-2.0', 'cnsa2-hybrid-sub-1024', q(cnsa[0]))} END
        WHEN {mlkem} THEN CASE WHEN {below.format(lvl, 1023)}
            THEN {v('cnsa-2.0', 'cnsa2-ml-kem-key-size', q(cnsa[0]))} END
        WHEN {mldsa} THEN CASE WHEN {below.format(lvl, 86)}
            THEN {v('cnsa-2.0', 'cnsa2-ml-dsa-param-set', q(cnsa[1]))} END
        WHEN {kem} THEN {v('cnsa-2.0', 'cnsa2-kem-not-approved', q(cnsa[0]))}
        WHEN {sig} AND NOT {stateful}
            THEN {v('cnsa-2.0', 'cnsa2-signature-not-approved', q(cnsa[1]))}
        WHEN {any_prefix(up, compliance.CNSA_OTHER_CIPHERS)}
            THEN {v('cnsa-2.0', 'cnsa2-symmetric-unapproved', q(cnsa[1]))}
        WHEN starts_with({up}, 'AES') THEN CASE WHEN {below.format('_key_bits', 255)}
            THEN {v('cnsa-2.0', 'cnsa2-symmetric-key-size', q(cnsa[1]))} END
        WHEN {is_hash} AND NOT {sha2} THEN {v('cnsa-2.0', 'cnsa2-hash-unapproved', q(cnsa[1]))}
        WHEN {is_hash} AND {below.format('_digest_bits', 383)}
            THEN {v('cnsa-2.0', 'cnsa2-hash-output-size', q(cnsa[1]))} END"""
    asd_case = f"""CASE {library('asd-ism', 'asd', q(asd[0]))}
        WHEN {at_risk} THEN {v('asd-ism', 'asd-quantum-vulnerable', q(asd[0]))}
        WHEN {hybrid} THEN CASE WHEN {below.format(lvl, 1023)}
            THEN {v('asd-ism', 'asd-hybrid-sub-1024', q(asd[0]))} END
        WHEN {mlkem} THEN CASE WHEN {below.format(lvl, 1023)}
            THEN {v('asd-ism', 'asd-ml-kem-grade', q(asd[0]))} END
        WHEN {mldsa} THEN CASE WHEN {below.format(lvl, 86)}
            THEN {v('asd-ism', 'asd-ml-dsa-grade', q(asd[1]))} END
        WHEN starts_with({up}, 'SLH-DSA') OR starts_with(replace({up}, '-', ''), 'SLHDSA') THEN NULL
        WHEN {kem} THEN {v('asd-ism', 'asd-kem-not-approved', q(asd[0]))}
        WHEN {sig} AND NOT {stateful}
            THEN {v('asd-ism', 'asd-signature-not-approved', q(asd[1]))}
        WHEN {any_prefix(up, compliance.ASD_OTHER_CIPHERS)} OR {up} = 'RC4'
            THEN {v('asd-ism', 'asd-symmetric-unapproved', q(asd[1]))}
        WHEN starts_with({up}, 'AES') THEN CASE WHEN {below.format('_key_bits', 255)}
            THEN {v('asd-ism', 'asd-aes-key-size', q(asd[1]))} END
        WHEN {is_hash} AND NOT {sha2} THEN {v('asd-ism', 'asd-hash-unapproved', q(asd[1]))}
        WHEN {is_hash} AND {below.format('_digest_bits', 383)}
            THEN {v('asd-ism', 'asd-hash-output-size', q(asd[1]))} END"""
    nist, ncsc = d["nist-ir-8547"], d["ncsc-uk"]
    nist_case = f"""CASE {library('nist-ir-8547', 'nist8547', q(nist[0]))}
        WHEN {at_risk} THEN {v('nist-ir-8547', 'nist8547-quantum-vulnerable', q(nist[0]))} END"""
    by_family = f"CASE WHEN {exchange} THEN '{ncsc[0]}' ELSE '{ncsc[1]}' END"
    ncsc_case = f"""CASE {library('ncsc-uk', 'ncsc', q(ncsc[0]))}
        WHEN {at_risk} THEN {v('ncsc-uk', 'ncsc-quantum-vulnerable', by_family)} END"""

    def hybrid_case(framework, prefix):
        kex = q(d[framework][0])
        return f"""CASE {library(framework, prefix, kex)}
            WHEN {at_risk} THEN {v(framework, prefix + '-quantum-vulnerable', kex)}
            WHEN {pure} AND {kem}
                THEN {v(framework, prefix + '-hybrid-kem-required', kex, 'warn')} END"""

    cases = [cnsa_case, asd_case, nist_case, ncsc_case,
             hybrid_case("bsi-tr-02102", "bsi"), hybrid_case("anssi-guide-pqc", "anssi")]
    digits = "NULLIF(regexp_extract(replace(upper(alg_name), '-', ''), '([0-9]+)$', 1), '')"
    contained = " ".join(
        f"WHEN contains(upper(alg_name), '{n}') THEN {n}" for n in compliance.HASH_DIGITS)
    return f"""(
    SELECT x.* EXCLUDE (_v, _level, _key_bits, _digest_bits),
           COALESCE(alg_name, raw_identifier) AS algorithm,
           string_split(_v, '|')[1] AS framework, string_split(_v, '|')[2] AS rule,
           string_split(_v, '|')[3] AS deadline, string_split(_v, '|')[4] AS violation_severity
    FROM (SELECT y.*, unnest([{', '.join(cases)}]) AS _v FROM (
        SELECT z.*, CAST({digits} AS BIGINT) AS _level,
            CASE WHEN key_size > 0 THEN key_size ELSE CAST(NULLIF(regexp_extract(
                upper(alg_name), '\\bAES[-_]?(128|192|256)\\b', 1), '') AS INT) END AS _key_bits,
            CASE WHEN key_size > 0 THEN key_size ELSE COALESCE(
                CAST(NULLIF(regexp_extract(upper(alg_name),
                    '\\bSHA[-_]?(?:224|256|384|512)/(224|256)\\b', 1), '') AS INT),
                CAST(NULLIF(regexp_extract(upper(alg_name),
                    '\\bSHA[-_]?3?[-_]?(224|256|384|512)\\b', 1), '') AS INT),
                CASE {contained} END) END AS _digest_bits
        FROM {source} AS z) AS y) AS x WHERE _v IS NOT NULL)"""
