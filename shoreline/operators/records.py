"""Network records to findings: one record gives one row per algorithm seen."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoreline import schema
from shoreline.functions import tls as X
from shoreline.functions.text import blank_to_null, strip
from shoreline.rules import tls as rules
from shoreline.sources.lines import place


def first_per_key(df: DataFrame, keys: list, order: Column) -> DataFrame:
    """First row of each key.

    ``min_by`` combines on the map side, so a key that holds a third of the rows
    reaches the shuffle as one row per task; a window would sort them all in one.
    """
    rest = [c for c in df.columns if c not in keys]
    row = F.min_by(F.struct(*rest), order).alias("_row")
    picked = df.groupBy(*[F.col(k) for k in keys]).agg(row)
    return picked.select(*[
        F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns
    ])


def dedup_ssl(df: DataFrame) -> DataFrame:
    return first_per_key(
        df, ["src_file", "resp_host", "resp_port", "cipher", "curve", "pqc_key_share"], place()
    )


def dedup_x509(df: DataFrame) -> DataFrame:
    return first_per_key(
        df, ["src_file", "sig_alg", "key_alg", "key_type", "key_length", "curve"], place()
    )


def dedup_eve(df: DataFrame) -> DataFrame:
    return first_per_key(
        df, ["src_file", "dest_ip", "dest_port", "cipher", "version", "sni"], place()
    )


def cap_list(c: Column, n: int) -> Column:
    """First ``n`` entries of a list."""
    return F.slice(c, 1, n)


def split_list(c: Column, n: int | None = None) -> Column:
    """Non-blank entries of a comma list; the first ``n`` where a log format has a limit."""
    parts = F.transform(F.split(X.sanitize_field(c), ","), strip)
    entries = F.filter(parts, lambda s: s != "")
    return entries if n is None else cap_list(entries, n)


def _seen(name, primitive, source, key_size=None, group=None, raw=None, pqc=None):
    """One observed algorithm; the fields every branch of a record must share."""
    def lit(v, t):
        return v if isinstance(v, Column) else F.lit(v).cast(t)

    return F.struct(
        lit(name, "string").alias("name"), lit(primitive, "string").alias("primitive"),
        lit(key_size, "int").alias("key_size"), lit(source, "string").alias("source"),
        lit(group, "int").alias("group"), lit(raw, "string").alias("raw"),
        lit(pqc, "boolean").alias("pqc"),
    )


def _explode_seen(df: DataFrame, seen: Column, target: Column, engine: str, record: list):
    """One row per non-blank observed algorithm, with the finding columns."""
    rows = df.withColumn("_target", target).select(
        *record, "_target", F.explode(seen).alias("_s")
    ).where(blank_to_null(F.col("_s.name")).isNotNull())
    name = F.col("_s.name")
    found = rows.select(
        *record, F.col("_s.source").alias("observed_in"),
        X.synthetic_file(engine, F.col("_target"), name).alias("file"),
        F.lit(0).alias("line"),
        schema.algorithm(name, F.col("_s.primitive"), F.col("_s.key_size")).alias("algorithm"),
        F.lit("medium").alias("confidence"), F.lit(engine).alias("source_engine"),
        F.lit("unknown").alias("reachable"),
        F.coalesce(F.col("_s.raw"), name).alias("raw_identifier"),
        F.col("_s.group").alias("_group"), F.col("_s.pqc").alias("_pqc"),
    )
    return found


def ssl_record_to_findings(df: DataFrame) -> DataFrame:
    """Cipher, curve and each known key-share group of a TLS record."""
    cipher, curve = X.sanitize_field(F.col("cipher")), X.sanitize_field(F.col("curve"))
    shares = F.transform(
        F.split(F.coalesce(F.col("pqc_key_share"), F.lit("")), ","), X.hex_codepoint
    )
    known = F.filter(shares, lambda g: X.group_name(g).isNotNull())
    seen = F.concat(
        F.array(
            _seen(cipher, X.cipher_primitive_zeek(cipher), "ssl.log/cipher"),
            _seen(curve, "key-agree", "ssl.log/curve", group=X.group_codepoint(curve)),
        ),
        F.transform(
            known,
            lambda g: _seen(X.group_name(g), "key-agree", "ssl.log/pqc_key_share", group=g),
        ),
    )
    target = X.target_of_record(F.col("server_name"), F.col("resp_host"), F.col("resp_port"))
    record = [c for c in df.columns if c in ("src_file", "src_block", "row_no", "ts_received")]
    out = _explode_seen(df, seen, target, "zeek-log", record)
    by_share = F.col("observed_in") == "ssl.log/pqc_key_share"
    return out.select(
        "*",
        F.when(by_share, F.col("_group")).alias("negotiated_group"),
        X.group_name(F.col("_group")).alias("negotiated_group_name"),
        X.group_is_pqc(F.col("_group")).alias("pqc_present"),
        X.group_maturity(F.col("_group")).alias("pqc_maturity"),
    ).drop("_group", "_pqc")


def x509_record_to_findings(df: DataFrame) -> DataFrame:
    """Signature algorithm and key algorithm of a certificate record."""
    sig = F.coalesce(X.resolve_oid(F.col("sig_alg")), F.col("sig_alg"))
    key = F.coalesce(X.resolve_oid(F.col("key_alg")), F.col("key_alg"))
    seen = F.array(
        _seen(sig, "signature", "x509.log/sig_alg"),
        _seen(key, X.key_type_primitive(F.col("key_type")), "x509.log/key_alg",
              key_size=F.col("key_length")),
    )
    san = blank_to_null(F.substring_index(F.col("san_dns"), ",", 1))
    target = X.sanitize_target(F.coalesce(san, F.col("id"), F.lit("")))
    record = [c for c in df.columns if c in ("src_file", "src_block", "row_no", "ts_received")]
    return _explode_seen(df, seen, target, "zeek-log", record).drop("_group", "_pqc")


def ja3s_lookup(df: DataFrame, ja3s_dim: DataFrame) -> DataFrame:
    """Records whose server fingerprint is known to be post-quantum, with its label."""
    hints = ja3s_dim.where(F.col("pqc_present")).select(
        F.col("ja3s"),
        F.coalesce(blank_to_null(F.col("label")), F.lit("MLKEM768")).alias("ja3s_label"),
    )
    return df.join(hints, "ja3s")


def eve_record_to_findings(
    df: DataFrame, ja3s_dim: DataFrame | None = None, max_list: int | None = None
) -> DataFrame:
    """Cipher, fingerprint hint, signature algorithms and groups of an IDS record.

    ``ja3s_dim`` (ja3s, pqc_present, label) has one row per fingerprint.  ``max_list``
    keeps the first entries of each list only.
    """
    if ja3s_dim is None:
        staged = df.withColumn("_label", F.lit(None).cast("string"))
    else:
        hints = ja3s_dim.where(F.col("pqc_present")).select(
            "ja3s", F.coalesce(blank_to_null(F.col("label")), F.lit("MLKEM768")).alias("_label")
        )
        staged = df.join(hints, "ja3s", "left")
    cipher = X.sanitize_field(F.col("cipher"))
    none = F.array().cast("array<string>")
    seen = F.concat(
        F.array(
            _seen(cipher, X.cipher_primitive_suricata(cipher), "eve.json/cipher_suite"),
            _seen(F.col("_label"), "key-agree", "eve.json/ja3s", pqc=True,
                  raw=F.concat(F.lit("suricata-ja3s:"), F.col("ja3s"))),
        ),
        F.transform(
            F.coalesce(split_list(F.col("sigalgs"), max_list), none),
            lambda s: _seen(s, "signature", "eve.json/sigalgs"),
        ),
        F.transform(
            F.coalesce(split_list(F.col("groups"), max_list), none),
            lambda g: _seen(g, "key-agree", "eve.json/groups"),
        ),
    )
    target = X.target_of_record(F.col("sni"), F.col("dest_ip"), F.col("dest_port"))
    record = [c for c in df.columns if c in ("src_file", "src_block", "row_no", "ts_received")]
    out = _explode_seen(staged, seen, target, "suricata-log", record)
    return out.select(
        "*", F.col("_pqc").alias("pqc_present"),
        F.when(F.col("_pqc"), "final").alias("pqc_maturity"),
    ).drop("_group", "_pqc")


def decompose_cipher_suite(df: DataFrame) -> DataFrame:
    """One row per part of ``cipher_suite`` (a codepoint or a name)."""
    name = F.col("cipher_suite")
    if dict(df.dtypes)["cipher_suite"] != "string":
        name = X.suite_name(name)
    parts = df.withColumn("suite_name", name).withColumn(
        "_p", F.explode(X.suite_components(F.col("suite_name")))
    )
    return parts.select(
        *df.columns, "suite_name", F.col("_p.name").alias("name"),
        F.col("_p.primitive").alias("primitive"), F.col("_p.key_size").alias("key_size"),
        F.col("_p.mode").alias("mode"),
    )


def _session(df: DataFrame) -> DataFrame:
    """Columns about the whole handshake that every row of it shares."""
    total = F.coalesce(F.col("bytes_in"), F.lit(0)) + F.coalesce(F.col("bytes_out"), F.lit(0))
    group = F.col("negotiated_group")
    reason = blank_to_null(F.concat_ws(
        "+",
        F.when(F.col("ech_detected"), "ECH_ENABLED"),
        F.when(
            F.col("truncated"),
            F.coalesce(blank_to_null(F.col("truncation_reason")), F.lit("ENUMERATION_TRUNCATED")),
        ),
    ))
    return df.withColumns({
        "suite_name": X.suite_name(F.col("cipher_suite")),
        "negotiated_group_name": X.group_name(group),
        "pqc_present": F.coalesce(X.group_is_pqc(group), F.lit(False)),
        "pqc_maturity": X.group_maturity(group),
        "handshake_volume_class": X.handshake_volume_class(total),
        "handshake_bytes": F.when(total > 0, total),
        "partial_inventory": reason.isNotNull(),
        "partial_inventory_reason": reason,
    })


def merge_supported_groups(df: DataFrame) -> DataFrame:
    """Fill the enumeration columns of key-exchange rows; other rows get NULL.

    Groups are the accepted ones followed by those named in retry requests.
    """
    is_kex = F.col("algorithm.primitive") == "key-exchange"
    enumerated = is_kex & (F.coalesce(F.col("enumeration_mode"), F.lit("")) != "")

    def some(c):
        return F.when(F.size(c) > 0, c)

    none = F.array().cast("array<int>")
    accepted = F.coalesce(F.col("accepted_groups"), none)
    retried = F.coalesce(F.col("hrr_groups"), none)
    mode = X.server_preference(F.col("pref_forward"), F.col("pref_reverse"))
    return df.withColumns({
        "supported_groups": F.when(enumerated, some(F.concat(accepted, retried))),
        "supported_sig_algs": F.when(enumerated, some(F.col("sig_algs"))),
        "server_preferred_group": F.when(
            enumerated, X.preferred_group(F.col("pref_forward"), F.col("pref_reverse"))
        ),
        "server_preference_mode": F.when(enumerated, mode),
        "enumeration_mode": F.when(enumerated, F.col("enumeration_mode")),
    })


def tls_observation_to_findings(df: DataFrame) -> DataFrame:
    """Suite parts, certificate, key exchange and downgrade of each endpoint."""
    suffixes = {"key-exchange": "#kex", "signature": "#sig", "symmetric": "#sym", "hash": "#mac"}
    base = F.concat(F.lit("(tls-probe)/"), F.col("target"))

    def row(suffix, name, primitive, size=None, mode=None, raw=None):
        return F.struct(
            F.concat(base, suffix).alias("file"), name.alias("name"),
            primitive.alias("primitive"),
            (F.lit(None) if size is None else size).cast("int").alias("key_size"),
            (F.lit(None) if mode is None else mode).cast("string").alias("mode"),
            F.concat(raw, F.lit("|"), F.col("target")).alias("raw"),
        )

    parts = F.transform(
        X.suite_components(F.col("suite_name")),
        lambda p: row(
            F.coalesce(*[F.when(p["primitive"] == k, F.lit(v)) for k, v in suffixes.items()]),
            p["name"], p["primitive"], p["key_size"], p["mode"],
            F.concat(p["primitive"], F.lit(":"), p["name"], F.lit("|"), F.col("suite_name")),
        ),
    )
    key_alg, cert_sig = F.col("leaf_cert_key_algo"), F.col("leaf_cert_sig_algo")
    kex = F.when(F.col("pqc_present"), F.col("negotiated_group_name")).otherwise("ECDHE")
    fallback = F.coalesce(F.col("tls12_cipher_suite"), F.lit(""))
    extra = F.array_compact(F.array(
        F.when(
            blank_to_null(key_alg).isNotNull(),
            row(F.lit("#cert"), key_alg, F.lit("signature"), F.col("leaf_cert_key_size"),
                raw=F.concat(F.lit("cert:"), key_alg)),
        ),
        F.when(
            blank_to_null(cert_sig).isNotNull(),
            row(F.lit("#cert-sig"), cert_sig, F.lit("digital-signature"),
                raw=F.concat(F.lit("cert-sig:"), cert_sig)),
        ),
        F.when(
            F.col("tls_version") == rules.TLS13,
            row(F.lit("#kex"), kex, F.lit("key-exchange"), raw=F.concat(F.lit("kex:"), kex)),
        ),
        F.when(
            F.col("accepted_tls12") & F.col("pqc_present"),
            row(F.lit("#tls12-fallback"), F.lit("TLS_1.2_Fallback"), F.lit("key-exchange"),
                raw=F.concat(F.lit("tls12-fallback:"), fallback)),
        ),
    ))
    rows = _session(df).withColumn("_s", F.explode(F.concat(parts, extra)))
    downgrade = F.col("algorithm.name") == "TLS_1.2_Fallback"
    found = merge_supported_groups(rows.withColumns({
        "file": F.col("_s.file"), "line": F.lit(0), "artifact_type": F.lit("tls-endpoint"),
        "algorithm": schema.algorithm(
            F.col("_s.name"), F.col("_s.primitive"), F.col("_s.key_size"), F.col("_s.mode")
        ),
        "confidence": F.lit("high"), "source_engine": F.lit("tls-probe"),
        "reachable": F.lit("yes"), "raw_identifier": F.col("_s.raw"),
    })).drop("_s")
    return found.withColumns({
        "quantum_risk": F.when(downgrade, "quantum-vulnerable"),
        "severity": F.when(downgrade, "high"),
        "hndl_risk": F.when(downgrade, "immediate"),
        "recommendation": F.when(downgrade, "tls12-downgrade"),
    })


def tls12_downgrade(df: DataFrame) -> DataFrame:
    """Endpoints that offer ML-KEM but still accept TLS 1.2, as high-severity findings."""
    return tls_observation_to_findings(
        df.where(F.col("accepted_tls12") & X.group_is_pqc(F.col("negotiated_group")))
    ).where(F.col("algorithm.name") == "TLS_1.2_Fallback")


def key_share_length_check(df: DataFrame) -> DataFrame:
    """Compare observed key-share lengths (group, side, length) with the expected ones."""
    expected = X.expected_key_share(F.col("group"), F.col("side"))
    return df.withColumns({
        "family": X.key_share_family(F.col("group")),
        "expected_length": expected,
        "length_ok": expected == F.col("length"),
    })


def ct_record_to_finding(df: DataFrame, serial_chars: int | None = None) -> DataFrame:
    """One finding per certificate: its signature algorithm, else its key algorithm.

    ``file`` names the host and the serial number, so each certificate is a place of its
    own; ``serial_chars`` shortens the number, and certificates of a host that agree in
    these characters then count as one place.
    """
    name = F.coalesce(blank_to_null(F.col("sig_algorithm")), F.col("pub_key_algorithm"))
    serial = F.coalesce(F.col("serial_number"), F.lit(""))
    host = F.col("hostname")
    return df.select(
        *df.columns,
        F.concat(
            F.lit("(ct-lookup)/"), host, F.lit("#cert:"),
            serial if serial_chars is None else F.substring(serial, 1, serial_chars),
        ).alias("file"),
        F.lit(0).alias("line"), F.lit("ct-log").alias("artifact_type"),
        schema.algorithm(
            name, F.lit("signature"), F.col("pub_key_size"), None, F.col("pub_key_curve")
        ).alias("algorithm"),
        F.lit("medium").alias("confidence"), F.lit("ct-lookup").alias("source_engine"),
        F.lit("yes").alias("reachable"),
        F.concat(F.lit("ct-cert:"), F.concat_ws("|", host, name, serial)).alias("raw_identifier"),
    )


def ssh_kex_to_findings(df: DataFrame) -> DataFrame:
    """One finding per advertised method; post-quantum ones are safe as reported."""
    maturity = X.ssh_kex_maturity(F.col("method"))
    return df.select(
        *df.columns,
        F.concat(F.lit("(ssh-probe)/"), F.col("target"), F.lit("#kex")).alias("file"),
        F.lit(0).alias("line"), F.lit("ssh-endpoint").alias("artifact_type"),
        schema.algorithm(F.col("method"), F.lit("kex")).alias("algorithm"),
        F.lit("high").alias("confidence"), F.lit("ssh-probe").alias("source_engine"),
        F.lit("yes").alias("reachable"),
        F.concat(F.lit("ssh-kex:"), F.col("method"), F.lit("|"), F.col("target"))
        .alias("raw_identifier"),
        maturity.isNotNull().alias("pqc_present"), maturity.alias("pqc_maturity"),
        F.when(maturity.isNotNull(), "quantum-safe").alias("quantum_risk"),
        F.when(maturity.isNotNull(), "info").alias("severity"),
        F.when(maturity.isNotNull(), "ssh-pqc").alias("recommendation"),
    )


def tls_group_lookup(df: DataFrame, key: str) -> DataFrame:
    """Name, post-quantum flag and maturity of a group codepoint; unknown is not PQC."""
    return df.withColumns({
        "group_name": X.group_name(F.col(key)),
        "group_pqc": F.coalesce(X.group_is_pqc(F.col(key)), F.lit(False)),
        "group_maturity": X.group_maturity(F.col(key)),
    })


def sig_alg_oid(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("oid_name", X.resolve_oid(F.col(key)))


def sig_scheme_name(df: DataFrame, key: str) -> DataFrame:
    """Names of a codepoint, or of each entry of an array of codepoints (one row each)."""
    if dict(df.dtypes)[key].startswith("array"):
        df = df.withColumn(key, F.explode(key))
    return df.withColumn("scheme_name", X.signature_scheme(F.col(key)))


def ssh_kex_lookup(df: DataFrame) -> DataFrame:
    maturity = X.ssh_kex_maturity(F.col("method"))
    return df.withColumns({
        "pqc_present": maturity.isNotNull(), "pqc_maturity": maturity,
    })
