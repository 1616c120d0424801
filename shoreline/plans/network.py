"""Sensor logs, endpoint observations and certificates to classified findings."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoreline.functions import tls as X
from shoreline.operators import records as R
from shoreline.operators.classify import classify_findings


def ssl_findings(records: DataFrame) -> DataFrame:
    return classify_findings(R.ssl_record_to_findings(R.dedup_ssl(records)))


def x509_findings(records: DataFrame) -> DataFrame:
    return classify_findings(R.x509_record_to_findings(R.dedup_x509(records)))


def eve_findings(records: DataFrame, ja3s_dim: DataFrame | None = None) -> DataFrame:
    return classify_findings(R.eve_record_to_findings(R.dedup_eve(records), ja3s_dim))


def endpoint_findings(observations: DataFrame) -> DataFrame:
    return classify_findings(R.tls_observation_to_findings(observations))


def ech_hosts_to_ct(
    findings: DataFrame, certs: DataFrame, extra_hosts: DataFrame | None = None
) -> DataFrame:
    """Certificates of hosts whose handshakes were encrypted, and of hosts asked for.

    Hosts are made distinct first; they are joined to the certificates by
    canonical name, with the size of both sides deciding how.
    """
    place = F.regexp_replace(
        F.regexp_replace(F.col("file"), "^[^/]*/", ""), "#[^#]*$", ""
    )
    hidden = findings.where(
        F.col("partial_inventory") & F.col("partial_inventory_reason").startswith("ECH_ENABLED")
    ).select(X.canonical_hostname(place).alias("host"))
    if extra_hosts is not None:
        hidden = hidden.unionByName(
            extra_hosts.select(X.canonical_hostname(F.col("host")).alias("host"))
        )
    hosts = hidden.where(F.col("host").isNotNull()).distinct()
    named = certs.withColumn("_host", X.canonical_hostname(F.col("hostname")))
    return named.join(hosts, F.col("_host") == F.col("host")).drop("_host")
