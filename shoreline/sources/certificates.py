"""Certificate feeds, stored endpoint observations and SSH offers."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoreline.rules import tls

CERT_TYPE = (
    "hostname string, issuer_name string, common_name string, name_value string, id bigint, "
    "not_before string, not_after string, serial_number string, sig_algorithm string, "
    "pub_key_algorithm string, pub_key_size int, pub_key_curve string"
)
OBSERVATION_TYPE = (
    "target string, tls_version int, cipher_suite int, negotiated_group int, "
    "leaf_cert_key_algo string, leaf_cert_key_size int, leaf_cert_sig_algo string, "
    "ech_detected boolean, bytes_in bigint, bytes_out bigint, accepted_tls12 boolean, "
    "tls12_cipher_suite string, accepted_groups array<int>, hrr_groups array<int>, "
    "sig_algs array<int>, pref_forward int, pref_reverse int, enumeration_mode string, "
    "truncated boolean, truncation_reason string"
)


def cert_time(c: Column) -> Column:
    """Timestamp in the first layout that fits, NULL if none does."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in tls.CERT_TIME_FORMATS])


def with_cert_times(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "not_before": cert_time(F.col("not_before")), "not_after": cert_time(F.col("not_after")),
    })


def load_ct_certificates(spark: SparkSession, path) -> DataFrame:
    return with_cert_times(spark.read.schema(CERT_TYPE).json(path))


def load_tls_observations(spark: SparkSession, path, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).schema(OBSERVATION_TYPE).load(path)


def load_ssh_kex(df: DataFrame) -> DataFrame:
    """``(target, kex_methods)`` to one row per method; blank ones are dropped."""
    rest = [c for c in df.columns if c != "kex_methods"]
    return df.select(*rest, F.explode("kex_methods").alias("method")).where(
        F.col("method") != ""
    )
