"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` is the data folder, ``BENCH_CPUS`` the number of local cores.
Every query runs to the end over its whole tables; results go to a sink that
discards them.  One untimed query warms up the session.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from queries import catalog  # noqa: E402
from shoreline.session import builder  # noqa: E402

HEADLINE = [
    "host_readiness", "classified_log_findings", "eve_record_to_findings", "dedup_ssl",
    "normalize_algorithm", "dedupe_findings", "classify_findings", "scan_summary", "qrs",
    "compliance_eval", "policy_glob_match", "impact_zones", "enrich_key_size", "suppress_inline",
    "suppress_by_path", "config_vocab_match", "byte_signature_match", "cbom_components",
    "trend_delta", "incremental_split",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = (
        builder("bench").master(f"local[{cpus}]")
        .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        # small local files: read each with all cores
        .config("spark.sql.files.maxPartitionBytes", "2m")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    # start-up of the JVM and of code generation is not what is measured
    catalog.QUERIES["classify_algorithm"](spark, sf_dir).count()
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
