"""A full scan: from the findings of all feeds to sorted, prioritised findings."""

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoreline import schema
from shoreline.functions.text import lookup
from shoreline.operators import classify as C
from shoreline.operators import filters, suppress
from shoreline.operators import records as R
from shoreline.operators.cache import KEY, incremental_split, union_feeds
from shoreline.operators.dedupe import dedupe_findings
from shoreline.operators.enrich import enrich_key_size, enrich_key_size_by_identifier
from shoreline.operators.impact import attach_impact, impact_zones
from shoreline.operators.metrics import Watch, unwatched
from shoreline.operators.normalize import normalize_algorithm
from shoreline.plans.checkpoints import cut
from shoreline.plans.network import ech_hosts_to_ct


@dataclass
class ScanOptions:
    """What a scan leaves out and adds."""

    base: str | None = None
    mode: str = "full"
    exclude: list = field(default_factory=list)
    changed: DataFrame | None = None
    directives: DataFrame | None = None
    ignore_patterns: list = field(default_factory=list)
    constants: DataFrame | None = None
    impact: bool = False
    # hops of a flow path that count; None counts all
    max_hops: int | None = None
    snippets: bool = True
    # feeds that run, by name; the mode and the type of the scan also decide
    engines: list | None = None
    scan_type: str = "all"
    # certificates of hosts whose handshakes were encrypted are looked up in a second pass
    certificates: DataFrame | None = None
    extra_hosts: DataFrame | None = None
    watch: Watch | None = None
    # checkpoint the merged findings, which several later steps read; without, they are merged when they are read
    cut_lineage: bool = True


def collect(feeds: list) -> DataFrame:
    """Feeds in their order, as one DataFrame with the findings schema."""
    return schema.conform(union_feeds(feeds))


def run_feeds(feeds: dict, watch: Watch) -> list:
    """The feeds ``{name: function giving findings}`` that can be read, each checkpointed.

    A feed that fails is noted with its error and left out; the scan goes on without it.
    """
    out = []
    for name, feed in feeds.items():
        try:
            out.append(cut(watch(schema.conform(feed()), f"feed {name}")))
        except Exception as error:  # noqa: BLE001  whatever a feed's files or parser raise
            watch.failed(f"feed {name}", error)
    return out


def _watched(options: ScanOptions):
    return options.watch or unwatched


def merge(findings: DataFrame, n_feeds: int, options: ScanOptions) -> DataFrame:
    """Filter, name and merge; the order of the steps is part of the result."""
    watch = _watched(options)
    out = findings
    if options.certificates is not None:
        seen = cut(out)
        second = R.ct_record_to_finding(ech_hosts_to_ct(seen, options.certificates, options.extra_hosts))
        rank = seen.agg(F.max("engine_rank")).scalar()
        out = seen.unionByName(schema.conform(second.withColumns({
            "engine_rank": F.coalesce(rank, F.lit(-1)) + 1, "seq": F.monotonically_increasing_id()})))
        n_feeds += 1
    out = watch(out, "collected")
    if options.engines or options.mode in ("diff", "quick") or options.scan_type != "all":
        out = filters.filter_engines(out, filters.engines_dim(out.sparkSession), options.engines, options.mode, options.scan_type)
    out = filters.exclude_globs(out, options.exclude, options.base)
    if options.mode == "diff" and options.changed is not None:
        out = filters.filter_changed_files(out, options.changed, options.base)
    out = normalize_algorithm(watch(out, "selected"))
    return watch(dedupe_findings(out, n_feeds), "merged")


def _of_scan(table: DataFrame | None) -> DataFrame | None:
    """Markers or constants; without a column ``project`` they are those of findings without a project."""
    if table is None or schema.scope_columns(table):
        return table
    return schema.in_project(table, F.lit(None).cast("string"))


def finish(merged: DataFrame, options: ScanOptions) -> tuple[DataFrame, DataFrame | None]:
    """Suppress, complete, classify and prioritise merged findings; with impact zones."""
    watch = _watched(options)
    out = merged
    directives, constants = map(_of_scan, (options.directives, options.constants))
    if options.ignore_patterns:
        out = watch(suppress.suppress_by_path(out, options.ignore_patterns, options.base), "not suppressed by path")
    if directives is not None:
        out = watch(suppress.suppress_inline(out, directives), "not suppressed by marker")
    if constants is not None and options.mode not in ("diff", "quick"):
        out = enrich_key_size(out, constants)
        # a name as the source writes it, with its class, module or package
        scope = F.concat(F.col("scope"), F.lit(".")) if "scope" in constants.columns else F.lit("")
        out = enrich_key_size_by_identifier(out, constants.withColumn("name", F.concat(scope, "name")))
    out = C.classify_findings(out)
    if options.snippets:
        out = C.migration_snippet(out)
    zones = None
    if options.impact and options.mode == "full":
        zones = impact_zones(out, options.max_hops, options.base)
        out = attach_impact(out, zones)
    else:
        out = out.withColumn("blast_radius", F.lit(None).cast("int"))
    out = C.with_priority(filters.mark_test_generated(out))
    return out, zones


def scan(feeds: list, options: ScanOptions | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Findings of one scan in priority order, and the impact zones if asked for."""
    options = options or ScanOptions()
    merged = merge(collect(feeds), len(feeds), options)
    if options.cut_lineage:
        merged = cut(merged)
    findings, zones = finish(merged, options)
    if options.watch:
        # a sort samples its input first, and what is sampled would be counted twice
        findings = cut(findings)
    return C.sort_by_priority(findings), zones


class Incremental(NamedTuple):
    """What an incremental scan gives."""

    findings: DataFrame
    zones: DataFrame | None
    #: cache entries of the files that were scanned; :func:`cache_store.refresh_cache` keeps them
    entries: DataFrame
    #: the current files with their hashes, which are worked out once
    files: DataFrame


def incremental_scan(
    files: DataFrame, cache: DataFrame, engine_versions: dict, scan_changed: Callable[[DataFrame], DataFrame],
    options: ScanOptions | None = None,
) -> Incremental:
    """A full scan that runs its feeds on changed files only.

    ``files`` are the current ``(path, content_hash)``, ``engine_versions`` the feeds in
    their order with their versions.  ``scan_changed`` takes ``(engine, path, content_hash)``
    of what is to be scanned and gives findings with the columns ``engine`` and ``path``.
    Findings of all other files come from the cache; the result is that of scanning all,
    also when it is read after the cache was brought up to date.
    """
    options = options or ScanOptions()
    files = cut(files.select("path", "content_hash"))
    changed, reused = incremental_split(files, cache, engine_versions)
    changed = cut(changed)
    rank = lookup(F.col("engine"), {e: i for i, e in enumerate(engine_versions)})
    found = scan_changed(changed)
    ranked = found.withColumn("engine_rank", rank)
    fresh = cut(ranked.select("engine", "path", F.struct(*[c.alias(n) for n, c in _conformed(ranked).items()]).alias("f")))
    listed = fresh.groupBy(*KEY).agg(F.collect_list("f").alias("findings"))
    none = F.array().cast(listed.schema["findings"].dataType)
    entries = changed.join(listed, KEY, "left").select(
        lookup(F.col("engine"), engine_versions).alias("engine_version"), "path", "content_hash",
        F.coalesce("findings", none).alias("findings"), "engine")
    kept = reused.select("engine", F.explode("findings").alias("f"))
    # merged twice, rows would be counted twice
    at_once = options.cut_lineage or options.watch
    if not at_once:
        # a refresh replaces the cache's files
        kept = cut(kept)
    both = kept.unionByName(fresh.select("engine", "f")).select("f.*")
    # the order of feeds is that of this scan
    both = schema.conform(both.withColumn("engine_rank", F.coalesce(
        lookup(F.col("source_engine"), {e: i for i, e in enumerate(engine_versions)}), F.col("engine_rank"))))
    merged = merge(both, len(engine_versions), options)
    if at_once:
        merged = cut(merged)
    findings, zones = finish(merged, options)
    return Incremental(C.sort_by_priority(findings), zones, entries, files)


def _conformed(df: DataFrame) -> dict:
    return {n: schema.column(df, n).cast(t) for n, t in schema.FINDING.items()}
