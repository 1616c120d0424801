"""Follow the data flow of a finding and work out what a migration would break.

A flow path belongs to one finding, so it is handled inside its row with array
functions: nothing is exploded, joined or shuffled until the zones themselves.
``max_hops`` cuts a path where a caller asks for it.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoreline import schema
from shoreline.functions import impact as I
from shoreline.operators.known import once, with_facts
from shoreline.operators.path_patterns import containing


def _steps(df: DataFrame) -> DataFrame:
    """One row per flow step, numbered from 1."""
    return df.withColumn("finding_key", schema.finding_key()).select(
        "finding_key", "engine_rank", "seq", F.posexplode("data_flow_path").alias("_i", "_s")
    ).select(
        "finding_key", "engine_rank", "seq", (F.col("_i") + 1).alias("hop"),
        F.col("_s.file").alias("file"), F.col("_s.line").alias("line"),
        F.col("_s.message").alias("message"),
    )


def flow_steps(df: DataFrame) -> DataFrame:
    return _steps(df)


def hop_edges(df: DataFrame, max_hops: int | None = None) -> DataFrame:
    """Edges from each place to the next, starting at the finding itself; all without ``max_hops``."""
    path = F.col("data_flow_path") if max_hops is None else F.slice("data_flow_path", 1, max_hops)
    before = F.concat(
        F.array(F.struct(F.col("file").alias("file"), F.coalesce("line", F.lit(0)).alias("line"))),
        F.transform(path, lambda s: F.struct(s["file"].alias("file"), s["line"].alias("line"))),
    )
    edges = F.transform(path, lambda s, i: F.struct(
        (i + 1).alias("hop"),
        F.get(before, i)["file"].alias("source_file"), F.get(before, i)["line"].alias("source_line"),
        s["file"].alias("target_file"), s["line"].alias("target_line"),
        I.consumer_type(s["message"]).alias("consumer"),
    ))
    wanted = df.where(F.col("algorithm").isNotNull() & (F.size("data_flow_path") > 0))
    return wanted.select(
        schema.finding_key().alias("finding_key"), "engine_rank", "seq", F.inline(edges)
    )


def constraint_hits(steps: DataFrame) -> DataFrame:
    """Size limits in the messages of flow steps, one row each."""
    return steps.select(*steps.columns, F.inline(I.size_limits(F.col("message")))).drop("message")


def protocol_boundaries(steps: DataFrame, patterns_dim: DataFrame | None = None) -> DataFrame:
    """Protocols crossed at each step, each once per step.

    ``patterns_dim`` (protocol, call) replaces the built-in API names; it is joined to the
    distinct messages, so it may have any number of rows.
    """
    if patterns_dim is None:
        return steps.select(*steps.columns, F.explode(I.protocol_calls(F.col("message"))).alias("protocol")).drop("message")
    found = containing(steps, patterns_dim, "message", "call").select(
        F.col("message").alias("_said"), "protocol").distinct()
    return steps.join(found, F.col("message") == F.col("_said")).select(*steps.columns, "protocol").drop("message")


def size_profile(df: DataFrame, key: str = "name") -> DataFrame:
    """Bytes each algorithm puts on the wire, NULL when not known."""
    return df.withColumn("dominant_bytes", I.dominant_size(F.col(key)))


def impact_targets(df: DataFrame, key: str = "name") -> DataFrame:
    """One row per migration target, numbered in order."""
    return df.select(
        *df.columns, F.posexplode(I.impact_targets(F.col(key))).alias("target_no", "target")
    )


def impact_zones(df: DataFrame, max_hops: int | None = None, base: str | None = None) -> DataFrame:
    """What each target of each finding with a flow path would break.

    Limits and protocols come from the whole path; only the hop count stops at
    ``max_hops``, if given.  Targets without a known size give no zone.
    """
    wanted = df.where(F.col("algorithm").isNotNull() & (F.size("data_flow_path") > 0))
    if base:
        f = F.col("file")
        wanted = wanted.where((f == base) | f.startswith(base + "/") | (f == "") | f.isNull())
    path = F.col("data_flow_path")
    limits = F.flatten(F.transform(path, lambda s: F.transform(
        I.size_limits(F.coalesce(s["message"], F.lit(""))),
        lambda h: F.named_struct(
            F.lit("type"), h["type"], F.lit("file"), s["file"], F.lit("line"), s["line"],
            F.lit("max_bytes"), h["max_bytes"],
        ),
    )))
    crossings = F.flatten(F.transform(path, lambda s: F.transform(
        I.protocol_calls(F.coalesce(s["message"], F.lit(""))),
        lambda p: F.named_struct(
            F.lit("protocol"), p, F.lit("file"), s["file"], F.lit("line"), s["line"]
        ),
    )))
    name = F.col("algorithm.name")
    hops = F.size(path) if max_hops is None else F.least(F.size(path), F.lit(max_hops))
    # what the name decides is looked up, and limits and protocols are read once a finding,
    # not once for each of its targets
    known = with_facts(wanted, name, lambda n: F.struct(
        I.dominant_size(n).alias("size"),
        F.filter(F.transform(I.impact_targets(n), lambda t, i: F.struct(
            i.alias("no"), t.alias("name"), I.dominant_size(t).alias("size"))), lambda t: t["size"].isNotNull()
        ).alias("targets")), "_facts").where("_facts.size is not null and size(_facts.targets) > 0")
    read = once(known, F.struct(limits.alias("limits"), crossings.alias("crossings")), "_read")
    staged = read.select(
        schema.finding_key().alias("finding_key"), "engine_rank", "seq",
        name.alias("from_algorithm"), F.col("_read.limits").alias("_limits"),
        F.col("_read.crossings").alias("_crossings"), hops.alias("hop_count"),
        F.col("_facts.size").alias("_from_bytes"), F.explode("_facts.targets").alias("_t"),
    ).select(
        "*", F.col("_t.no").alias("target_no"), F.col("_t.name").alias("to_algorithm"),
        F.col("_t.size").alias("_to_bytes"),
    ).drop("_t")
    to_bytes = F.col("_to_bytes").cast("bigint")
    broken = F.transform(
        F.filter("_limits", lambda h: to_bytes > h["max_bytes"]),
        lambda h: F.struct(
            h["type"].alias("type"), h["file"].alias("file"), h["line"].alias("line"),
            h["max_bytes"].alias("max_bytes"), to_bytes.alias("projected_bytes"),
            (to_bytes - h["max_bytes"]).alias("overflow"),
        ),
    )

    def projected(p):
        return I.encoded_size(to_bytes, I.protocol_encoding(p))

    violated = F.transform(
        F.filter("_crossings", lambda b: projected(b["protocol"]) > I.protocol_limit(b["protocol"])),
        lambda b: F.struct(
            b["protocol"].alias("protocol"),
            I.protocol_limit(b["protocol"]).alias("max_bytes"),
            projected(b["protocol"]).alias("projected_bytes"),
            (projected(b["protocol"]) - I.protocol_limit(b["protocol"])).alias("overflow"),
            I.protocol_hard_limit(b["protocol"]).alias("hard_limit"),
            b["file"].alias("file"), b["line"].alias("line"),
        ),
    )
    ratio = F.when(
        F.col("_from_bytes") > 0, F.col("_to_bytes") / F.col("_from_bytes")
    ).otherwise(F.lit(0.0))
    zones = staged.withColumns({
        "size_ratio": ratio, "broken_constraints": broken, "violated_protocols": violated,
    }).withColumn("blast_radius_score", I.blast_radius(
        F.col("hop_count"), F.size("broken_constraints"), F.size("violated_protocols"),
        F.col("size_ratio"),
    )).withColumn("blast_radius_grade", I.blast_grade(F.col("blast_radius_score")))
    return zones.drop("_limits", "_crossings", "_from_bytes", "_to_bytes")


def _place() -> Column:
    return F.struct("engine_rank", "seq", "target_no")


def first_zone(zones: DataFrame, *columns: str) -> DataFrame:
    """The first zone of each finding key, reduced to the given columns."""
    row = F.min_by(F.struct(*columns), _place())
    return zones.groupBy("finding_key").agg(row.alias("_z")).select("finding_key", "_z.*")


def last_zone(zones: DataFrame, *columns: str) -> DataFrame:
    """The last zone of each finding key; the component list uses this one."""
    row = F.max_by(F.struct(*columns), _place())
    return zones.groupBy("finding_key").agg(row.alias("_z")).select("finding_key", "_z.*")


def attach_impact(df: DataFrame, zones: DataFrame) -> DataFrame:
    """Blast radius of each finding from the first zone of its key."""
    first = first_zone(zones, "blast_radius_score").select(
        F.col("finding_key").alias("_zone_key"), F.col("blast_radius_score").alias("_blast")
    )
    keyed = df.withColumn("_key", schema.finding_key()).join(
        first, F.col("_key") == F.col("_zone_key"), "left"
    )
    return keyed.withColumn("blast_radius", F.col("_blast")).drop("_key", "_zone_key", "_blast")
