"""URL verdicts from rules and from trust that spreads over the links between hosts.

Rules come first.  For urls that no rule fits, the host decides.  Hosts are nodes; an
edge leads from the host of a page to the host of each link on it (weights: numbers of
links; links inside a host make no edge).  Trust starts at hosts with pages that a rule
allows and follows the links; distrust starts at hosts with pages that a rule blocks and
goes against them, to those who link there.  Both are personalised PageRanks: each step
passes on ``damping`` of a host's value along its edges and gives the rest to the seeds,
as does the value of hosts without edges.  A host is blocked if its share of distrust,
distrust / (trust + distrust), is at least ``threshold``; a host with neither is allowed.

Pages of one host, and links between two hosts, are counted before they are shuffled.
The two ranks are carried side by side as rows (kind, host, value).
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoreline.llm.frames import stored

#: (verdict, host, path)
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: The part of any host's rank that the last step may add.
TOLERANCE = 1e-6
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _absolute(url: Column) -> Column:
    return F.coalesce(url.contains("://"), F.lit(False))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.when(_absolute(url), F.translate(host, _UPPER, _LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.when(_absolute(url), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls if none does.  First listed wins ties."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # the last to be put in front is the longest, and of these the first listed
    for says, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def link_hosts(html: Column, own: Column) -> Column:
    """Hosts of the absolute links of a page, scheme or not, other than its own."""
    hrefs = F.regexp_extract_all(html, F.lit(r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""), F.lit(1))
    return F.filter(F.transform(hrefs, lambda h: F.translate(h, _UPPER, _LOWER)), lambda h: h != own)


def _judged(pages: DataFrame, id_col: str, url_col: str, rules) -> DataFrame:
    url = pages[url_col].cast("string")
    rows = pages.select(pages[id_col].alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return rows.withColumn("rule", rule).withColumn("by_rule", verdict)


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(src, dst, n)``: numbers of links from host to host."""
    host = host_of(pages[url_col].cast("string"))
    links = pages.select(host.alias("src"), F.explode(link_hosts(pages[html_col].cast("string"), host)).alias("dst"))
    return links.where("src <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def _shares(seeds: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(kind, host, share)`` of the seeds and ``(kind, src, dst, part)`` of the edges out of a host."""
    total = seeds.groupBy("kind").agg(F.sum("weight").alias("all"))
    start = stored(seeds.join(F.broadcast(total), "kind").select("kind", "host", (F.col("weight") / F.col("all")).alias("share")), "seeds")
    out = edges.groupBy("kind", "src").agg(F.sum("n").alias("out"))
    passed = stored(edges.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("out")).alias("part")), "edges")
    return start, passed


def settled(seeds: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = TOLERANCE,
            steps: int = 1000) -> DataFrame:
    """What ``propagate`` tends to with ever more steps; takes and returns the same.

    Adds up what the seeds' shares bring after 0, 1, 2, ... links, which is in proportion
    to the ranks, until a step adds to no host more than ``tolerance`` of what it has; so
    it never ends while hosts are newly reached.  Raises if ``steps`` are not enough.
    """
    start, passed = _shares(seeds, edges)
    value = start.select("kind", "host", F.col("share").alias("value"), F.col("share").alias("last"))
    for _ in range(steps):
        moved = (passed.join(value, (passed["kind"] == value["kind"]) & (passed["src"] == value["host"]))
                 .select(passed["kind"], F.col("dst").alias("host"), (F.col("last") * F.col("part") * damping).alias("value"))
                 .groupBy("kind", "host").agg(F.sum("value").alias("value")))
        value = value.withColumn("last", F.lit(0.0)).unionByName(moved.withColumn("last", F.col("value")))
        value = stored(value.groupBy("kind", "host").agg(F.sum("value").alias("value"), F.sum("last").alias("last")), "ranks")
        most = value.agg(F.max(F.col("last") / F.col("value"))).first()[0]
        if most is None or most <= tolerance:
            break
    else:
        raise RuntimeError(f"settled: ranks still change after {steps} steps")
    total = value.groupBy("kind").agg(F.sum("value").alias("all"))
    return value.join(F.broadcast(total), "kind").select("kind", "host", (F.col("value") / F.col("all")).alias("value"))


def propagate(seeds: DataFrame, edges: DataFrame, steps: int = 10, damping: float = 0.85) -> DataFrame:
    """``(kind, host, value)`` after ``steps`` from ``seeds`` ``(kind, host, weight)`` and ``edges`` ``(kind, src, dst, n)``.

    Values of a kind add up to 1 if it has seeds.
    """
    start, passed = _shares(seeds, edges)
    value = start.withColumnRenamed("share", "value")
    for step in range(steps):
        moved = (passed.join(value, (passed["kind"] == value["kind"]) & (passed["src"] == value["host"]))
                 .select(passed["kind"], F.col("dst").alias("host"), (F.col("value") * F.col("part") * damping).alias("value"))
                 .groupBy("kind", "host").agg(F.sum("value").alias("value")))
        # what did not move, at hosts without edges too, goes back to the seeds
        rest = moved.groupBy("kind").agg(F.sum("value").alias("moved"))
        back = (start.join(F.broadcast(rest), "kind", "left")
                .select("kind", "host", (F.col("share") * (1 - F.coalesce("moved", F.lit(0.0)))).alias("value")))
        value = moved.unionByName(back).groupBy("kind", "host").agg(F.sum("value").alias("value"))
        value = stored(value, "ranks")
    return value


def url_verdicts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                 rules=RULES, damping: float = 0.85, threshold: float = 0.5, tolerance: float = TOLERANCE) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for each row.

    The ranks are those of ``settled``, so distrust reaches hosts any number of links away.

    Null urls and urls without ``://`` have an empty host and path; no rule fits an empty
    host, and it is no node: such pages are allowed.  Null pages have no links; repeated
    rows count as often as they occur.  Other columns are not looked at.
    """
    judged = _judged(pages, id_col, url_col, rules)
    seeds = (judged.where("by_rule is not null and host <> ''").groupBy("host", "by_rule")
             .agg(F.count(F.lit(1)).alias("weight"))
             .select(F.when(F.col("by_rule") == "allow", "trust").otherwise("distrust").alias("kind"), "host", "weight"))
    links = host_edges(pages, url_col, html_col)
    edges = links.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionByName(
        links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    ranks = settled(seeds, edges, damping, tolerance)
    hosts = ranks.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "trust", F.col("value")).otherwise(0.0)).alias("trust"),
        F.sum(F.when(F.col("kind") == "distrust", F.col("value")).otherwise(0.0)).alias("distrust"))
    bad = hosts.where(F.col("distrust") >= threshold * (F.col("trust") + F.col("distrust"))).where("distrust > 0").select(
        F.col("host").alias("bad_host"))
    return judged.join(bad, judged["host"] == bad["bad_host"], "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("by_rule", F.when(F.col("bad_host").isNotNull(), "block").otherwise("allow")).alias("verdict"))
