"""Connected components of a graph whose edges are rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoreline.llm.frames import forget, stored_with


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """``edges`` (a long, b long) to ``(node long, label long)``: the smallest node reachable.

    Alternates the large-star and the small-star step: each node points its larger
    neighbours (then the smaller ones and itself) at the smallest node it knows.  Both
    are joins of the edge rows with a minimum per node, and the minimum is combined
    before the shuffle, so that a node with very many neighbours costs no more than
    its rows.  Each round is written to the shared folder.  Nodes without an edge do
    not appear; self-loops and repeated edges are ignored.  Stops when a round changes
    nothing; raises if ``rounds`` (logarithmic in the longest chain) are not enough.
    """
    sums = {"rows": F.count(F.lit(1)), "both": F.sum(F.xxhash64("a", "b") % 1_000_003), "ends": F.sum(F.xxhash64("b") % 1_000_003)}
    pairs, mark = stored_with(_tidy(edges), "links", **sums)
    for _ in range(rounds):
        if not mark.get("rows"):
            break
        after, now = stored_with(_small_star(_large_star(pairs)), "links", **sums)
        forget(pairs)
        pairs, before, mark = after, mark, now
        if mark == before:
            break
    else:
        raise RuntimeError(f"components: not stable after {rounds} rounds")
    nodes = pairs.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return nodes.unionByName(nodes.select(F.col("label").alias("node"), "label").distinct())


def _tidy(edges: DataFrame) -> DataFrame:
    return (edges.where("a <> b")
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())


def _large_star(pairs: DataFrame) -> DataFrame:
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return _tidy(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(pairs: DataFrame) -> DataFrame:
    # every row has a > b
    least = pairs.groupBy("a").agg(F.min("b").alias("m"))
    turned = pairs.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _tidy(turned.unionByName(least.select("a", F.col("m").alias("b"))))
