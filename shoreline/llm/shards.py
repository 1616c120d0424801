"""Shards by a k-d tree over document metadata.

The tree is the same as for points in space: a node is split along its widest
dimension at the median weighted by bytes.  Nodes are split until there are as many
leaves as shards, which brings each leaf to its share of the bytes.  The dimensions are
the length of the text, its source, its language and its place in id order, each
brought to 0 .. 65535.  Along a dimension rows are ordered by that value, then by a
hash of the text, then by a hash of the id, so that equal texts stay together unless a
cut falls among them, and a value that a third of all rows share is still cut in half.
Rows that agree in all this are told apart by the number they got when they were read.

The median is found by narrowing: four passes count bytes in bins of the value, of the
text's hash, of the id's hash and of the number's.  A pass sends at most 65536 bins of each node to the
driver, whatever the number of rows.  Everything runs on a narrow table written once;
the text is read once.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoreline.llm.frames import numbered, stored

_BINS = 65_536
_DIMS = ["by_length", "by_source", "by_lang", "by_id"]


def _scaled(value: Column, low: int | None, high: int | None) -> Column:
    if low is None or high is None or low == high:
        return F.lit(0)
    return F.coalesce(F.floor((value - low) * (_BINS - 1) / (high - low)).cast("int"), F.lit(0))


def _bin(name: str, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col(name)), F.lit(_BINS)).cast("int")


def _narrow(docs: DataFrame, id_col: str, text_col: str, source_col: str | None, lang_col: str | None) -> DataFrame:
    text = docs[text_col].cast("string")
    crowd = [docs[c].cast("string") if c else F.lit(None).cast("string") for c in (source_col, lang_col)]
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("text_crc32"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"),
        F.xxhash64(crowd[0]).alias("source_hash"), F.xxhash64(crowd[1]).alias("lang_hash"),
        F.monotonically_increasing_id().alias("place"))


_LEVELS = ["value", "text_bin", "id_bin", "place_bin"]


def _cuts(rows: DataFrame, nodes: dict[int, tuple[str, float]]) -> dict[int, tuple[int, ...]]:
    """The cut of each node: a bin of each level, the last place on the left side.

    ``nodes`` has each node's dimension and the share of its bytes that goes left.
    """
    value = F.expr("CASE node " + " ".join(f"WHEN {n} THEN {d}" for n, (d, _) in nodes.items()) + " END")
    keyed = rows.where(F.col("node").isin([*nodes])).withColumn("value", value)
    found: dict[int, list[int]] = {n: [] for n in nodes}
    left: dict[int, float] = {}
    for level, name in enumerate(_LEVELS):
        inside = keyed
        if level:
            known = _LEVELS[:level]
            inside = keyed.where(" OR ".join(
                f"(node = {n} AND " + " AND ".join(f"{k} = {v}" for k, v in zip(known, found[n], strict=True)) + ")" for n in nodes))
        bins = inside.groupBy("node", F.col(name).alias("at")).agg(F.sum("size").alias("size")).collect()
        for n, (_, share) in nodes.items():
            mine = sorted((r["at"], r["size"]) for r in bins if r["node"] == n)
            if not level:
                left[n] = share * sum(s for _, s in mine)
            for at, size in mine:
                # the bin that the wanted number of bytes ends in
                if left[n] <= size or at == mine[-1][0]:
                    # at the end the bin goes to the side that it fits better
                    found[n].append(at - 1 if name == _LEVELS[-1] and left[n] < size / 2 else at)
                    break
                left[n] -= size
    return {n: tuple(f) for n, f in found.items()}


def kd_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text",
              source_col: str | None = "source", lang_col: str | None = "lang",
              target_bytes: int | None = None) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` for each row.

    ``size`` is the text's UTF-8 bytes plus 1; the law is ``bytes``: shards have nearly
    the same number of them (a cut can miss by one document's bytes).  Null texts have
    size 1, null metadata a place of its own, null or repeated ids are told apart by
    their text, repeated rows by their place.  With ``target_bytes`` there are as many
    shards as bring each to these bytes, instead of ``shards``.  Fewer documents than
    shards leave shards empty; an empty table gives no rows.  Other columns are not
    looked at.
    """
    narrow = stored(_narrow(docs, id_col, text_col, source_col, lang_col), "metadata")
    seen = narrow.agg(
        F.count(F.lit(1)).alias("rows"), F.min(F.log2("size")).alias("l0"), F.max(F.log2("size")).alias("l1"),
        F.min("doc_id").alias("i0"), F.max("doc_id").alias("i1"), F.sum("size").alias("bytes")).first()
    if target_bytes is not None:
        shards = max(1, -(-(seen["bytes"] or 0) // target_bytes))
    rows = narrow.select(
        "doc_id", "size", "text_crc32",
        _scaled(F.log2("size"), seen["l0"], seen["l1"]).alias("by_length"), _bin("source_hash", 1).alias("by_source"),
        _bin("lang_hash", 2).alias("by_lang"), _scaled(F.col("doc_id"), seen["i0"], seen["i1"]).alias("by_id"),
        _bin("text_hash", 3).alias("text_bin"),
        F.pmod(F.xxhash64(F.lit(4), "doc_id", "text_hash"), F.lit(_BINS)).cast("int").alias("id_bin"),
        _bin("place", 5).alias("place_bin"), "place")
    # a node is named by its first shard; it holds `want` shards
    rows = rows.withColumn("node", F.lit(0))
    want = {0: shards}
    for _ in range(math.ceil(math.log2(shards)) if shards > 1 else 0):
        split = [n for n, k in want.items() if k > 1]
        # the widths only decide which way to cut: one pass over the narrow table
        wide = {r["node"]: r for r in rows.where(F.col("node").isin(split)).groupBy("node").agg(
            *[(F.max(d) - F.min(d)).alias(d) for d in _DIMS]).collect()}
        nodes = {n: (max(_DIMS, key=lambda d: wide[n][d]), (want[n] // 2) / want[n]) for n in split if n in wide}
        if nodes:
            cuts = _cuts(rows, nodes)
            moved = F.col("node")
            for n, (dim, _) in nodes.items():
                right = F.struct(dim, *_LEVELS[1:]) > F.struct(*[F.lit(x).alias(c) for c, x in zip((dim, *_LEVELS[1:]), cuts[n], strict=True)])
                moved = F.when((F.col("node") == n) & right, n + want[n] // 2).otherwise(moved)
            rows = rows.withColumn("node", moved)
        for n in split:
            half = want[n] // 2
            want[n + half] = want[n] - half
            want[n] = half
    placed = rows.select("doc_id", "size", "text_crc32", F.col("node").alias("shard"), "place")
    ranked = numbered(placed, ["shard"], ["doc_id", "text_crc32", "size", "place"], "slot", seen["rows"])
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))
