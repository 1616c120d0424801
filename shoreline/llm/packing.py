"""Optimal length buckets and token-budget batches.

Texts are measured in byte tokens: one for each UTF-8 byte and one that ends the text.
A text longer than ``max_len`` is cut into pieces of ``max_len``, so nothing is lost.
Each piece is padded to the upper bound of its bucket.  The bounds come from dynamic
programming over the histogram of all piece lengths, which has at most ``max_len``
rows whatever the size of the corpus, so it is safe on the driver.  Inside a bucket
pieces are put into batches that hold at most ``budget`` tokens, padding included.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoreline.llm.frames import numbered


def choose_bounds(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least padding in all.

    ``lengths`` ascend and differ.  The last bound is the last length.  Among equally
    good choices the one with fewer buckets is taken.  No lengths give no bounds.
    """
    if not lengths:
        return []
    size = np.array(lengths, np.float64)
    many = np.concatenate([[0.0], np.cumsum(np.array(counts, np.float64))])
    n = len(lengths)
    # cost[j]: tokens, padding included, of the first j lengths in the buckets so far
    cost = np.concatenate([[0.0], size * many[1:]])
    cuts = []
    for _ in range(min(buckets, n) - 1):
        new, cut = cost.copy(), np.full(n + 1, -1)
        for j in range(1, n + 1):
            with_cut = cost[:j] + size[j - 1] * (many[j] - many[:j])
            at = int(with_cut.argmin())
            if with_cut[at] < new[j]:
                new[j], cut[j] = with_cut[at], at
        cuts.append(cut)
        cost = new
    bounds, j = [], n
    for cut in reversed(cuts):
        if j and cut[j] >= 0:
            bounds.append(lengths[j - 1])
            j = int(cut[j])
    if j:
        bounds.append(lengths[j - 1])
    return bounds[::-1]


def pieces(docs: DataFrame, id_col: str, text_col: str, max_len: int) -> DataFrame:
    """``(doc_id, piece, start, n_tokens)``; a null or empty text is one piece of one token."""
    total = F.coalesce(F.octet_length(docs[text_col].cast("string")), F.lit(0)).cast("long") + 1
    sized = docs.select(docs[id_col].cast("long").alias("doc_id"), total.alias("total"))
    number = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(total - 1) div {max_len}"))).alias("piece")
    cut = sized.select("doc_id", "total", number)
    return cut.select("doc_id", "piece", (F.col("piece") * max_len).alias("start"),
                      F.least(F.lit(max_len).cast("long"), F.col("total") - F.col("piece") * max_len).alias("n_tokens"))


def length_buckets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_len: int = 4096,
                   buckets: int = 16, budget: int = 65_536) -> DataFrame:
    """``(doc_id, piece, start, n_tokens, bucket, bound, batch, slot)``, one row for each piece.

    ``start`` counts bytes.  ``batch`` and ``slot`` are numbered from 0, batches in each
    bucket, slots in each batch; a batch is full but for the last of its bucket.  The
    order in a bucket is a fixed shuffle by id and piece.  Ids may be null or repeated:
    such pieces are told apart by their place alone.  An empty table gives no rows.
    Other columns are not looked at.
    """
    if max_len > budget:
        raise ValueError("a piece must fit the budget")
    cut = pieces(docs, id_col, text_col, max_len)
    histogram = sorted((r["n_tokens"], r["count"]) for r in cut.groupBy("n_tokens").count().collect())
    bounds = choose_bounds([n for n, _ in histogram], [c for _, c in histogram], buckets)
    limits = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.lit(None).cast("array<long>")
    placed = (cut.withColumn("bucket", F.size(F.filter(limits, lambda b: b < F.col("n_tokens"))))
              .withColumn("bound", F.element_at(limits, F.col("bucket") + 1)))
    ranked = numbered(placed, ["bucket"], ["doc_id", "piece", "n_tokens"], "rank", sum(c for _, c in histogram))
    room = F.expr(f"{budget} div bound")
    return ranked.select("doc_id", "piece", "start", "n_tokens", "bucket", "bound",
                         F.floor(F.col("rank") / room).alias("batch"), (F.col("rank") % room).alias("slot"))
