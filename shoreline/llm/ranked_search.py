"""Ranked lexical search, term at a time, with a limited set of accumulators.

Documents are indexed in blocks: a block has a header with the ids and the numbers of
terms of its documents, and a row for each of its terms with the documents that hold
the term (positions in the header) and how often.  The index is a table in the shared
folder.  Corpus statistics are sums over it.

The terms of the items, with their weights, are joined to the index, so each block gets
the lists that any item asks for, and every list carries the items that ask for it.  In
a block an item's terms are taken rarest first.  Each term adds its part to the
accumulators of the documents in its list, and makes new ones, until the sum of the
largest parts that the remaining terms can give is below the k-th partial score: then a
document without an accumulator can no longer be among the block's first k.  From there
on only the accumulators that exist are updated, each exactly, by looking their
documents up in the remaining lists.  A block gives its first k for each item; the first
k of all blocks together are the result, which no block's limit can change.

What a list gives to a document does not depend on the item, so it is worked out once
in a block.  Memory: one block's lists for one slice of items; items are dealt over so
many slices that a slice asks for a bounded number of terms.

Cases: null texts and texts without terms are in no list and are not counted; empty
items and items without a known term have no rows; rows of an item of the same id are
one item, with all its terms once; items without an id take no part; documents without
an id count in the statistics but are not returned; repeated documents are ranked each;
equal scores go by ascending id.  Other columns are not looked at.
"""

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shoreline.llm.frames import ship, stored

#: Digits, letters in lower case and everything beyond ASCII stay; all else parts terms.
_KEPT = bytes(c if c > 127 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text, as UTF-8, repeats included."""
    return (text or b"").translate(_KEPT).split()


def _blocks(batch: pa.RecordBatch, rows: int, size: int) -> Iterator[tuple[list, list]]:
    """Ids and texts of a batch in runs of at most ``rows`` documents and about ``size`` bytes."""
    ids, texts, held = [], [], 0
    for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
        ids.append(i)
        texts.append(t)
        held += len(t or b"")
        if len(ids) == rows or held >= size:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


INDEX = "block long, term binary, docs array<int>, times array<int>, ids array<long>, sizes array<long>"
_INDEX = pa.schema([
    ("block", pa.int64()), ("term", pa.binary()), ("docs", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())),
    ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))])


def _indexed(rows: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for ids, texts in _blocks(batch, rows, size):
                number = defaultdict()
                number.default_factory = number.__len__
                words = [np.fromiter(map(number.__getitem__, ws), np.int64, len(ws)) for ws in map(terms_of, texts)]
                sizes = np.array([len(w) for w in words], np.int64)
                block += 1
                yield pa.RecordBatch.from_arrays([
                    pa.array([block]), pa.nulls(1, pa.binary()), pa.nulls(1, pa.list_(pa.int32())),
                    pa.nulls(1, pa.list_(pa.int32())), pa.array([ids], pa.list_(pa.int64())),
                    pa.array([sizes], pa.list_(pa.int64()))], schema=_INDEX)
                if not number:
                    continue
                keys = np.concatenate(words) * len(ids) + np.repeat(np.arange(len(ids)), sizes)
                keys, times = np.unique(keys, return_counts=True)
                starts = np.searchsorted(keys, np.arange(len(number) + 1) * len(ids)).astype(np.int32)
                n = len(number)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, block)), pa.array(list(number), pa.binary()),
                    pa.ListArray.from_arrays(starts, (keys % len(ids)).astype(np.int32)),
                    pa.ListArray.from_arrays(starts, times.astype(np.int32)),
                    pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))], schema=_INDEX)

    return run


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_docs: int = 4096,
                block_bytes: int = 32 << 20) -> DataFrame:
    """The inverted index of ``docs`` in blocks, stored: headers have no term, lists no ids."""
    ship(docs.sparkSession)
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    return stored(texts.mapInArrow(_indexed(block_docs, block_bytes), INDEX), "index")


def _item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [sorted(set(terms_of(t))) for t in b.column(1).cast(pa.binary()).to_pylist()]
            at = np.repeat(np.arange(len(own)), [len(o) for o in own])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at)), pa.array([t for o in own for t in o], pa.binary())], ["item", "term"])

    named = items.where(items[id_col].isNotNull())
    return named.select(named[id_col].cast("long").alias("item"), named[text_col].cast("string").alias("text")).mapInArrow(
        run, "item long, term binary").distinct()


class _Block:
    """The lists of one block that a slice of items asks for, rarest term first."""

    def __init__(self, ids: pa.Array, sizes: np.ndarray, documents: int, terms: int):
        self.ids = ids
        self.norm = 20 * (100 - 50 + (50 * sizes * documents) // max(terms, 1))
        self.lists: list[tuple[np.ndarray, np.ndarray]] = []
        self.most: list[int] = []
        self.by_item: dict[int, list[int]] = defaultdict(list)

    def add(self, weight: int, docs: np.ndarray, times: np.ndarray, items: list[int]) -> None:
        times = times.astype(np.int64)
        parts = weight * ((1_000_000_000 * times) // (1000 * times + self.norm[docs]))
        for item in items:
            self.by_item[item].append(len(self.lists))
        self.lists.append((docs, parts))
        self.most.append(int(parts.max()))

    def scores(self, own: list[int], k: int) -> np.ndarray:
        """Accumulators of all documents; those that can be among the first k are exact."""
        held = np.zeros(len(self.norm), np.int64)
        rest = np.cumsum([self.most[t] for t in own][::-1])[::-1]
        alive = None
        for nth, t in enumerate(own):
            docs, parts = self.lists[t]
            if alive is None:
                held[docs] += parts
                if nth + 1 < len(own) and len(held) >= k and rest[nth + 1] < held.max():
                    kth = np.partition(held, len(held) - k)[len(held) - k]
                    # strictly below: a document that ties could still come before by its id
                    if rest[nth + 1] < kth:
                        alive = np.flatnonzero(held)
            else:
                at = np.searchsorted(docs, alive)
                at[at == len(docs)] = 0
                hit = docs[at] == alive
                held[alive[hit]] += parts[at[hit]]
        return held

    def first(self, k: int) -> pa.RecordBatch:
        items, rows, found = [], [], []
        known = self.ids.is_valid().to_numpy(zero_copy_only=False)
        for item, own in self.by_item.items():
            held = self.scores(own, k)
            held[~known] = 0
            at = np.flatnonzero(held)
            if len(at) > k:
                at = at[held[at] >= np.partition(held[at], len(at) - k)[len(at) - k]]
            if len(at) > k:
                # the k-th score may be that of several: the smaller ids stay
                ids = self.ids.take(pa.array(at)).to_numpy(zero_copy_only=False)
                at = at[np.lexsort((ids, -held[at]))[:k]]
            items.append(np.full(len(at), item))
            rows.append(at)
            found.append(held[at])
        rows = np.concatenate(rows) if rows else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays([
            pa.array(np.concatenate(items) if items else np.empty(0, np.int64)),
            self.ids.take(pa.array(rows)).cast(pa.int64()),
            pa.array(np.concatenate(found) if found else np.empty(0, np.int64))], ["item_id", "doc_id", "score"])


def _ranked(k: int, documents: int, terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for b in batches:
            heads = b.column("ids").is_valid().to_numpy(zero_copy_only=False)
            for i in range(b.num_rows):
                if heads[i]:
                    if block is not None:
                        yield block.first(k)
                    sizes = b.column("sizes")[i].values.to_numpy(zero_copy_only=False)
                    block = _Block(b.column("ids")[i].values, sizes, documents, terms)
                else:
                    block.add(b.column("weight")[i].as_py(), b.column("docs")[i].values.to_numpy(),
                              b.column("times")[i].values.to_numpy(), b.column("items")[i].as_py())
        if block is not None:
            yield block.first(k)

    return run


def search(index: DataFrame, items: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text",
           slice_terms: int = 1 << 20) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents of each item."""
    ship(items.sparkSession)
    asked = stored(_item_terms(items, id_col, text_col), "asked")
    heads = index.where("term is null").select("block", "ids", "sizes")
    lists = index.where("term is not null").select("block", "term", "docs", "times")
    counted = heads.select(F.explode("sizes").alias("n")).agg(
        F.coalesce(F.sum((F.col("n") > 0).cast("long")), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    documents, terms = counted
    slices = max(1, -(-asked.count() // slice_terms))
    held = lists.join(asked.select("term").distinct(), "term").groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(documents) + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
    weighed = held.select("term", weight.cast("long").alias("weight"))
    # the items' own inverted lists, a slice of the items at a time
    cut = F.pmod(F.xxhash64("item"), F.lit(slices)).cast("int")
    wanted = (asked.join(weighed, "term").groupBy("term", "weight", cut.alias("slice"))
              .agg(F.sort_array(F.collect_list("item")).alias("items")))
    met = lists.join(wanted, "term").select(
        "slice", "block", F.lit(1).alias("kind"), "weight", "term", "docs", "times", "items",
        F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("array<long>").alias("sizes"))
    tops = heads.select(
        F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "block", F.lit(0).alias("kind"),
        F.lit(0).cast("long").alias("weight"), F.lit(None).cast("binary").alias("term"),
        F.lit(None).cast("array<int>").alias("docs"), F.lit(None).cast("array<int>").alias("times"),
        F.lit(None).cast("array<long>").alias("items"), "ids", "sizes")
    dealt = met.unionByName(tops).repartition("slice", "block").sortWithinPartitions(
        "slice", "block", "kind", F.desc("weight"), "term")
    found = dealt.mapInArrow(_ranked(k, documents, terms), "item_id long, doc_id long, score long")
    # a bound on the rank is applied before the shuffle too
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc("doc_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "item_id", "rank", "doc_id", "score")


ORACLE = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM sizes),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
held AS (
  SELECT term, doc_id, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY term, doc_id),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM held, totals GROUP BY term, docs),
scored AS (
  SELECT a.item_id, h.doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // terms)))))::BIGINT AS score
  FROM asked a JOIN held h USING (term) JOIN weights USING (term) JOIN sizes s ON s.doc_id = h.doc_id, totals
  GROUP BY a.item_id, h.doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 50
"""
