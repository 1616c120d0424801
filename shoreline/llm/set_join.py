"""Jaccard join of word-shingle sets by T-occurrence search (DivideSkip).

A text's set is the distinct hashes of its ``words``-word shingles.  Two sets of n and m
tokens link when their overlap o has ``9 o >= 4 (n + m)``, which is a Jaccard similarity
of 0.8 or more; a set of n then shares at least ``T = ceil(0.8 n)`` of its tokens.

**Who can have a partner.**  A token in one text only cannot be shared, so a text with
more than ``n // 5`` such tokens links with nothing.  This is counted first on the
tokens whose hash lies in the lowest quarter (the same tokens in every text, so the
count is exact for them), then on all tokens of the texts that are left.

**Which texts meet.**  Their shared tokens are ordered by the number of texts that hold
them, rarest first.  A linked pair shares a token among the first ``n // 5 + 1`` of each,
so only these are put into inverted lists (here: cells), and a passage or a phrase that
very many texts have comes last and mostly into none.  In a cell every text meets the
head of its size band, and the heads of neighbouring bands meet.

**The search.**  A query's lists are divided: the L longest are set aside, the others
are merged by a heap of their heads, skipping what cannot occur ``T - L`` times; what
does is looked up in the long lists by binary search until it has or cannot have the
overlap it needs.  First each head is searched among the texts that meet it, which links
a family of copies in steps in proportion to its size.  The cells whose texts are then
still in different components are searched in full: texts connected by such cells form a
bin, and each text is a query against the lists of the others that are not in its own
component.  A bin of more than ``block`` texts is dealt over pairs of blocks, so no task
holds more than two blocks.  Only links that join components leave a task.

Texts are equal if 128 bits of hash are, tokens if 64 bits are.
"""

from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import reduce
from heapq import heapify, heappop, heappush
from math import log2
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shoreline.llm.components import components
from shoreline.llm.frames import forget, pieces, ship, stored, text_keys

_MIX, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)
#: Tokens with hashes below this are counted first: a quarter.
_LOW = np.uint64(1 << 62)


def tokens_of(text: bytes | None, words: int) -> np.ndarray:
    """The distinct shingles of a text as sorted hashes; one for fewer words, none without words."""
    parts = (text or b"").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    wide = min(words, len(parts))
    out = np.full(len(parts) - wide + 1, wide, np.uint64)
    for i in range(wide):
        out = (out ^ hashes[i:len(parts) - wide + 1 + i]) * _MIX
        out ^= out >> _TURN
    return np.unique(out)


def needed(n: int, m: int) -> int:
    """The least overlap of linked sets of n and m tokens."""
    return -(-4 * (n + m) // 9)


# -- the search in a task ----------------------------------------------------------------

def merged(lists: list[list[int]], least: int) -> Iterator[tuple[int, int]]:
    """The numbers in at least ``least`` of the sorted lists and in how many they are."""
    heap = [(l[0], i, 0) for i, l in enumerate(lists) if l]
    heapify(heap)
    while len(heap) >= least:
        top, out = heap[0][0], []
        while heap and heap[0][0] == top:
            out.append(heappop(heap))
        if len(out) >= least:
            yield top, len(out)
            to = top + 1
        else:
            # fewer than `least` lists lie before the next head, so nothing before it counts
            while len(out) < least - 1 and heap:
                out.append(heappop(heap))
            if not heap:
                return
            to = heap[0][0]
        for _, i, at in out:
            at = bisect_left(lists[i], to, at)
            if at < len(lists[i]):
                heappush(heap, (lists[i][at], i, at))


def _holds(numbers: list[int], number: int) -> bool:
    at = bisect_left(numbers, number)
    return at < len(numbers) and numbers[at] == number


class Bin:
    """Texts of one bin: inverted lists of those that are listed, and a union of what is linked."""

    def __init__(self, rows: list[tuple[int, int, int, np.ndarray, bool, bool]]):
        # the texts of a component have neighbouring numbers, so a query can leave out its own
        self.rows = sorted(rows, key=lambda r: (r[1], r[0]))
        self.root = list(range(len(rows)))
        self.span: dict[int, tuple[int, int]] = {}
        for i, (_, label, *_) in enumerate(self.rows):
            low, _ = self.span.get(label, (i, i))
            self.span[label] = low, i + 1
            self.root[i] = low
        # the lists one after the other, by token: a list is a run of numbers in order
        listed = [i for i, row in enumerate(self.rows) if row[5]]
        tokens = np.concatenate([np.empty(0, np.int64), *[self.rows[i][3] for i in listed]])
        numbers = np.repeat(np.array(listed, np.int64), [len(self.rows[i][3]) for i in listed])
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.numbers = tokens[order], numbers[order].astype(np.int32)

    def lists(self, tokens: np.ndarray) -> Iterator[list[int]]:
        """The lists of these tokens that are not empty."""
        starts, ends = (np.searchsorted(self.tokens, tokens, side).tolist() for side in ("left", "right"))
        for a, b in zip(starts, ends, strict=True):
            if a < b:
                yield self.numbers[a:b].tolist()

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def partners(self, q: int, skip: Callable[[int], bool]) -> Iterator[int]:
        """The listed texts of other labels that link with text ``q``, but for those to ``skip``."""
        _, label, n, tokens, _, _ = self.rows[q]
        low, high = self.span[label]
        least = -(-4 * n // 5)
        lists = []
        for found in self.lists(tokens):
            a, b = bisect_left(found, low), bisect_left(found, high)
            found = found[:a] + found[b:] if a < b else found
            if found:
                lists.append(found)
        if len(lists) < least:
            return
        lists.sort(key=len)
        longs = min(least - 1, int(least / (0.01 * log2(len(lists[-1]) + 1) + 1)))
        short, long = lists[:len(lists) - longs], lists[len(lists) - longs:]
        for other, seen in merged(short, least - longs):
            if skip(other):
                continue
            # each list not asked yet can add one
            want = needed(n, self.rows[other][2])
            left = len(long)
            for numbers in long:
                if seen >= want or seen + left < want:
                    break
                seen += _holds(numbers, other)
                left -= 1
            if seen >= want:
                yield other

    def links(self) -> tuple[list[int], list[int]]:
        """Links of the texts that ask, as many as join components."""
        a, b = [], []
        for q, row in enumerate(self.rows):
            if not row[4]:
                continue
            for other in self.partners(q, lambda o, q=q: self.find(o) == self.find(q)):
                mine, theirs = self.find(q), self.find(other)
                if mine != theirs:
                    self.root[max(mine, theirs)] = min(mine, theirs)
                    a.append(row[0])
                    b.append(self.rows[other][0])
        return a, b

    def superseded(self) -> tuple[list[int], list[int]]:
        """Read in order of labels: the texts linked with one before them that is not itself such a text."""
        by: dict[int, int] = {}
        for q, row in enumerate(self.rows):
            if row[4] and q not in by:
                for other in self.partners(q, lambda o, q=q: o in by or self.rows[o][4] and o < q):
                    by[other] = q
        return [self.rows[q][0] for q in by.values()], [self.rows[o][0] for o in by]


def _searched(what: str):
    """Sorted rows ``bin, c, label, n, tokens, asks, listed`` to what a bin answers (a method of it)."""
    def flush(rows):
        a, b = getattr(Bin(rows), what)()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            bins, cs, labels, ns, asks, listed = (batch.column(x).to_pylist() for x in ("bin", "c", "label", "n", "asks", "listed"))
            tokens = batch.column("tokens")
            for i, x in enumerate(bins):
                if x != now and rows:
                    yield flush(rows)
                    rows = []
                now = x
                rows.append((cs[i], labels[i], ns[i], tokens[i].values.to_numpy(zero_copy_only=False), asks[i], listed[i]))
        if rows:
            yield flush(rows)

    return run


def _search(rows: DataFrame, what: str = "links") -> DataFrame:
    dealt = rows.select("bin", "c", "label", "n", "tokens", "asks", "listed").repartition("bin").sortWithinPartitions("bin")
    return dealt.mapInArrow(_searched(what), "a long, b long").distinct()


# -- which texts meet --------------------------------------------------------------------

def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ship(docs.sparkSession)
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text")).select(
        *text_keys(F.col("text")), "doc_id", "text")


def _marked(texts: DataFrame, words: int) -> DataFrame:
    """``(k1, k2, doc_id, n, low)``: the size of the set and its lowest quarter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            sets = [tokens_of(t, words) for t in b.column("text").cast(pa.binary()).to_pylist()]
            low = [s[:np.searchsorted(s, _LOW)].view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays([
                b.column("k1"), b.column("k2"), b.column("doc_id"), pa.array([len(s) for s in sets], pa.int32()),
                pa.array(low, pa.list_(pa.int64()))], ["k1", "k2", "doc_id", "n", "low"])

    return texts.select("k1", "k2", "doc_id", "text").mapInArrow(
        run, "k1 long, k2 long, doc_id long, n int, low array<long>")


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """``(c, n, text)`` to ``(c, n, tokens)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            sets = [tokens_of(t, words).view(np.int64) for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("c"), b.column("n"), pa.array(sets, pa.list_(pa.int64()))], ["c", "n", "tokens"])

    return texts.select("c", "n", "text").mapInArrow(run, "c long, n int, tokens array<long>")


def _open_texts(marked: DataFrame) -> DataFrame:
    """``(c, k1, k2, least, n)``: the texts of whose lowest tokens not too many are in no other text."""
    held = marked.select("k1", F.explode("low").alias("t")).groupBy("t").agg(F.min("k1").alias("k1"), F.max("k1").alias("last"))
    alone = held.where("k1 = last").groupBy("k1").agg(F.count(F.lit(1)).alias("alone"))
    # how many rows have the text and the smallest id: one of them stands for the text
    rows = marked.groupBy("k1", "k2", "doc_id").agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("n"))
    order = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    texts = rows.groupBy("k1", "k2").agg(
        F.min("doc_id").alias("least"), F.max("n").alias("n"), F.min_by("rows", order).alias("twins")).where("n > 0")
    left = texts.join(alone, "k1", "left").where("coalesce(alone, 0) <= n div 5")
    return stored(left.select(F.monotonically_increasing_id().alias("c"), "k1", "k2", "least", "n", "twins"), "open")


def _ordered(sets: DataFrame) -> DataFrame:
    """``(c, n, own, tokens)``: tokens in other texts too, rarest first; ``own`` others come before them."""
    each = sets.select("c", "n", F.explode("tokens").alias("t"))
    held = each.groupBy("t").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    found = each.join(held, "t").groupBy("c", "n").agg(
        F.sort_array(F.collect_list(F.struct("held", "t"))).alias("x"))
    own = (F.col("n") - F.size("x")).alias("own")
    return stored(found.select("c", "n", own, F.col("x.t").alias("tokens")).where("own <= n div 5"), "sets")


def _band(n) -> F.Column:
    """Linked sizes differ by a factor of 1.25 at most: they are in the same or in neighbouring bands."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(1.2501)))


def _cells(ordered: DataFrame) -> DataFrame:
    """``(t, band, c)``: the lists of the first ``n // 5 + 1`` tokens with two texts or more.

    The smaller text of a linked pair has its first shared token among its first
    ``n // 9 + 1``, so a list in which no text has the token there is left out.
    """
    short = ordered.select("c", "n", "own", F.posexplode(F.expr("slice(tokens, 1, n div 5 - own + 1)")).alias("i", "t"))
    short = short.select("c", _band(F.col("n")).alias("band"), "t", (9 * (F.col("own") + F.col("i")) <= F.col("n")).alias("early"))
    crowded = short.groupBy("t").agg(F.count(F.lit(1)).alias("of"), F.max("early").alias("early")).where("of > 1 and early")
    return stored(short.select("t", "band", "c").join(crowded.select("t"), "t"), "cells")


def _meetings(cells: DataFrame) -> DataFrame:
    """``(a, b)``: each text of a cell and the head of its band, and the heads of neighbouring bands."""
    heads = cells.groupBy("t", "band").agg(F.min("c").alias("head"))
    members = cells.join(heads, ["t", "band"]).where("c <> head").select(F.col("head").alias("a"), F.col("c").alias("b"))
    above = heads.select("t", (F.col("band") - 1).alias("band"), F.col("head").alias("b"))
    steps = heads.join(above, ["t", "band"]).where("head <> b").select(F.col("head").alias("a"), "b")
    return members.unionByName(steps).distinct()


def _head_links(ordered: DataFrame, meetings: DataFrame, block: int) -> DataFrame:
    """Search every head among the texts that meet it; a head of many asks in several bins."""
    sizes = meetings.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("bins"))
    placed = meetings.join(sizes, "a").select(
        F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("bins"))).alias("bin"), F.col("b").alias("c"))
    heads = sizes.select("a", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("part")).select(
        F.xxhash64("a", F.col("part").cast("long")).alias("bin"), F.col("a").alias("c"))
    listed = placed.select("bin", "c", F.lit(False).alias("asks"), F.lit(True).alias("listed"))
    asking = heads.select("bin", "c", F.lit(True).alias("asks"), F.lit(False).alias("listed"))
    return _search(listed.unionByName(asking).join(ordered, "c").withColumn("label", F.col("c")))


def _labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``(c, label)`` of all nodes; without a link each is its own."""
    found = components(links).select(F.col("node").alias("c"), "label")
    return nodes.select("c").join(found, "c", "left").select("c", F.coalesce("label", "c").alias("label"))


def _full_links(ordered: DataFrame, cells: DataFrame, labels: DataFrame, block: int) -> DataFrame:
    """Search the cells whose texts are in different components, all texts against all others."""
    named = cells.join(labels, "c")
    mixed = named.groupBy("t").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("t")
    open_ = stored(cells.join(mixed, "t"), "open-cells")
    groups = components(_meetings(open_)).select(F.col("node").alias("c"), F.col("label").alias("grp"))
    sizes = groups.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = groups.join(sizes, "grp").withColumn("mine", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    # a text goes to every pair of blocks that has its own; the pair's lower block asks
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    placed = dealt.select(F.xxhash64("grp", low, high).alias("bin"), "c",
                          (F.col("mine") == low).alias("asks"), (F.col("mine") == high).alias("listed"))
    rows = placed.join(labels, "c").join(ordered, "c")
    return _search(rows)


class Joined(NamedTuple):
    """What the join knows: all as stored tables."""

    rows: DataFrame  #: each row's ``(k1, k2, doc_id, n)``
    texts: DataFrame  #: ``(c, k1, k2, least, ...)`` of the texts that can have partners
    sets: DataFrame  #: their ``(c, n, own, tokens)``
    families: DataFrame  #: ``(c, family)`` of the linked ones, the same for all that links connect


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
            block: int = 384) -> Joined:
    """Find the families of linked texts.

    A text that no different text is linked with is in no family.
    """
    texts = _texts(docs, id_col, text_col)
    lows = stored(_marked(texts, words), "lows")
    left = _open_texts(lows)
    marked = stored(lows.drop("low"), "marked")
    forget(lows)
    same = (texts["k1"] == left["k1"]) & (texts["k2"] == left["k2"]) & texts["doc_id"].eqNullSafe(left["least"])
    # dealt by text at any size of the tables: the list of open texts grows with the corpus
    found = texts.hint("merge").join(left.hint("merge"), same)
    # rows that agree in text and id are one; only these need a shuffle of their own
    twins = found.where("twins > 1").select("c", "n", "text").dropDuplicates(["c"])
    sets = stored(_sets(found.where("twins = 1").select("c", "n", "text").unionByName(twins), words), "tokens")
    ordered = _ordered(sets)
    forget(sets)
    cells = _cells(ordered)
    meetings = stored(_meetings(cells), "meetings")
    more = stored(_head_links(ordered, meetings, 1024), "head-links")
    labels = stored(_labelled(ordered, more), "labels")
    more = stored(_full_links(ordered, cells, labels, block), "full-links")
    joined = more.join(labels.select(F.col("c").alias("a"), F.col("label").alias("la")), "a").join(
        labels.select(F.col("c").alias("b"), F.col("label").alias("lb")), "b").select(
        F.col("la").alias("a"), F.col("lb").alias("b"))
    last = components(joined).select(F.col("node").alias("label"), F.col("label").alias("top"))
    families = labels.join(last, "label", "left").select("c", F.coalesce("top", "label").alias("family"))
    crowded = families.groupBy("family").agg(F.count(F.lit(1)).alias("of")).where("of > 1").select("family")
    families = stored(families.join(crowded, "family").select("c", "family"), "families")
    forget(cells, meetings)
    return Joined(marked, left, ordered, families)


def superseded(joined: Joined, block: int = 1024) -> DataFrame:
    """``(k1, k2)`` of the texts that a kept one makes superfluous.

    Read a family in order of ids, nulls last: a text is kept unless it is linked with one
    kept before it.  A turn decides the first ``block`` open texts of each family in one
    task and searches the kept of them among the family's others, dealt over tasks.  A
    family of copies ends in its first turn; a turn keeps or drops ``block`` texts at least.
    """
    order = Window.partitionBy("family").orderBy(F.asc_nulls_last("least"), "c")
    open_ = stored(joined.families.join(joined.texts.select("c", "least"), "c"), "open-families")
    gone = []
    while not open_.isEmpty():
        # a bound on the rank is applied before the shuffle too
        first = stored(open_.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= block), "first")
        both = F.lit(True)
        within = first.select(F.col("family").alias("bin"), "c", F.col("nth").cast("long").alias("label"),
                              both.alias("asks"), both.alias("listed")).join(joined.sets, "c")
        out = stored(_search(within, "superseded").select(F.col("b").alias("c")).distinct(), "superseded")
        gone.append(out)
        rest = stored(open_.join(first.select("c"), "c", "left_anti"), "rest")
        if rest.isEmpty():
            break
        bins = rest.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("bins"))
        heads = first.join(out, "c", "left_anti").join(bins, "family").select(
            "family", "c", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("part"))
        asking = heads.select(F.xxhash64("family", F.col("part").cast("long")).alias("bin"), "c",
                              F.lit(-1).cast("long").alias("label"), F.lit(True).alias("asks"), F.lit(False).alias("listed"))
        listed = rest.join(bins, "family").select(
            F.xxhash64("family", F.pmod(F.xxhash64("c"), F.col("bins"))).alias("bin"), "c", F.col("c").alias("label"),
            F.lit(False).alias("asks"), F.lit(True).alias("listed"))
        near = stored(_search(asking.unionByName(listed).join(joined.sets, "c"), "superseded").select(
            F.col("b").alias("c")).distinct(), "superseded")
        gone.append(near)
        open_ = stored(rest.join(near, "c", "left_anti"), "open-families")
    if not gone:
        return joined.texts.where("false").select("k1", "k2")
    return reduce(DataFrame.unionByName, gone).join(joined.texts, "c").select("k1", "k2")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for each row; ``component_id`` is the smallest id reachable.

    Equal texts are linked.  Null texts count as empty; a text without words has no
    shingles and is linked with nothing, not even with an equal one: its component is
    its own id.  Ids may be null or repeat: a component has its smallest id, null only
    where no row of it has one.  Other columns are not looked at.
    """
    joined = similar(docs, id_col, text_col, words)
    families = joined.families.join(joined.texts, "c").select("k1", "k2", "family")
    texts = joined.rows.groupBy("k1", "k2").agg(F.min("doc_id").alias("least"))
    known = texts.join(families, ["k1", "k2"], "left")
    tops = known.where("family is not null").groupBy("family").agg(F.min("least").alias("top"))
    final = known.join(tops, "family", "left").select(
        "k1", "k2", F.when(F.col("family").isNull(), F.col("least")).otherwise(F.col("top")).alias("component_id"))
    return joined.rows.join(final, ["k1", "k2"]).select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


ORACLE = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
tokens AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS t
  FROM worded),
sizes AS (SELECT doc_id, count(*) AS n FROM tokens GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o
  FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * o >= 80 * (x.n + y.n - o)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN reach r ON r.a = d.doc_id GROUP BY ALL
"""
