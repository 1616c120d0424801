"""Benchmark items in documents, with edits: pigeonhole pieces and Myers distances.

Texts are compared lower-cased, each run of white space one space.  An item of n
characters may differ by ``rate * n`` edits (rounded down) from a passage of a document.
Cut into one piece more than that, at least one piece is found unchanged in any such
passage.  An item too short for an edit must stand there as whole words.  All pieces of a block of items go into one Aho-Corasick automaton, which reads
each document once; the places where a hit puts its item are verified with Myers'
bit-parallel edit distance, the item's whole length in one machine word of Python.

Items are taken in blocks of a bounded number of characters, which is what is sent to
the executors; a corpus is read once for each block.  Nothing is shuffled.
"""

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoreline.llm.frames import ship

RATE = 0.08


def plain(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def cut_pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(place, piece): ``budget`` + 1 pieces of nearly equal length."""
    n, k = len(item), budget + 1
    marks = [n * i // k for i in range(k + 1)]
    return [(a, item[a:b]) for a, b in zip(marks[:-1], marks[1:], strict=True) if b > a]


class Pattern:
    """An item ready for Myers' algorithm."""

    def __init__(self, item: str, rate: float):
        self.item, self.budget = item, int(len(item) * rate)
        self.at: dict[str, int] = defaultdict(int)
        for i, c in enumerate(item):
            self.at[c] |= 1 << i

    def distance(self, text: str) -> tuple[int, int] | None:
        """(least edits, end) of the item against any part of ``text``, if within budget."""
        where = text.find(self.item)
        if where >= 0:
            return 0, where + len(self.item)
        if not self.budget:
            return None
        m = len(self.item)
        mask, last = (1 << m) - 1, 1 << (m - 1)
        up, down, score, best = mask, 0, m, None
        get = self.at.get
        for j, c in enumerate(text):
            eq = get(c, 0)
            xv = eq | down
            xh = (((eq & up) + up) ^ up) | eq
            ph, mh = down | (mask & ~(xh | up)), up & xh
            score += (ph & last > 0) - (mh & last > 0)
            ph = (ph << 1) & mask
            mh = (mh << 1) & mask
            up, down = mh | (mask & ~(xv | ph)), ph & xv
            if score <= self.budget and (best is None or score < best[0]):
                best = score, j + 1
        return best


def _bordered(text: str, a: int, b: int) -> bool:
    """Whether the words at both ends of ``text[a:b]`` end there."""
    before = a and text[a - 1].isalnum() and text[a].isalnum()
    after = b < len(text) and text[b].isalnum() and text[b - 1].isalnum()
    return not before and not after


class Matcher:
    """Finds the items of one block in a text."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.patterns = {i: Pattern(t, rate) for i, t in items}
        self.automaton = ahocorasick.Automaton()
        where = defaultdict(list)
        for i, p in self.patterns.items():
            for at, piece in cut_pieces(p.item, p.budget):
                where[piece].append((i, at + len(piece) - 1))
        for piece, places in where.items():
            self.automaton.add_word(piece, places)
        if where:
            self.automaton.make_automaton()
        else:
            self.automaton = None

    def find(self, text: str | None, first: bool = False) -> list[tuple[int, int, int]]:
        """(item number, edits, end in the plain text) of each item found; one if ``first``."""
        if self.automaton is None or not text:
            return []
        text = plain(text)
        starts = defaultdict(list)
        for end, places in self.automaton.iter(text):
            for i, back in places:
                starts[i].append(end - back)
        found = []
        for i, at in starts.items():
            p, best = self.patterns[i], None
            at.sort()
            if not p.budget:
                # no room for edits: the item itself, not a part of longer words
                at = [x for x in at if _bordered(text, x, x + len(p.item))][:1]
            k, reach = 0, 2 * p.budget
            while k < len(at):
                lo = hi = at[k]
                # hits that may belong to one passage
                while k < len(at) and at[k] <= hi + reach:
                    hi = at[k]
                    k += 1
                a = max(0, lo - p.budget)
                seen = p.distance(text[a:hi + len(p.item) + p.budget])
                if seen and (best is None or seen[0] < best[0]):
                    best = seen[0], a + seen[1]
                    if first or not best[0]:
                        break
            if best:
                found.append((i, *best))
                if first:
                    break
        return found


_matchers: dict[tuple, Matcher] = {}


def _matcher(items: tuple[tuple[int, str], ...], rate: float) -> Matcher:
    key = (hash(items), len(items), rate)
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher(list(items), rate)
    return _matchers[key]


def blocks(items: DataFrame, id_col: str, text_col: str, most: int = 4_000_000) -> Iterator[list[tuple[int, str]]]:
    """Items as (id, plain text), in blocks of at most ``most`` characters (or one item).

    Null, empty and repeated texts are left out; an item without an id counts as -1.
    """
    rows = items.select(items[id_col].cast("long").alias("item"), items[text_col].cast("string").alias("text"))
    rows = rows.groupBy("text").agg(F.min("item").alias("item"))
    block, held = [], 0
    for r in rows.toLocalIterator():
        text = plain(r["text"])
        if not text:
            continue
        if block and held + len(text) > most:
            yield block
            block, held = [], 0
        block.append((-1 if r["item"] is None else r["item"], text))
        held += len(text)
    if block:
        yield block


def _matches(block, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts = [i for i, _ in block.value], tuple(enumerate(t for _, t in block.value))
        m = _matcher(texts, rate)
        for b in batches:
            rows = [(d, ids[i], edits, end) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True)
                    for i, edits, end in m.find(t.as_py())]
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "edits", "end"])

    return run


def benchmark_matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      item_id_col: str = "item_id", item_text_col: str = "text", rate: float = RATE) -> DataFrame:
    """``(doc_id, item_id, edits, end)``: the items found in each document, with the least edits.

    ``end`` is where the best passage ends, in characters of the compared text (the first
    one, of equally good ones in the first region with hits).  Items with the same text
    are one item, the one with the smallest id.  Null and empty texts and items match
    nothing; repeated rows give repeated results.  Other columns are not looked at.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    schema = "doc_id long, item_id long, edits long, end long"
    out = spark.createDataFrame([], schema)
    for block in blocks(items, item_id_col, item_text_col):
        out = out.unionByName(rows.mapInArrow(_matches(spark.sparkContext.broadcast(block), rate), schema))
    return out


def _hits(block, rate: float, text: Column) -> Column:
    import pandas as pd

    def hit(values: pd.Series) -> pd.Series:
        m = _matcher(tuple(enumerate(t for _, t in block.value)), rate)
        return pd.Series([bool(m.find(t, first=True)) for t in values], dtype=bool)

    return F.pandas_udf(hit, "boolean")(text)


def without_benchmark(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id",
                      item_text_col: str = "text", rate: float = RATE) -> DataFrame:
    """The rows of ``docs`` in which no item is found; columns as they are."""
    spark = docs.sparkSession
    ship(spark)
    text = docs[text_col].cast("string")
    for block in blocks(items, item_id_col, item_text_col):
        docs = docs.where(~_hits(spark.sparkContext.broadcast(block), rate, text))
    return docs
