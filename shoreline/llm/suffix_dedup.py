"""Exact removal of repeated byte strings by induced suffix sorting.

A 200-byte string that starts at two places marks both.  The suffixes are sorted by
induction from a sample, as in external suffix sorting with common prefixes:

1. **Sample.**  Every 200-byte window names one sample suffix: the place of its
   smallest hashed ``gram`` (leftmost on ties).  This depends on the window's bytes
   alone, so equal windows name sample suffixes that start with the same gram, at the
   same distance.  A sample suffix stands for the windows that named it, up to 152
   bytes to its left.
2. **Reduction.**  The grams at sample suffixes are the names of the reduced string.
   One that occurs once cannot be part of a repeat and is dropped.  Sample suffixes
   with the same surroundings are counted, and one of them goes on.
3. **Sorting.**  What is left, as tuples (name, bytes to the right, bytes to the left),
   is sorted by Spark's shuffle and external sorter: a queue that spills to disk and
   hands the tuples back in order, so a shard may be far larger than memory.
4. **Induction.**  From the sorted sample suffixes the order of the suffixes one, two,
   ... bytes further left follows: by the byte in front, ties by the order of the
   suffix behind it.  The common prefix of neighbours is carried along: one more than
   the least common prefix between the suffixes behind them.  A neighbour with 200 or
   more bytes in common is a repeat.  A suffix that cannot reach that any more leaves.

A task holds one batch of names at a time.  A name of more than ``crowd`` places is not
sorted in one task: its windows are told apart by their hashes, a count that is combined
before the shuffle.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoreline.llm.frames import pieces, ship, text_keys

GRAM = 48
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_MARKS = "ghash long, chash long, marks binary"
# never null: no step then adds a filter of its own, and the shuffled samples serve all of them
_SAMPLES = T.StructType([T.StructField(c, T.LongType(), False) for c in ("ghash", "chash", "k1", "k2", "at")])


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


class _Hasher:
    """Hashes of any piece of a block, from prefix sums of a polynomial modulo 2**64."""

    def __init__(self):
        self.up = self.down = np.empty(0, np.uint64)

    def load(self, block: np.ndarray) -> None:
        if len(self.up) <= len(block):
            self.up, self.down = _powers(_BASE, len(block) * 2), _powers(_BACK, len(block) * 2)
        self.sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum((block.astype(np.uint64) + np.uint64(1)) * self.up[:len(block)], out=self.sums[1:])

    def pieces(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return _mixed((self.sums[size:] - self.sums[:n]) * self.down[:n])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * _MIX
    return h ^ (h >> np.uint64(32))


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    out, span = values, 1
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def sample_suffixes(data: bytes, length: int, hasher: _Hasher) -> Iterator[tuple[np.ndarray, ...]]:
    """(gram hash, surroundings hash, place, left, right) of the sample suffixes of a text.

    ``left`` and ``right`` are the distances from the first and the last window that
    named the place.  Long texts are read in blocks of windows.
    """
    for at in range(0, len(data) - length + 1, BLOCK):
        block = np.frombuffer(data, np.uint8, min(BLOCK + length - 1, len(data) - at), at)
        hasher.load(block)
        grams = hasher.grams(GRAM)
        # the upper half orders the grams, the lower half tells where they are
        ranked = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        named = (_window_minima(ranked, length - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], named[1:] != named[:-1]]))
        last = np.concatenate([first[1:], [len(named)]]) - 1
        place = named[first]
        around = hasher.pieces(first, last + length)
        shape = ((place - first) * 1024 + (place - last)).astype(np.uint64)
        yield grams[place], _mixed(around ^ (shape * _MIX)), place + at, place - first, place - last


def _packed(place, left, right):
    return (place.astype(np.int64) << 16) | (left.astype(np.int64) << 8) | right.astype(np.int64)


def _unpacked(at: int) -> tuple[int, int, int]:
    return at >> 16, (at >> 8) & 255, at & 255


def _bitmap(marks: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in np.packbits(marks, axis=1)]


def _column(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(name).to_numpy(zero_copy_only=False)


def _samples(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher()
        for b in pieces(batches):
            rows = []
            for i, text in enumerate(b.column("text")):
                for g, c, place, left, right in sample_suffixes(text.as_py().encode("utf-8", "surrogatepass"), length, hasher):
                    rows.append((g, c, _packed(place, left, right), np.full(len(g), i)))
            if not rows:
                continue
            g, c, at, i = (np.concatenate(x) for x in zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(g.view(np.int64)), pa.array(c.view(np.int64)), pa.array(_column(b, "k1")[i]),
                 pa.array(_column(b, "k2")[i]), pa.array(at)], ["ghash", "chash", "k1", "k2", "at"])

    return run


def _surroundings(length: int):
    """Texts with the sample suffixes asked of them to sort tuples."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for b in pieces(batches):
            out = ([], [], [], [], [])
            k1, k2 = _column(b, "k1"), _column(b, "k2")
            for i, (text, asked) in enumerate(zip(b.column("text"), b.column("asked"), strict=True)):
                # copies come one after another; one of them will do
                if before == (k1[i], k2[i]):
                    continue
                before = (k1[i], k2[i])
                data = text.as_py().encode("utf-8", "surrogatepass")
                for row in asked.as_py():
                    place, left, right = _unpacked(row["at"])
                    for col, v in zip(out, (row["ghash"], row["chash"], row["n"], data[place:place - right + length],
                                            data[place - left:place][::-1]), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()),
                 pa.array(out[3], pa.binary()), pa.array(out[4], pa.binary())],
                ["ghash", "chash", "n", "tail", "front"])

    return run


def _matrix(values: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, values), np.int64, len(values))
    flat = np.frombuffer(b"".join(v.ljust(width, b"\0") for v in values), np.uint8)
    return flat.reshape(len(values), width), size


def induce(group: np.ndarray, tails: list[bytes], fronts: list[bytes], length: int) -> np.ndarray:
    """Marks, a bit for each distance left of the sample suffix, whose window is repeated.

    The tuples are sorted by (group, tail).  ``fronts`` are the bytes to the left, read
    leftwards.  Memory is a few hundred bytes a tuple.
    """
    n = len(tails)
    reach = max((len(f) for f in fronts), default=0)
    marks = np.zeros((n, length - GRAM + 1), bool)
    tail, known = _matrix(tails, length)
    front, far = _matrix(fronts, max(reach, 1))
    order = np.arange(n)
    # common prefix with the suffix before, in order; 0 between groups
    lcp = np.zeros(n, np.int64)
    if n > 1:
        differ = tail[1:] != tail[:-1]
        same = np.where(differ.any(1), differ.argmax(1), length)
        same = np.minimum(same, np.minimum(known[1:], known[:-1]))
        lcp[1:] = np.where(group[1:] == group[:-1], same, 0)
    for step in range(reach + 1):
        near = np.maximum(lcp, np.concatenate([lcp[1:], [0]]))
        marks[order[near >= length], step] = True
        left = far[order] - step
        stay = np.flatnonzero((left > 0) & (near + left >= length))
        if len(stay) < 2:
            break
        # common prefix between the suffixes that stay
        gaps = np.minimum.reduceat(lcp[:stay[-1] + 1], np.concatenate([[0], stay[:-1] + 1]))
        order, lcp = order[stay], gaps
        lcp[0] = 0
        # the suffixes one byte further left: by group, byte in front, order so far
        lead = front[order, step]
        kin = np.cumsum(lcp == 0) * 256 + lead
        turn = np.argsort(kin, kind="stable")
        least = _least_between(lcp, turn[:-1], turn[1:], kin[turn[:-1]] == kin[turn[1:]])
        order, lcp = order[turn], np.concatenate([[0], least])
    return marks


def _least_between(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, ask: np.ndarray) -> np.ndarray:
    """One more than the least of values[lo + 1 .. hi] where asked, else 0."""
    out = np.zeros(len(lo), np.int64)
    at = np.flatnonzero(ask)
    start, size = lo[at] + 1, hi[at] - lo[at]
    level, table = 0, values
    while len(at):
        now = size < (2 << level)
        s, z = start[now], size[now]
        out[at[now]] = np.minimum(table[s], table[s + z - (1 << level)]) + 1
        at, start, size = at[~now], start[~now], size[~now]
        table = np.minimum(table[:-(1 << level)], table[(1 << level):]) if len(at) else table
        level += 1
    return out


def _induced(length: int, batch_rows: int = 20_000):
    """Sorted tuples to marks; a batch of whole names at a time."""
    def judged(ghash, chash, n, tails, fronts):
        marks = induce(ghash, tails, fronts, length)
        # where the same surroundings occur again all windows do, and marks are left empty
        hit = np.flatnonzero(marks.any(1) | (n > 1))
        windows = np.fromiter((len(f) + len(t) - length + 1 for f, t in zip(fronts, tails, strict=True)), np.int64, len(tails))
        whole = (n[hit] > 1) | (marks[hit].sum(1) == windows[hit])
        packed = [b"" if w else m for w, m in zip(whole, _bitmap(marks[hit]), strict=True)]
        return pa.RecordBatch.from_arrays(
            [pa.array(ghash[hit]), pa.array(chash[hit]), pa.array(packed, pa.binary())], ["ghash", "chash", "marks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            part = [_column(b, "ghash"), _column(b, "chash"), _column(b, "n"), b.column("tail").to_pylist(), b.column("front").to_pylist()]
            held = part if held is None else [
                x + y if isinstance(x, list) else np.concatenate([x, y]) for x, y in zip(held, part, strict=True)]
            ghash = held[0]
            whole = int(np.searchsorted(ghash, ghash[-1], "left")) if len(ghash) else 0
            if whole and len(ghash) >= batch_rows:
                yield judged(*[x[:whole] for x in held])
                held = [x[whole:] for x in held]
        if held is not None and len(held[0]):
            yield judged(*held)

    return run


def _window_hashes(length: int):
    """Texts with the sample suffixes of crowded names asked of them to one row per window.

    The sort tuples stay in the task's one Python process: a function of its own for each
    step would take a second process with its own memory.
    """
    tuples = _surroundings(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher()
        for b in pieces(tuples(batches)):
            out = []
            for g, c, n, tail, front in zip(*(b.column(x).to_pylist() for x in ("ghash", "chash", "n", "tail", "front")), strict=True):
                hasher.load(np.frombuffer(front[::-1] + tail, np.uint8))
                far = np.arange(length - len(tail), len(front) + 1)
                start = len(front) - far
                out.append((np.full(len(far), g), np.full(len(far), c), np.full(len(far), n), far,
                            hasher.pieces(start, start + length).view(np.int64)))
            cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in cols], ["ghash", "chash", "n", "far", "whash"])

    return run


def _bits(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = np.zeros((b.num_rows, length - GRAM + 1), bool)
            for i, far in enumerate(b.column("fars")):
                marks[i, far.as_py()] = True
            yield pa.RecordBatch.from_arrays(
                [b.column("ghash"), b.column("chash"), pa.array(_bitmap(marks), pa.binary())], ["ghash", "chash", "marks"])

    return run


def _spans(found: list[dict], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal covered runs."""
    starts = []
    for r in found:
        place, left, right = _unpacked(r["at"])
        far = np.flatnonzero(np.unpackbits(np.frombuffer(r["marks"], np.uint8))) if r["marks"] else np.arange(right, left + 1)
        starts.append(place - far)
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.unique(np.concatenate(starts))
    new = np.concatenate([[True], starts[1:] > starts[:-1] + length])
    return starts[new], np.concatenate([starts[:-1][new[1:]], starts[-1:]]) + length


def _cut(data: bytes, found: list[dict], length: int) -> tuple[list[tuple[int, int]], bytes]:
    lo, hi = _spans(found, length)
    spans = list(zip(lo.tolist(), hi.tolist(), strict=True))
    kept, at = [], 0
    for a, b in spans:
        kept.append(data[at:a])
        at = b
    kept.append(data[at:])
    return spans, b"".join(kept)


def _keyed(docs: DataFrame, text_col: str, rest: list) -> DataFrame:
    """``(k1, k2, text, rest)``; every step uses the same rows, so that texts are shuffled once."""
    ship(docs.sparkSession)
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(text.alias("text"), F.struct(*rest).alias("rest")).select(*text_keys(F.col("text")), "text", "rest")


def _with(texts: DataFrame, lists: DataFrame, how: str = "inner") -> DataFrame:
    """Texts with their list.

    The lists are already dealt by key.  Joined by an expression they are dealt anew, and
    Spark can split the copies of a very common text over tasks.
    """
    lists = lists.select(F.bitwise_not("k1").alias("l1"), F.col("k2").alias("l2"), lists.columns[-1])
    return texts.join(lists, (F.bitwise_not(texts["k1"]) == lists["l1"]) & (texts["k2"] == lists["l2"]), how)


def _found(texts: DataFrame, length: int, crowd: int) -> DataFrame:
    """``(k1, k2, found)`` for texts with a repeat: sample suffixes and the marks of their windows."""
    if not GRAM < length <= GRAM + 200:
        raise ValueError(f"length must be over {GRAM} and at most {GRAM + 200}")
    samples = texts.select("k1", "k2", "text").mapInArrow(
        _samples(length), _SAMPLES)
    names = samples.groupBy("ghash").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    # joined by an expression, so that both sides get an exchange that splits a name of very many places
    names = names.select(F.bitwise_not("ghash").alias("name"), (F.col("times") > crowd).alias("crowded"))
    live = samples.join(names, F.bitwise_not(samples["ghash"]) == names["name"]).drop("name")
    # one sample suffix for each surroundings
    one = live.groupBy("ghash", "chash", "crowded").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "at")).alias("one"))

    def asked_of(chosen: DataFrame) -> DataFrame:
        asked = chosen.select("ghash", "chash", "n", "one.*").groupBy("k1", "k2").agg(
            F.collect_list(F.struct("ghash", "chash", "n", "at")).alias("asked"))
        return _with(texts, asked)

    queue = asked_of(one.where("not crowded")).mapInArrow(
        _surroundings(length), "ghash long, chash long, n long, tail binary, front binary")
    queue = queue.repartition("ghash").sortWithinPartitions("ghash", "tail", "chash")
    marks = queue.mapInArrow(_induced(length), _MARKS)
    windows = asked_of(one.where("crowded")).mapInArrow(
        _window_hashes(length), "ghash long, chash long, n long, far long, whash long")
    twice = windows.groupBy("ghash", "far", "whash").agg(
        F.max("n").alias("n"), F.min("chash").alias("lo"), F.max("chash").alias("hi")).where("n > 1 or lo <> hi")
    crowded = (windows.join(twice.select("ghash", "far", "whash"), ["ghash", "far", "whash"])
               .groupBy("ghash", "chash").agg(F.collect_set("far").alias("fars")).mapInArrow(_bits(length), _MARKS))
    marked = marks.unionByName(crowded)
    return live.join(marked, ["ghash", "chash"]).groupBy("k1", "k2").agg(
        F.collect_set(F.struct("at", "marks")).alias("found"))


def _digest(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            rows = []
            for text, found in zip(b.column("text"), b.column("found"), strict=True):
                data = text.as_py().encode("utf-8", "surrogatepass")
                spans, kept = _cut(data, found.as_py() or [], length)
                rows.append((len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def _kept_text(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            kept = []
            for text, found in zip(b.column("text"), b.column("found"), strict=True):
                text = text.as_py()
                if found.is_valid:
                    data = text.encode("utf-8", "surrogatepass")
                    text = _cut(data, found.as_py(), length)[1].decode("utf-8", "ignore")
                kept.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), b.column("rest")], ["text", "rest"])

    return run


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200,
                   crowd: int = 4096) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` for each row.

    A byte is removed if a ``length``-byte string that covers it also starts at another
    place of any row's text, its own included.  Null texts count as empty; texts shorter
    than ``length`` lose nothing; repeated rows repeat each other's text and lose all of
    it.  Ids may be null or repeated; other columns are not looked at.
    """
    texts = _keyed(docs, text_col, [docs[id_col].cast("long").alias("doc_id")])
    found = _found(texts, length, crowd)
    return _with(texts, found, "left").select(F.col("rest.doc_id").alias("doc_id"), "text", "found").mapInArrow(
        _digest(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, text_col: str = "text", length: int = 200, crowd: int = 4096) -> DataFrame:
    """``docs`` with the repeated bytes taken out of the text, all rows and columns kept.

    Characters that lose some of their bytes go as a whole.  Null texts stay null;
    other columns are passed on as they are.
    """
    others = [c for c in docs.columns if c != text_col]
    rest = [docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(others)] + [docs[f"`{text_col}`"].isNull().alias("none")]
    texts = _keyed(docs, text_col, rest)
    found = _found(texts, length, crowd)
    joined = _with(texts, found, "left").select("text", "rest", "found")
    cut = joined.mapInArrow(_kept_text(length), joined.select("text", "rest").schema)
    kept = F.when(~F.col("rest.none"), F.col("text")).cast(docs.schema[text_col].dataType)
    return cut.select(*[
        kept.alias(c) if c == text_col else F.col(f"rest.c{others.index(c)}").alias(c) for c in docs.columns])
