"""SimHash near-duplicates through a segment-popcount embedding.

A document's fingerprint has 64 bits.  Fingerprints that differ in at most ``radius``
bits are linked.  The search works on distinct fingerprints:

* the 64 bits are cut into equal parts, so many that one part of any linked pair
  differs in at most one bit (``radius // parts <= 1``);
* a part is embedded as the bit counts of its two-bit segments.  The Manhattan
  distance of two embeddings never exceeds the Hamming distance of the parts, so a
  linked pair meets in a part at Manhattan distance 0 or 1;
* that range join runs on the grid of embeddings: each fingerprint is put into its own
  cell and, if its bit count is even, into the cells one step away; of two cells one
  step apart exactly one has an even count, so each pair meets;
* cells with one member are dropped before any fingerprint is compared; the members of
  the others are compared exactly, in bulk, inside sorted partitions.

Cells of more than ``block`` members are dealt over pairs of blocks, so that no task
holds more than two blocks of a cell.  Only a spanning forest of a cell's links leaves
it, never all pairs.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from shoreline.llm import set_join
from shoreline.llm.components import components
from shoreline.llm.frames import own_name, ship, stored, text_keys

SEED = 42
_ONE = np.uint64(1)
#: The lowest bit of each byte; hashes taken at once.
_LANES, _AT_ONCE = np.uint64(0x0101010101010101), 1 << 16


# -- fingerprints -------------------------------------------------------------------

def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of the space-joined word shingles of a text, repeats included."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    if len(parts) <= words:
        shingles = [b" ".join(parts)]
    else:
        shingles = map(b" ".join, zip(*(parts[i:] for i in range(words)), strict=False))
    one = xxhash.xxh64_intdigest
    return np.array([one(s, SEED) for s in shingles], np.uint64)


def _bits_set(hashes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set in each row of hashes: eight bits a pass, a byte each."""
    out = np.zeros((len(hashes), 8, 8), np.int64)
    # 255 ones fit a byte
    cuts = np.arange(0, hashes.shape[1], 255)
    for bit in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(bit)) & _LANES, cuts, axis=1)
        out[:, :, bit] = np.ascontiguousarray(sums, "<u8").view(np.uint8).reshape(len(hashes), -1, 8).sum(1)
    return out.reshape(len(hashes), 64)


def _majority(ones: np.ndarray, of: int) -> np.ndarray:
    return np.packbits(2 * ones > of, axis=1, bitorder="little").view("<u8")[:, 0]


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if more than half of the hashes have it; no hashes give 0."""
    if not len(hashes):
        return 0
    ones = sum(_bits_set(hashes[None, i:i + _AT_ONCE]) for i in range(0, len(hashes), _AT_ONCE))
    return int(_majority(ones, len(hashes))[0])


def fingerprints(texts: DataFrame, words: int) -> DataFrame:
    """``(k1, k2, doc_id, text)`` to ``(k1, k2, doc_id, fp)``; the bits of ``fp`` as a long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(shingle_hashes(t.as_py(), words)) for t in b.column("text")),
                              np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays(
                [b.column("k1"), b.column("k2"), b.column("doc_id"), pa.array(fps.view(np.int64))],
                ["k1", "k2", "doc_id", "fp"])

    return texts.select("k1", "k2", "doc_id", "text").mapInArrow(run, "k1 long, k2 long, doc_id long, fp long")


# -- links --------------------------------------------------------------------------

def _counts(part: np.ndarray, width: int) -> np.ndarray:
    """Bit counts of the two-bit segments, two bits each, in one number."""
    even = np.uint64(0x5555555555555555 & ((1 << width) - 1))
    return (part & even) + ((part >> _ONE) & even)


def _cells(fps: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, cell, index of the fingerprint, whether it is a step away)."""
    width = 64 // parts
    rows = np.arange(len(fps))
    for part in range(parts):
        own = _counts((fps >> np.uint64(part * width)) & np.uint64((1 << width) - 1), width)
        yield part, own, rows, np.zeros(len(fps), bool)
        even = np.flatnonzero(np.bitwise_count((fps >> np.uint64(part * width)) & np.uint64((1 << width) - 1)) % 2 == 0)
        for seg in range(width // 2):
            unit = np.uint64(1 << (2 * seg))
            value = (own[even] >> np.uint64(2 * seg)) & np.uint64(3)
            for move, can in ((unit, value < 2), (None, value > 0)):
                at = even[can]
                yield part, (own[at] + unit if move is not None else own[at] - unit), at, np.ones(len(at), bool)


def _emit(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            first = b.column("print").to_numpy(zero_copy_only=False).astype(np.int32) * parts
            for part, cell, at, away in _cells(fps, parts):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(first[at] + np.int32(part)), pa.array(cell.view(np.int64)),
                     pa.array(fps[at].view(np.int64)), pa.array(away)], ["part", "cell", "fp", "away"])

    return run


def _forest(radius: int):
    """Compare the members of each bin of a sorted partition; emit a spanning forest of its links."""
    def links(key: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, left, right, step = np.arange(len(fps)), [], [], 0
        while True:
            step += 1
            at = at[at + step < len(fps)]
            at = at[key[at] == key[at + step]]
            if not len(at):
                break
            near = at[np.bitwise_count(fps[at] ^ fps[at + step]) <= radius]
            left.append(near)
            right.append(near + step)
        if not left:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        a, b = np.concatenate(left), np.concatenate(right)
        label = np.arange(len(fps))
        while True:
            low = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        moved = np.flatnonzero(label != np.arange(len(fps)))
        return moved, label[moved]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(key, fps):
            a, b = links(key, fps)
            return pa.RecordBatch.from_arrays([pa.array(fps[a].view(np.int64)), pa.array(fps[b].view(np.int64))], ["a", "b"])

        key = np.empty(0, np.int64)
        fps = np.empty(0, np.uint64)
        for b in batches:
            key = np.concatenate([key, b.column("bin").to_numpy(zero_copy_only=False)])
            fps = np.concatenate([fps, b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
            whole = np.searchsorted(key, key[-1], "left") if len(key) and key[0] != key[-1] else 0
            if whole and len(key) > 4096:
                # sorted by bin: everything before the last bin is complete
                yield flush(key[:whole], fps[:whole])
                key, fps = key[whole:], fps[whole:]
        if len(key):
            yield flush(key, fps)

    return run


def links(fps: DataFrame, radius: int, block: int = 4096) -> DataFrame:
    """Distinct ``fp`` longs to links ``(a, b)`` that connect all pairs within ``radius`` bits.

    With a column ``print`` only fingerprints of the same number are compared.  The links are a spanning forest: two fingerprints within the radius are always
    connected by a path of them.  A radius of 0 gives none.
    """
    parts = next((p for p in (1, 2, 4, 8) if radius // p <= 1), None)
    if parts is None:
        raise ValueError("the radius must be below 16")
    if "print" not in fps.columns:
        fps = fps.withColumn("print", F.lit(0))
    cells = fps.select("fp", "print").mapInArrow(_emit(parts), "part int, cell long, fp long, away boolean")
    sizes = (cells.groupBy("part", "cell")
             .agg(F.count(F.lit(1)).alias("n"), F.sum((~F.col("away")).cast("int")).alias("own"))
             .where("n > 1 and own > 0").select("part", "cell", "n"))
    met = cells.join(sizes, ["part", "cell"])
    # a cell beyond one block: each member goes to every pair of blocks that has its own
    blocks = F.ceil(F.col("n") / block).cast("int")
    met = met.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    bins = met.select(
        F.xxhash64("part", "cell", F.least("mine", "other"), F.greatest("mine", "other")).alias("bin"), "fp")
    dealt = bins.repartition("bin").sortWithinPartitions("bin", "fp")
    return dealt.mapInArrow(_forest(radius), "a long, b long").where("a <> b").distinct()


def fingerprint_groups(fps: DataFrame, radius: int) -> DataFrame:
    """``fp`` rows to ``(fp, grp)``: the smallest linked fingerprint, for linked ones only."""
    distinct = stored(fps.select("fp").distinct(), "fingerprints")
    return components(links(distinct, radius)).select(F.col("node").alias("fp"), F.col("label").alias("grp"))


# -- operators ----------------------------------------------------------------------

def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ship(docs.sparkSession)
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text")).select(
        *text_keys(F.col("text")), "doc_id", "text")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3,
                       radius: int = 3) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for each row.

    A null text counts as empty; texts without words have fingerprint zero and are
    linked like any other.  ``component_id`` is the smallest non-null id reachable,
    null only where no row of the component has one.  Repeated rows give repeated
    results.  Other columns are not looked at.
    """
    marked = stored(fingerprints(_texts(docs, id_col, text_col), words), "fingerprints")
    grouped = fingerprint_groups(marked, radius)
    # one row per fingerprint, so that a fingerprint of very many documents is one row here
    first = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    known = first.join(grouped, "fp", "left").withColumn("grp", F.coalesce("grp", "fp"))
    least = known.groupBy("grp").agg(F.min("least").alias("component_id"))
    by_fp = known.join(least, "grp").select("fp", "component_id")
    return marked.join(by_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """``docs`` with one row of each group of near-copies, all columns kept.

    Two texts are near-copies if their ``words``-word shingles have a Jaccard similarity of
    at least 0.8.  Read in order of ids, nulls last, a text goes if it is a near-copy of one
    that stays.  The set join finds every such pair, so fingerprints, which could neither
    add a pair nor take one away, are not made.  Equal texts (null counts as empty) always
    go to one row, the one with the smallest id; texts without words are equal only to
    themselves.
    """
    joined = set_join.similar(docs, id_col, text_col, words)
    least = joined.rows.groupBy("k1", "k2").agg(F.min("doc_id").alias("least"))
    kept = least.join(set_join.superseded(joined), ["k1", "k2"], "left_anti")
    h1, h2, n, nth = (own_name(docs, x) for x in ("kept_k1", "kept_k2", "kept_least", "kept_nth"))
    kept = kept.select(F.col("k1").alias(h1), F.col("k2").alias(h2), F.col("least").alias(n))
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    keys = text_keys(text)
    keyed = docs.withColumns({"_" + h1: keys[0], "_" + h2: keys[1]})
    ident = keyed[id_col].cast("long")
    same = (keyed["_" + h1] == kept[h1]) & (keyed["_" + h2] == kept[h2]) & ident.eqNullSafe(kept[n])
    found = keyed.join(kept, same)
    order = Window.partitionBy(h1, h2, n).orderBy(*[F.col(f"`{c}`") for c in docs.columns if c != text_col and _orderable(docs, c)] or [F.lit(1)])
    return found.withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def _orderable(df: DataFrame, name: str) -> bool:
    return not isinstance(df.schema[name].dataType, T.MapType | T.VariantType)
