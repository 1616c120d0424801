"""Token ids as Parquet list columns.

A folder of token files has the columns ``doc_id``, ``n_tokens`` and ``tokens`` (a list of
32-bit ids), in ascending ``doc_id`` order across and within files.  Ids are delta-packed
or dictionary-encoded, row groups and pages have a chosen size, and the writer leaves
page indexes, so that a reader of a few documents or of the metadata alone skips the rest.
"""

import json
import re
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shoreline.llm.frames import new_folder, ship

#: Encoded words that a worker remembers at most; then it begins anew.
REMEMBERED = 500_000
#: Words encoded side by side in one text.
_TOGETHER = 4_096
#: A space that starts a word: the pattern of byte-level BPE parts texts here in any case.
_WORD_SPACE = re.compile(r" (?=\S)")
_SIGNS = ".,;:!?*$%&#()\"-"
#: How byte-level vocabularies write a space.
_SPACE_BYTE = "\u0120"


class Encoder:
    """Encodes texts word by word with a tokenizer, and remembers words.

    Byte-level BPE parts a text before each space that is followed by another character
    and never merges across that place, so a text's ids are its words' ids.  Letters and
    the signs after them are parted too.  New words are encoded many at a time, side by
    side; the ids of each begin where an id begins with a space.  Texts that hold an added
    token (special ones count unless ``escape``) are encoded whole.
    """

    def __init__(self, definition: str, escape: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = escape
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content and not (escape and t.special)]
        self.added = added
        #: ids of a space and the word
        self.known: dict[str, bytes] = {}
        # other kinds of tokenizers are left to the library
        model = json.loads(definition)
        self.wordwise = (
            not model.get("normalizer") and (model.get("pre_tokenizer") or {}).get("type") == "ByteLevel"
            and model["pre_tokenizer"].get("use_regex", True) and not model["pre_tokenizer"].get("add_prefix_space"))

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    @cached_property
    def _begins(self) -> np.ndarray:
        """Which ids begin with a space."""
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        out = np.zeros(max(vocabulary.values()) + 1, bool)
        out[[i for t, i in vocabulary.items() if t.startswith(_SPACE_BYTE)]] = True
        return out

    def _together(self, words: list[str]) -> dict[str, bytes]:
        """Ids of a space and each word; words with a space of their own one by one."""
        out = {w: self._ids(" " + w) for w in words if " " in w or not w}
        words = [w for w in words if w not in out]
        runs = [words[i:i + _TOGETHER] for i in range(0, len(words), _TOGETHER)]
        for run, e in zip(runs, self.tokenizer.encode_batch_fast([" " + " ".join(r) for r in runs], add_special_tokens=False),
                          strict=True):
            ids = np.array(e.ids, "<u4")
            at = (np.flatnonzero(self._begins[ids]) * 4).tolist()
            if len(at) != len(run):
                out.update((w, self._ids(" " + w)) for w in run)
                continue
            octets = ids.tobytes()
            out.update(zip(run, map(octets.__getitem__, map(slice, at, [*at[1:], len(octets)])), strict=True))
        return out

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        known, cores = self.known, {}
        whole = {w for w in words if w.isalpha()}
        for w in words - whole:
            core = w.rstrip(_SIGNS)
            if core.isalpha():
                cores[w] = core
                if core not in known:
                    whole.add(core)
            else:
                whole.add(w)
        out = self._together(list(whole))
        signs: dict[str, bytes] = {}
        for w, core in cores.items():
            tail = w[len(core):]
            if tail not in signs:
                signs[tail] = self._ids(tail)
            out[w] = (out.get(core) or known[core]) + signs[tail]
        return out

    def _remember(self, words: set[str] | list[str]) -> dict[str, bytes]:
        """What is known, with these words in it."""
        learnt = self._learn({w for w in words if w not in self.known})
        if len(self.known) + len(learnt) > REMEMBERED:
            # what is asked for now is what is remembered next
            self.known = {w: self.known[w] for w in words if w in self.known}
        self.known.update(learnt)
        return self.known

    def _apart(self, text: str) -> bytes:
        """A text with an added token, or with spaces that do not start a word."""
        if not self.wordwise or any(a in text for a in self.added):
            return self._ids(text)
        head, *words = _WORD_SPACE.split(text)
        known = self._remember(words)
        return (self._ids(head) if head else b"") + b"".join(known[w] for w in words)

    def encode_flat(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, each ended by ``end``; and how many each has.

        The words of a batch are made distinct first, so that only distinct words are looked
        up; the ids of all words are then gathered at once.
        """
        odd = [not self.wordwise or any(a in t for a in self.added) for t in texts]
        while True:
            split = pc.split_pattern(pa.array(["" if o else t for t, o in zip(texts, odd, strict=True)], pa.large_string()), " ")
            words = pc.dictionary_encode(split.values)
            bounds = split.offsets.to_numpy()
            distinct = words.dictionary.to_pylist()
            # a space before another one, or before the end, starts no word
            strange = np.fromiter((not w or w[0].isspace() for w in distinct), bool, len(distinct))
            if not strange.any():
                break
            at = np.flatnonzero(strange[words.indices.to_numpy(zero_copy_only=False)])
            more = np.unique(np.searchsorted(bounds, at[~np.isin(at, bounds[:-1])], "right") - 1)
            if not len(more):
                break
            for i in more.tolist():
                odd[i] = True
        known = self._remember(distinct) if self.wordwise else {}
        ids = [known[w] for w in distinct] if self.wordwise else [b""] * len(distinct)
        # the first word of a text has no space before it
        heads = words.indices.to_numpy(zero_copy_only=False)[bounds[:-1]]
        ids += [self._apart(t) if o else self._ids(distinct[h]) if distinct[h] else b""
                for t, o, h in zip(texts, odd, heads, strict=True)]
        ids.append(b"" if end is None else np.array([end], "<u4").tobytes())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        values, starts = np.frombuffer(b"".join(ids), "<u4"), np.concatenate([[0], np.cumsum(sizes)[:-1]])
        which = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        which[bounds[:-1]] = len(distinct) + np.arange(len(texts))
        which = np.insert(which, bounds[1:], len(ids) - 1)
        each = sizes[which]
        ends = np.cumsum(each)
        # the place of every id in `values`: its word's start, and how far it is into the word
        at = np.repeat(starts[which] - (ends - each), each)
        at += np.arange(len(at))
        last = ends[bounds[1:] + np.arange(len(texts))] if len(texts) else ends
        return values[at], np.diff(last, prepend=0)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text."""
        values, sizes = self.encode_flat(texts)
        for part in np.split(values, np.cumsum(sizes)[:-1]) if len(texts) else []:
            yield part.tobytes()


@lru_cache(2)
def encoder(definition: str, escape: bool = False) -> Encoder:
    return Encoder(definition, escape)


def _encoded(definition, end_id: int, escape: bool, most: int = 4_000_000):
    """Rows in order to rows with tokens; a batch holds about ``most`` characters."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(definition.value, escape)

        def write(ids: list, texts: list[str]) -> pa.RecordBatch:
            values, sizes = enc.encode_flat(texts, end_id)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes.astype(np.int32)),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int32)))],
                ["doc_id", "n_tokens", "tokens"])

        ids, texts, held = [], [], 0
        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids.append(i)
                texts.append(t.as_py())
                held += len(texts[-1])
                if held >= most:
                    yield write(ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield write(ids, texts)

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int = 0, encoding: str = "delta", row_group_bytes: int = 32 << 20,
                 page_rows: int = 2_000, escape: bool = False) -> None:
    """Encode the whole text of each row and write token files.

    ``tokenizer_file`` is a definition for the tokenizers library, read on the driver (a
    few MB).  A special token in a text gets its id, as the library has it by default, or
    is ordinary text with ``escape``.  ``end_id`` ends each document.
    ``encoding`` is ``delta`` or ``dictionary``.  Null texts count as empty and give the
    end id alone; null ids come first; rows of the same id keep a fixed order by text.
    Other columns are not written.
    """
    if encoding not in ("delta", "dictionary"):
        raise ValueError(f"unknown encoding {encoding}")
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer_file, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text"))
    # the shuffle carries texts, which are smaller than their ids
    order = [F.col("doc_id"), F.xxhash64("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    tokens = rows.mapInArrow(_encoded(definition, end_id, escape), "doc_id long, n_tokens int, tokens array<int>")
    (tokens.write.option("compression", "zstd")
     .option("parquet.block.size", row_group_bytes)
     .option("parquet.page.row.count.limit", page_rows)
     .option("parquet.writer.version", "PARQUET_2_0")
     .option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
     .parquet(path))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, n_tokens, tokens, file, row)``; select or filter to read less."""
    return spark.read.schema("doc_id long, n_tokens int, tokens array<int>").parquet(path).select(
        "*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column("tokens")
        octets = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4")).cast("B")
        at = lists.offsets.to_numpy() * 4
        crc = [zlib.crc32(octets[lo:hi]) for lo, hi in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("file"), b.column("row"), pa.array(np.diff(at) // 4, pa.int64()),
             pa.array(crc, pa.int64())], ["doc_id", "file", "row", "n_tokens", "ids_crc32"])


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of token files, from their ids.

    ``start`` counts the ids of all documents before, in file order.
    """
    ship(spark)
    rows = read_tokens(spark, path).select("doc_id", "tokens", "file", "row").mapInArrow(
        _sums, "doc_id long, file string, row long, n_tokens long, ids_crc32 long")
    # lists are as long as their metadata say: file totals need the small column only
    totals = read_tokens(spark, path).groupBy("file").agg(F.sum("n_tokens").alias("size"))
    # by number: from 100,000 files on their names are not in order
    number = F.regexp_extract("file", "^part-([0-9]+)", 1).cast("long")
    earlier = Window.orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1)
    first = totals.select(F.col("file").alias("of"), F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("first"))
    before = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    return inside.join(first, inside["file"] == first["of"]).select(
        "doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def encode_and_read_back(docs: DataFrame, tokenizer_file: str, **options) -> DataFrame:
    """Write token files to a folder of their own and return their digest."""
    path = new_folder(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_file, **options)
    return token_digest(docs.sparkSession, path)
