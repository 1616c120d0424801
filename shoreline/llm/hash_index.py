"""Nearest neighbours by multi-index hashing of learned binary codes.

Codes: vectors are centred, rotated and reduced to signs.  The rotation is learned by
iterative quantisation on a bounded sample of distinct vectors (``sample`` of them, the
smallest by hash).  A code is cut into substrings of eight bits; each substring value is
a bucket of its own index.  Two codes within Hamming radius r agree in some substring up
to r // substrings bits (pigeonhole), so probing all buckets that near to the query's
substrings finds every code within the radius.  What is found is checked against the
radius, and ranked again by the Euclidean distance of the original vectors.

The radius is set on the sample: the smallest one within which ``reach`` of its true
neighbours lie.  Queries with fewer than k answers are asked again with a radius that
takes in all codes, so every query gets its answers.

Equal vectors are one class with its k + 1 smallest ids, which is all that a top-k can
use, however many rows there are.  Every class is indexed.  Queries go to the index in
blocks of a bounded number of vectors; every partition answers with its best k + 1.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shoreline.llm.frames import ship, stored

_NEAR = [np.flatnonzero(np.bitwise_count(np.arange(256, dtype=np.uint8)) <= r).astype(np.uint8) for r in range(9)]


class Codes:
    """A learned rotation; codes have a multiple of eight bits."""

    def __init__(self, sample: np.ndarray, rounds: int = 30, seed: int = 7):
        self.mean = sample.mean(0)
        x = sample - self.mean
        _, basis = np.linalg.eigh(x.T @ x)
        d = x.shape[1]
        self.bits = -(-d // 8) * 8
        rng = np.random.default_rng(seed)
        # a start for the rotation; longer than the vectors where these do not fill a byte
        turn, _ = np.linalg.qr(rng.standard_normal((self.bits, self.bits)))
        y = x @ basis
        wide = np.zeros((len(y), self.bits))
        wide[:, :d] = y
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.sign(wide @ turn).T @ wide)
            turn = (u @ v).T
        self.matrix = basis @ turn[:d]

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        return np.packbits((vectors - self.mean) @ self.matrix > 0, axis=1)


def _hamming(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ code).sum(1)


def choose_radius(codes: Codes, sample: np.ndarray, k: int, reach: float, asked: int = 200) -> int:
    packed = codes.encode(sample)
    need = []
    for i in range(min(asked, len(sample))):
        d = ((sample - sample[i]) ** 2).sum(1)
        d[i] = np.inf
        near = np.argpartition(d, min(k, len(d) - 1))[:k]
        need.append(_hamming(packed[near[np.isfinite(d[near])]], packed[i]))
    need = np.concatenate(need) if need else np.empty(0)
    return int(np.ceil(np.quantile(need, reach))) if len(need) else codes.bits


class Index:
    """The codes of one batch of vectors, indexed by each substring."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = np.argsort(codes, axis=0, kind="stable")
        self.at = np.stack([np.searchsorted(codes[self.order[:, j], j], np.arange(257)) for j in range(codes.shape[1])])

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code is within the radius of ``code``."""
        parts = len(code)
        each = min(8, radius // parts)
        hit = np.zeros(len(self.codes), bool)
        for j in range(parts):
            probes = _NEAR[each] ^ code[j]
            for lo, hi in zip(self.at[j, probes], self.at[j, probes.astype(int) + 1], strict=True):
                hit[self.order[lo:hi, j]] = True
        rows = np.flatnonzero(hit)
        return rows[_hamming(self.codes[rows], code) <= radius]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(vec_id, v)`` of the vectors that take part, as doubles.

    Null ids and vectors, vectors with null or non-finite parts, empty and zero vectors
    do not.
    """
    v = F.transform(vectors[vector_col], lambda x: x.cast("double"))
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), v.alias("v"))
    fit = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(
        F.coalesce(fit, F.lit(False)) & F.exists("v", lambda x: x != 0))


def classes(rows: DataFrame, keep: int) -> DataFrame:
    """``(v, ids)``: distinct vectors with their ``keep`` smallest ids, in two steps for very common ones."""
    # adding 0.0 makes -0.0 and 0.0 one value
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    part = Window.partitionBy("v", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")
    whole = Window.partitionBy("v").orderBy("vec_id")
    some = rows.distinct().withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= keep).drop("_r")
    few = some.withColumn("_r", F.row_number().over(whole)).where(F.col("_r") <= keep)
    return few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def _answers(model, block, radius: int, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, (numbers, queries) = model.value, block.value
        packed = codes.encode(queries)
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column("v")
            rows = v.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            ids = b.column("ids").to_pylist()
            index = Index(codes.encode(rows))
            out_q, out_id, out_s = [], [], []
            for i in range(len(queries)):
                near = index.within(packed[i], radius)
                if not len(near):
                    continue
                d = np.sqrt(((rows[near] - queries[i]) ** 2).sum(1))
                most = np.partition(d, keep - 1)[keep - 1] if len(d) > keep else np.inf
                best = sorted((s, x) for s, at in zip(d[d <= most].tolist(), near[d <= most].tolist(), strict=True) for x in ids[at])[:keep]
                out_q += [numbers[i]] * len(best)
                out_id += [x for _, x in best]
                out_s += [s for s, _ in best]
            yield pa.RecordBatch.from_arrays(
                [pa.array(out_q, pa.int64()), pa.array(out_id, pa.int64()), pa.array(out_s, pa.float64())],
                ["q", "vec_id", "score"])

    return run


def _ask(indexed: DataFrame, model, asked: DataFrame, radius: int, keep: int, block_rows: int) -> DataFrame:
    """``(q, vec_id, score)``, the best ``keep`` of each query class."""
    spark = indexed.sparkSession
    schema = "q long, vec_id long, score double"
    out = spark.createDataFrame([], schema)

    def answered(block):
        numbers, vectors = zip(*block, strict=True)
        sent = spark.sparkContext.broadcast((list(numbers), np.array(vectors)))
        done = stored(indexed.mapInArrow(_answers(model, sent, radius, keep), schema), "answers")
        sent.destroy()
        return done

    block = []
    for r in asked.select("q", "v").toLocalIterator():
        block.append((r["q"], r["v"]))
        if len(block) == block_rows:
            out, block = out.unionByName(answered(block)), []
    if block:
        out = out.unionByName(answered(block))
    best = Window.partitionBy("q").orderBy("score", "vec_id")
    return out.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= keep).drop("_r")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
            sample: int = 4096, reach: float = 0.97, block_rows: int = 2048) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k nearest rows, itself left out.

    ``queries`` has the columns of ``vectors``.  ``score`` is the Euclidean distance in
    double precision; ties go to the smaller id.  Vectors that cannot be compared (see
    ``usable``) and vectors that are not as long as most take no part, neither as queries
    nor as answers.  Equal (id, vector) rows count once.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    rows = usable(vectors, id_col, vector_col)
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("v") == common["d"])
    index = stored(classes(rows, k + 1), "index")
    drawn = np.array([r["v"] for r in index.orderBy(F.xxhash64("v")).limit(sample).select("v").collect()])
    codes = Codes(drawn)
    model = spark.sparkContext.broadcast(codes)
    own = usable(queries, id_col, vector_col).where(F.size("v") == common["d"]).distinct()
    own = own.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).withColumn("q", F.xxhash64("v"))
    own = stored(own, "queries")
    asked = own.dropDuplicates(["q"])
    found = stored(_ask(index, model, asked, choose_radius(codes, drawn, k, reach), k + 1, block_rows), "answers")
    # a query can miss itself only if it is not in the table: ask for k + 1 in any case
    few = found.groupBy("q").count().where(F.col("count") > k).select("q")
    short = asked.join(few, "q", "left_anti")
    again = _ask(index, model, short, codes.bits, k + 1, block_rows)
    every = found.join(few, "q").unionByName(again)
    pairs = own.select(F.col("vec_id").alias("query_id"), "q").join(every, "q").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "q").orderBy("score", "vec_id"))
    return pairs.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
