"""Quality grades by ordinal regression on hashed text.

Ratings are grades 0 .. top.  A cumulative-link model has one weight for each hashed
feature, shared by all grades, and ascending thresholds between grades:

    P(grade >= j) = sigmoid(w . x - t_j),    t_1 < t_2 < ...

Features are present or not: lower-cased words, the signs that end a word, whether
words are written in capitals, and the share of different words.  The model is fitted on a bounded sample of the rated
texts (``sample`` rows, the smallest by a hash of the id, none longer than
``sample_chars``) by Adam with shuffled batches; ascending thresholds are kept by
fitting the logarithms of their gaps.  The fit runs in one task, so that the driver gets
the weights and not the sample.  A feature keeps a weight only as far as its
evidence exceeds ``doubt`` standard errors of chance (a lasso penalty that follows the
number of texts with the feature), so that words without a bearing weigh nothing however
long a text is.  Grades count alike, whatever their share.  The weights are a fixed ``2 ** bits`` numbers,
which is what is sent to the executors.  All rows are scored, over their whole texts.
"""

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoreline.llm.frames import own_name, ship

BITS = 18
#: Rows that the model is fitted on, and their longest text.
SAMPLE, SAMPLE_CHARS = 16_000, 60_000
#: A text is kept if it is at least as likely as this to have the top grade.
KEEP = 0.35
_SIGNS = ".,;:!?*$%&#()\"'-_=+~<>[]{}|/\\@^`"


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Ascending feature numbers of a text."""
    spoken = (text or "").split()
    words = set(spoken)
    # how often words come back, in tenths
    names = {f"\x03{10 * len(words) // len(spoken)}"} if spoken else set()
    for w in words:
        core = w.strip(_SIGNS)
        names.add(core.lower())
        if len(core) < len(w):
            names.add("\x01" + w[len(w.rstrip(_SIGNS)):])
        if len(core) > 3 and core.isupper():
            names.add("\x02")
    if not names:
        return np.zeros(1, np.int64)
    codes = np.fromiter((zlib.crc32(n.encode("utf-8", "surrogatepass")) for n in names), np.uint32, len(names))
    return np.unique(codes & np.uint32((1 << bits) - 1)).astype(np.int64)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, feature: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1 .. top."""
        return _sigmoid(self.weights[feature].sum() - self.thresholds)


def fit(docs: list[np.ndarray], grades: np.ndarray, top: int, bits: int = BITS, epochs: int = 12, batch: int = 512, steps: int = 375,
        rate: float = 0.03, doubt: float = 2.0, seed: int = 11, least: int = 5) -> Ordinal:
    """Fit by Adam: ``epochs`` passes, and at least ``steps`` batches.

    Features of fewer than ``least`` texts get no weight.
    """
    size = 1 << bits
    w, t0, gaps = np.zeros(size), np.array([-1.0]), np.zeros(top - 1)
    if not len(docs):
        return Ordinal(w.astype(np.float32), np.arange(top, dtype=float))
    # a batch at a time here and below: the sample is held once, as it came
    seen = np.zeros(size, np.int64)
    for lo in range(0, len(docs), batch):
        seen += np.bincount(np.concatenate(docs[lo:lo + batch]), minlength=size)
    often = seen >= least
    many = np.bincount(grades, minlength=top + 1)
    share = (len(docs) / (top + 1) / np.maximum(many, 1)) ** 0.5
    penalty = doubt * 0.5 * np.sqrt(seen) / len(docs)
    rng = np.random.default_rng(seed)
    m, v = np.zeros(size), np.zeros(size)
    mt, vt = np.zeros(top), np.zeros(top)
    step = 0
    for _ in range(max(epochs, -(-steps * batch // len(docs)))):
        order = rng.permutation(len(docs))
        for lo in range(0, len(order), batch):
            step += 1
            rows = order[lo:lo + batch]
            flat = np.concatenate([docs[i] for i in rows])
            of = np.repeat(np.arange(len(rows)), [len(docs[i]) for i in rows])
            counted = often[flat]
            flat, of = flat[counted], of[counted]
            s = np.bincount(of, w[flat], len(rows))
            t = np.concatenate([t0, t0 + np.cumsum(np.exp(gaps))])
            f = np.concatenate([np.ones((len(rows), 1)), _sigmoid(s[:, None] - t), np.zeros((len(rows), 1))], 1)
            y = grades[rows]
            at = np.arange(len(rows))
            upper, lower = f[at, y], f[at, y + 1]
            p = np.maximum(upper - lower, 1e-9)
            slope = f * (1 - f)
            # d log p / d s, and / d t_j
            weigh = share[y] / len(rows)
            gs = (slope[at, y] - slope[at, y + 1]) / p * weigh
            gt = np.zeros((len(rows), top + 2))
            gt[at, y] -= slope[at, y] / p
            gt[at, y + 1] += slope[at, y + 1] / p
            gt = (gt[:, 1:-1] * weigh[:, None]).sum(0)
            g = np.bincount(flat, gs[of], size)
            tail = np.cumsum(gt[::-1])[::-1]
            gt = np.concatenate([tail[:1], tail[1:] * np.exp(gaps)])
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            mt, vt = 0.9 * mt + 0.1 * gt, 0.999 * vt + 0.001 * gt * gt
            a, b = 1 - 0.9 ** step, 1 - 0.999 ** step
            scale = rate / (np.sqrt(v / b) + 1e-8)
            w += scale * (m / a)
            w = np.sign(w) * np.maximum(np.abs(w) - scale * penalty, 0)
            move = rate * (mt / a) / (np.sqrt(vt / b) + 1e-8)
            t0, gaps = t0 + move[:1], gaps + move[1:]
    return Ordinal(w.astype(np.float32), np.concatenate([t0, t0 + np.cumsum(np.exp(gaps))]))


def grade_of(quality: Column, toxic: Column) -> Column:
    """0 toxic, 1 poor, 2 good; null where a rating is missing."""
    return F.when(quality.isNull() | toxic.isNull(), None).when(toxic > 0, 0).when(quality <= 0, 1).otherwise(2)


def train(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", top: int = 2,
          sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS, bits: int = BITS) -> Ordinal:
    """Fit on rated documents; ``ratings`` has ``id_col`` and ``grade``.

    Rows without id or grade, and grades outside 0 .. top, are left out; of several
    ratings of an id the lowest counts.  Without any rated text every grade is open
    (weights of zero).
    """
    ship(docs.sparkSession)
    rated = ratings.where(F.col("grade").between(0, top)).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min("grade").alias("grade"))
    rated = rated.where("id is not null").orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    rows = rows.where(F.char_length("text") <= sample_chars).join(F.broadcast(rated), "id")
    # at most `sample` ids: of repeated ids one row counts
    chosen = (rows.select("id", "grade", "text").mapInArrow(_with_id(bits), "id long, grade int, features binary")
              .groupBy("id").agg(F.min_by(F.struct("grade", "features"), "features").alias("r")).select("r.*", "id"))
    # one task fits: the sample is bounded, and only the weights come to the driver
    got = chosen.repartition(1).sortWithinPartitions("id").mapInArrow(_fitted(top, bits), "weights binary, thresholds binary").first()
    if got is None:
        return fit([], np.empty(0, np.int64), top, bits)
    return Ordinal(np.frombuffer(got["weights"], "<f4"), np.frombuffer(got["thresholds"], "<f8"))


def _fitted(top: int, bits: int):
    """The features of a partition to the one row of a model's numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, grades = [], [np.empty(0, np.int64)]
        for b in batches:
            docs += [np.frombuffer(x.as_buffer(), "<i4") for x in b.column("features")]
            grades.append(b.column("grade").to_numpy())
        model = fit(docs, np.concatenate(grades), top, bits)
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.weights.astype("<f4").tobytes()], pa.binary()),
             pa.array([model.thresholds.astype("<f8").tobytes()], pa.binary())], ["weights", "thresholds"])

    return run


def _with_id(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features(t.as_py(), bits).astype("<i4").tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("grade").cast(pa.int32()), pa.array(rows, pa.binary())], ["id", "grade", "features"])

    return run


def tail_probabilities(spark, model: Ordinal, text: Column, bits: int = BITS) -> Column:
    """``array<double>``: P(grade >= j) of a text, j from 1; null texts count as empty."""
    sent = spark.sparkContext.broadcast(model)

    def run(values: pd.Series) -> pd.Series:
        return pd.Series([sent.value.tails(features(t, bits)).tolist() for t in values])

    return F.pandas_udf(run, "array<double>")(text)


def graded(docs: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """``(doc_id, expected_grade, p_top, p_above_0, kept)`` for each row.

    Null and empty texts are graded by the model like any text without words.  Repeated
    rows give repeated results.  Other columns are not looked at.
    """
    ship(docs.sparkSession)
    tails = tail_probabilities(docs.sparkSession, model, F.col("text"))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    rows = rows.select("doc_id", tails.alias("tails"))
    return rows.select(
        "doc_id", F.aggregate("tails", F.lit(0.0), lambda a, x: a + x).alias("expected_grade"),
        F.element_at("tails", -1).alias("p_top"), F.element_at("tails", 1).alias("p_above_0"),
        (F.element_at("tails", -1) >= keep).alias("kept"))


def selected(docs: DataFrame, model: Ordinal, text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """The rows of ``docs`` that are likely enough to have the top grade; columns as they are."""
    ship(docs.sparkSession)
    name = own_name(docs, "tail_probabilities")
    tails = tail_probabilities(docs.sparkSession, model, docs[text_col].cast("string"))
    return docs.withColumn(name, tails).where(F.element_at(F.col(name), -1) >= keep).drop(name)
