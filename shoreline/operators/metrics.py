"""Counts taken while rows pass: what came in, what could not be read, what was left out.

A :class:`Watch` puts named observations into a plan.  They cost nothing but their sums,
ride along with whatever runs the plan, and are there once it has run; nothing is read or
joined a second time to count it.
"""

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

COUNTS = "step string, measure string, value bigint"


class Watch:
    """Named counts of a plan, for one run of it."""

    def __init__(self):
        self._steps: dict[str, Observation] = {}
        self.errors: list[tuple[str, str]] = []

    def __call__(self, df: DataFrame, step: str, **counts: Column) -> DataFrame:
        """``df``, with its rows counted as ``rows`` and rows that fit a condition under its name.

        A stream's counts are found in the progress of its query, see :func:`stream_counts`.
        """
        if step in self._steps:
            raise ValueError(f"step {step!r} is watched already")
        sums = [F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(n) for n, c in counts.items()]]
        if df.isStreaming:
            return df.observe(step, *sums)
        self._steps[step] = Observation(step)
        return df.observe(self._steps[step], *sums)

    def failed(self, step: str, error: Exception) -> None:
        """Note a step that could not be run; its first line says why."""
        self._steps.pop(step, None)
        self.errors.append((step, str(error).strip().split("\n")[0]))

    def counts(self) -> dict[str, dict[str, int]]:
        """Measures by step; waits for the plan's first run.

        Where a plan's result is empty, adaptive execution may leave steps out together
        with their counts; such steps are missing here rather than told as nothing.
        """
        out = {}
        for step, seen in self._steps.items():
            try:
                out[step] = dict(seen.get)
            except Py4JJavaError:
                continue
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """``(step, measure, value)``, a step that failed with the measure ``errors``."""
        rows = [(s, m, int(v)) for s, ms in self.counts().items() for m, v in ms.items()]
        rows += [(s, "errors", 1) for s, _ in self.errors]
        return spark.createDataFrame(rows, COUNTS)


def unwatched(df: DataFrame, step: str, **counts: Column) -> DataFrame:
    """What readers do without a watch: nothing."""
    return df


def stream_counts(query: StreamingQuery) -> dict[str, dict[str, int]]:
    """Measures by step of all batches that a query's progress still tells of."""
    out: dict[str, dict[str, int]] = {}
    for progress in query.recentProgress:
        for step, row in progress.observedMetrics.items():
            step_counts = out.setdefault(step, {})
            for measure, value in row.asDict().items():
                step_counts[measure] = step_counts.get(measure, 0) + value
    return out
