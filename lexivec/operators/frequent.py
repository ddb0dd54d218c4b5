"""Frequent items in bounded memory: counters with a bound on their error, merged in any order.

For vocabularies whose counts don't fit anywhere: each task keeps at most ``size``
counters; when there are more, the size-th largest count is taken from all and those that
are used up go. What was taken is the summary's error: an item's true count is at least its
counter's and at most that and the error, an item without a counter has at most the error,
and the error is at most total / size. Merging two summaries adds counters and errors and
takes again, so none of this depends on how or in which order parts are merged.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..storage import cut

#: Summaries that one task merges; more are merged in several rounds.
FAN_IN = 64
_PART = "part long, token string, count long, error long, total long"


class Summary:
    """Counters of at most ``size`` items."""

    def __init__(self, size: int):
        if size < 1:
            raise InvalidArgument("a summary needs a counter at least")
        self.size, self.counts, self.error, self.total = size, Counter(), 0, 0

    def add(self, items: Iterable[tuple[str, int]]) -> None:
        """Items with their numbers of occurrences."""
        for item, n in items:
            self.counts[item] += n
            self.total += n
            if len(self.counts) >= 2 * self.size:
                self._take()
        self._take()

    def merge(self, other: Summary) -> None:
        self.counts.update(other.counts)
        self.error, self.total = self.error + other.error, self.total + other.total
        self._take()

    def _take(self) -> None:
        if len(self.counts) > self.size:
            # each of over size counters loses it, so it is lost at most total / size times
            least = sorted(self.counts.values(), reverse=True)[self.size]
            self.counts = Counter({k: n - least for k, n in self.counts.items() if n > least})
            self.error += least


def _rows(part: int, s: Summary) -> pa.RecordBatch:
    items = sorted(s.counts.items())
    n = len(items) + 1  # a row of no item carries error and total
    return pa.RecordBatch.from_arrays(
        [pa.array([part] * n), pa.array([k for k, _ in items] + [None], pa.string()), pa.array([c for _, c in items] + [None], pa.int64()), pa.array([None] * len(items) + [s.error], pa.int64()), pa.array([None] * len(items) + [s.total], pa.int64())],
        names=["part", "token", "count", "error", "total"],
    )


def frequent(tokens: DataFrame, size: int, token_col: str = "token") -> DataFrame:
    """(token, least, most) of every token that may occur over total / size times, and others: its count is between the two.

    Null tokens aren't counted; an empty table gives no rows. A task holds at most twice
    ``size`` counters while it reads, and FAN_IN summaries of ``size`` when it merges.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Summary(size)
        for batch in batches:
            own.add((v["values"], v["counts"]) for v in batch.column(0).value_counts().to_pylist() if v["values"] is not None)
        if own.total:
            yield _rows(TaskContext.get().partitionId(), own)

    def merged(group: pa.Table) -> pa.Table:
        whole: dict[int, Summary] = {}
        for r in group.to_pylist():
            s = whole.setdefault(r["part"], Summary(size))
            if r["token"] is None:
                s.error, s.total = r["error"], r["total"]
            else:
                s.counts[r["token"]] = r["count"]
        out = Summary(size)
        for _, s in sorted(whole.items()):
            out.merge(s)
        return pa.Table.from_batches([_rows(group["next"][0].as_py(), out)])

    n = tokens.rdd.getNumPartitions()
    parts = tokens.select(F.col(token_col).cast("string").alias("token")).mapInArrow(count, _PART)
    while True:
        n = -(-n // FAN_IN)
        parts = parts.withColumn("next", F.expr(f"part div {FAN_IN}")).groupBy("next").applyInArrow(merged, _PART)
        if n <= 1:
            break
    parts = cut(parts)
    error = parts.where("token is null").select(F.col("error").alias("_error"))  # one row
    return parts.where("token is not null").crossJoin(F.broadcast(error)).select("token", F.col("count").alias("least"), (F.col("count") + F.col("_error")).alias("most"))
