"""Connected components of a link table, by repeated contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


#: Links that one task settles at the end (16 bytes each); more of them are contracted by another round.
LAST_LINKS = 16_000


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, label) of all ends of the links (a, b)."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            up[root(a)] = root(b)
    if up:
        yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([root(x) for x in up], pa.int64())], names=["node", "label"])


def connected_components(links: DataFrame, max_rounds: int = 60, last_links: int = LAST_LINKS) -> DataFrame:
    """Label every linked node with one node of its component.

    links: columns ``a``, ``b`` (long). Returns ``node``, ``label``, a row for each node
    that occurs in a link to another node; null ends and self-links are ignored, repeated
    links count once, an empty table gives an empty one.

    In each round every node points to its first neighbour (or itself) in an order that
    is drawn anew for each round by hashing, and the links are rewritten between the nodes
    pointed to. As the order has nothing to do with the links, the nodes shrink to a
    fraction each round, so rounds grow with the logarithm of the longest chain, whatever
    the ids. Neighbours are folded with min(), so a node with very many links is
    pre-aggregated in each task; joins have one row a node on one side, so AQE can split
    the other. What is left in the end, at most ``last_links`` links, is settled by one
    task, which saves the rounds in which little is left. Links stay on the cluster.
    """
    ends = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    left = cut(links.where("a <> b").select(*ends).distinct())
    steps: list[DataFrame] = []
    for turn in range(max_rounds):
        n = left.count()
        if n <= last_links:
            if n or not steps:
                steps.append(cut(left.repartition(1).mapInArrow(_settle, "node long, label long")))
            break
        drawn = lambda node: F.struct(F.xxhash64(node, F.lit(turn)).alias("place"), F.col(node).alias("node"))  # noqa: B023, E731
        both = left.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("end")).select("end.*")
        steps.append(cut(both.groupBy("node").agg(F.min(drawn("other")).alias("m")).select("node", F.least(drawn("node"), "m")["node"].alias("label"))))
        to = steps[-1]
        left = cut(
            left.join(to.select(F.col("node").alias("a"), F.col("label").alias("pa")), "a")
            .join(to.select(F.col("node").alias("b"), F.col("label").alias("pb")), "b")
            .where("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
            .distinct()
        )
    else:
        raise RuntimeError(f"components not found in {max_rounds} rounds")
    labels = steps[0]
    for step in steps[1:]:
        labels = labels.join(step.select(F.col("node").alias("label"), F.col("label").alias("next")), "label", "left").select("node", F.coalesce("next", "label").alias("label"))
    return labels
