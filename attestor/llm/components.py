"""Connected components of a graph given as links, without collecting it.

Tasks contract the links they hold, TASK_ROWS at most on average, to stars by
their own; where one task held them all, these are the components.  Otherwise
large-star and small-star steps alternate: each joins links with the least
neighbour of a node, which partial aggregation finds, so a hub with very many
links never has them in one place; its join is one that Spark can split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm import kernels
from attestor.llm.session import release

#: Links that one task contracts; small graphs take few tasks and leave few files.
TASK_ROWS = 1 << 20


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the links and the least node it is connected to."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    least = np.arange(len(nodes))
    while len(x):
        low = np.minimum(least[x], least[y])
        np.minimum.at(least, least[x], low)
        np.minimum.at(least, least[y], low)
        while (least[least] != least).any():
            least = least[least]
        apart = least[x] != least[y]
        x, y = x[apart], y[apart]
    return nodes, nodes[least]


@kernels.tidied
def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [[c.to_numpy() for c in batch.columns] for batch in batches]
    if parts:
        nodes, least = contracted(*(np.concatenate(c) for c in zip(*parts, strict=True)))
        for lo in range(0, len(nodes), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + (1 << 16)]) for x in (nodes, least)], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """node and component (the least node) of every node in links (a, b).

    Loops and repeated links change nothing; without links there are no rows.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    tasks = 1 + edges.count() // TASK_ROWS  # later steps have at most twice as many links
    if tasks == 1:
        return edges.coalesce(1).mapInArrow(_contract, "a long, b long").toDF("node", "component")
    edges = edges.repartition(tasks, "b").mapInArrow(_contract, "a long, b long").where("a <> b").distinct().coalesce(tasks).checkpoint()
    while not edges.select(F.col("b").alias("a")).join(edges.select("a"), "a", "left_semi").isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = large.coalesce(tasks).distinct().coalesce(tasks).checkpoint()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = small.unionByName(least.select("a", F.col("m").alias("b"))).coalesce(tasks).distinct().coalesce(tasks).checkpoint()
        release(links.sparkSession)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
