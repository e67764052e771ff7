"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.operators.joins import spread_join
from voxframe.workspace import write_table

#: Links that a task joins at once, before Spark's steps join what is left.
HELD = 1 << 20


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) of every node that has a link to another node.

    Nodes are non-null longs. Each round rewires every link to the smallest known neighbour; rounds grow with the
    logarithm of the longest path. Only counts reach the driver. Neighbour minima are partial aggregates, and a hub's minimum is brought to
    its links by spread_join, so no task holds all links of a hub. Repeated links and self-links change nothing. Before each round the tasks join the
    links at hand (HELD at most at once), so that few links in few files take few rounds: each round's plans stay in the driver's memory. Links that are
    stars already take none.
    """
    edges = _joined(_tidy(links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))))
    for _ in range(max_rounds):
        nodes = _nodes(edges)
        n, unsettled = nodes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if((F.col("least") != F.col("most")) | (F.col("led") & F.col("least").isNotNull()))).first()
        if not unsettled:
            return nodes.select("node", F.coalesce("least", "node").alias("component"))
        edges = _joined(_small_star(_large_star(edges, n // 2), n // 2))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _nodes(edges: DataFrame) -> DataFrame:
    """node, least and most (smaller nodes that it has links to), led (it has links to larger ones), n (its links). All are stars if none has both or two of the former."""
    ends = edges.select(F.col("u").alias("node"), "v").unionByName(edges.select(F.col("v").alias("node"), F.lit(None).cast("long").alias("v")))
    return ends.groupBy("node").agg(F.min("v").alias("least"), F.max("v").alias("most"), F.max(F.col("v").isNull()).alias("led"), F.count("*").alias("n"))


def _joined(edges: DataFrame) -> DataFrame:
    """Written: links that connect the same nodes, from each node of the links that a task holds at once to the smallest that they reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            n += len(b)
            if n >= HELD:
                yield stars(*(np.concatenate(c) for c in zip(*held)))
                held, n = [], 0
        if n:
            yield stars(*(np.concatenate(c) for c in zip(*held)))

    return write_table(edges.mapInArrow(run, "u long, v long"), "cc")


def stars(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """u, v: each node but the smallest of its component, and that one."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    least = np.arange(len(nodes))
    while True:
        x, y = least[a], least[b]
        low = np.minimum(x, y)
        new = least.copy()
        np.minimum.at(new, x, low)  # the roots of both ends of a link get the smaller one
        np.minimum.at(new, y, low)
        while not np.array_equal(up := new[new], new):
            new = up
        if np.array_equal(new, least):
            break
        least = new
    out = least != np.arange(len(nodes))
    return pa.RecordBatch.from_arrays([pa.array(nodes[out]), pa.array(nodes[least[out]])], ["u", "v"])


def _tidy(edges: DataFrame) -> DataFrame:
    """Each link once, from its larger node u to its smaller node v."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("_n"))
    led = spread_join(both.where("v > u"), least, "u", "_n", 2 * n)
    return _tidy(led.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n"))
    led = spread_join(edges, least, "u", "_n", n)
    return _tidy(led.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))))
