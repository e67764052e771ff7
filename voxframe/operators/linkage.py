"""Constrained clustering of large components: without a matrix in a task, and of those too large for one task in rounds of joins.

Two clusters that are each other's nearest may be merged at once, wherever they are: with average and with complete linkage no merge makes a cluster nearer to a third than the nearer of its
parts was, and a pair that may not be merged stays so, so the order of merges far apart doesn't matter. Ties are broken as in the steps one by one, by the lowest members. A round merges all such
pairs; the nearest pair of all is among them, so rounds end.

No matrix is held. With average linkage the similarity of two clusters of unit vectors is the product of their mean vectors, so a cluster is its size and the sum of its vectors, and its nearest among all
that it may join is found anew in each round; as it may have to pass those that share a file with it, it asks for one more than these are. No pairs but those that share a file are listed, at most as many as voices in a file pair off.
With complete linkage a pair counts its links: it may be merged while it holds one for every pair of members, at the least of their similarities; there all links are listed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.functions.vectors import l2_normalise
from voxframe.operators.similarity import PLACES, nearest, pairs_above
from voxframe.workspace import write_table

#: Similarities that are held at once (32 MB).
SOUGHT = 1 << 22


def by_means(v: np.ndarray, files: list[int], threshold: float) -> list[int]:
    """As identity.agglomerate with average linkage, of unit vectors v, in memory that grows with their number only: a cluster is its size and its mean vector."""
    n = len(v)
    mean, size, dead = v.copy(), np.ones(n), np.zeros(n)
    near, who, of = np.full(n, -np.inf), np.zeros(n, np.int64), np.arange(n)
    order = np.argsort(files, kind="stable")
    starts = np.flatnonzero(np.diff(np.asarray(files)[order], prepend=np.nan) != 0)
    members, rivals = [np.array([i]) for i in range(n)], [np.empty(0, np.int64)] * n  # rivals: voices of the files of a cluster's
    for together in np.split(order, starts[1:]):
        for i in together.tolist():
            rivals[i] = together

    def seek(at: np.ndarray) -> np.ndarray:
        sim = np.round(mean[at] @ mean.T, PLACES) + dead
        for row, i in zip(sim, at.tolist()):
            row[of[rivals[i]]] = -np.inf
        who[at] = sim.argmax(1)  # the lowest of equals
        best = sim[np.arange(len(at)), who[at]]
        near[at] = np.where(best >= threshold, best, -np.inf)
        return sim

    step = max(1, SOUGHT // max(1, n))
    for at in range(0, n, step):
        seek(np.arange(at, min(n, at + step)))
    left = n
    while n and (top := near.max()) > -np.inf:
        i, j = min((min(k, int(who[k])), max(k, int(who[k]))) for k in np.flatnonzero(near == top).tolist())
        mean[i] = (size[i] * mean[i] + size[j] * mean[j]) / (size[i] + size[j])
        size[i] += size[j]
        of[members[j]] = i
        members[i], rivals[i] = np.concatenate([members[i], members[j]]), np.concatenate([rivals[i], rivals[j]])
        dead[j] = near[j] = -np.inf
        stale = np.flatnonzero((near > -np.inf) & ((who == i) | (who == j)) & (np.arange(len(who)) != i))
        for at in range(0, len(stale), step):
            seek(stale[at : at + step])
        shown = seek(np.array([i]))[0]
        tie = (shown >= threshold) & ((shown > near) | ((shown == near) & (i < who)))
        near[tie], who[tie] = shown[tie], i
        left -= 1
        if left < len(who) // 2:  # those that are gone are dropped
            kept = np.flatnonzero(dead == 0)
            new = np.zeros(len(who), np.int64)
            new[kept] = np.arange(len(kept))
            mean, size, dead, near = mean[kept], size[kept], dead[kept], near[kept]
            who, of = new[who[kept]], new[of]
            members, rivals = [members[k] for k in kept.tolist()], [rivals[k] for k in kept.tolist()]
    return np.unique(of, return_inverse=True)[1].tolist()


def _renamed(pairs: DataFrame, merges: DataFrame) -> DataFrame:
    """Pairs a < b with merged clusters under their new names, and whether one of both was merged; pairs inside a cluster go."""
    for c in "ab":
        new = merges.select(F.col("gone").alias(c), F.col("kept").alias(f"_{c}"))
        pairs = pairs.join(new, c, "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *rest).where("a <> b")


def _with_sides(pairs: DataFrame, clusters: DataFrame, columns: list[str]) -> DataFrame:
    for c in "ab":
        pairs = pairs.join(clusters.select(F.col("cluster").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in columns]), c)
    return pairs


def reciprocal(links: DataFrame) -> DataFrame:
    """kept, gone: pairs a, b of links that are each other's best: highest sim (rounded), then lowest a, then b."""
    order = F.struct((-F.round("sim", PLACES)).alias("s"), "a", "b")
    ends = links.select(F.explode(F.array("a", "b")).alias("c"), order.alias("o"))
    best = ends.groupBy("c").agg(F.min("o").alias("o"))
    return best.groupBy("o.a", "o.b").agg(F.count("*").alias("n")).where("n = 2").select(F.col("a").alias("kept"), F.col("b").alias("gone"))


def _best(clusters: DataFrame, apart: DataFrame, threshold: float) -> DataFrame:
    """a, b, sim (a < b): each cluster's nearest that it may join, at or above threshold (rounded)."""
    both = apart.unionByName(apart.select(F.col("b").alias("a"), F.col("a").alias("b")))
    most = both.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("_apart"))
    means = clusters.select(F.col("cluster").alias("id"), F.transform("total", lambda x: x / F.col("n")).alias("centroid"))
    asked = means.join(most, "id", "left").withColumn("_k", 2 + F.coalesce("_apart", F.lit(0)))  # itself, those it may not join, one more
    near = nearest(asked, means, "id", threshold - 10.0**-PLACES, F.col("_k"), unit=False).where((F.col("id") != F.col("who")) & (F.round("sim", PLACES) >= threshold))
    free = near.select(F.col("id").alias("a"), F.col("who").alias("b"), "sim").join(both, ["a", "b"], "left_anti")
    best = free.groupBy("a").agg(F.min(F.struct((-F.round("sim", PLACES)).alias("s"), "b")).alias("o"))
    return best.select(F.least("a", "o.b").alias("a"), F.greatest("a", "o.b").alias("b"), (-F.col("o.s")).alias("sim"))


def merge_rounds(rows: DataFrame, threshold: float, average: bool = True) -> DataFrame:
    """id, cluster (lowest id in it) of rows id, file_id, centroid. Rows of one file never meet in a cluster."""
    clusters = write_table(rows.select(F.col("id").alias("cluster"), F.lit(1.0).alias("n"), l2_normalise(F.col("centroid")).alias("total")), "clusters")
    members = write_table(rows.select("id", F.col("id").alias("cluster")), "members")
    own = rows.select("file_id", F.col("id").alias("a"))
    apart = write_table(own.join(own.withColumnRenamed("a", "b"), "file_id").where("a < b").select("a", "b").distinct(), "apart")  # as many as pairs in a file

    def links() -> DataFrame:
        if average:
            return write_table(_best(clusters, apart, threshold), "links")
        found = pairs_above(rows.select("id", F.col("centroid").alias("v")), threshold)
        return write_table(found.select("a", "b", "sim", F.lit(1).cast("long").alias("k")).where(F.round("sim", PLACES) >= threshold).join(apart, ["a", "b"], "left_anti"), "links")

    now = links()
    while not now.isEmpty():
        if average:  # a pair that both ends name is there twice
            merges = now.groupBy("a", "b").agg(F.count("*").alias("n")).where("n = 2").select(F.col("a").alias("kept"), F.col("b").alias("gone"))
        else:
            merges = reciprocal(now)
        merges = write_table(merges, "merges")
        if merges.isEmpty():  # only if roundings of one product differ: the nearest pair of all
            merges = write_table(now.orderBy(F.desc("sim"), "a", "b").limit(1).select(F.col("a").alias("kept"), F.col("b").alias("gone")), "merges")
        names = merges.select(F.col("gone").alias("cluster"), "kept")
        members = write_table(members.join(names, "cluster", "left").select("id", F.coalesce("kept", "cluster").alias("cluster")), "members")
        second = names.join(clusters, "cluster").select(F.col("kept").alias("cluster"), F.col("n").alias("_n"), F.col("total").alias("_total"))
        clusters = clusters.join(names, "cluster", "left_anti").join(second, "cluster", "left")
        total = F.when(F.col("_n").isNotNull(), F.zip_with("total", "_total", lambda x, y: x + y)).otherwise(F.col("total"))
        clusters = write_table(clusters.select("cluster", (F.col("n") + F.coalesce("_n", F.lit(0.0))).alias("n"), total.alias("total")), "clusters")
        apart = write_table(_renamed(apart, merges).distinct(), "apart")
        if average:
            now = links()
        else:
            pairs = _renamed(now, merges).groupBy("a", "b").agg(F.min("sim").alias("sim"), F.sum("k").alias("k")).join(apart, ["a", "b"], "left_anti")
            now = write_table(_with_sides(pairs, clusters, ["n"]).where(F.col("k") == F.col("n_a") * F.col("n_b")).select("a", "b", "sim", "k"), "links")
    return members
