"""Matching of local speakers to the identity store, and the offline pass that clusters all of them anew."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxframe.functions.vectors import cosine
from voxframe.operators import store
from voxframe.operators.identity import centroid_arrays, cluster, cluster_totals, greedy
from voxframe.operators.similarity import nearest
from voxframe.workspace import write_table


def _with_rivals(locals_: DataFrame) -> DataFrame:
    """id, centroid, _rivals: the number of locals in its file."""
    n = locals_.groupBy("file_id").agg(F.count("*").alias("_rivals"))
    return locals_.join(n, "file_id", "left").select("id", "centroid", F.coalesce("_rivals", F.lit(1)).alias("_rivals"))


def resolve_batch(locals_: DataFrame, identities: DataFrame, clips: DataFrame, *, enrol: float = 0.55, match: float = 0.65, floor: float = 8.0, collapse: bool = True) -> DataFrame:
    """file_id, local_id, outcome (enrolled, inferred, mint, below_floor, no_vector), global_id, similarity.

    All files are matched against one frozen store, so two files can't see each other's new identities. In a file, enrolled identities
    are dealt first by falling similarity (one may take several locals if collapse), then the others one to one; the rest are new, or
    stay local under the speech floor. A local without a vector is like nobody and stays local, too. The other locals of a file can take as
    many identities before a local as they are, so of those near to it only as many as its file has locals come out of the comparison.
    """
    asked = _with_rivals(locals_)
    first = nearest(asked, clips, "global_id", enrol, None if collapse else F.col("_rivals")).withColumn("stage", F.lit(1))
    second = nearest(asked, identities.where("not enrolled"), "id", match, F.col("_rivals")).withColumn("stage", F.lit(2))
    voiced = (F.coalesce(F.size("centroid"), F.lit(0)) > 0).alias("voiced")
    rows = locals_.select("file_id", F.col("id").alias("local_id"), "total_dur", voiced).join(first.unionByName(second).withColumnsRenamed({"id": "local_id", "who": "global_id"}), "local_id", "left")

    def one(group: pd.DataFrame) -> pd.DataFrame:
        pairs = {k: list(zip(g.sim, g.local_id, g.global_id)) for k, g in group.dropna(subset=["stage"]).groupby("stage")}
        enrolled = greedy(pairs.get(1, []), collapse)
        inferred = greedy([p for p in pairs.get(2, []) if p[1] not in enrolled])
        out = []
        for i, dur, voiced in group.drop_duplicates("local_id")[["local_id", "total_dur", "voiced"]].itertuples(index=False):
            g, s = enrolled.get(i) or inferred.get(i) or (None, None)
            kind = "enrolled" if i in enrolled else "inferred" if i in inferred else "no_vector" if not voiced else "mint" if floor <= 0 or dur >= floor else "below_floor"
            out.append((group.file_id.iloc[0], i, kind, g, s))
        return pd.DataFrame(out, columns=["file_id", "local_id", "outcome", "global_id", "similarity"]).astype({"global_id": "Int64", "similarity": "float64"})

    return rows.groupBy("file_id").applyInPandas(one, "file_id long, local_id long, outcome string, global_id long, similarity double")


def enrolled_matches(locals_: DataFrame, clips: DataFrame, threshold: float = 0.55, collapse: bool = True) -> DataFrame:
    """local_id, global_id, sim of the locals that enrolled identities take: in each file by falling similarity, an identity once unless collapse. Clips don't move, so no order of files matters."""
    asked = locals_ if collapse else _with_rivals(locals_)
    near = nearest(asked, clips, "global_id", threshold, None if collapse else F.col("_rivals")).withColumnsRenamed({"id": "local_id", "who": "global_id"})
    rows = near.join(locals_.select(F.col("id").alias("local_id"), "file_id"), "local_id")

    def one(group: pd.DataFrame) -> pd.DataFrame:
        taken = greedy(zip(group.sim, group.local_id, group.global_id), collapse)
        return pd.DataFrame([(i, g, s) for i, (g, s) in taken.items()], columns=["local_id", "global_id", "sim"])

    return rows.groupBy("file_id").applyInPandas(one, "local_id long, global_id long, sim double")


def unresolved(locals_: DataFrame, clips: DataFrame, threshold: float = 0.55) -> DataFrame:
    """Locals without a clip of an enrolled identity at or above the threshold."""
    return locals_.join(nearest(locals_, clips, "id", threshold).select("id"), "id", "left_anti")


def below_floor(rows: DataFrame, floor: float) -> DataFrame:
    """Unresolved locals that have too little speech for an identity of their own."""
    return rows.where(F.col("total_dur") < floor)


def by_name(voters: DataFrame, key: str = "cluster") -> DataFrame:
    """key, by_name: the named identity of the member with most speech (ties: the first member); voters: id, key, global_id, named, total_dur."""
    return voters.where("named").groupBy(key).agg(F.max_by("global_id", F.struct("total_dur", -F.col("id"))).alias("by_name"))


def by_vote(voters: DataFrame, key: str = "cluster") -> DataFrame:
    """key, by_vote: the identity that most members have (ties: the lowest)."""
    return voters.groupBy(key, "global_id").count().groupBy(key).agg(F.max_by("global_id", F.struct("count", -F.col("global_id"))).alias("by_vote"))


def outcomes(resolved: DataFrame) -> DataFrame:
    """outcome, n of what resolve_batch gives."""
    return resolved.groupBy("outcome").agg(F.count("*").alias("n"))


def recluster(identities: DataFrame, locals_: DataFrame, *, threshold: float = 0.65, floor: float = 8.0) -> DataFrame:
    """id, cluster, global_id, reassigned, similarity (to the centre of the cluster) of the locals that take part.

    Locals of enrolled identities and unresolved ones under the speech floor are held out. A cluster keeps the named identity of its member with
    most speech, else the one most members have (ties: lowest id); of clusters that claim one identity the larger keeps it (ties: the first), the
    others and clusters without a claim get new ids.
    """
    held = identities.where("enrolled").select(F.col("id").alias("global_id"))
    rows = locals_.where((F.size("centroid") > 0) & (F.col("global_id").isNotNull() | (F.col("total_dur") >= floor))).join(held, "global_id", "left_anti")
    rows = write_table(rows, "taking_part")
    rows = write_table(rows.join(cluster(rows, threshold), "id"), "clustered")  # read many times below
    named = identities.select(F.col("id").alias("global_id"), (F.coalesce("name", F.lit("")) != "").alias("named"))
    voters = rows.where("global_id is not null").join(named, "global_id")
    claims = cluster_totals(rows, "cluster").select("cluster", F.col("members").alias("n")).join(by_name(voters), "cluster", "left").join(by_vote(voters), "cluster", "left").withColumn("claim", F.coalesce("by_name", "by_vote"))
    keeps = F.row_number().over(Window.partitionBy("claim").orderBy(F.desc("n"), "cluster")) == 1
    claims = claims.withColumn("own", F.when(F.col("claim").isNotNull() & keeps, F.col("claim")))
    fresh = store.mint(identities, claims.where("own is null").select("cluster"), ["cluster"]).withColumnRenamed("id", "fresh")
    ids = claims.join(fresh, "cluster", "left").select("cluster", F.coalesce("own", "fresh").alias("new_id"))
    weighted = rows.select("cluster", "centroid", F.greatest(F.lit(1.0), F.col("total_dur")).alias("w"))
    centre = centroid_arrays(weighted, "cluster", "centroid", "w").select("cluster", F.col("centroid").alias("_centre"))
    out = rows.join(ids, "cluster").join(centre, "cluster")
    return out.select("id", "cluster", F.col("new_id").alias("global_id"), (~F.col("global_id").eqNullSafe(F.col("new_id"))).alias("reassigned"), cosine(F.col("centroid"), F.col("_centre")).alias("similarity"))
