"""Identities of speakers: reports, centroids, duplicates, merge, enrolment, greedy matching and constrained clustering.

Tables: identities (id, name, enrolled, centroid), locals (id, file_id, label, centroid, total_dur, global_id), clips (id, global_id,
centroid, duration), dismissed pairs (low, high).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.functions.text import display_name, lower
from voxframe.functions.vectors import l2_normalise
from voxframe.operators import linkage
from voxframe.operators.components import connected_components
from voxframe.operators.scans import running
from voxframe.operators.similarity import PLACES, forest_above, nearest, pairs_above
from voxframe.workspace import write_table


def usage(locals_: DataFrame) -> DataFrame:
    """global_id, n_locals, n_files, total_dur, always derived from the rows."""
    return locals_.where("global_id is not null").groupBy("global_id").agg(F.count("*").alias("n_locals"), F.countDistinct("file_id").alias("n_files"), F.sum("total_dur").alias("total_dur"))


def report(identities: DataFrame, locals_: DataFrame, clips: DataFrame) -> DataFrame:
    """id, display, enrolled, n_files, n_clips, n_locals, total_dur; vectors are never read."""
    n = clips.groupBy("global_id").agg(F.count("*").alias("n_clips"))
    r = identities.select("id", "name", "enrolled").join(usage(locals_).withColumnRenamed("global_id", "id"), "id", "left").join(n.withColumnRenamed("global_id", "id"), "id", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_files", "n_clips", "n_locals")]
    return r.select("id", display_name(F.col("name"), F.col("id")).alias("display"), "enrolled", *zero, F.coalesce("total_dur", F.lit(0.0)).alias("total_dur"))


def with_vectors(rows: DataFrame) -> DataFrame:
    """Rows whose centroid isn't null or empty."""
    return rows.where(F.coalesce(F.size("centroid"), F.lit(0)) > 0)


def enrolled(identities: DataFrame) -> DataFrame:
    return identities.where("enrolled")


def profiles(clips: DataFrame) -> DataFrame:
    """global_id, clips, seconds of the clips that have a vector."""
    return with_vectors(clips).groupBy("global_id").agg(F.count("*").alias("clips"), F.sum("duration").alias("seconds"))


def globals_in_files(locals_: DataFrame) -> DataFrame:
    """file_id, global_id: who is heard where, each once."""
    return locals_.where("global_id is not null").select("file_id", "global_id").distinct()


def files_of(locals_: DataFrame) -> DataFrame:
    """global_id and the sorted array of its files."""
    return locals_.where("global_id is not null").groupBy("global_id").agg(F.array_sort(F.collect_set("file_id")).alias("files"))


def shared_files(locals_: DataFrame) -> DataFrame:
    """a, b (a < b): identities that are heard in one file, each pair once. Rows grow with the square of the speakers of a file, not of the corpus."""
    f = globals_in_files(locals_)
    return f.select("file_id", F.col("global_id").alias("a")).join(f.select("file_id", F.col("global_id").alias("b")), "file_id").where("a < b").select("a", "b").distinct()


def compare_files(locals_: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, shared (whether both are heard in one file), files (of either) for pairs of identities that are heard at all."""
    f = files_of(locals_)
    sides = [f.select(F.col("global_id").alias(k), F.col("files").alias(f"_{k}")) for k in ("a", "b")]
    both = pairs.select("a", "b").join(sides[0], "a").join(sides[1], "b")
    return both.select("a", "b", F.arrays_overlap("_a", "_b").alias("shared"), F.size(F.array_union("_a", "_b")).cast("long").alias("files"))


def people_in_files(locals_: DataFrame) -> DataFrame:
    """file_id, people (identities), labels (local speakers, known or not)."""
    return locals_.groupBy("file_id").agg(F.countDistinct("global_id").alias("people"), F.countDistinct("label").alias("labels"))


def speech_totals(turns: DataFrame) -> DataFrame:
    """file_id, speaker, total_dur of all turns."""
    return turns.groupBy("file_id", "speaker").agg(F.sum(F.col("t_end") - F.col("t_start")).alias("total_dur"))


def cluster_totals(rows: DataFrame, key: str) -> DataFrame:
    """key, members, total_dur."""
    return rows.groupBy(key).agg(F.count("*").alias("members"), F.sum("total_dur").alias("total_dur"))


def relabelled(segments: DataFrame, locals_: DataFrame) -> DataFrame:
    """Segments with the global_id of their file's speaker of that label, null if it has none."""
    refs = locals_.select("file_id", F.col("label").alias("local_label"), "global_id")
    rows = segments.drop("global_id").join(refs, ["file_id", "local_label"], "left")
    return rows.select(*dict.fromkeys([*segments.columns, "global_id"]))


def shown(segments: DataFrame, identities: DataFrame) -> DataFrame:
    """Segments with label: the name of their identity as shown, or the local label where the identity is unknown."""
    names = identities.select(F.col("id").alias("global_id"), display_name(F.col("name"), F.col("id")).alias("_shown"))
    return segments.join(names, "global_id", "left").withColumn("label", F.coalesce("_shown", "local_label")).drop("_shown")


def weighted_centroids(vectors: DataFrame, key: str, v: str, weight: str) -> DataFrame:
    """key, pos, x: the mean of each component weighted by max(1, weight)-like weights (those not above 0 count 1), scaled to length 1. Sums are partial before the shuffle."""
    w = F.when(F.col(weight) > 0, F.col(weight)).otherwise(1.0)
    parts = vectors.select(key, w.alias("w"), F.posexplode(v).alias("pos", "x")).groupBy(key, "pos").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("x"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(key)))
    return parts.withColumn("norm", norm).select(key, "pos", F.when(F.col("norm") > 0, F.col("x") / F.col("norm")).otherwise(F.col("x")).alias("x"))


def centroid_arrays(vectors: DataFrame, key: str, v: str, weight: str) -> DataFrame:
    """key, centroid: weighted_centroids with a vector in an array."""
    x = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"])
    return weighted_centroids(vectors, key, v, weight).groupBy(key).agg(x.alias("centroid"))


def refresh_enrolment(identities: DataFrame, clips: DataFrame) -> DataFrame:
    """Identities with clips have their clips' mean (by length, 1 s at least) and are enrolled; others aren't, and keep their centroid."""
    rows = clips.where(F.size("centroid") > 0).select("global_id", "centroid", F.greatest(F.lit(1.0), F.col("duration")).alias("w"))
    mean = centroid_arrays(rows, "global_id", "centroid", "w").select(F.col("global_id").alias("id"), F.col("centroid").alias("_mean"))
    joined = identities.join(mean, "id", "left").withColumn("enrolled", F.col("_mean").isNotNull()).withColumn("centroid", F.coalesce("_mean", "centroid"))
    return joined.select(*identities.columns)


def fold(identities: DataFrame, matches: DataFrame) -> DataFrame:
    """id, centroid, n_locals, total_dur of identities (the same columns) after one match each (global_id, centroid, total_dur): a centroid weighs as many locals as it has, 1 at least."""
    m = matches.select(F.col("global_id").alias("id"), F.col("centroid").alias("_c"), F.col("total_dur").alias("_d"))
    n = F.greatest(F.lit(1), F.col("n_locals"))
    new = l2_normalise(F.zip_with("centroid", "_c", lambda a, b: (a * n + b) / (n + 1)))
    hit = F.col("_c").isNotNull() & (F.size("centroid") > 0)
    joined = identities.join(m, "id", "left")
    return joined.select("id", F.when(hit, new).otherwise(F.col("centroid")).alias("centroid"), F.when(hit, F.col("n_locals") + 1).otherwise(F.col("n_locals")).alias("n_locals"), F.when(hit, F.col("total_dur") + F.col("_d")).otherwise(F.col("total_dur")).alias("total_dur"))


def longest_turns(turns: DataFrame, most: int = 8, least: float = 3.0, relaxed: float = 0.6) -> DataFrame:
    """The longest turns of each file_id, speaker as file_id, speaker, t_start, dur, k: of at least the first length, or of the second where none is."""
    by = Window.partitionBy("file_id", "speaker")
    rows = turns.withColumn("dur", F.col("t_end") - F.col("t_start")).withColumn("_top", F.max("dur").over(by))
    rows = rows.where(F.col("dur") >= F.when(F.col("_top") >= least, least).otherwise(relaxed)).withColumn("k", F.row_number().over(by.orderBy(F.desc("dur"), "t_start")))
    return rows.where(F.col("k") <= most).drop("_top")


def voiceprints(turns: DataFrame, **choice) -> DataFrame:
    """file_id, speaker, n_segments, total_dur, centroid from turns with vectors; total_dur counts all turns. Speakers without a turn long enough are left out."""
    total = speech_totals(turns)
    chosen = longest_turns(turns, **choice).where("vector is not null").withColumn("_who", F.struct("file_id", "speaker"))
    n = chosen.groupBy("file_id", "speaker").agg(F.count("*").alias("n_segments"))
    centre = centroid_arrays(chosen, "_who", "vector", "dur").select("_who.file_id", "_who.speaker", "centroid")
    return n.join(total, ["file_id", "speaker"]).join(centre, ["file_id", "speaker"])


def resolve_targets(asked: DataFrame, identities: DataFrame) -> DataFrame:
    """who, action (join, create, error), id of rows who: digits name an id that must exist; a name joins its only bearer (letters folded as ASCII), else it is new or ambiguous."""
    digits = F.col("who").rlike("^[0-9]+$")
    keyed = asked.select("who", F.when(digits, F.concat(F.lit("#"), F.regexp_replace("who", "^0+(?=[0-9])", ""))).otherwise(F.concat(F.lit("@"), lower(F.col("who")))).alias("_key")).distinct()
    names = identities.select(F.concat(F.lit("@"), lower(F.coalesce("name", F.lit("")))).alias("_key"), "id")
    known = identities.select(F.concat(F.lit("#"), F.col("id").cast("string")).alias("_key"), "id").unionByName(names)
    found = known.join(keyed.select("_key").distinct(), "_key", "left_semi").groupBy("_key").agg(F.count("*").alias("_n"), F.min("id").alias("_id"))
    rows = keyed.join(found, "_key", "left")
    action = F.when(F.col("_n") == 1, "join").when(F.col("_n").isNull() & F.startswith("_key", F.lit("@")), "create").otherwise("error")
    return rows.select("who", action.alias("action"), F.when(F.col("_n") == 1, F.col("_id")).alias("id"))


def duplicate_candidates(identities: DataFrame, locals_: DataFrame, dismissed: DataFrame, low: float, high: float, keep: Callable | None = None) -> DataFrame:
    """left_id, right_id, similarity of identities in the band that are not both enrolled, share no file and are not dismissed; left is first by enrolled, speech, id.

    keep, if given, tells from the ids of both sides (arrays that broadcast) which pairs aren't dismissed besides. Pairs in the band may be many more than all else, so none is
    shuffled: identities are compared under their places in the order, and the pairs that share a file or are dismissed go to the tasks that compare their tiles.
    """
    speech = usage(locals_).select(F.col("global_id").alias("id"), F.col("total_dur").alias("d"))
    known = with_vectors(identities).select("id", "enrolled", F.col("centroid").alias("v")).join(speech, "id", "left")
    known = known.select("id", "v", F.lit(0).alias("all"), F.col("enrolled").cast("long").alias("e"), (-F.col("enrolled").cast("int")).alias("o1"), (-F.coalesce("d", F.lit(0.0))).alias("o2"))
    ranked = write_table(running(known, "all", ["o1", "o2", "id"], {"place": F.lit(1)}).select("id", "v", "e", F.col("place").cast("long").alias("place")), "ranked")
    without = shared_files(locals_).unionByName(dismissed.select(F.least("low", "high").alias("a"), F.greatest("low", "high").alias("b")))
    for c in "ab":
        without = without.join(ranked.select(F.col("id").alias(c), F.col("place").alias(f"_{c}")), c)
    without = without.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))

    def wanted(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        hit = (p[..., 1] & q[..., 1]) == 0
        return hit if keep is None else hit & keep(p[..., 0], q[..., 0])

    found = pairs_above(ranked.select(F.col("place").alias("id"), "v", F.array("id", "e").alias("x")), low, high, F.col("x"), wanted, without)
    return found.select(F.col("a").alias("left_id"), F.col("b").alias("right_id"), F.col("sim").alias("similarity"))


def merge(locals_: DataFrame, source: int, into: int) -> DataFrame:
    """The locals after source has been merged into another identity."""
    return locals_.withColumn("global_id", F.when(F.col("global_id") == source, F.lit(into).cast("long")).otherwise(F.col("global_id")))


def merge_identities(identities: DataFrame, locals_: DataFrame, clips: DataFrame, dismissed: DataFrame, source: int, into: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The four tables after the merge: locals and clips move, the survivor keeps its name or takes the other's, its centroid stays unless it has clips (see
    weighted_centroids), dismissals that name the source go. Merging an identity with itself changes nothing."""
    if source == into:
        return identities, locals_, clips, dismissed
    gone = identities.where(F.col("id") == source).select(F.col("name").alias("_name"))
    named = F.when((F.col("id") == into) & (F.coalesce("name", F.lit("")) == ""), F.col("_name")).otherwise(F.col("name"))
    kept = identities.where(F.col("id") != source).join(gone, F.lit(True), "left").withColumn("name", named).drop("_name")
    return kept, merge(locals_, source, into), merge(clips, source, into), dismissed.where((F.col("low") != source) & (F.col("high") != source))


def split_local(identities: DataFrame, locals_: DataFrame, local_id: int) -> tuple[DataFrame, DataFrame]:
    """Identities and locals after the local has been given an identity of its own, with its centroid; identities left without use go."""
    fresh = identities.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("_fresh"))
    moved = locals_.join(fresh, F.lit(True)).withColumn("global_id", F.when(F.col("id") == local_id, F.col("_fresh")).otherwise(F.col("global_id"))).drop("_fresh")
    own = locals_.where(F.col("id") == local_id).join(fresh, F.lit(True)).select(F.col("_fresh").alias("id"), F.lit("").alias("name"), F.lit(False).alias("enrolled"), "centroid")
    all_ids = identities.select("id", "name", "enrolled", "centroid").unionByName(own)
    return all_ids.join(unused(all_ids, moved).select("id"), "id", "left_anti"), moved


def unused(identities: DataFrame, locals_: DataFrame) -> DataFrame:
    """Identities to delete: no name, not enrolled, no local refers to them."""
    refs = locals_.where("global_id is not null").select(F.col("global_id").alias("id")).distinct()
    return identities.where("coalesce(name, '') = '' and not enrolled").join(refs, "id", "left_anti")


def best_enrolled(locals_: DataFrame, clips: DataFrame, threshold: float) -> DataFrame:
    """local_id, global_id, similarity: the enrolled identity with the nearest clip; several locals may share one (ties: lowest id)."""
    best = nearest(locals_, clips, "global_id", threshold)
    return best.select(F.col("id").alias("local_id"), F.col("who").alias("global_id"), F.greatest(F.lit(0.0), "sim").alias("similarity"))


def greedy(pairs: Iterable[tuple[float, int, int]], shared: bool = False) -> dict[int, tuple[int, float]]:
    """Local to (identity, similarity), by falling similarity; each local once, each identity once unless shared. Ties: lowest local, then identity."""
    taken: set[int] = set()
    out: dict[int, tuple[int, float]] = {}
    for sim, a, g in sorted(pairs, key=lambda x: (-round(x[0], PLACES), x[1], x[2])):
        if a not in out and (shared or g not in taken):
            out[a] = (g, sim)
            taken.add(g)
    return out


def agglomerate(v: np.ndarray, files: list[int], threshold: float, average: bool = True) -> list[int]:
    """Cluster numbers by lowest member: merges the nearest two clusters (ties: the lowest members) while they are at least as near as threshold and share no file.

    Besides the matrix of similarities each cluster's nearest is kept; a merge makes no cluster nearer to a third than the nearer of its parts was, so it changes few.
    """
    n = len(v)
    sim = v @ v.T
    file = np.array(files)
    apart = file[:, None] == file[None, :]
    size, members, alive = np.ones(n), [[i] for i in range(n)], np.ones(n, bool)
    near, who = np.full(n, -np.inf), np.full(n, n)

    def seek(i: int) -> None:
        row = np.where(alive & ~apart[i], np.round(sim[i], PLACES), -np.inf)
        who[i] = row.argmax()  # the lowest of equals
        near[i] = row[who[i]] if row[who[i]] >= threshold else -np.inf

    for i in range(n):
        seek(i)
    while n and (top := near.max()) > -np.inf:
        i, j = min((min(k, int(who[k])), max(k, int(who[k]))) for k in np.flatnonzero(near == top).tolist())
        row = (size[i] * sim[i] + size[j] * sim[j]) / (size[i] + size[j]) if average else np.minimum(sim[i], sim[j])
        sim[i], sim[:, i] = row, row
        apart[i] |= apart[j]
        apart[:, i] = apart[i]
        size[i], members[i], alive[j], near[j] = size[i] + size[j], members[i] + members[j], False, -np.inf
        for k in np.flatnonzero(alive & (near > -np.inf) & ((who == i) | (who == j))).tolist():
            seek(k)
        seek(i)
        shown = np.round(sim[i], PLACES)
        tie = alive & ~apart[i] & (shown >= threshold) & ((shown > near) | ((shown == near) & (i < who)))
        near[tie], who[tie] = shown[tie], i
    out = [0] * n
    for number, i in enumerate(np.flatnonzero(alive).tolist()):
        for k in members[i]:
            out[k] = number
    return out


#: Members of a component up to which one task clusters it with a matrix of their number squared, and numbers of their vectors up to which one does without (average linkage; 32 MB).
LARGE, HELD = 4096, 1 << 22


def cluster(locals_: DataFrame, threshold: float, average: bool = True) -> DataFrame:
    """id, cluster (lowest id in it). No merge crosses a component of the graph of pairs at or above the threshold, so each component is clustered on its own:
    in a task, or, with too many members for one, in rounds of joins (operators.linkage) that give the same. The graph's pairs are never listed, a forest of them is."""
    links = forest_above(locals_.select("id", F.col("centroid").alias("v")), low=threshold)
    parts = write_table(connected_components(links).withColumnRenamed("node", "id"), "parts")
    numbers = locals_.select("id", F.size("centroid").alias("_d")).join(parts, "id").groupBy("component").agg(F.count("*").alias("n"), F.sum("_d").alias("numbers"))
    large = write_table(numbers.where((F.col("n") > LARGE) & (F.lit(not average) | (F.col("numbers") > HELD))).select("component"), "large")

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        v = np.array(group["centroid"].tolist(), np.float64)
        v, files = v / np.sqrt((v * v).sum(1))[:, None], group["file_id"].tolist()
        c = linkage.by_means(v, files, threshold) if len(v) > LARGE else agglomerate(v, files, threshold, average)
        first = {}
        for k, i in zip(c, group["id"]):
            first.setdefault(k, i)
        return pd.DataFrame({"id": group["id"], "cluster": [first[k] for k in c]})

    rows = locals_.join(parts, "id", "left")
    alone = rows.where("component is null").select("id", F.col("id").alias("cluster"))
    if large.isEmpty():
        return rows.where("component is not null").groupBy("component").applyInPandas(one, "id long, cluster long").unionByName(alone)
    inside = write_table(parts.join(large, "component", "left_semi").select("id"), "inside")
    small = rows.where("component is not null").join(large, "component", "left_anti").groupBy("component").applyInPandas(one, "id long, cluster long")
    big = linkage.merge_rounds(locals_.join(inside, "id", "left_semi"), threshold, average)
    return small.unionByName(big).unionByName(alone)


def merge_into(left: Column, left_name: Column, left_files: Column, right: Column, right_name: Column, right_files: Column) -> Column:
    """The identity that a merge keeps: the named one, else the one in more files, else the left; names as displayed."""
    unnamed = [F.startswith(n, F.lit("SPEAKER_")) for n in (left_name, right_name)]
    return F.when((unnamed[0] & ~unnamed[1]) | ((unnamed[0] == unnamed[1]) & (right_files > left_files)), right).otherwise(left)
