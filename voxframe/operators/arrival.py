"""Matching of many files in order of arrival, without a step a file.

Each file's voices are matched against the identities as the files before have left them: a match moves an identity's centroid, a voice that is like nobody becomes an identity that later
files may match. Files depend on one another only where a voice comes near an identity, so voices and identities are dealt to components of the graph of pairs at or
above the threshold, and each component is replayed file by file in one task, all components side by side.

A centroid that moves may come near a voice of another component, which the graph didn't foresee. Every state that a centroid has had is therefore compared with the voices of other
components that arrived while it had it. If none is near, then by induction over the files the replay is what the files one by one would have given; else the components concerned are joined and
replayed again. Rounds don't grow with the number of files; each joins components, so they end.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.operators import identity
from voxframe.operators.components import connected_components
from voxframe.operators.matching import enrolled_matches
from voxframe.operators.similarity import candidates, forest_above
from voxframe.workspace import write_table

#: Identities that voices found are numbered after all others, by the voice.
_NEW = 1 << 62
_EVENT = "component long, kind int, file_id long, id long, centroid array<double>, weight double"
_DONE = "component long, kind int, file_id long, until long, id long, who long, centroid array<double>, similarity double"
#: Kinds of events: an identity and how many locals it has, locals that go when their file comes again, a voice and its speech. Of results: a voice's match, a state of a centroid.
IDENTITY, GONE, VOICE = 0, 1, 2
MATCH, STATE = 0, 1


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.sqrt((v * v).sum(-1, keepdims=True))
    return np.where(n > 1e-6, v / np.maximum(n, 1e-300), 0.0)


def replay(events: pd.DataFrame, match: float, floor: float) -> pd.DataFrame:
    """Matches of a component's voices (who: the identity, _NEW and the voice's id for a new one, null for none) and the states of its centroids: those of file_id on, before until."""
    at, since = {}, {}
    count: dict[int, float] = defaultdict(float)
    out = []
    known = events[events.kind == IDENTITY]
    for i, v, n in zip(known.id, known.centroid, known.weight):
        at[i], count[i] = np.asarray(v, np.float64), n
    later = events[events.kind != IDENTITY].sort_values(["file_id", "kind", "id"])
    for file_id, rows in later.groupby("file_id"):
        for i, n in zip(rows.id[rows.kind == GONE], rows.weight[rows.kind == GONE]):
            count[i] -= n
        voices = rows[rows.kind == VOICE]
        if not len(voices):
            continue
        vectors = [np.asarray(v, np.float64) for v in voices.centroid]
        found = []
        for size in {len(v) for v in vectors}:
            own, ids = [k for k, v in enumerate(vectors) if len(v) == size], [i for i, v in at.items() if len(v) == size]
            if ids:
                sim = _unit(np.stack([vectors[k] for k in own])) @ _unit(np.stack([at[i] for i in ids])).T
                found += [(sim[a, b], own[a], ids[b]) for a, b in np.argwhere(sim >= match).tolist()]
        taken = identity.greedy(found)
        for k, (i, speech) in enumerate(zip(voices.id, voices.weight)):
            who, sim = taken.get(k, (None, None))
            if who is not None:
                n = max(1.0, count[who])
                if who in since:
                    out.append((STATE, since[who], file_id, None, who, at[who], None))
                moved = (at[who] * n + vectors[k]) / (n + 1)
                at[who], since[who] = _scaled(moved), file_id + 1
                count[who] += 1
            elif floor <= 0 or speech >= floor:
                who, sim = _NEW + i, 1.0
                at[who], count[who] = vectors[k], 1
            out.append((MATCH, file_id, None, i, who, None, sim))
    out += [(STATE, since[i], None, None, i, at[i], None) for i in since]
    columns = dict(zip(["kind", "file_id", "until", "id", "who", "centroid", "similarity"], [list(c) for c in zip(*out)] or [[]] * 7))
    whole = {k: pd.array(v, "Int64") if k not in ("centroid", "similarity") else v for k, v in columns.items()}  # ids don't go through floats
    rows = pd.DataFrame(whole).astype({"similarity": "float64"})
    rows.insert(0, "component", events.component.iloc[0])
    return rows


def _strange(voice: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Whether a voice (component, file) arrived while a centroid of another component had a state (component, first file, last file)."""
    return (voice[..., 0] != state[..., 0]) & (voice[..., 1] >= state[..., 1]) & (voice[..., 1] <= state[..., 2])


def _scaled(v: np.ndarray) -> np.ndarray:
    n = np.sqrt((v * v).sum())
    return v / n if n > 0 else v


def resolve_in_order(locals_: DataFrame, identities: DataFrame, clips: DataFrame, earlier: DataFrame, *, enrol: float = 0.55, match: float = 0.65, floor: float = 8.0, collapse: bool = True) -> tuple[DataFrame, DataFrame]:
    """As matching.resolve_batch, but a file (in order of file_id) at a time, each against the store that the ones before have left; and the centroids that moved.

    locals_: the new locals, ids in order of file_id and label; identities and clips with vectors; earlier: file_id, global_id of the locals in the store, those of files that come again
    among them. First result: local_id, outcome, global_id (null unless the identity was there before), minted_by (the local whose identity it is, null otherwise), similarity. Second: global_id or
    minted_by, centroid of the identities that were matched.
    """
    fixed = write_table(enrolled_matches(locals_, clips, enrol, collapse), "enrolled")
    voiced = identity.with_vectors(locals_).join(fixed.select(F.col("local_id").alias("id")), "id", "left_anti")
    voices = write_table(voiced.select("id", "file_id", "centroid", F.col("total_dur").cast("double").alias("weight")), "voices")
    open_ids = identity.with_vectors(identities.where("not enrolled")).select("id", "centroid")
    again = earlier.where("global_id is not null").join(locals_.select("file_id").distinct(), "file_id", "left_semi").groupBy("file_id", F.col("global_id").alias("id")).agg(F.count("*").cast("double").alias("weight"))
    counts = earlier.where("global_id is not null").groupBy(F.col("global_id").alias("id")).agg(F.count("*").cast("double").alias("weight"))
    nodes = [d.select((F.col("id") * 2 + k).alias("id"), F.col("centroid").alias("v")) for k, d in enumerate((voices, open_ids))]
    links = write_table(forest_above(*nodes, match).unionByName(forest_above(nodes[0], low=match)), "links")
    met = open_ids.join(links.select(F.explode(F.array("a", "b")).alias("n")).where("n % 2 = 1").select(F.expr("n div 2").alias("id")).distinct(), "id", "left_semi")
    events = met.join(counts, "id", "left").select(F.lit(IDENTITY).alias("kind"), F.lit(0).cast("long").alias("file_id"), "id", "centroid", F.coalesce("weight", F.lit(0.0)).alias("weight"), (F.col("id") * 2 + 1).alias("node"))
    gone = again.join(met.select("id"), "id", "left_semi").select(F.lit(GONE).alias("kind"), "file_id", "id", F.lit(None).cast("array<double>").alias("centroid"), "weight", (F.col("id") * 2 + 1).alias("node"))
    said = voices.select(F.lit(VOICE).alias("kind"), "file_id", "id", "centroid", "weight", (F.col("id") * 2).alias("node"))
    events = write_table(events.unionByName(gone).unionByName(said), "events")
    while True:
        parts = write_table(connected_components(links), "parts")
        dealt = events.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")).select(*[c.split()[0] for c in _EVENT.split(", ")])
        done = write_table(dealt.groupBy("component").applyInPandas(lambda rows: replay(rows, match, floor), _DONE), "replayed")
        states = write_table(done.where(F.col("kind") == STATE).select(F.monotonically_increasing_id().alias("id"), "component", "file_id", "until", "who", "centroid"), "states")
        own = done.where(F.col("kind") == MATCH).select("id", F.col("component").alias("_of"))
        at = F.array("component", "file_id", F.coalesce("until", F.lit((1 << 63) - 1)))
        strange = candidates(voices.join(own, "id"), states, match, F.array("_of", "file_id"), at, _strange)
        strange = strange.join(own.select(F.col("id").alias("local_id"), "_of"), "local_id").join(states.select(F.col("id").alias("other_id"), "component"), "other_id")
        strange = write_table(strange.select(F.col("_of").alias("a"), F.col("component").alias("b")).distinct(), "strange")
        if strange.isEmpty():
            break
        links = write_table(links.unionByName(strange), "links")  # components are named by one of their nodes
    matched = done.where(F.col("kind") == MATCH).select(F.col("id").alias("local_id"), "who", "similarity")
    whose = lambda c: [F.when(c < _NEW, c).alias("global_id"), F.when(c >= _NEW, c - _NEW).alias("minted_by")]
    found = locals_.select(F.col("id").alias("local_id"), (F.coalesce(F.size("centroid"), F.lit(0)) > 0).alias("_voiced")).join(fixed.select("local_id", F.col("global_id").alias("_g"), F.col("sim").alias("_s")), "local_id", "left").join(matched, "local_id", "left")
    outcome = F.when(F.col("_g").isNotNull(), "enrolled").when(~F.col("_voiced"), "no_vector").when(F.col("who").isNull(), "below_floor").when(F.col("who") == F.col("local_id") + _NEW, "mint").otherwise("inferred")
    g, m = whose(F.col("who"))
    resolved = found.select("local_id", outcome.alias("outcome"), F.coalesce("_g", g).alias("global_id"), m, F.coalesce("_s", "similarity").alias("similarity"))
    return resolved, states.where("until is null").select(*whose(F.col("who")), "centroid")
