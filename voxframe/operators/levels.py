"""Levels of sound as DataFrame aggregates, and the analysis of reference clips from their windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.functions.vectors import cosine
from voxframe.operators.identity import centroid_arrays
from voxframe.operators.joins import spread_join
from voxframe.workspace import write_table

# Thresholds of the gate and of clips. Fixed values.
QUIET, RATIO, LEAST_SPEECH, COHERENT = 2e-4, 0.12, 3.0, 0.72


def frame_energy(samples: DataFrame, key: str, pos: str, value: str, frame: int) -> DataFrame:
    """key, frame, energy: the mean absolute value of each whole frame of so many samples; pos counts from 0."""
    rows = samples.groupBy(key, F.expr(f"{pos} div {frame}").alias("frame")).agg(F.avg(F.abs(value)).alias("energy"), F.count("*").alias("_n"))
    return rows.where(F.col("_n") == frame).drop("_n")


#: Values of a key that are sorted in one task at most; beyond, counts of BUCKETS ranges narrow down where the wanted ones are.
SORTED, BUCKETS = 100_000, 1024


def _bare(rows: DataFrame, key: str, value: str) -> DataFrame:
    return rows.select(F.col(key).alias("_key"), F.col(value).alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan(F.col("_v").cast("double")))


def nth(rows: DataFrame, key: str, value: str, at: dict[str, str]) -> DataFrame:
    """key, n and, for each name, the element of the n sorted values at the position (from 0) that an expression over n gives; nulls and NaN are left out, other values are finite.

    A key with more than SORTED values is never sorted: between the bounds of what is looked for, values are counted by ranges, with partial counts before the shuffle, and the range
    that holds the position gives the next bounds, until it has one value or few enough to sort.
    """
    values = _bare(rows, key, value)
    sizes = write_table(values.groupBy("_key").agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")), "sizes")
    hot = sizes.where(F.col("n") > SORTED)
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), F.expr(e).cast("long").alias("k")) for name, e in at.items()])
    if hot.isEmpty():
        found = _sorted(values.join(sizes.select("_key", F.explode(wanted).alias("w")), "_key").select("_key", "w.name", "w.k", "_v"))
    else:
        cool = values.join(F.broadcast(hot.select("_key")), "_key", "left_anti")  # there are fewer hot keys than values over SORTED
        small = _sorted(cool.join(sizes.where(F.col("n") <= SORTED).select("_key", F.explode(wanted).alias("w")), "_key").select("_key", "w.name", "w.k", "_v"))
        found = small.unionByName(_narrowed(values, hot.select("_key", F.explode(wanted).alias("w"), "lo", "hi", "n").select("_key", "w.name", "w.k", "lo", "hi", "n")))
    wide = found.groupBy("_key").agg(*[F.max(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name in at])
    return sizes.select("_key", "n").join(wide, "_key").withColumnRenamed("_key", key)


def _sorted(rows: DataFrame) -> DataFrame:
    """_key, name, _v: of rows _key, name, k, _v the one at place k."""
    ranked = rows.withColumn("_k", F.row_number().over(Window.partitionBy("_key", "name").orderBy("_v")) - 1)
    return ranked.where(F.col("_k") == F.col("k")).select("_key", "name", "_v")


def _between(values: DataFrame, targets: DataFrame) -> DataFrame:
    """_key, name, k, lo, hi, _v: the values between the bounds of each target of their key; hot keys are spread."""
    one = write_table(targets.groupBy("_key").agg(F.collect_list(F.struct("name", "k", "lo", "hi")).alias("_targets"), F.max("n").alias("_n")), "targets")
    total = one.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    met = spread_join(values, one, "_key", "_n", total).select("_key", "_v", F.explode("_targets").alias("t"))
    return met.select("_key", "t.*", "_v").where((F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi")))


def _narrowed(values: DataFrame, targets: DataFrame) -> DataFrame:
    done = []
    whole = write_table(targets.withColumn("left", F.col("n")), "targets")
    while True:
        few = (F.col("lo") == F.col("hi")) | (F.col("left") <= SORTED)
        done.append(whole.where(few))
        whole = whole.where(~few)
        if whole.isEmpty():
            break
        half = lambda c: F.col(c).cast("double") / 2  # noqa: E731  so that no difference is too large
        share = (half("_v") - half("lo")) / (half("hi") - half("lo"))
        rows = _between(values, whole).withColumn("_b", F.least(F.lit(BUCKETS - 1), F.floor(share * BUCKETS)))
        counts = rows.groupBy("_key", "name", "k", "_b").agg(F.count("*").alias("c"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        before = F.sum("c").over(Window.partitionBy("_key", "name").orderBy("_b")) - F.col("c")
        at = counts.withColumn("_before", before).where((F.col("k") >= F.col("_before")) & (F.col("k") < F.col("_before") + F.col("c")))
        at = at.join(whole.select("_key", "name", "n"), ["_key", "name"])
        whole = write_table(at.select("_key", "name", (F.col("k") - F.col("_before")).alias("k"), "lo", "hi", "n", F.col("c").alias("left")), "targets")
    ends = done[0]
    for d in done[1:]:
        ends = ends.unionByName(d)
    alone = ends.where(F.col("lo") == F.col("hi")).select("_key", "name", F.col("lo").alias("_v"))
    rest = ends.where(F.col("lo") < F.col("hi"))
    return alone.unionByName(_sorted(_between(values, rest).select("_key", "name", "k", "_v")))


def rms(samples: DataFrame, key: str, value: str) -> DataFrame:
    """key, rms: the root of the mean square."""
    return samples.groupBy(key).agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"))


def channel_correlation(energies: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """key, correlation: |r| of the frame energies of two channels; 0 under 100 frames, 1 where a channel is constant."""
    spread = F.var_pop(a) * F.var_pop(b) * F.count("*") * F.count("*")
    rows = energies.groupBy(key).agg(F.count("*").alias("_n"), spread.alias("_s"), (F.covar_pop(a, b) * F.count("*")).alias("_c"))
    return rows.select(key, F.when(F.col("_n") < 100, 0.0).when(F.col("_s") < 1e-6, 1.0).otherwise(F.least(F.lit(1.0), F.abs("_c") / F.sqrt("_s"))).alias("correlation"))


def usable(duration: Column, least: float = LEAST_SPEECH) -> Column:
    """Whether a clip has enough speech."""
    return duration >= least


def clip_duration(kept: Column, spans: Column, window: float = 4.0, hop: float = 2.0) -> Column:
    """Seconds of the windows kept, overlaps counted once where there are several."""
    return kept * F.when(spans > 1, min(1.0, hop / max(0.001, window))).otherwise(1.0)


def usable_clips(clips: DataFrame) -> DataFrame:
    """global_id, usable, seconds of clips that have enough speech."""
    ok = usable(F.col("duration"))
    return clips.groupBy("global_id").agg(F.count_if(ok).alias("usable"), F.coalesce(F.sum(F.when(ok, F.col("duration"))), F.lit(0.0)).alias("seconds"))


def noise_floor(energies: DataFrame, key: str) -> DataFrame:
    """key, floor: the tenth over the middle of the sorted energies, 1 at most; 0 under 20 frames, 1 where the middle is silent."""
    e = nth(energies, key, "energy", {"p50": "n div 2", "p10": "n div 10"})
    floor = F.when(F.col("n") < 20, 0.0).when(F.col("p50") <= 1e-6, 1.0).otherwise(F.least(F.lit(1.0), F.col("p10") / F.col("p50")))
    return e.select(key, floor.alias("floor"))


def gates(levels: DataFrame, key: str, level: str = "level") -> DataFrame:
    """key, loud, gate: the level nine tenths up the windows that sound, 0 if none; the gate is a share of it, or the least."""
    sounding = nth(levels.where(F.col(level) >= QUIET), key, level, {"loud": "cast(floor((n - 1) * 0.9D) as int)"}).select(key, "loud")
    rows = levels.select(key).distinct().join(sounding, key, "left").withColumn("loud", F.coalesce("loud", F.lit(0.0)))
    return rows.withColumn("gate", F.greatest(F.col("loud") * RATIO, F.lit(QUIET)))


def windows(frames: Column, width: int, hop: int) -> Column:
    """Starts of the whole windows over so many samples; a clip of one window or less has one."""
    zero = F.lit(0).cast("long")
    return F.when(frames <= width, F.array(zero)).otherwise(F.sequence(zero, F.greatest(frames - width, zero), F.lit(hop).cast("long")))


def analyse_clips(spans: DataFrame, *, window: float = 4.0, hop: float = 2.0, least: float = LEAST_SPEECH, coherent: float = COHERENT) -> DataFrame:
    """clip, windows, duration, coherence, usable, problem (silent: no window loud enough; short: too little speech; mixed: the windows differ): from rows clip, start, end, level, vector (null: not embedded), one a window.

    Windows below the clip's gate are left out. Duration counts overlaps once; coherence is the lowest cosine of a window with the clip's
    centroid, 1 for one window. A clip without a window kept has duration and coherence 0.
    """
    gate = gates(spans, "clip").select("clip", "gate")
    n = spans.groupBy("clip").agg(F.count("*").alias("_spans"))
    kept = spans.join(gate, "clip").where((F.col("level") >= F.col("gate")) & F.col("vector").isNotNull()).withColumn("_w", F.col("end") - F.col("start"))
    centre = centroid_arrays(kept, "clip", "vector", "_w")
    near = kept.join(centre, "clip").groupBy("clip").agg(F.count("*").alias("windows"), F.sum("_w").alias("_kept"), F.min(cosine(F.col("vector"), F.col("centroid"))).alias("_low"))
    rows = n.join(near, "clip", "left").withColumn("windows", F.coalesce("windows", F.lit(0)))
    duration = clip_duration(F.coalesce(F.col("_kept"), F.lit(0.0)), F.col("_spans"), window, hop)
    coherence = F.when(F.col("windows") == 0, 0.0).when(F.col("windows") == 1, 1.0).otherwise(F.least(F.lit(1.0), F.col("_low")))
    rows = rows.select("clip", "windows", duration.alias("duration"), coherence.alias("coherence"))
    ok = (F.col("windows") > 0) & usable(F.col("duration"), least)
    problem = F.when(F.col("windows") == 0, "silent").when(~ok, "short").when((F.col("windows") > 1) & (F.col("coherence") < coherent), "mixed").otherwise("")
    return rows.withColumn("usable", ok).withColumn("problem", problem)
