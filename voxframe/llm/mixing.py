"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

A source of S words with the target T gives every document floor(T / S) certain whole copies. The rest R = T mod S is a sample without
replacement in which a document's inclusion probability p grows with its size: p = f * size, the factor f such that the expected words are R. Documents
whose p would reach 1 are certain, too (one more whole copy), and the others share what is left. These are ranked by their random odds
u / (1 - u) divided by their inclusion odds p / (1 - p), and the first ones are taken whose words fill the rest; the document at the edge is taken if that brings the sum
nearer. A document of no words counts as one word for p. u is a hash of the document's id, so reruns agree.

Defined cases: a null source is a source of its own, last in order; null and empty texts have size 0 and are copied
like others, taking no words; an empty table gives an empty table; repeated rows are separate documents that share
a random number, and ties are broken by id, then size; other columns pass through, whatever their names are, but for
names that begin with _vx_. Rows that agree in random number, id and size are taken together or left together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxframe.operators.joins import spread_join
from voxframe.workspace import write_table

#: Tables of a row a source are broadcast up to so many sources; beyond, spread_join deals them.
FEW_SOURCES = 50_000
#: Rows of a source in a bucket of the rank axis, about; buckets are summed before any order by document is made.
BUCKET_ROWS = 1000


def word_count(text: str = "text") -> F.Column:
    """Runs of anything but space and \\t \\n \\v \\f \\r; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(classes: DataFrame, weights: tuple[int, ...], max_repeat: int, share: float) -> DataFrame:
    """From the number _vx_k of documents of each _vx_source and size _vx_s: _vx_rank, _vx_key (source), _vx_source_size, _vx_rows, _vx_target: one row a source.

    Targets are min(cap, f * weight) with one factor f for all, found by walking the sources in order of cap / weight:
    what sources above their cap can't take is shared by the others' weights. All sums are integers. The windows without partition hold a row a source.
    """
    s = classes.groupBy(F.col("_vx_source").alias("_vx_key")).agg(F.sum(F.col("_vx_s") * F.col("_vx_k")).alias("_vx_source_size"), F.sum("_vx_k").alias("_vx_rows"))
    by_name, by_ratio, all_rows = Window.orderBy(F.col("_vx_key").asc_nulls_last()), Window.orderBy("_vx_ratio", "_vx_rank"), Window.partitionBy()
    s = s.withColumn("_vx_rank", F.row_number().over(by_name))
    s = s.withColumn("_vx_w", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), ((F.col("_vx_rank") - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("_vx_cap", F.col("_vx_source_size") * max_repeat).withColumn("_vx_ratio", F.col("_vx_cap") / F.col("_vx_w"))
    s = s.withColumn("_vx_total", F.round(F.sum("_vx_source_size").over(all_rows) * share).cast("long"))
    s = s.withColumn("_vx_num", F.col("_vx_total") - (F.sum("_vx_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_vx_cap")))
    s = s.withColumn("_vx_den", F.sum("_vx_w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("_vx_at", F.row_number().over(by_ratio))
    fits = F.col("_vx_num").cast("decimal(38,0)") * F.col("_vx_w") <= F.col("_vx_cap").cast("decimal(38,0)") * F.col("_vx_den")
    s = s.withColumn("_vx_first", F.min(F.when(fits, F.struct("_vx_at", "_vx_num", "_vx_den"))).over(all_rows))
    free = F.col("_vx_first").isNotNull() & (F.col("_vx_at") >= F.col("_vx_first._vx_at"))
    target = F.when(free, (F.col("_vx_first._vx_num") * F.col("_vx_w")).cast("double") / F.col("_vx_first._vx_den").cast("double")).otherwise(F.col("_vx_cap").cast("double"))
    return s.select("_vx_rank", "_vx_key", "_vx_source_size", "_vx_rows", target.alias("_vx_target"))


def pareto_rank(u: F.Column, p: F.Column) -> F.Column:
    """Random odds over inclusion odds; smaller comes first."""
    return (u / (1 - u)) * ((1 - p) / p)


def uniform(id_col: str, seed: int) -> F.Column:
    """52 bits of an MD5 of the id, in (0, 1)."""
    text = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(f"|{seed}"))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)


def odds_factor(classes: DataFrame, targets: DataFrame) -> DataFrame:
    """_vx_rank, _vx_z (documents of at least this size are certain; null: none are), _vx_left (words that the others fill), _vx_f (p = _vx_f * size).

    With the sizes from z on certain, the others' factor is (R - their words) / (sum of squares of the rest); z is certain if that factor reaches 1 / z. A window holds
    a row for each size that a source has, not a row a document.
    """
    rows = classes.where("_vx_s > 0").join(F.broadcast(targets) if targets.count() <= FEW_SOURCES else targets, F.col("_vx_source").eqNullSafe(F.col("_vx_key"))).where("_vx_rest > 0")
    square = (F.col("_vx_s").cast("decimal(38,0)") * F.col("_vx_s") * F.col("_vx_k")).cast("decimal(38,0)")
    down = Window.partitionBy("_vx_rank").orderBy(F.desc("_vx_s")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_vx_above", F.sum(F.col("_vx_s") * F.col("_vx_k")).over(down)).withColumn("_vx_all", F.sum(square).over(Window.partitionBy("_vx_rank")))
    rows = rows.withColumn("_vx_below", (F.col("_vx_all") - F.sum(square).over(down)).cast("double"))
    sure = F.col("_vx_above").cast("double") + F.col("_vx_below") / F.col("_vx_s").cast("double") <= F.col("_vx_rest")
    cut = rows.groupBy("_vx_rank").agg(F.min(F.when(sure, F.struct("_vx_s", "_vx_above", "_vx_below"))).alias("c"), F.first("_vx_rest").alias("r"), F.first(F.col("_vx_all").cast("double")).alias("all"))
    left, below = F.col("r") - F.coalesce(F.col("c._vx_above"), F.lit(0)), F.coalesce(F.col("c._vx_below"), F.col("all"))
    return cut.select("_vx_rank", F.col("c._vx_s").alias("_vx_z"), left.alias("_vx_left"), F.when(below > 0, left / below).otherwise(0.0).alias("_vx_f"))


def mix(rows: DataFrame, sizes: DataFrame | None = None, *, id_col: str = "doc_id", source: str = "source", size: str = "_vx_size", weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3, share: float = 1.0, seed: int = 11) -> DataFrame:
    """rows with _vx_source_size, _vx_target and _vx_copies, how often the mix takes the row.

    sizes: the same rows with only id, source and size, if those are cheaper to read; sums are made from it.
    Shuffles: counts by source and size, sums by source and bucket of the rank axis, and an order of the few rows in the one
    bucket of each source where the sample ends (p is the probability of a rank below 1, so that is a bucket about 1, of about BUCKET_ROWS rows or fewer).
    A source with a third of all rows is only ever summed. The rows themselves are read once, with the last rank taken of each source beside them.
    """
    sizes = (rows if sizes is None else sizes).select(F.col(id_col).alias("_vx_id"), F.col(source).alias("_vx_source"), F.col(size).alias("_vx_s"))
    classes = write_table(sizes.groupBy("_vx_source", "_vx_s").agg(F.count("*").alias("_vx_k")), "classes")
    targets = source_targets(classes, weights, max_repeat, share)
    whole = F.when(F.col("_vx_source_size") > 0, F.floor(F.col("_vx_target") / F.col("_vx_source_size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("_vx_whole", whole).withColumn("_vx_rest", F.col("_vx_target") - F.col("_vx_whole") * F.col("_vx_source_size"))
    targets = write_table(targets.withColumn("_vx_n", F.ceil(F.col("_vx_rows") / BUCKET_ROWS)), "targets")
    plan = write_table(targets.join(odds_factor(classes, targets), "_vx_rank", "left").drop("_vx_rest"), "odds")
    n, few = sizes.count(), targets.count() <= FEW_SOURCES

    def ranked(df: DataFrame, plan: DataFrame, by: str, key: str, s: str) -> DataFrame:
        if few:
            df = df.join(F.broadcast(plan), F.col(by).eqNullSafe(F.col("_vx_key"))).drop("_vx_key")
        else:
            named = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in (by, "_vx_key")]
            df = spread_join(df.withColumn("_vx_by", named[0]), plan.withColumn("_vx_by", named[1]).drop("_vx_key").withColumn("_vx_m", F.col("_vx_rows")), "_vx_by", "_vx_m", n).drop("_vx_by")
        sure = F.coalesce(F.col(s) >= F.col("_vx_z"), F.lit(False))
        p = F.least(F.coalesce("_vx_f", F.lit(0.0)) * F.greatest(F.col(s), F.lit(1)), F.lit(1.0))
        df = df.withColumn("_vx_sure", sure.cast("int")).withColumn("_vx_p", F.when(~sure & (p > 0), p))
        return df.withColumn("_vx_q", pareto_rank(uniform(key, seed), F.col("_vx_p")))

    bucket = F.floor((1 - 1 / (1 + F.col("_vx_q"))) * F.col("_vx_n"))
    own = ranked(sizes, plan, "_vx_source", "_vx_id", "_vx_s").where("_vx_p is not null").withColumn("_vx_b", bucket)
    sums = own.groupBy("_vx_rank", "_vx_b", "_vx_left").agg(F.sum("_vx_s").alias("_vx_w"))
    up_to = Window.partitionBy("_vx_rank").orderBy("_vx_b").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("_vx_cum", F.sum("_vx_w").over(up_to)).where(F.col("_vx_cum") >= F.col("_vx_left"))
    edge = sums.groupBy("_vx_rank").agg(F.min_by(F.struct(F.col("_vx_b").alias("b"), (F.col("_vx_cum") - F.col("_vx_w")).alias("before")), "_vx_b").alias("_vx_edge"))
    edge = write_table(edge, "edge")
    # a row a source, as the plan; the rows of the edge's buckets are few, and alike ones are one
    near = own.join(F.broadcast(edge) if few else edge, "_vx_rank").where(F.col("_vx_b") == F.col("_vx_edge.b"))
    near = near.groupBy("_vx_rank", "_vx_left", "_vx_edge", "_vx_q", "_vx_id", "_vx_s").agg((F.count("*") * F.col("_vx_s")).alias("_vx_w"))
    order = Window.partitionBy("_vx_rank").orderBy("_vx_q", "_vx_id", "_vx_s").rowsBetween(Window.unboundedPreceding, 0)
    cum, rest = F.sum("_vx_w").over(order) + F.col("_vx_edge.before"), F.col("_vx_left")
    near = near.withColumn("_vx_cum", cum).where((F.col("_vx_cum") <= rest) | (F.col("_vx_cum") - rest < rest - (F.col("_vx_cum") - F.col("_vx_w"))))
    last = near.groupBy("_vx_rank").agg(F.max(F.struct(F.col("_vx_q").alias("q"), F.col("_vx_id").alias("i"), F.col("_vx_s").alias("s"))).alias("_vx_last"))
    plan = write_table(plan.join(edge, "_vx_rank", "left").join(last, "_vx_rank", "left"), "edges")
    at = F.struct(F.col("_vx_q").alias("q"), F.col(f"`{id_col}`").alias("i"), F.col(f"`{size}`").alias("s"))
    inside = F.coalesce(at <= F.col("_vx_last"), F.lit(False))
    pick = F.when(F.col("_vx_p").isNull(), 0).when(F.col("_vx_edge").isNull() | (F.col("_vx_b") < F.col("_vx_edge.b")) | ((F.col("_vx_b") == F.col("_vx_edge.b")) & inside), 1).otherwise(0)
    placed = ranked(rows, plan, source, id_col, size).withColumn("_vx_b", bucket)
    return placed.withColumn("_vx_copies", F.col("_vx_whole") + F.col("_vx_sure") + pick).select(*[F.col(f"`{c}`") for c in rows.columns], "_vx_source_size", "_vx_target", "_vx_copies")
