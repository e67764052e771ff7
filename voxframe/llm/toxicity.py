"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Training takes at most max_toxic and max_clean labelled documents (those with the smallest hash of their id; the
documented bound), counts in how many of either class each hashed n-gram is present, keeps the `features`
n-grams that differ most, scales presence by the log-count ratio and fits a logistic regression on it. The intercept is moved to
the share of toxic labels among all labels that may be learned from. Scores are probabilities.

Defined cases: null and empty texts have no n-grams and get the score of the intercept; labels that are null or of unknown
documents teach nothing; repeated labels of an id count once, the largest; without labels of both classes every score is the smoothed share of
toxic labels; repeated rows get equal scores; an empty table gives an empty table; columns kept are passed through whatever their names are, but for _vx_score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxframe.llm.batches import map_batches
from voxframe.workspace import small_batches, write_table

N_GRAMS, BUCKET_BITS = (3, 4, 5, 6), 19
#: Characters that are hashed at once.
PIECE = 1 << 18
_P = np.uint64(0x100000001B3)
_C = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Model:
    """slot: feature of a bucket or -1; weight: of a feature, ratio included."""

    slot: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        z = self.bias + float(self.weight[present(text, self.slot)].sum())
        return 1 / (1 + np.exp(-z)) if z > -700 else 0.0


def _buckets(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of the lower-cased text between two spaces, a piece at a time."""
    text = f" {text.lower()} " if text else "  "
    for at in range(0, len(text), PIECE):
        c = np.frombuffer(text[at : at + PIECE + max(N_GRAMS) - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        h = c
        for n in range(2, max(N_GRAMS) + 1):
            if len(c) < n:
                break
            h = h[:-1] * _P + c[n - 1 :]
            if n in N_GRAMS:
                yield ((h + np.uint64(n)) * _C) >> np.uint64(64 - BUCKET_BITS)


def present(text: str | None, slot: np.ndarray) -> np.ndarray:
    """The features that the text has, each once."""
    found = []
    for b in _buckets(text):
        s = slot[b]
        found.append(s[s >= 0])
    return np.unique(np.concatenate(found)) if found else np.empty(0, slot.dtype)


def held_out(id_col: str = "doc_id") -> F.Column:
    """True for rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_toxic: int = 4000, max_clean: int = 8000, features: int = 1024, l2: float = 0.3, steps: int = 200) -> Model:
    """The model; labels of held-out rows are not read."""
    spark = docs.sparkSession
    small_batches(spark, 1000)
    known = labels.where(~held_out(id_col)).groupBy(F.col(id_col).alias("_vx_id")).agg(F.max(F.col(label_col).cast("int")).alias("y")).where("_vx_id is not null and y is not null")
    known = write_table(known, "labels")
    n = {bool(y): k for y, k in known.groupBy((F.col("y") > 0).alias("y")).count().collect()}
    share = (n.get(True, 0) + 1) / (sum(n.values()) + 2)
    bias = float(np.log(share / (1 - share)))
    constant = Model(np.full(1 << BUCKET_BITS, -1, np.int16), np.zeros(1), bias)
    if len(n) < 2:
        return constant
    parts = [known.where(cond).orderBy(F.xxhash64("_vx_id"), "_vx_id").limit(most) for cond, most in (("y > 0", max_toxic), ("y <= 0", max_clean))]
    picked = parts[0].unionByName(parts[1])  # max_toxic + max_clean rows at most, so it may be broadcast
    sample = write_table(docs.select(F.col(id_col).alias("_vx_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), "_vx_id").select("text", F.when(F.col("y") > 0, 1).otherwise(0).alias("y")), "sample")
    m = {y: k for y, k in sample.groupBy("y").count().collect()}
    if len(m) < 2:
        return constant
    counted = sample.mapInArrow(_count, "bucket int, p long, q long").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    rate, other = F.col("p") / m[1], F.col("q") / m[0]
    pooled = (F.col("p") + F.col("q")) / (m[0] + m[1])
    differs = F.abs(rate - other) / F.sqrt(pooled * (1 - pooled) + 1e-9)
    best = counted.where(F.col("p") + F.col("q") >= 4).orderBy(differs.desc(), "bucket").limit(features).collect()
    slot = np.full(1 << BUCKET_BITS, -1, np.int16)
    slot[[r.bucket for r in best]] = np.arange(len(best))
    ratio = np.array([np.log((r.p + 1) / (m[1] + 2)) - np.log((r.q + 1) / (m[0] + 2)) for r in best])
    shared = spark.sparkContext.broadcast(slot)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([present(t.as_py(), shared.value).astype("<i2").tobytes() for t in b.column(0)], pa.binary())], ["y", "x"])

    found = sample.mapInArrow(rows, "y int, x binary").collect()  # max_toxic + max_clean rows at most
    found = sorted((r.y, bytes(r.x)) for r in found)
    w, b = _logistic([np.frombuffer(x, "<i2") for _, x in found], np.array([y for y, _ in found]), ratio, l2, steps)
    return Model(slot, w * ratio, b + bias - float(np.log(m[1] / m[0])))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either class with an n-gram in the bucket; a task returns a row a bucket at most."""
    sums, once = np.zeros((2, 1 << BUCKET_BITS), np.int64), np.zeros(1 << BUCKET_BITS, bool)
    for b in batches:
        for text, y in zip(b.column(0), b.column(1).to_pylist()):
            for h in _buckets(text.as_py()):
                once[h] = True
            at = np.flatnonzero(once)
            sums[y][at] += 1
            once[at] = False
    at = np.flatnonzero(sums.any(0)).astype(np.int32)
    for i in range(0, len(at), 10_000):
        k = at[i : i + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(sums[1][k]), pa.array(sums[0][k])], ["bucket", "p", "q"])


def _logistic(xs: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, l2: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights before scaling and the intercept, by Adam on all rows."""
    col = np.concatenate(xs).astype(np.int64)
    row = np.repeat(np.arange(len(xs)), [len(x) for x in xs])
    val, n = ratio[col], len(xs)
    w, b, m1, m2 = np.zeros(len(ratio)), 0.0, np.zeros(len(ratio) + 1), np.zeros(len(ratio) + 1)
    for t in range(1, steps + 1):
        z = np.bincount(row, val * w[col], n) + b
        e = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) / n
        g = np.append(np.bincount(col, val * e[row], len(ratio)) + l2 * w / n, e.sum())
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        step = 0.05 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def score(docs: DataFrame, model: Model, *, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The columns in keep (default: all) and _vx_score. The model is broadcast; its size is fixed by BUCKET_BITS and features."""
    spark = docs.sparkSession
    small_batches(spark, 1000)
    keep = docs.columns if keep is None else keep
    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [shared.value.score(t.as_py()) for t in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s, pa.float64())], [*b.schema.names[:-1], "_vx_score"])

    return map_batches(docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).cast("string").alias("_vx_text")), run, T.StructType([*kept.schema.fields, T.StructField("_vx_score", T.DoubleType())]))
