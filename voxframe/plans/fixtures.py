"""Speech tables derived from the driver's tables: in Spark, and as DuckDB common table expressions that say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxframe.functions.text import display_name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seg(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    by = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    label = F.when(F.col("role") == "user", "speaker_00").when(F.col("role") == "assistant", "speaker_01").otherwise("speaker_02")
    end = F.sum(F.length("text")).over(by) / F.lit(15.0)
    return c.select(F.col("conv_id").alias("file_id"), F.col("turn").alias("idx"), "text", label.alias("local_label"), (end - F.length("text") / F.lit(15.0)).alias("seg_start"), end.alias("seg_end"))


SEG = """seg AS (SELECT conv_id AS file_id, turn AS idx, text,
  CASE role WHEN 'user' THEN 'speaker_00' WHEN 'assistant' THEN 'speaker_01' ELSE 'speaker_02' END AS local_label,
  sum(length(text)) OVER w / 15::DOUBLE - length(text) / 15::DOUBLE AS seg_start, sum(length(text)) OVER w / 15::DOUBLE AS seg_end
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))"""


def trn(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = seg(spark, sf_dir).where("idx % 7 <> 6")
    return s.select("file_id", (F.col("idx") % 3).cast("int").alias("speaker"), F.greatest(F.col("seg_start") - F.lit(1.5) * (F.col("idx") % 4), F.lit(0.0)).alias("t_start"), (F.col("seg_end") - F.lit(1.5) * (F.col("idx") % 3)).alias("t_end"))


TRN = """trn AS (SELECT file_id, (idx % 3)::INT AS speaker, greatest(seg_start - 1.5::DOUBLE * (idx % 4), 0::DOUBLE) AS t_start, seg_end - 1.5::DOUBLE * (idx % 3) AS t_end
  FROM seg WHERE idx % 7 <> 6)"""


def wrd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of segments, timed by characters."""
    s = seg(spark, sf_dir).select("file_id", "idx", "seg_start", F.posexplode(F.split("text", " ", -1)).alias("w_pos", "text"))
    by = Window.partitionBy("file_id", "idx").orderBy("w_pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("seg_start") + (F.sum(F.length("text") + 1).over(by)) / F.lit(15.0)
    return s.select("file_id", "idx", "w_pos", (end - (F.length("text") + 1) / F.lit(15.0)).alias("w_start"), end.alias("w_end"), "text")


WRD = """wp AS (SELECT file_id, idx, seg_start, unnest(string_split(text, ' ')) AS text, generate_subscripts(string_split(text, ' '), 1) - 1 AS w_pos FROM seg),
wrd AS (SELECT file_id, idx, w_pos, seg_start + sum(length(text) + 1) OVER w / 15::DOUBLE - (length(text) + 1) / 15::DOUBLE AS w_start, seg_start + sum(length(text) + 1) OVER w / 15::DOUBLE AS w_end, text
  FROM wp WINDOW w AS (PARTITION BY file_id, idx ORDER BY w_pos ROWS UNBOUNDED PRECEDING))"""


def told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with what a recognizer tells of them; every fourth has no words."""
    w = wrd(spark, sf_dir).where("idx % 4 <> 3").withColumn("probability", (F.col("w_pos") % 9 + 1) / F.lit(11.0))
    word = F.struct("w_pos", *[F.col(c).cast("float").alias(k) for c, k in (("w_start", "start"), ("w_end", "end"), ("probability", "probability"))], "text")
    words = w.groupBy("file_id", "idx").agg(F.transform(F.array_sort(F.collect_list(word)), lambda x: F.struct(x["start"], x["end"], x["probability"], x["text"])).alias("words"))
    told = seg(spark, sf_dir).withColumn("avg_logprob", (-(F.col("idx") % 7) / F.lit(9.0)).cast("float")).withColumn("no_speech", ((F.col("file_id") % 5) / F.lit(7.0)).cast("float"))
    return told.join(words, ["file_id", "idx"], "left")


TOLD = """tw AS (SELECT file_id, idx, list({'a': w_start::FLOAT, 'b': w_end::FLOAT, 'p': ((w_pos % 9 + 1) / 11::DOUBLE)::FLOAT, 't': text} ORDER BY w_pos) AS words FROM wrd WHERE idx % 4 <> 3 GROUP BY file_id, idx),
told AS (SELECT seg.*, (-(seg.idx % 7) / 9::DOUBLE)::FLOAT AS avg_logprob, ((seg.file_id % 5) / 7::DOUBLE)::FLOAT AS no_speech, words FROM seg LEFT JOIN tw ON tw.file_id = seg.file_id AND tw.idx = seg.idx)"""


def vp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, file_id, label, gt, centroid, total_dur: mixtures of a label's first vector and the own one."""
    e = table(spark, sf_dir, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("c")).withColumnRenamed("label", "gt")
    k = F.element_at(F.array(*[F.lit(x) for x in (1.0, 0.9, 0.6, 1.3)]), (F.col("vec_id") % 4 + 1).cast("int"))
    m = F.zip_with("c", "embedding", lambda c, x: F.col("k") * c.cast("double") + F.lit(0.5) * x.cast("double"))
    rows = e.withColumn("k", k).join(first, F.col("label") == F.col("gt")).withColumn("m", m)
    rows = rows.withColumn("n", F.sqrt(F.aggregate("m", F.lit(0.0), lambda s, x: s + x * x)))
    return rows.select(F.col("vec_id").alias("id"), F.expr("vec_id div 5").alias("file_id"), F.concat(F.lit("speaker_0"), F.col("vec_id") % 5).alias("label"), "gt", F.transform("m", lambda x: x / F.col("n")).alias("centroid"), (2 + F.col("vec_id") * 7 % 40).cast("double").alias("total_dur"))


VP = """vc AS (SELECT label, arg_min(embedding, vec_id) AS c FROM embeddings GROUP BY label),
vm AS (SELECT vec_id, e.label, [([1.0, 0.9, 0.6, 1.3])[vec_id % 4 + 1]::DOUBLE * c[i]::DOUBLE + 0.5::DOUBLE * embedding[i]::DOUBLE for i in range(1, 65)] AS m FROM embeddings e JOIN vc USING (label)),
vp AS (SELECT vec_id AS id, vec_id // 5 AS file_id, 'speaker_0' || (vec_id % 5) AS label, label AS gt,
  [x / sqrt(list_sum([y * y for y in m])) for x in m] AS centroid, (2 + vec_id * 7 % 40)::DOUBLE AS total_dur FROM vm)"""


def heard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The voices of vp; one in 17 has no vector, as it was too short."""
    return vp(spark, sf_dir).withColumn("centroid", F.when(F.col("id") % 17 != 3, F.col("centroid")))


def voices(spark: SparkSession, sf_dir: str) -> int:
    """Number of vectors; so many identities there are."""
    return table(spark, sf_dir, "embeddings").count()


N = "(SELECT count(*) FROM embeddings)"


def loc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voices with an identity: many have a few, some none; one voice in 11 has none yet."""
    return vp(spark, sf_dir).where("id % 11 <> 0").withColumn("global_id", F.expr("id * id div 3") % voices(spark, sf_dir) + 1)


LOC = f"loc AS (SELECT *, id * id // 3 % {N} + 1 AS global_id FROM vp WHERE id % 11 <> 0)"


def _other(kept: F.Column) -> F.Column:
    """The centroid, or a voice that nobody has."""
    return F.when(kept, F.col("centroid")).otherwise(F.transform("centroid", lambda x, i: F.when(i % 2 == 0, x).otherwise(-x))).alias("centroid")


def gs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An identity for each vector. Of the labels' persons one third is enrolled, if its number divides by 5, and one third has changed its voice."""
    name = F.when(F.col("id") % 4 == 0, F.concat(F.lit("Person "), F.col("id"))).otherwise("")
    rows = vp(spark, sf_dir).select((F.col("id") + 1).alias("id"), "gt", _other(F.col("gt") % 3 != 2))
    return rows.select("id", name.alias("name"), ((F.col("id") % 5 == 0) & (F.col("gt") % 3 == 0)).alias("enrolled"), "centroid")


_OTHER = "[CASE WHEN i % 2 = 1 THEN x ELSE -x END for x, i in centroid]"
GS = f"gs AS (SELECT id + 1 AS id, CASE WHEN (id + 1) % 4 = 0 THEN 'Person ' || (id + 1) ELSE '' END AS name, (id + 1) % 5 = 0 AND gt % 3 = 0 AS enrolled, CASE WHEN gt % 3 <> 2 THEN centroid ELSE {_OTHER} END AS centroid FROM vp)"


def enr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clip for each vector, dealt to the identities whose number divides by 5; those of one third of the labels have the label's voice."""
    many = max(1, voices(spark, sf_dir) // 5)
    return vp(spark, sf_dir).select("id", (5 * (1 + F.col("id") % many)).alias("global_id"), (1 + F.col("id") % 9).cast("double").alias("duration"), _other(F.col("gt") % 3 == 0))


ENR = f"enr AS (SELECT id, 5 * (1 + id % greatest(1, {N} // 5)) AS global_id, (1 + id % 9)::DOUBLE AS duration, CASE WHEN gt % 3 = 0 THEN centroid ELSE {_OTHER} END AS centroid FROM vp)"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, track, size, mtime, status of the store."""
    d = table(spark, sf_dir, "documents")
    status = F.when(F.col("doc_id") % 5 == 0, "pending").when(F.col("doc_id") % 5 == 1, "failed").otherwise("done")
    return d.select(F.concat(F.lit("/in/"), F.col("source"), F.lit("/"), F.col("doc_id"), F.lit(".wav")).alias("path"), F.lit(0).alias("track"), F.col("n_chars").alias("size"), (F.col("doc_id") * 10).cast("double").alias("mtime"), status.alias("status"), "doc_id")


FILES = "fl AS (SELECT '/in/' || source || '/' || doc_id || '.wav' AS path, 0 AS track, n_chars AS size, (doc_id * 10)::DOUBLE AS mtime, CASE doc_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' ELSE 'done' END AS status, doc_id FROM documents)"


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later look at the same files: some changed, some new, some gone."""
    f = files(spark, sf_dir).where("doc_id % 13 <> 0")
    i = F.col("doc_id") % 10
    path = F.when(F.col("doc_id") % 17 == 0, F.concat("path", F.lit(".new"))).otherwise(F.col("path"))
    return f.select(path.alias("path"), "track", (F.col("size") + F.when(i == 3, 1).otherwise(0)).alias("size"), (F.col("mtime") + F.when(i == 4, 0.5).when(i == 5, 1.0).otherwise(0.0)).alias("mtime"))


SCAN = "scan AS (SELECT CASE WHEN doc_id % 17 = 0 THEN path || '.new' ELSE path END AS path, track, size + CASE WHEN doc_id % 10 = 3 THEN 1 ELSE 0 END AS size, mtime + CASE doc_id % 10 WHEN 4 THEN 0.5::DOUBLE WHEN 5 THEN 1::DOUBLE ELSE 0::DOUBLE END AS mtime FROM fl WHERE doc_id % 13 <> 0)"


def display(df: DataFrame) -> DataFrame:
    return df.withColumn("display", display_name(F.col("name"), F.col("id")))
