"""The corpus pipeline: STAGES applied one after another to the documents, each written as Parquet and reread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.llm import decontaminate, mixing, simhash, tokens, toxicity
from voxframe.llm.queries import TOKENIZER, TOXIC_FROM, table
from voxframe.workspace import new_path, write_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, trained on the labels of docs, scores below TOXIC_FROM."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(F.col("_vx_score") < TOXIC_FROM).drop("_vx_score")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id; of repeated rows of it, one."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a window of a benchmark item."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them."""
    rows = docs.withColumn("_vx_size", mixing.word_count())
    sizes = write_table(rows.select("doc_id", "source", "_vx_size"), "sizes")
    taken = mixing.mix(rows, sizes)
    # outer, so that no filter on the copies is pushed below the join, where sizes and ranks would be worked out once more
    copies = F.explode_outer(F.when(F.col("_vx_copies") > 0, F.sequence(F.lit(1).cast("long"), F.col("_vx_copies"))))
    return taken.withColumn("_vx_copy", copies).where("_vx_copy is not null").select(*[F.col(f"`{c}`") for c in docs.columns])


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the mix, read back from the files."""
    return tokens.read(spark, tokens.write(docs, new_path(spark, "tokens"), TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("mix_sources", mix_sources),
    ("token_output", write_tokens),
]

#: A trained classifier and rANS files can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = write_table(docs, name)
    return docs
