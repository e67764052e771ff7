import os
import subprocess
import sys
import zlib

import __spark_entry__
import corpus_pipeline as p
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from voxframe.llm import decontaminate, queries, toxicity
from voxframe.workspace import write_table


def test_stages_one_after_another(spark, sf):
    docs = queries.table(spark, sf, "documents")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in p.STAGES[:-1]:
        before = docs
        docs = write_table(stage(spark, before, sf), name)
        assert docs.columns == columns
        counts.append(docs.count())
        kept, was = ({r.doc_id for r in x.select("doc_id").collect()} for x in (docs, before))
        assert kept <= was
        if name == "simhash_near_dedup":
            assert docs.count() == len(kept) < len(was)
        if name == "benchmark_decontamination":
            assert not any(r.contaminated for r in decontaminate.digest(decontaminate.locate(docs, queries.table(spark, sf, "benchmark"))).collect())
    t = Tokenizer.from_file(queries.TOKENIZER)
    want, start = [], 0
    for r in docs.orderBy("doc_id").collect():
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = sorted(tuple(r) for r in p.run(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == want


def test_toxic_documents_go(spark, sf):
    docs, labels = queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels")
    model = toxicity.fit(docs, labels)
    high = {r.doc_id for r in toxicity.score(docs, model).where(F.col("_vx_score") >= queries.TOXIC_FROM).collect()}
    left = {r.doc_id for r in p.drop_toxic(spark, docs, sf).collect()}
    assert left == {r.doc_id for r in docs.collect()} - high


def test_empty_documents(spark, sf):
    docs = queries.table(spark, sf, "documents").limit(0)
    for name, stage in p.STAGES:
        assert stage(spark, docs, sf).count() == 0, name


@pytest.mark.parametrize("n", range(1, 11))
def test_registered(n):
    assert sum(name.startswith(f"op{n}_") for name in __spark_entry__.queries()) == 1
    assert "pipeline" in __spark_entry__.queries()


def test_odd_rows_stage_by_stage(spark, sf):
    """Nulls in any column, repeated rows and columns with the operators' own names: each stage gives the same rows as without those columns, with them."""
    odd = [(None, "lost words of no one", None, None, None), (-1, None, "en", "web", 3), (-2, "", None, None, 0), (-2, "", None, None, 0), (-3, "solo", "en", "web", 4), (-3, "solo", "en", "web", 4), (-4, "w " * 30_000, "de", "new", None)]
    plain = queries.table(spark, sf, "documents").limit(60)
    plain = plain.unionByName(spark.createDataFrame(odd, plain.schema))
    wide = plain.select("*", *[F.lit(k).alias(k) for k in ("fp", "node", "key", "start", "end", "size", "target", "label", "y", "doc", "at", "file", "n", "first", "a b", "c.d")])
    for name, stage in p.STAGES:
        small, large = stage(spark, plain, sf), stage(spark, wide, sf)
        if name != "token_output":
            assert large.columns == wide.columns and small.columns == plain.columns
            large = write_table(large.drop("a b", "c.d"), name).select(*plain.columns)
        got, want = (sorted(map(tuple, x.collect()), key=repr) for x in (large, small))
        assert got == want and len(got) > 0, name
        if name == "simhash_near_dedup":
            assert sum(r[0] == -3 for r in got) == 1 and sum(r[1] in (None, "") for r in got) == 1


def test_a_missing_library_is_not_passed_over(tmp_path):
    (tmp_path / "xxhash.py").write_text("raise ModuleNotFoundError('none', name='xxhash')")
    root = os.path.dirname(os.path.abspath(p.__file__))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=root, env={**os.environ, "PYTHONPATH": f"{tmp_path}{os.pathsep}{root}"}, capture_output=True, text=True)
    assert said.returncode != 0 and "xxhash" in said.stderr
