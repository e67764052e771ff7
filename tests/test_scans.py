from itertools import accumulate

import numpy as np
from pyspark.sql import functions as F
from voxframe.operators import scans
from voxframe.streaming import events


def test_running_sums_over_ranges(spark):
    rng = np.random.default_rng(2)
    keys = rng.choice(["hot", "hot", "hot", "a", "b", None], 3000).tolist()
    rows = [(k, int(i), int(x)) for k, i, x in zip(keys, rng.permutation(3000), rng.integers(-5, 9, 3000))]
    df = spark.createDataFrame(rows, "k string, i long, x long").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = scans.running(df, "k", ["i"], {"n": F.lit(1).cast("long"), "s": "x"})
        sizes = [r["count"] for r in got.where("k = 'hot'").groupBy(F.spark_partition_id()).count().collect()]
        found = sorted(((r.k or "", r.i, r.x, r.n, r.s) for r in got.collect()))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = []
    for k in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == k), key=lambda r: r[1])
        want += [(k or "", i, x, n + 1, s) for n, ((_, i, x), s) in enumerate(zip(own, accumulate(r[2] for r in own)))]
    assert found == sorted(want)
    assert len(sizes) > 1
    assert scans.running(df.limit(0), "k", ["i"], {"s": "x"}).count() == 0


def test_lines_of_one_long_source(spark):
    pieces = [("s", k, f"{k} a\nb{k}" if k % 3 else f" {k}") for k in range(500)]
    got = events.joined_lines(spark.createDataFrame(pieces, "source string, n long, text string").repartition(4), "source", "n").orderBy("line").collect()
    want = "".join(p[2] for p in pieces).split("\n")
    assert [(r.line, r.text) for r in got] == [(i, w.strip()) for i, w in enumerate(want) if w.strip()]
    assert [r.line for r in got if r.open] == [len(want) - 1]
