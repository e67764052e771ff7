from pyspark.sql import functions as F
from voxframe.functions import sql, text, vectors


def test_functions_in_sql(spark):
    assert len(sql.register(spark)) == len(sql.FUNCTIONS)
    one = spark.sql("SELECT cosine(array(3D, 4D), array(4D, 3D)), cosine(array(1D), array(1D, 2D)), cosine(array(), array()), l2_normalise(array(3D, 4D)), l2_normalise(array(0D)), overlap_seconds(0, 5, 3, 9), overlap_seconds(0, 1, 3, 9), display_name('', 7), display_name('Ann', 7)").head()
    assert tuple(one) == (0.96, 0.0, 0.0, [0.6, 0.8], [0.0], 2.0, 0.0, "SPEAKER_0007", "Ann")
    assert [r.start for r in spark.sql("SELECT start FROM split_windows(10, 4, 3)").collect()] == [0, 3, 6]
    assert [r.start for r in spark.sql("SELECT w.start FROM VALUES (3L), (8L) AS t(n), LATERAL split_windows(t.n, 4, 2) w ORDER BY n, start").collect()] == [0, 0, 2, 4]


def test_same_as_the_column_functions(spark):
    sql.register(spark)
    rows = spark.range(400).select((F.col("id") * F.col("id") * 0.3777 - 20).alias("x"))
    got = rows.select(F.expr("fmt_timestamp(x, ',')").alias("a"), text.timestamp(F.col("x"), True).alias("b"), F.expr("fmt_duration(x)").alias("c"), text.duration(F.col("x")).alias("d"))
    assert got.where("a <> b or c <> d").count() == 0
    v = F.array(F.col("x"), F.lit(1.0), F.lit(2.0))
    assert rows.where(F.abs(F.call_function("cosine", v, F.array(F.lit(1.0), F.lit(5.0), F.lit(0.5))) - vectors.cosine(v, F.array(F.lit(1.0), F.lit(5.0), F.lit(0.5)))) > 1e-12).count() == 0
