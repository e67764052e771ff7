"""Running sums over the rows of a key in order, with a hot key's rows spread over tasks: sums inside ranges of the order, then what the ranges before have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.workspace import write_table


def running(rows: DataFrame, key: str, order: list[str], sums: dict[str, Column | str]) -> DataFrame:
    """rows with a column for each of sums: its sum over the rows of the key up to this one, by the order, which tells any two rows of a key apart.

    Rows are dealt to ranges of (key, order) and written, so that the ranges stay as they are. A range begins inside one key at most, so what is added to ranges, the
    only table that is broadcast, has a row a range at most.
    """
    ranged = write_table(rows.select("*", *[F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0)).alias(f"_x_{name}") for name, c in sums.items()]).repartitionByRange(key, *order).withColumn("_range", F.spark_partition_id()), "ranged")
    inside = Window.partitionBy("_range", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.select(*rows.columns, "_range", *[F.sum(f"_x_{name}").over(inside).alias(f"_s_{name}") for name in sums])
    totals = ranged.groupBy("_range", key).agg(*[F.sum(f"_x_{name}").alias(f"_t_{name}") for name in sums])
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("_range").alias("_at"), F.col(key).alias("_of"), *[F.sum(f"_t_{name}").over(before).alias(f"_o_{name}") for name in sums])
    first = next(iter(sums))
    offsets = offsets.where(F.col(f"_o_{first}").isNotNull())
    joined = summed.join(F.broadcast(offsets), (F.col("_range") == F.col("_at")) & F.col(key).eqNullSafe(F.col("_of")), "left")
    return joined.select(*rows.columns, *[(F.col(f"_s_{name}") + F.coalesce(f"_o_{name}", F.lit(0))).alias(name) for name in sums])
