"""Order statistics without gathering values: the element at a place of the sorted order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailweave.functions.numbers import order_place
from trailweave.operators.iterate import settled


def at_fractions(df: DataFrame, value: str, places: dict[str, float]) -> DataFrame:
    """One row: for each name the value at its fraction of the order of all non-null values, null without any.

    Values are sorted in ranges, each in a task of its own; the ranges' sizes tell which hold the places.
    """
    ranges = df.where(F.col(value).isNotNull()).select(F.col(value).alias("v")).repartitionByRange(F.col("v")).withColumn("part", F.spark_partition_id())
    ranges = settled(ranges, "ranges")
    # a row for each range
    sizes = ranges.groupBy("part").agg(F.count("*").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    total = ranges.agg(F.count("*").alias("total"))
    ranked = (
        ranges.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy("v")) - 1)
        .join(F.broadcast(sizes), "part")
        .crossJoin(F.broadcast(total))  # one row
        .withColumn("place", F.col("place") + F.col("before"))
    )
    return ranked.agg(*[F.max(F.when(F.col("place") == order_place(F.col("total"), p), F.col("v"))).alias(k) for k, p in places.items()])


def at_fraction_by(df: DataFrame, keys: list[str], value: str, p: float, name: str) -> DataFrame:
    """``keys, name``: of each group the value at a fraction of its order."""
    by = Window.partitionBy(*keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("v"))
    rows = rows.withColumn("place", F.row_number().over(by.orderBy("v")) - 1).withColumn("n", F.count("*").over(by))
    return rows.where(F.col("place") == order_place(F.col("n"), p)).select(*keys, F.col("v").alias(name))
