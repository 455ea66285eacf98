"""Exact quantiles without bringing a group's values together."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.sources.readers import shared_path


def between(n: Column, q: float) -> Column:
    """Place q (n - 1), which may lie between two values."""
    return F.lit(float(q)) * (n - 1)


def index(n: Column, q: float) -> Column:
    """Place floor(n q), the last value at most: always a value that occurs."""
    return F.least(F.floor(n * F.lit(float(q))), n - 1).cast("double")


def exact_quantiles(rows: DataFrame, key: str, value: str, at: Sequence[float], place: Callable[[Column, float], Column] = between) -> DataFrame:
    """(key, p): for each key its values' quantiles at each place, between neighbours in proportion; nulls and NaN left out.

    `place` gives the place in the sorted values, from 0, of a quantile of n values.

    Values are counted, then dealt out in ranges of the whole order (key, value), so a key with very many values lies over
    many ranges. Each range's count tells which ranges hold the wanted places, and only those are read again, each summed
    up within itself. Keys are not null.
    """
    spark = rows.sparkSession
    v = F.col(value).cast("double")
    counted = rows.select(F.col(key).alias("key"), v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v")).groupBy("key", "v").agg(F.count(F.lit(1)).alias("k"))
    path = shared_path(spark, "ranges")
    ranges = counted.repartitionByRange("key", "v").withColumn("part", F.spark_partition_id())
    ranges.write.parquet(path)
    ranges = spark.read.schema(ranges.schema).parquet(path)

    own = Window.partitionBy("key")  # a row for each range that holds the key
    held = ranges.groupBy("key", "part").agg(F.sum("k").alias("in_part")).withColumn("n", F.sum("in_part").over(own))
    held = held.withColumn("before", F.sum("in_part").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("in_part"))
    places = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), place(F.col("n"), q).alias("r")) for i, q in enumerate(at)))).alias("w")
    wanted = held.select("key", "part", "before", "in_part", places).select("key", "part", "before", "in_part", "w.i", "w.r")
    inside = lambda r: (F.col("before") <= r) & (r < F.col("before") + F.col("in_part"))
    low, high = F.floor("r"), F.ceil("r")
    wanted = wanted.where(inside(low) | inside(high))

    up = Window.partitionBy("key", "part").orderBy("v")  # one range of one key
    needed = ranges.join(wanted.select("key", "part").distinct().hint("merge"), ["key", "part"], "left_semi").withColumn("upto", F.sum("k").over(up.rowsBetween(Window.unboundedPreceding, 0)))
    met = needed.join(wanted.hint("merge"), ["key", "part"])
    here = lambda r: (F.col("before") + F.col("upto") - F.col("k") <= r) & (r < F.col("before") + F.col("upto"))
    found = met.groupBy("key", "i", "r").agg(F.max(F.when(here(low), F.col("v"))).alias("a"), F.max(F.when(here(high), F.col("v"))).alias("b"))
    x = F.col("a") + (F.col("b") - F.col("a")) * (F.col("r") - low)
    each = found.groupBy("key").agg(*(F.max(F.when(F.col("i") == i, x)).alias(f"q{i}") for i in range(len(at))))
    return each.select(F.col("key").alias(key), F.array(*(F.col(f"q{i}") for i in range(len(at)))).alias("p"))
