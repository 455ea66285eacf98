"""Running values over the order of a key's rows, where one key may have more rows than a task can take.

Rows are dealt out in ranges of the whole order (keys, order) and written; a key with very many rows lies over many ranges.
Each range of a key is summed up in one row, these few rows are accumulated, and a window then runs inside a range only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.sources.readers import shared_path


def in_ranges(rows: DataFrame, by: Sequence[str], ranges: int | None = None) -> DataFrame:
    """The rows with `part`, the number of their range in the order of these columns; equal rows share a range."""
    dealt = rows.repartitionByRange(*([ranges] if ranges else []), *by).withColumn("part", F.spark_partition_id())
    path = shared_path(rows.sparkSession, "ranges")
    dealt.write.parquet(path)
    return rows.sparkSession.read.schema(dealt.schema).parquet(path)


def before(rows: DataFrame, keys: Sequence[str], order: Sequence[str], **want: tuple[str, Column | str]) -> DataFrame:
    """rows (from in_ranges by keys and order) with a column for each wanted (kind, value): over the key's earlier rows alone.

    Kinds: sum (0 without values), min, max (null without values), last (the latest value that isn't null). Rows with a null
    key have no row in the result; (keys, order) should be unique, else the order of equal rows is open.
    """
    value = {k: F.col(v) if isinstance(v, str) else v for k, (_, v) in want.items()}
    kind = {k: how for k, (how, _) in want.items()}
    rows = rows.select("*", *(value[k].alias(f"__{k}") for k in want))
    over = {"sum": F.sum, "min": F.min, "max": F.max, "last": lambda x: F.last(x, ignorenulls=True)}
    whole = over | {"last": lambda x: F.max_by(x, F.when(F.col(x).isNotNull(), F.struct(*order)))}
    joint = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "min": F.least, "max": F.greatest, "last": lambda a, b: F.coalesce(b, a)}

    lower = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range that holds the key
    held = rows.groupBy(*keys, "part").agg(*(whole[kind[k]](f"__{k}").alias(f"__{k}") for k in want))
    held = held.select(*keys, "part", *(over[kind[k]](f"__{k}").over(lower).alias(f"__low_{k}") for k in want))
    inside = Window.partitionBy(*keys, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    met = rows.join(held.hint("merge"), [*keys, "part"])
    met = met.select("*", *(joint[kind[k]](F.col(f"__low_{k}"), over[kind[k]](f"__{k}").over(inside)).alias(k) for k in want))
    return met.drop(*(f"__{k}" for k in want), *(f"__low_{k}" for k in want))
