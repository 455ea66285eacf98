"""Vectors as exact integers: what whitening and code compression share.

A component c becomes floor(256 c). Left out are vectors that are null or empty, hold null or non-finite components or ones
of 2 ** 19 and more in size (whose squares no long column can sum), and vectors of another length than the most frequent one
(of two as frequent, the shorter). Repeated rows and null ids stay rows of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256
LARGEST = float(1 << 19)


def in_range(v: Column) -> Column:
    """Whether all components are numbers below LARGEST in size."""
    each = F.forall(v, lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False)))  # NaN is above every number
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(each, F.lit(False))


def integer_vectors(rows: DataFrame, vector_col: str, names: dict[str, str], multiple_of: int = 1) -> tuple[DataFrame, int]:
    """((the columns of names under their new names, x array<int>), length); length 0 and no rows where none is usable.

    multiple_of: only lengths that it divides count.
    """
    v = F.col(vector_col).cast("array<double>")
    kept = rows.where(in_range(v)).select(*(F.col(old).alias(new) for old, new in names.items()), F.transform(v, lambda c: F.floor(c * SCALE).cast("int")).alias("x"))
    sizes = kept.groupBy(F.size("x").alias("n")).count().where(F.col("n") % multiple_of == 0)
    first = sizes.orderBy(F.desc("count"), "n").first()  # a row for each length of vectors
    length = int(first["n"]) if first else 0
    return kept.where(F.size("x") == length), length
