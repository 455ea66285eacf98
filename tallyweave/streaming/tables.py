"""Tables of a streaming job in shared storage: one folder a micro-batch, and keyed state as a log with compaction.

Folders are written beside and renamed into place, and a batch that runs again finds its folder there and leaves it, so each
batch counts once however often it is tried. Works on any file system that Hadoop's API reaches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def batches(spark: SparkSession, base: str) -> list[int]:
    """Numbers of the published batches of a folder."""
    fs, at = _fs(spark, base)
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n[6:]) for n in names if n.startswith("batch=") and n[6:].lstrip("-").isdigit())


def publish(rows: DataFrame, base: str, batch: int) -> None:
    """Writes rows as batch `batch` of the folder, unless it is there."""
    spark = rows.sparkSession
    fs, final = _fs(spark, f"{base}/batch={batch}")
    if not fs.exists(final):
        beside = f"{base}/_writing/batch={batch}"
        rows.write.mode("overwrite").parquet(beside)
        fs.rename(_fs(spark, beside)[1], final)


def remove(spark: SparkSession, base: str, numbers: Sequence[int]) -> None:
    for n in numbers:
        fs, at = _fs(spark, f"{base}/batch={n}")
        fs.delete(at, True)


def ensure(spark: SparkSession, base: str) -> str:
    fs, at = _fs(spark, base)
    fs.mkdirs(at)
    return base


class KeyedLog:
    """The last row of each key: what batches wrote, newest first by `order`, then by batch.

    A batch appends its own rows only, so it writes as much as it holds. After `every` batches those before the present one
    are merged into a base and removed; the merge leaves out the present batch, which can therefore run again. Files are
    sorted by a hash of the first key, so reading a few keys skips the rest by the files' statistics.
    """

    def __init__(self, base: str, schema: str, keys: Sequence[str], order: str | None = None, every: int = 20, buckets: int = 32):
        self.base, self.schema, self.keys, self.order, self.every, self.buckets = base, schema, list(keys), order, every, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.keys[0]), F.lit(self.buckets)).cast("int").alias("bucket")

    def _write(self, rows: DataFrame, base: str, batch: int) -> None:
        spark = rows.sparkSession
        fs, final = _fs(spark, f"{base}/batch={batch}")
        if not fs.exists(final):
            beside = f"{base}/_writing/batch={batch}"
            rows.withColumn("bucket", self.bucket()).sortWithinPartitions("bucket").write.mode("overwrite").parquet(beside)
            fs.rename(_fs(spark, beside)[1], final)

    def append(self, rows: DataFrame, batch: int) -> None:
        """The batch's rows, the last of each key only."""
        self._write(self._last(rows.withColumn("batch", F.lit(batch))).drop("batch"), f"{self.base}/log", batch)

    def _last(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (*self.keys, "bucket")]
        first = [F.col(self.order)] if self.order else []
        newest = F.max_by(F.struct(*rest), F.struct(*first, F.col("batch"))).alias("r")
        return rows.groupBy(*self.keys).agg(newest).select(*self.keys, *(F.col("r")[c].alias(c) for c in rest))

    def current(self, spark: SparkSession, upto: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
        """The last row of each key after batch `upto` (all), from some buckets only if given."""
        held = [n for n in batches(spark, f"{self.base}/merged") if upto is None or n <= upto]
        low = max(held, default=-(2**31))
        paths = [f"{self.base}/merged/batch={low}"] if held else []
        paths += [f"{self.base}/log/batch={n}" for n in batches(spark, f"{self.base}/log") if n > low and (upto is None or n <= upto)]
        schema = f"{self.schema}, bucket int, batch int"
        if not paths:
            return spark.createDataFrame([], self.schema)
        rows = None
        for p in sorted({x.rsplit("/", 1)[0] for x in paths}):
            part = spark.read.schema(schema).option("basePath", p).parquet(*(x for x in paths if x.rsplit("/", 1)[0] == p))
            rows = part if rows is None else rows.unionByName(part)
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(list(buckets)))
        return self._last(rows).drop("batch")

    def compact(self, spark: SparkSession, batch: int) -> None:
        """Merges all batches before `batch` if they are `every` or more."""
        low = max(batches(spark, f"{self.base}/merged"), default=-(2**31))
        due = [n for n in batches(spark, f"{self.base}/log") if low < n < batch]
        if len(due) >= self.every:
            self._write(self.current(spark, due[-1]), f"{self.base}/merged", due[-1])
        done = max(batches(spark, f"{self.base}/merged"), default=None)
        if done is not None:
            remove(spark, f"{self.base}/log", [n for n in batches(spark, f"{self.base}/log") if n <= done])
            remove(spark, f"{self.base}/merged", [n for n in batches(spark, f"{self.base}/merged") if n < done])
