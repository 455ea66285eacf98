"""What the corpus operators share: reading tables, scratch tables and hashing helpers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder from spark.checkpoint.dir; a folder in the warehouse only where that is unset."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = f"{spark.conf.get('spark.sql.warehouse.dir')}/tallyweave-scratch"
        spark.conf.set("spark.checkpoint.dir", shared)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared)
    return shared


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a lookup table up to which it is broadcast.
SMALL = 100_000


def join_labels(rows: DataFrame, by_label: DataFrame, label: str) -> DataFrame:
    """rows with the columns of by_label, a row for each label; null labels match each other.

    by_label is broadcast where it was counted to have at most SMALL rows; beyond that it is a merge join, whose large
    partitions adaptive execution may split.
    """
    small = stored(by_label.withColumnRenamed(label, "__label"), "labels")
    how = "broadcast" if small.count() <= SMALL else "merge"
    return rows.join(small.hint(how), rows[label].eqNullSafe(small["__label"]), "left").drop("__label")


def unit_hash(*cols: Column) -> Column:
    """A repeatable number in [0, 1) for a row."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def crc_mod(doc_id: Column, m: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % m


def small_batches(spark: SparkSession, mb: int = 8) -> None:
    """Arrow batches of a few MB however long the texts are: bounded memory in Python workers.

    The setting stays with the session, as plans that are returned read it only when they run.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def bit_table(hashes: DataFrame, bits: int = 26) -> np.ndarray:
    """A table of 2 ** bits bits (8 MB for 26, whatever the input) that has the bits of all hashes (one long column)."""
    bits = max(3, bits)
    chunk = 1 << min(20, bits)
    at = hashes.select(F.col(hashes.columns[0]).bitwiseAND(F.lit((1 << bits) - 1)).alias("at")).distinct()

    def fill(group: pa.Table) -> pa.Table:
        marks = np.zeros(chunk, np.uint8)
        marks[group.column("at").to_numpy() % chunk] = 1
        return pa.table({"chunk": group.column("chunk")[:1], "bits": pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros(1 << (bits - 3), np.uint8)
    parts = at.withColumn("chunk", F.floor(F.col("at") / chunk).cast("long")).groupBy("chunk").applyInArrow(fill, "chunk long, bits binary")
    for r in parts.toLocalIterator():
        out[r.chunk * (chunk // 8) : (r.chunk + 1) * (chunk // 8)] = np.frombuffer(r.bits, np.uint8)
    return out


def level_table(levels: DataFrame, slots: int = 24) -> np.ndarray:
    """For rows (key long, level int): a table of 2 ** slots bytes (16 MB for 24, whatever the input) with the highest level
    of the keys of each slot, 0 where there is none."""
    chunk = 1 << min(16, slots)
    key, level = levels.columns
    at = levels.groupBy(F.col(key).bitwiseAND(F.lit((1 << slots) - 1)).alias("at")).agg(F.max(level).alias("level"))

    def fill(group: pa.Table) -> pa.Table:
        out = np.zeros(chunk, np.uint8)
        out[group.column("at").to_numpy() % chunk] = group.column("level").to_numpy()
        return pa.table({"chunk": group.column("chunk")[:1], "levels": pa.array([out.tobytes()], pa.binary())})

    table = np.zeros(1 << slots, np.uint8)
    parts = at.withColumn("chunk", F.floor(F.col("at") / chunk).cast("long")).groupBy("chunk").applyInArrow(fill, "chunk long, levels binary")
    for r in parts.toLocalIterator():
        table[r.chunk * chunk : (r.chunk + 1) * chunk] = np.frombuffer(r.levels, np.uint8)
    return table


def in_table(table_bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash's bit is set: all that went in, and some that share a bit."""
    at = hashes & (len(table_bits) * 8 - 1)
    return (table_bits[at >> 3] >> (at & 7).astype(np.uint8) & 1) == 1


def where_maybe_in(rows: DataFrame, key: Column, table_bits: np.ndarray) -> DataFrame:
    """The rows whose key's hash has its bit in the table: no row that is wanted is missing, some more may come along.

    Spares the shuffle of long rows of which few are wanted; a full table only makes it let more through.
    """
    shared = rows.sparkSession.sparkContext.broadcast(table_bits)  # fixed size
    last = len(rows.columns)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marked = pa.array(in_table(shared.value, b.column(last).to_numpy()))
            yield pa.RecordBatch.from_arrays(b.columns[:last], names=b.schema.names[:last]).filter(marked)

    return rows.withColumn("__hash", F.xxhash64(key)).mapInArrow(keep, rows.schema)


_worker_memos: list[dict] = []


def worker_memo() -> dict:
    """A dictionary that a Python worker keeps between tasks, until another operator needs the memory."""
    memo: dict = {}
    _worker_memos.append(memo)
    return memo


def free_worker_memos() -> None:
    for memo in _worker_memos:
        memo.clear()
