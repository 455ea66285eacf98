"""Exact dedup by a Golomb-coded fingerprint exchange.

1. Each task (sender) sorts the 48-bit fingerprints of its texts, deals them to owners by range and sends every owner
   one Golomb-coded list; texts that repeat inside a sender are marked there.
2. Each owner decodes its lists and returns to every sender a bitmap of the fingerprints that others sent as well.
3. Senders' marked fingerprints become one bit table of fixed size (filter_bits); a second scan sets aside the rows
   whose bit is set. Only these suspects are shuffled, grouped by their bytes (not by a digest), and labelled.
   A false suspect forms a group of one, so the size of the bit table changes the cost but never the result (beyond some
   60 million texts that repeat, all rows are suspects, and the job is a plain shuffle of all texts by their digest).

Texts are equal when identical after lower-casing A-Z only; null counts as empty. Of equal texts the largest doc_id
stays. Rows that repeat a doc_id count in group_size; inside a group kept is decided by doc_id alone, so repeats of the
row that stays are all marked kept (drop_exact_duplicates keeps one of them, of each text). A null doc_id stays only in a group without any
other id. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm.common import bit_table, free_worker_memos, in_table, small_batches, stored, table

FINGERPRINT_BITS = 48
#: Fingerprints a sender holds before it sends: bounds a task's memory.
SENDER_ROWS = 1_000_000
#: Fingerprints of an owner, on average: bounds the memory of its task, so owners grow with the rows.
OWNER_ROWS = 1_000_000
#: Bits of the suspects' table, 8 MB as broadcast.
FILTER_BITS = 26


def golomb_encode(values: np.ndarray, width: int) -> tuple[int, bytes]:
    """Sorted distinct integers in [0, width) -> (k, code): gaps as unary quotients, then k-bit remainders."""
    n = len(values)
    gaps = np.diff(values, prepend=0).astype(np.uint64)
    k = max(0, int(np.log2(max(1.0, 0.69 * width / n))))
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.ones(int(quotients.sum()) + n, np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 0
    low = (gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)
    return k, np.packbits(unary).tobytes() + np.packbits(low.astype(np.uint8)).tobytes()


def golomb_decode(n: int, k: int, code: bytes) -> np.ndarray:
    data = np.frombuffer(code, np.uint8)
    low_bytes = (n * k + 7) // 8
    unary = np.unpackbits(data[: len(data) - low_bytes])
    ends = np.flatnonzero(unary == 0)[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    low = np.unpackbits(data[len(data) - low_bytes :], count=n * k).reshape(n, k).astype(np.uint64) if k else np.zeros((n, 0), np.uint64)
    low = (low << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum((quotients.astype(np.uint64) << np.uint64(k)) + low)


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _sha(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def _fingerprint(sha: Column) -> Column:
    return F.conv(F.substring(sha, 1, FINGERPRINT_BITS // 4), 16, 10).cast("long")


def send_fingerprints(fingerprints: DataFrame, owners: int) -> DataFrame:
    """(sender, owner, n, k, code, own): one Golomb-coded list for each sender and owner; own marks repeats inside."""
    width = -(-(1 << FINGERPRINT_BITS) // owners)

    def lists(sender: int, parts: list[np.ndarray]) -> pa.RecordBatch:
        values, times = np.unique(np.concatenate(parts), return_counts=True)
        owner = values // width
        cuts = np.append(np.flatnonzero(np.diff(owner, prepend=-1)), len(values))
        rows = {c: [] for c in ("sender", "owner", "n", "k", "code", "own")}
        for a, b in zip(cuts[:-1], cuts[1:]):
            k, code = golomb_encode(values[a:b] - owner[a] * width, width)
            for c, x in zip(rows, (sender, int(owner[a]), b - a, k, code, np.packbits(times[a:b] > 1, bitorder="little").tobytes())):
                rows[c].append(x)
        types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), types)], names=list(rows))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker_memos()
        parts, held, sent = [], 0, 0
        task = TaskContext.get().partitionId() << 24
        for b in batches:
            parts.append(b.column(0).to_numpy())
            held += b.num_rows
            if held >= SENDER_ROWS:
                yield lists(task + sent, parts)
                parts, held, sent = [], 0, sent + 1
        if held:
            yield lists(task + sent, parts)

    return fingerprints.mapInArrow(send, "sender long, owner int, n int, k int, code binary, own binary")


def answer_bitmaps(messages: DataFrame) -> DataFrame:
    """(sender, owner, others): for every list, a bitmap of its entries that other senders sent too."""

    def answer(group: pa.Table) -> pa.Table:
        lists = [golomb_decode(*x) for x in zip(*(group.column(c).to_pylist() for c in ("n", "k", "code")))]
        values, inverse, times = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        shared = (times > 1)[inverse]
        maps = [np.packbits(x, bitorder="little").tobytes() for x in np.split(shared, np.cumsum([len(x) for x in lists])[:-1])]
        return pa.table({"sender": group.column("sender"), "owner": group.column("owner"), "others": pa.array(maps, pa.binary())})

    return messages.groupBy("owner").applyInArrow(answer, "sender long, owner int, others binary")


def suspect_filter(messages: DataFrame, owners: int, filter_bits: int) -> np.ndarray:
    """The bit table of all fingerprints that occur more than once; 2 ** filter_bits bits whatever the input."""
    width = -(-(1 << FINGERPRINT_BITS) // owners)

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for owner, n, k, code, own, others in zip(*(c.to_pylist() for c in b.columns)):
                marked = np.unpackbits(np.frombuffer(own, np.uint8) | np.frombuffer(others, np.uint8), count=n, bitorder="little")
                values = golomb_decode(n, k, code)[marked == 1].astype(np.int64) + owner * width
                if len(values):
                    yield pa.RecordBatch.from_arrays([pa.array(values, pa.int64())], names=["fp"])

    answered = messages.join(answer_bitmaps(messages).hint("merge"), ["sender", "owner"])
    return bit_table(answered.select("owner", "n", "k", "code", "own", "others").mapInArrow(suspects, "fp long"), filter_bits)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row for each row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // OWNER_ROWS))
    text = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), _sha(text).alias("sha"))
    rows = rows.withColumn("fp", _fingerprint(F.col("sha")))
    messages = stored(send_fingerprints(rows.select("fp"), owners), "fingerprints")
    marks = spark.sparkContext.broadcast(suspect_filter(messages, owners, filter_bits))

    def set_aside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marked = pa.array(in_table(marks.value, b.column(3).to_numpy()))
            texts = pc.if_else(marked, b.column(1), pa.scalar(None, b.column(1).type))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), texts], names=["doc_id", "sha", "text"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    aside = stored(rows.mapInArrow(set_aside, f"doc_id {kind}, sha string, text string"), "suspects")
    single = aside.where(F.col("text").isNull()).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha")
    suspects = aside.where(F.col("text").isNotNull())
    groups = suspects.groupBy("sha", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = stored(groups, "groups")  # read back, so that both sides of the join are shuffled and a hot text can be split
    same = suspects.join(groups.hint("merge"), ["sha", "text"]).select("doc_id", "keep_id", "group_size", "sha")
    return single.unionByName(same).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """docs without the rows that are copies of another: one row of every group of equal texts, its columns as they were."""
    kept = exact_duplicates(docs).where("kept").groupBy(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__kept_sha")).agg(F.count(F.lit(1)).alias("__times"))
    rows = docs.withColumn("__sha", _sha(normalised(F.col("text"))))
    left = rows.join(kept.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__sha") == F.col("__kept_sha")))
    once = left.where("__times = 1").select(docs.columns)
    return once.unionByName(left.where("__times > 1").dropDuplicates(["doc_id", "__sha"]).select(docs.columns))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP3_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT doc_id, norm, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
