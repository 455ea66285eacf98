"""Pairs of bit strings that differ in few bits, whatever bits the strings have in common."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.sources.readers import shared_path

#: Rows of a band value up to which all its pairs are compared.
CROWD = 64
LEVELS = 3
_mix = np.uint64(0x9E3779B97F4A7C15)


def deal(bits: np.ndarray, bands: int) -> list[np.ndarray]:
    """The bits dealt out to bands in turn, there and back, so that bands have about as much of each kind."""
    turn = np.concatenate([np.arange(bands), np.arange(bands)[::-1]])
    to = turn[np.arange(len(bits)) % len(turn)]
    return [bits[to == b] for b in range(bands)]


def left_after(order: np.ndarray, path: int, bands: int) -> np.ndarray:
    """The bits outside of the bands of a path, in order. A path lists the bands taken: its digits to the base bands + 1."""
    taken = []
    while path:
        path, band = divmod(path, bands + 1)
        taken.append(band - 1)
    for band in reversed(taken):
        order = order[~np.isin(order, deal(order, bands)[band])]
    return order


def _unpacked(b: pa.RecordBatch, first: int, words: int) -> np.ndarray:
    """(rows, bits) of the word columns from `first` on."""
    longs = np.stack([b.column(first + i).to_numpy() for i in range(words)], axis=1).astype(np.int64)
    return np.unpackbits(np.ascontiguousarray(longs).view(np.uint8), axis=1)


def hamming_pairs(rows: DataFrame, id_col: str, words: Sequence[str], limit: int, crowd: int = CROWD, levels: int = LEVELS) -> DataFrame:
    """(a, b, distance): all pairs of ids a < b whose words (64-bit longs, not null) differ in `limit` bits at most. Ids and
    words don't repeat.

    Bits are dealt into limit + 1 bands by how often they are set over all rows, the most even first, so constant bits spread
    over all bands. Two rows that near agree in a whole band (pigeonhole). A band value that more than `crowd` rows have is
    not compared as it is: the bits outside the band are dealt into limit + 1 bands again, of which such a pair agrees in
    one, and so on for a few levels. What is still crowded then is compared as a whole, so no pair is lost.
    """
    spark, bands, n_words = rows.sparkSession, limit + 1, len(words)
    n_bits = 64 * n_words
    rows = rows.select(F.col(id_col).alias("id"), *words)
    kind = rows.schema["id"].dataType.simpleString()
    fields = ", ".join(f"{w} long" for w in words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_bits + 1, np.int64)
        for b in batches:
            total += np.append(_unpacked(b, 0, n_words).sum(axis=0, dtype=np.int64), b.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_bits + 1)), pa.array(total)], names=["bit", "ones"])

    ones = np.zeros(n_bits + 1)
    for r in rows.select(*words).mapInArrow(count, "bit long, ones long").groupBy("bit").agg(F.sum("ones").alias("ones")).collect():  # a row a bit
        ones[r["bit"]] = r["ones"]
    share = ones[:-1] / max(1, ones[-1])
    order = np.argsort(-np.minimum(share, 1 - share), kind="stable")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, path, id, words) with one band more, from rows with the path so far."""
        for b in batches:
            keys, paths, bits = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy(), _unpacked(b, 3, n_words)
            for path in np.unique(paths):
                at = np.flatnonzero(paths == path)
                for band, mine in enumerate(deal(left_after(order, int(path), bands), bands)):
                    packed = np.packbits(bits[np.ix_(at, mine)], axis=1)
                    key = keys[at] ^ np.uint64(band + 1)
                    for i in range(packed.shape[1]):
                        key = (key ^ packed[:, i]) * _mix
                        key ^= key >> np.uint64(29)
                    pick = pa.array(at)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), pa.array(np.full(len(at), int(path) * (bands + 1) + band + 1)), *(b.column(i).take(pick) for i in range(2, b.num_columns))], names=["key", "path", "id", *words]
                    )

    def kept(df: DataFrame, name: str) -> DataFrame:
        path = shared_path(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    def met(filed: DataFrame) -> DataFrame:
        """Pairs of rows of one band value that are near enough."""
        one = filed.select("key", "path", F.col("id").alias("a"), *words)
        two = filed.select("key", "path", F.col("id").alias("b"), *(F.col(w).alias(f"{w}_2") for w in words))
        each = [F.bit_count(F.col(w).bitwiseXOR(F.col(f"{w}_2"))) for w in words]
        distance = sum(each[1:], each[0])
        return one.join(two.hint("merge"), ["key", "path"]).where((F.col("a") < F.col("b")) & (distance <= limit)).select("a", "b", distance.alias("distance"))

    schema = f"key long, path long, id {kind}, {fields}"
    todo, pairs = rows.select(F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("path"), "id", *words), None
    for level in range(levels):
        filed = kept(todo.mapInArrow(split, schema), "bands")
        sizes = kept(filed.groupBy("key", "path").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "band-sizes")
        last = level == levels - 1 or n_bits - (level + 1) * -(-n_bits // bands) < 2 * bands
        few = sizes if last else sizes.where(F.col("n") <= crowd)
        part = met(filed.join(few.hint("merge"), ["key", "path"], "left_semi"))
        pairs = part if pairs is None else pairs.unionByName(part)
        many = sizes.where(F.col("n") > crowd)
        if last or many.isEmpty():
            break
        todo = filed.join(many.hint("merge"), ["key", "path"], "left_semi").select("key", "path", "id", *words)
    return pairs.distinct()
