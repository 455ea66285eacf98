"""Line dedup by pairwise alignment.

1. Lines are compared without case and outer white space; blank lines take no part. From each line on, the fewest adjoining
   lines with at least `min_words` words together are a window; a block to delete holds at least one whole window. Each
   document is paired with the earliest and with the nearest earlier document that holds one of its windows, however many
   do. A partner holds the whole window, and pairs grow with the lines, not with the square of a window's holders.
2. Each pair is aligned by patience diff: lines that are unique in both and keep their order are the anchors; between
   them equal beginnings, equal ends and further unique lines are matched.
3. Blocks of adjoining matched lines with at least `min_words` words together are deleted from the later document, the one
   with the larger doc_id (ties: the larger hash of the text).

Null text gives null with no lines. Rows with null doc_ids are returned as they are. Rows that agree in doc_id and text are
one document, each row with the same result. No rows give no rows.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm.common import small_batches, stored, table

MIN_WORDS = 5


def patience_matches(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched places (i, j) of the patience diff, in order."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, k, j, m = todo.pop()
        while i < k and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < k and j < m and a[k - 1] == b[m - 1]:
            k, m = k - 1, m - 1
            out.append((k, m))
        if i == k or j == m:
            continue
        in_a, in_b = Counter(a[i:k]), Counter(b[j:m])
        place = {x: at for at, x in enumerate(a[i:k], i) if in_a[x] == 1 and in_b.get(x) == 1}
        unique = [(place[x], at) for at, x in enumerate(b[j:m], j) if x in place]
        tails: list[int] = []  # longest rising run of places in a, by patience sorting
        ends: list[int] = []
        back: list[int] = []
        for n, (x, _) in enumerate(unique):
            p = bisect_left(tails, x)
            back.append(ends[p - 1] if p else -1)
            tails[p : p + 1] = [x]
            ends[p : p + 1] = [n]
        n, anchors = (ends[-1] if ends else -1), []
        while n >= 0:
            anchors.append(unique[n])
            n = back[n]
        for x, y in anchors:  # from the last to the first
            out.append((x, y))
            todo.append((x + 1, k, y + 1, m))
            k, m = x, y
        if anchors:
            todo.append((i, k, j, m))
    return sorted(out)


def common_blocks(a: list[int], b: list[int], words: list[int], min_words: int) -> list[int]:
    """The places in b of aligned blocks that hold at least min_words words."""
    out: list[int] = []
    block: list[int] = []
    last = (-2, -2)
    for i, j in [*patience_matches(a, b), (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if sum(words[x] for x in block) >= min_words:
                out += block
            block = []
        block.append(j)
        last = (i, j)
    return out


def line_windows(lines: list[int], words: list[int], min_words: int) -> list[int]:
    """Distinct hashes of the windows: from each line on, the fewest adjoining lines with at least min_words words."""
    out: set[int] = set()
    end, total = 0, 0
    for start, n in enumerate(words):
        while end < len(words) and (end <= start or total < min_words):
            total += words[end]
            end += 1
        if total < min_words:
            break
        part = lines[start:end]
        out.add(part[0] if len(part) == 1 else xxhash.xxh3_64_intdigest(array("q", part).tobytes()) - (1 << 63))
        total -= n
    return sorted(out)


def _bare(line: Column) -> Column:
    """The line without white space of any kind on its outer sides."""
    return F.regexp_replace(line, r"^\s+|\s+$", "")


def _line_hash(line: Column, salt: str) -> Column:
    return F.xxhash64(F.lower(line), F.lit(salt))


def nearest_earlier(held: DataFrame) -> DataFrame:
    """(k, e): for each row of held (line, k), distinct, the largest k below it with the same line, if any.

    All rows are put in one order, in ranges of even size, so a line that very many documents hold is spread over ranges;
    each range looks back within itself, and the seams between ranges are closed from each one's ends (a row a range).
    """
    kind = held.schema["k"].dataType.simpleString()

    def look_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: list[pa.Array] = []
        for b in batches:
            if not b.num_rows:
                continue
            lines, ks = (pa.concat_arrays([*before[i : i + 1], b.column(i)]) for i in (0, 1))
            at = np.arange(b.num_rows) + len(lines) - b.num_rows - 1  # the place before each row, -1 at the start of a range
            values = lines.to_numpy()
            same = (at >= 0) & (values[np.maximum(at, 0)] == b.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns, ks.take(pa.array(at, mask=~same))], names=["line", "k", "part", "e"])
            before = [lines.slice(len(lines) - 1), ks.slice(len(ks) - 1)]

    ranges = held.repartitionByRange("line", "k").sortWithinPartitions("line", "k").select("line", "k", F.spark_partition_id().alias("part"))
    rows = stored(ranges.mapInArrow(look_back, f"line long, k {kind}, part int, e {kind}"), "neighbours")
    ends = rows.groupBy("part").agg(F.min(F.struct("line", "k")).alias("low"), F.max(F.struct("line", "k")).alias("high")).orderBy("part").collect()  # a row a range
    seams = [(b.low.k, a.high.k) for a, b in zip(ends, ends[1:]) if a.high.line == b.low.line]
    closed = held.sparkSession.createDataFrame(seams, f"k {kind}, e {kind}")
    return rows.where("e IS NOT NULL").select("k", "e").unionByName(closed)


def deleted_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(k, places): k is (doc_id, hash of the text), places the numbers of the lines to delete, from 0."""
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("k"), F.split("text", "\n").alias("lines"))
    lines = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("at"), _bare(x).alias("line"))), lambda s: s["line"] != "")
    rows = rows.withColumn("lines", lines).where(F.size("lines") > 0).select(
        "k",
        F.transform("lines", lambda s: s["at"]).alias("at"),
        F.transform("lines", lambda s: F.size(F.split(s["line"], r"\s+"))).alias("words"),
        F.transform("lines", lambda s: _line_hash(s["line"], "find")).alias("find"),
        F.transform("lines", lambda s: _line_hash(s["line"], "align")).alias("align"),  # with the other hash, 128 bits
    )
    rows = stored(rows.dropDuplicates(["k"]), "lines")
    key = rows.schema["k"].dataType.simpleString()

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [line_windows(find, words, min_words) for words, find in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["k", "windows"])

    held = rows.select("k", "words", "find").mapInArrow(windows, f"k {key}, windows array<long>").select("k", F.explode("windows").alias("line"))
    held = stored(held, "line-windows")
    # Stored, so that both sides of the join are shuffled and a window that very many documents hold can be split.
    per = stored(held.groupBy("line").agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "holders")
    shared = stored(held.join(per.hint("merge"), "line"), "shared-lines")
    earliest = shared.where(F.col("k") != F.col("first")).select("k", F.col("first").alias("e"))
    pairs = stored(earliest.unionByName(nearest_earlier(shared.select("line", "k"))).distinct(), "pairs")

    needed = rows.select(F.col("k").alias("e"), F.col("align").alias("a"))
    both = pairs.join(rows.select("k", "at", "words", F.col("align").alias("b")).hint("merge"), "k").join(needed.hint("merge"), "e")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = []
            for at, words, b, a in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                places.append([at[j] for j in common_blocks(a, b, words, min_words)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(places, pa.list_(pa.int32()))], names=["k", "places"])

    found = both.select("k", "at", "words", "b", "a").mapInArrow(align, f"k {key}, places array<int>").where(F.size("places") > 0)
    # A document's pairs are at most twice its lines.
    return stored(found.groupBy("k").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places")), "deleted")


def remove_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text, n_lines, deleted): the text without the lines deleted, and their numbers, from 0."""
    small_batches(docs.sparkSession)
    gone = deleted_lines(docs.select("doc_id", "text"), min_words)
    rows = docs.select("doc_id", "text", F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", F.xxhash64("text").alias("h"))).alias("k"))
    rows = rows.join(gone.hint("merge"), "k", "left")
    places = F.coalesce("places", F.expr("cast(array() as array<int>)"))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n")))
    rows = rows.select("doc_id", "text", n.alias("n_lines"), places.alias("deleted"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, gone in enumerate(batch.column(3).to_pylist()):
                if gone:
                    left = set(gone)
                    texts[i] = "\n".join(line for at, line in enumerate(texts[i].split("\n")) if at not in left)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), *batch.columns[2:]], names=batch.schema.names)

    return rows.mapInArrow(cut, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string, n_lines int, deleted array<int>")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeated_lines(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("deleted").cast("long").alias("n_deleted"), "deleted", F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256")
    )
