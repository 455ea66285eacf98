"""Substring dedup by content-defined chunks with a gear rolling hash.

A word is a run of bytes other than white space. The gear hash of the bytes up to a word's end is rolled over the text; of
every `span` successive words the one with the least hash ends a chunk. So cuts depend on a few bytes around them, chunks
vary in length up to `span` words, and an insertion moves the cuts near it only.

1. Of documents with equal texts only the earliest (smallest doc_id) goes through steps 2 and 3. The others have its sources,
   and itself where it is the source of any of its windows.
2. Chunks are deduplicated by digest: digests that several texts have go to a bit table of fixed size (filter_bits).
   A false bit costs work only.
3. A window is `min_words` successive words. `span` is so short that every window holds at least one whole chunk whose cuts
   its own words decide, whatever stands around it. A window with such a chunk that one document alone has cannot repeat.
   The other windows are keyed by the hash of all their bytes; the earliest document of each key (smallest doc_id) is its
   source and holds the whole window; later documents with the key are held against it.
4. The common windows of such a pair are checked byte by byte and extended in both directions to the whole common passage.

So every window that an earlier document holds is inside a passage of the result, however short or long its words are, and
also where still earlier documents hold parts of it.

Offsets count bytes of the UTF-8 text; passages begin and end at character boundaries. Null and empty texts have none, nor
do rows with null doc_ids. Rows that repeat a doc_id are one document; of its different texts the one that sorts last
counts. Repeats inside one document are not reported. No rows give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm.common import bit_table, in_table, small_batches, stored, table, where_maybe_in

MIN_WORDS = 50
#: Bits of the table of shared chunks, 32 MB as broadcast.
FILTER_BITS = 28
#: The gear hash reaches over so many bytes, and so over half as many words at most.
REACH = 8
#: Stands among the window keys of a text for all its windows that cannot repeat.
OWN = -1

_gear = np.random.RandomState(20240501).randint(0, 2**16, 256).astype(np.uint16)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of gear[data[i - j]] << 2 j over the last 8 bytes, mod 2 ** 16: the rolling hash, in three doublings."""
    h = _gear[data]
    for step in (1, 2, 4):
        h[step:] = h[step:] + (h[:-step] << np.uint16(2 * step))
    return h


def chunk_span(min_words: int) -> int:
    """Most words of a chunk, so that any min_words words hold a whole chunk whose cuts they decide."""
    return max(1, (min_words - 2) // 4)


_values = np.random.RandomState(20240502).randint(0, 2**63, 256).astype(np.uint64)
_BASE = 0x9E3779B97F4A7C15
_is_space = np.zeros(256, bool)
_is_space[list(b" \t\n\r\f\v")] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


class Words:
    """The words of a text, its chunks, and hashes of runs of words with the white space between."""

    def __init__(self, data: np.ndarray):
        self.data = data
        word = np.concatenate([[False], ~_is_space[data], [False]])
        self.starts = np.flatnonzero(word[1:] & ~word[:-1])[: len(data)]
        self.ends = np.flatnonzero(word[:-1] & ~word[1:])
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_values[data] * _powers(_BASE, len(data)))])
        self.inverse = _powers(pow(_BASE, -1, 1 << 64), len(data))[self.starts]

    def _hash(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hashes of the bytes from the start of the words `first` to the end of the words `last`."""
        x = (self.sums[self.ends[last]] - self.sums[self.starts[first]]) * self.inverse[first]
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (x ^ (x >> np.uint64(29))).view(np.int64)

    def hashes(self, run: int) -> np.ndarray:
        """The hash of each run of so many words, in order."""
        first = np.arange(max(0, len(self.starts) - run + 1))
        return self._hash(first, first + run - 1)

    def cuts(self, span: int) -> np.ndarray:
        """The words that end a chunk: of every span successive words the one with the least gear hash, the last of equal ones."""
        n = len(self.starts)
        if n < span:
            return np.zeros(0, np.int64)
        key = gear_hashes(self.data)[self.ends - 1].astype(np.int64) << 32 | (0xFFFFFFFF - np.arange(n))
        return np.unique(0xFFFFFFFF - (_window_min(key, span) & 0xFFFFFFFF))

    def chunks(self, span: int) -> np.ndarray:
        """Digests of the chunks between successive cuts."""
        cuts = self.cuts(span)
        return self._hash(cuts[:-1] + 1, cuts[1:])

    def may_repeat(self, min_words: int, shared: np.ndarray) -> np.ndarray:
        """For each window, whether all chunks whose cuts it decides are in the bit table."""
        span = chunk_span(min_words)
        start = np.arange(max(0, len(self.starts) - min_words + 1))
        cuts = self.cuts(span)
        alone = np.concatenate([np.zeros(1, np.int64), np.cumsum(~in_table(shared, self.chunks(span)))])
        first = np.searchsorted(cuts, start + REACH // 2 + span - 1)
        last = np.searchsorted(cuts, start + min_words - span, "right") - 1
        return (last <= first) | (alone[np.maximum(last, 0)] == alone[np.minimum(first, len(alone) - 1)])


def _window_min(x: np.ndarray, n: int) -> np.ndarray:
    """Least of x[i : i + n] for each i where there are n."""
    out, have = x, 1
    while have < n:
        step = min(have, n - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def _first_of_equal_texts(rows: DataFrame, filter_bits: int) -> tuple[DataFrame, DataFrame]:
    """Of rows (id, text): those (id, text) whose text no smaller id has, and the others as (id, first), first the least id.

    Only texts whose digest may repeat are shuffled: others are told by a bit table of fixed size.
    """
    rows = rows.withColumn("digest", F.sha2("text", 256))
    groups = rows.groupBy("digest").agg(F.min("id").alias("source"), F.max("id").alias("last")).where("source < last").select("digest", "source")
    groups = stored(groups, "equal")  # so that the join of a text that very many documents have can be split
    marks = bit_table(groups.select(F.xxhash64("digest")), filter_bits)
    maybe = where_maybe_in(rows, F.col("digest"), marks)
    maybe = stored(maybe.join(groups.hint("merge"), "digest", "left").select("id", "text", "source"), "maybe-equal")
    alone = where_maybe_in(rows, F.col("digest"), ~marks).select("id", "text")
    first = maybe.where("source is null or id = source").select("id", "text")
    return alone.union(first), maybe.where("id > source").select("id", F.col("source").alias("first"))


def _keyed(docs: DataFrame, keys) -> DataFrame:
    """(h, id): the distinct keys of each text of docs (id, text); keys: Words -> hashes."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.unique(keys(Words(np.frombuffer(text.encode(), np.uint8)))) for text in b.column(1).to_pylist()]
            which = np.repeat(np.arange(len(found)), [len(x) for x in found])
            if len(which):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), b.column(0).take(pa.array(which))], names=["h", "id"])

    return docs.select("id", "text").mapInArrow(key, f"h long, id {docs.schema['id'].dataType.simpleString()}")


_space = re.compile(rb"\s+")


def _common_length(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning."""
    n, i, step = min(len(a), len(b)), 0, 256
    while i < n:
        differ = np.flatnonzero(a[i : min(n, i + step)] != b[i : min(n, i + step)])
        if len(differ):
            return i + int(differ[0])
        i, step = i + step, step * 2
    return n


def common_passages(later: bytes, earlier: bytes, min_words: int) -> list[tuple[int, int, int, int]]:
    """(start, size, words, start in earlier) of passages of later that are in earlier; they cover all common windows."""
    a, b = np.frombuffer(later, np.uint8), np.frombuffer(earlier, np.uint8)
    own, other = Words(a), Words(b)
    keys, first = np.unique(other.hashes(min_words), return_index=True)
    wanted = own.hashes(min_words)
    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    out, done = [], -1
    for i in np.flatnonzero(keys[at] == wanted).tolist() if len(keys) else []:
        x, end = int(own.starts[i]), int(own.ends[i + min_words - 1])
        y = int(other.starts[first[at[i]]])
        if end <= done or later[x:end] != earlier[y : y + end - x]:
            continue
        start, end = x - _common_length(a[:x][::-1], b[:y][::-1]), x + _common_length(a[x:], b[y:])
        while later[start] & 0xC0 == 0x80:
            start += 1
        while end < len(later) and later[end] & 0xC0 == 0x80:
            end -= 1
        done = end
        out.append((start, end - start, len(_space.split(later[start:end].strip())), start + y - x))
    return out


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", filter_bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, start, size, words, source_id, source_start): every passage that repeats one of an earlier document."""
    small_batches(docs.sparkSession)
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    firsts, copies = _first_of_equal_texts(rows, filter_bits)
    chunks = _keyed(firsts, lambda w: w.chunks(chunk_span(min_words))).groupBy("h").count().where("count > 1")
    shared = docs.sparkSession.sparkContext.broadcast(bit_table(chunks.select("h"), filter_bits))  # fixed size

    def window_keys(words: Words) -> np.ndarray:
        may = words.may_repeat(min_words, shared.value)
        found = words.hashes(min_words)[may]
        return found if may.all() else np.append(found, OWN)

    # Stored, so that both sides of a join are shuffled and a window or text that very many documents hold can be split.
    windows = stored(_keyed(firsts, window_keys), "windows")
    sources = windows.where(F.col("h") != OWN).groupBy("h").agg(F.min("id").alias("source"), F.max("id").alias("last"))
    sources = stored(sources, "sources")
    repeats = windows.join(sources.where("source < last").select("h", "source").hint("merge"), "h").where("id > source")
    of_firsts = stored(repeats.select("id", "source").distinct(), "first-pairs")
    owners = stored(windows.where(F.col("h") == OWN).select("id").union(sources.select("source")).distinct(), "owners")
    of_copies = copies.join(of_firsts.select(F.col("id").alias("first"), "source").hint("merge"), "first").select("id", "source")
    firsts_as_sources = copies.join(owners.select(F.col("id").alias("first")).hint("merge"), "first", "left_semi").select("id", F.col("first").alias("source"))
    pairs = stored(of_firsts.union(of_copies).union(firsts_as_sources).distinct(), "pairs")

    ids = pairs.select(F.xxhash64("id")).union(pairs.select(F.xxhash64("source")))
    texts = where_maybe_in(rows, F.col("id"), bit_table(ids))
    texts = stored(texts.groupBy("id").agg(F.max("text").alias("text")), "texts")
    both = pairs.join(texts.withColumnRenamed("text", "later").hint("merge"), "id")
    both = both.join(texts.select(F.col("id").alias("source"), F.col("text").alias("earlier")).hint("merge"), "source")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            which, found = [], []
            for i, (later, earlier) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                for passage in common_passages(later.encode(), earlier.encode(), min_words):
                    which.append(i)
                    found.append(passage)
            pick = pa.array(which, pa.int64())
            numbers = [pa.array([f[c] for f in found], pa.int64()) for c in range(4)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pick), *numbers[:3], b.column(1).take(pick), numbers[3]], names=["doc_id", "start", "size", "words", "source_id", "source_start"]
            )

    both = both.select("id", "source", "later", "earlier")
    found = both.mapInArrow(check, f"doc_id {kind}, start long, size long, words long, source_id {kind}, source_start long")
    return found.distinct()


def remove_repeated_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(doc_id, text): the texts without the passages found in them."""
    small_batches(docs.sparkSession)
    spans = passages.groupBy("doc_id").agg(F.collect_list(F.struct("start", "size")).alias("spans"))  # within one document
    rows = docs.select("doc_id", "text").join(spans.withColumnRenamed("doc_id", "__id").hint("merge"), F.col("doc_id") == F.col("__id"), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for text, starts, sizes in zip(*(b.column(c).to_pylist() for c in (1, 2, 3))):
                if text is not None and starts:
                    data = text.encode()
                    keep = np.ones(len(data), bool)
                    for start, size in zip(starts, sizes):
                        keep[start : start + size] = False
                    text = np.frombuffer(data, np.uint8)[keep].tobytes().decode(errors="ignore")
                texts.append(text)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    rows = rows.select("doc_id", "text", F.col("spans.start").alias("starts"), F.col("spans.size").alias("sizes"))
    return rows.mapInArrow(cut, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
