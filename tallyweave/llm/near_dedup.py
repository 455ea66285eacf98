"""Near-dedup with Order MinHash sketches and banded alignment.

Words are the lower-cased runs of letters and digits. Two texts are linked if their word sequences are at least 0.8 alike:
m / (a + b - m), where m words can be matched in order between a and b words (one word in ten exchanged gives 0.82).
Matching is exact in a band around the diagonal that holds every alignment good enough. Texts whose five-word shingles are
0.8 alike in this sense are always 0.8 alike by words.

1. Copies with equal word sequences are one text from here on; its row with the smallest doc_id stands for it.
2. Order MinHash on shingles of five words (a text of fewer words is one shingle): each of `SKETCHES` hash functions picks
   the least occurrence-labelled shingles of a text and lists them in text order; the list is a bucket's key. Loose keys
   list two: texts whose shingles are j alike share one of 28 with probability 1 - (1 - j ** 2) ** 28, 0.995 where every
   tenth word was exchanged. As few shingles of a short text outlive an edit, texts of up to SHORT words have 12 keys of four
   single words besides: where one word in ten was exchanged two such texts share one with probability 0.997 and more, from
   ten words on. Strict keys list three: texts with shingles 0.8 alike miss all 20 of them below one in a million.
3. A bucket compares its texts with two of them only, its first and one drawn by a hash (stars). Linked texts become
   classes; a crowd whose members are alike only in part meets many drawn texts over its buckets. Then, of strict buckets
   that still hold several classes, all texts outside the largest class are compared with the texts of other classes,
   unless prefix and position filters on the shingles (exact bounds, rare shingles first) show that their shingles are
   not 0.8 alike. So every pair of a strict bucket with shingles 0.8 alike is in one class, and texts that merely have a
   common passage are not paired.
4. Classes are the connected components of all links, found by joins with alternating star contractions.

A class id is the smallest doc_id of the class (the doc_id itself for a text without links). Null and empty texts have no
words and form no links, nor do rows with null doc_ids; their class is their own doc_id. A doc_id that repeats is one
document; if its rows have different texts that no other doc_id has, one of them is compared. Long texts are compared as a
whole; an alignment's memory is bounded by its band. No rows give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm.common import bit_table, free_worker_memos, level_table, small_batches, stored, table, where_maybe_in

SHINGLE = 5
SIMILARITY = 0.8
SKETCHES = 28
LOOSE = 2
#: The first so many functions give strict keys as well.
STRICT_SKETCHES = 20
STRICT = 3

#: Texts of at most so many words have keys of single words too: enough that of a pair with a text of 40 words both have them.
SHORT = 50
SHORT_SKETCHES = 12
SHORT_PICK = 4

_word = re.compile(r"[^\W_]+")
_mix = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    return _word.findall(text.lower()) if text else []


def hashed(w: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))


def shingles(h: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of a word sequence's shingles in order, from the words' hashes; empty if it has no word."""
    if not len(h):
        return np.empty(0, np.uint64)
    h = h.astype(np.uint64)
    n = max(1, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(k, len(h))):
        out = (out ^ h[i : i + n]) * _mix
        out ^= out >> np.uint64(32)
    return out


def occurrences(s: np.ndarray) -> np.ndarray:
    """For each place, how many equal shingles come before it."""
    order = np.argsort(s, kind="stable")
    t = s[order]
    start = np.maximum.accumulate(np.where(np.append(True, t[1:] != t[:-1]), np.arange(len(t)), 0))
    out = np.empty(len(s), np.uint64)
    out[order] = np.arange(len(t)) - start
    return out


def _least(s: np.ndarray, salts: np.ndarray, take: int) -> np.ndarray:
    """For each salted hash function, the places of the least occurrence-labelled elements of s, from the least on."""
    labelled = (s ^ (occurrences(s) + np.uint64(1)) * _mix) * np.uint64(0xBF58476D1CE4E5B9)
    labelled ^= labelled >> np.uint64(29)
    least, take = [], min(take, len(s))
    step = max(1, (1 << 20) // len(s))  # functions at a time: bounded memory for long texts
    for a in range(0, len(salts), step):
        h = (labelled[None, :] ^ salts[a : a + step, None]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        at = np.argpartition(h, take - 1, axis=1)[:, :take]
        least.append(np.take_along_axis(at, np.argsort(np.take_along_axis(h, at, 1), axis=1), 1))
    return np.concatenate(least)


def _keys(s: np.ndarray, at: np.ndarray, salts: np.ndarray, strict: int) -> np.ndarray:
    """The elements at the places of each function, hashed in text order."""
    picked, out = s[np.sort(at, axis=1)], salts[: len(at)].copy()
    for i in range(at.shape[1]):
        out = (out ^ picked[:, i]) * _mix
        out ^= out >> np.uint64(31)
    return out & ~np.uint64(1) | np.uint64(strict)


def order_sketches(s: np.ndarray) -> np.ndarray:
    """Keys of the Order MinHash: for each function, the least labelled shingles, hashed in text order. Strict keys are odd."""
    salts = np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x94D049BB133111EB)
    at = _least(s, salts, STRICT)
    return np.concatenate([_keys(s, at[:, :LOOSE], salts, 0), _keys(s, at[:STRICT_SKETCHES], salts, 1)])


def short_sketches(h: np.ndarray) -> np.ndarray:
    """More loose keys of a short text: Order MinHash of single words, from their hashes."""
    salts = np.arange(1, SHORT_SKETCHES + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)
    return _keys(h, _least(h, salts, SHORT_PICK), salts, 0)


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    """How many words two sequences have in common, in any order."""
    a, b = np.sort(a), np.sort(b)
    times = np.searchsorted(b, a, "right") - np.searchsorted(b, a, "left")
    return int((np.arange(len(a)) - np.searchsorted(a, a, "left") < times).sum())


#: Places of a word that are looked up one by one; words with more keep a bit mask of the band.
FEW = 64


def aligned(a: np.ndarray, b: np.ndarray, threshold: float = SIMILARITY) -> float:
    """Similarity of two word sequences, 0 if it is under the threshold.

    Bit-parallel longest common subsequence inside the band |i - j| <= width, which holds every alignment that reaches
    the threshold. A bit of `row` is 0 where the count of matches grows; only places inside the band are held.
    """
    if len(a) > len(b):
        a, b = b, a
    n, m = len(a), len(b)
    need = int(np.ceil(threshold * (n + m) / (1 + threshold) - 1e-9))
    if n == 0 or n < need or _overlap(a, b) < need:
        return 0.0
    start = int(np.argmin(np.append(a == b[:n], False)))  # equal beginnings and ends are matched as they are
    end = int(np.argmin(np.append(a[start:][::-1] == b[start:][::-1][: n - start], False)))
    x, y = a[start : n - end], b[start : m - end]
    width = m - need + 1
    by_word = np.argsort(y, kind="stable")
    first, last = (np.searchsorted(y[by_word], x, side).tolist() for side in ("left", "right"))
    places = by_word.tolist()
    masks: dict[int, list[int]] = {}  # of frequent words: the column of bit 0, the bits, the next place to come
    matched, low = start + end, 0
    high = min(len(y), width + 1)
    row = (1 << high) - 1
    for i in range(len(x)):
        new_low, new_high = max(0, i - width), min(len(y), i + width + 1)
        if new_low > low:  # columns leave the band on the left: count what they hold
            gone = new_low - low
            matched += gone - (row & ((1 << gone) - 1)).bit_count()
            row >>= gone
            low = new_low
        if new_high > high:
            row |= ((1 << (new_high - high)) - 1) << (high - low)
            high = new_high
        f, e, hit = first[i], last[i], 0
        if e - f <= FEW:
            for p in places[f:e]:
                if low <= p < high:
                    hit |= 1 << (p - low)
        else:
            mask = masks.setdefault(f, [low, 0, f])
            hit, p = mask[1] >> (low - mask[0]), mask[2]
            while p < e and places[p] < high:
                if places[p] >= low:
                    hit |= 1 << (places[p] - low)
                p += 1
            masks[f] = [low, hit, p]
        hit &= row
        if hit:
            row = ((row + hit) | (row - hit)) & ((1 << (high - low)) - 1)
    matched += (high - low) - row.bit_count() if len(x) else 0
    similarity = matched / (n + m - matched)
    return similarity if similarity >= threshold - 1e-12 else 0.0


def _sketched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, copy, n, keys) of the rows that can have links; copy is a digest of the word sequence, n its words."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker_memos()
        for b in batches:
            at, copies, ns, keys = [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                w = words(text)
                if w:
                    at.append(i)
                    copies.append(xxhash.xxh3_128_hexdigest(" ".join(w)))
                    ns.append(len(w))
                    h = hashed(w)
                    sketches = order_sketches(shingles(h))
                    keys.append((np.concatenate([sketches, short_sketches(h)]) if len(w) <= SHORT else sketches).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), pa.array(copies, pa.string()), pa.array(ns, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=["id", "copy", "n", "keys"],
            )

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(sketch, f"id {rows.schema['id'].dataType.simpleString()}, copy string, n long, keys array<long>")


def _arrays(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, words): the 32-bit hashes of a doc_id's words as bytes; of several texts under one doc_id the one that sorts last."""

    def to_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [hashed(words(t)).astype(np.uint32).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], names=["id", "words"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(to_bytes, f"id {rows.schema['id'].dataType.simpleString()}, words binary")


def _labelled(data: bytes) -> np.ndarray:
    """The occurrence-labelled shingles of a text's words."""
    s = shingles(np.frombuffer(data, np.uint32))
    return ((s ^ (occurrences(s) + np.uint64(1)) * _mix) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def _elements(rows: DataFrame) -> DataFrame:
    """(e, minority): every labelled shingle of the texts of rows (id, minority, words)."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for minority, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                e = _labelled(data)
                yield pa.RecordBatch.from_arrays([pa.array(e), pa.array(np.full(len(e), minority))], names=["e", "minority"])

    return rows.select("id", "minority", "words").mapInArrow(explode, "e long, minority boolean")


def _prefix_pairs(pool: DataFrame, arrays: DataFrame) -> DataFrame:
    """(a, b): all pairs of a minority text and another class's text whose shingles could be 0.8 alike, by prefix and
    position filters.

    All shingles are put in one order: those that propose no pair first (in one text only, or in no minority text), then by
    frequency class (powers of two; a table of fixed size, where shingles that share a slot share the higher class), so that
    shingles of a passage that many texts share come last. Such texts have a shingle in common among the first
    n - ceil(0.8 n) + 1, and at the first common one enough shingles are still to come in both. The filters lose no link.
    """
    kind = pool.schema["id"].dataType.simpleString()
    rows = stored(pool.join(arrays.hint("merge"), "id").select("id", "minority", "words", "root"), "pool-words")
    times = _elements(rows).groupBy("e").agg(F.count(F.lit(1)).alias("times"), F.max("minority").alias("m")).where("times > 1 AND m")
    classes = rows.sparkSession.sparkContext.broadcast(level_table(times.select("e", F.ceil(F.log2("times")).cast("int").alias("level"))))  # fixed size

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = classes.value
        for b in batches:
            for i, data in enumerate(b.column(2).to_pylist()):
                e = _labelled(data)
                level = table[e & (len(table) - 1)]
                order = np.lexsort((e, level))[: len(e) - int(np.ceil(SIMILARITY * len(e) - 1e-9)) + 1]
                pos = np.flatnonzero(level[order])
                same = b.slice(i, 1).select(["id", "minority", "root"]).columns
                at = pa.array(np.zeros(len(pos), np.int64))
                columns = [pa.array(e[order[pos]]), pa.array(np.full(len(pos), len(e))), pa.array(pos + 1), *(c.take(at) for c in same)]
                yield pa.RecordBatch.from_arrays(columns, names=["e", "n", "pos", "id", "minority", "root"])

    prefixes = stored(rows.mapInArrow(prefix, f"e long, n long, pos long, id {kind}, minority boolean, root {kind}"), "prefixes")
    x = prefixes.where("minority").select("e", F.col("id").alias("x"), "n", "pos", F.col("root").alias("rx"))
    y = prefixes.select("e", F.col("id").alias("y"), F.col("n").alias("m"), F.col("pos").alias("at"), F.col("root").alias("ry"))
    enough = 1 + F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("at")) >= F.ceil(SIMILARITY / (1 + SIMILARITY) * (F.col("n") + F.col("m")) - 1e-9)
    pairs = x.join(y.hint("merge"), "e").where((F.col("rx") != F.col("ry")) & _alike("n", "m") & enough)
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _verified(pairs: DataFrame, arrays: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are linked; a is the side that may be in very many pairs."""
    kind = pairs.schema["a"].dataType.simpleString()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            good = [aligned(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) > 0 for x, y in zip(left, right)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    one = arrays.select(F.col("id").alias("b"), F.col("words").alias("sb"))
    two = arrays.select(F.col("id").alias("a"), F.col("words").alias("sa"))
    both = pairs.join(one.hint("merge"), "b").join(two.hint("merge"), "a").select("a", "b", "sa", "sb")
    return both.mapInArrow(verify, f"a {kind}, b {kind}")


def components(links: DataFrame) -> DataFrame:
    """(id, root) for links (a, b): the smallest id of each connected component, by alternating star contractions.

    Each round is two joins by key and halves chains; its result is stored, and it ends when nothing changes. The nodes'
    smallest neighbours are stored too, so that the links of a node with very many can be split over tasks.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: all larger neighbours of a node are hung on its smallest neighbour or itself.
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")), "least")
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: all smaller neighbours of a node, and the node, are hung on the smallest of them.
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = stored(small.unionByName(small_least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        after = new.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        edges = new
        if after == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        before = after


def _alike(n: str, m: str) -> Column:
    """Whether two lengths allow a link: no more can match than the shorter has."""
    return F.least(n, m) >= F.lit(SIMILARITY - 1e-9) * F.greatest(n, m)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id), a row for each doc_id."""
    small_batches(docs.sparkSession)
    sketched = stored(_sketched(docs, id_col, text_col), "sketches")
    heads = stored(sketched.groupBy("copy").agg(F.min(F.struct("id", "n", "keys")).alias("h")).select("copy", "h.*"), "heads")
    member = stored(sketched.select("id", "copy").distinct().join(heads.select("copy", F.col("id").alias("head")).hint("merge"), "copy").select("id", "head"), "members")

    filed = heads.select(F.explode(F.array_distinct("keys")).alias("key"), "id", "n")
    text = F.struct("id", "n")
    pivots = F.array(F.min(text), F.min_by(text, F.xxhash64("key", "id"))).alias("pivots")
    # Stored, so that both sides of the next join are shuffled and a bucket that very many texts share can be split.
    shared = stored(filed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), pivots).where("size > 1"), "shared-keys")
    rows = stored(filed.join(shared.hint("merge"), "key").drop("size"), "buckets")
    needed = rows.select(F.col("id").alias("needed")).distinct()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = where_maybe_in(texts, F.col("id"), bit_table(needed.select(F.xxhash64("needed"))))
    arrays = stored(_arrays(texts.groupBy("id").agg(F.max("text").alias("text")), "id", "text"), "arrays")

    star = rows.select("id", "n", F.explode("pivots").alias("p")).where((F.col("id") != F.col("p.id")) & _alike("n", "p.n"))
    star = star.select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b"))
    star = stored(star.distinct(), "pairs")
    links = stored(_verified(star, arrays), "links")
    roots = components(links)

    # Strict buckets with several classes: their texts outside the largest class against all such buckets' texts.
    strict = rows.where(F.col("key").bitwiseAND(F.lit(1)) == 1).select("key", "id")
    rooted = strict.join(roots.hint("merge"), "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    per = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("times"))
    largest = stored(per.groupBy("key").agg(F.max(F.struct("times", "root")).alias("top"), F.count(F.lit(1)).alias("classes")).where("classes > 1"), "mixed-keys")
    mixed = rooted.join(largest.select("key", F.col("top.root").alias("top")).hint("merge"), "key")
    pool = stored(mixed.groupBy("id").agg(F.min("root").alias("root"), F.max(F.col("root") != F.col("top")).alias("minority")), "pool")
    rest = stored(_prefix_pairs(pool, arrays).join(star.hint("merge"), ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        links = stored(links.unionByName(_verified(rest, arrays)), "links")
    roots = components(links.unionByName(member.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b"))))

    ids = docs.select(F.col(id_col).alias("doc_id")).distinct()
    out = ids.join(roots.withColumnRenamed("id", "doc_id").hint("merge"), "doc_id", "left")
    return out.select("doc_id", F.coalesce("root", "doc_id").alias("class_id"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one document of each class, the one with the smallest doc_id, its columns as they were; rows without
    doc_id stay."""
    classes = near_duplicates(docs)
    gone = classes.where("class_id <> doc_id").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone.hint("merge"), F.col("doc_id") == F.col("__gone"), "left_anti").select(docs.columns)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
