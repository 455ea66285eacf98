"""Vector code compression: product codes trained and assigned over Hilbert-sorted flat blocks.

Vectors of integers (`vectors`) are cut into `PARTS` equal parts, each with a codebook of at most `ENTRIES` entries that
start as the parts of the vectors with the smallest ids (of rows that repeat an id, the lesser vector first; null ids last).
The vectors are packed into chunks; within a chunk every part's points are sorted along a Hilbert curve and cut into flat
blocks of `BLOCK` points, each stored with its min/max box and its sum. A round reads the chunks once: from the box it
bounds the distance of every entry to any point of a block; entries whose least distance exceeds the smallest of the
largest ones can't be nearest to any point and are out. A block with one entry left adds its stored sum and is done;
otherwise a small exact integer kernel compares its points with the shortlist. All arithmetic is on whole numbers, ties go to
the lower entry, and entries without parts stay as they are, so results are the same for any layout of the rows.

Only codebooks and a sum for each entry pass the driver (parts x entries x dimensions, whatever the input). Nothing is
grouped by vector, so repeated vectors make no large group; labels are summed with partial sums first.

Rows left out are those of `vectors`, and vectors whose length PARTS doesn't divide. Repeated rows get a row each. Fewer
vectors than entries make smaller codebooks. Without usable vectors there are no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm.common import join_labels, small_batches, stored, table
from tallyweave.llm.vectors import integer_vectors

PARTS = 16
ENTRIES = 64
ROUNDS = 2
BLOCK = 32
#: Components of a chunk: 8,192 vectors of 64 dimensions.
CHUNK = 1 << 19


def hilbert_order(points: np.ndarray) -> np.ndarray:
    """The order of integer points (n, dimensions) along a Hilbert curve (Skilling's transform of the axes).

    Coordinates keep as many high bits as fit 63 bits together; points that agree in them stay in their order.
    """
    low = points.min(axis=0)
    x = (points - low)[:, :63].astype(np.int64)
    dims = x.shape[1]
    have = max(1, int(x.max()).bit_length())
    bits = min(have, 63 // dims)
    x >>= have - bits
    top = 1 << (bits - 1)
    q = top
    while q > 1:  # undo the excess rotations
        p = q - 1
        for i in range(dims):
            turn = (x[:, i] & q) > 0
            swap = np.where(turn, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(turn, p, swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, dims):  # Gray code
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = top
    while q > 1:
        t ^= np.where((x[:, dims - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return np.argsort(key, kind="stable")


def _packed(x: np.ndarray, parts: int) -> tuple[bytes, ...]:
    """(points, order, low, high, sums) of one chunk of vectors (n, length), by part and block."""
    n, width = len(x), x.shape[1] // parts
    starts = np.arange(0, n, BLOCK)
    points, order, low, high, sums = [], [], [], [], []
    for p in range(parts):
        part = x[:, p * width : (p + 1) * width]
        at = hilbert_order(part)
        part = part[at]
        points.append(part), order.append(at)
        low.append(np.minimum.reduceat(part, starts)), high.append(np.maximum.reduceat(part, starts)), sums.append(np.add.reduceat(part.astype(np.int64), starts))
    as_int = lambda a: np.stack(a).astype(np.int32).tobytes()
    return as_int(points), as_int(order), as_int(low), as_int(high), np.stack(sums).tobytes()


def pack_blocks(vectors: DataFrame, length: int, parts: int = PARTS) -> DataFrame:
    """Chunks of vectors (id, label, x) as rows: ids, labels, and for each part the sorted points, boxes and sums of blocks."""
    most = max(BLOCK, CHUNK // length)
    id_type, label_type = (vectors.schema[c].dataType.simpleString() for c in ("id", "label"))
    names = ["ids", "labels", "points", "place", "low", "high", "sums"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            x = np.asarray(t.column("x").combine_chunks().flatten()).reshape(-1, length)
            lists = [pa.ListArray.from_arrays([0, len(x)], t.column(c).combine_chunks()) for c in ("id", "label")]
            return pa.RecordBatch.from_arrays([*lists, *(pa.array([b], pa.binary()) for b in _packed(x, parts))], names=names)

        held, n = [], 0
        for b in batches:
            while b.num_rows:
                piece = b.slice(0, most - n)
                held.append(piece)
                n, b = n + piece.num_rows, b.slice(piece.num_rows)
                if n == most:
                    yield row(held)
                    held, n = [], 0
        if n:
            yield row(held)

    return vectors.select("id", "label", "x").mapInArrow(pack, f"ids array<{id_type}>, labels array<{label_type}>, points binary, place binary, low binary, high binary, sums binary")


def _chunk(b: pa.RecordBatch, i: int, parts: int, width: int) -> tuple[np.ndarray, ...]:
    read = lambda c, kind: np.frombuffer(b.column(c)[i].as_py(), kind)
    return (
        read("points", np.int32).reshape(parts, -1, width).astype(np.int64), read("place", np.int32).reshape(parts, -1),
        read("low", np.int32).reshape(parts, -1, width).astype(np.int64), read("high", np.int32).reshape(parts, -1, width).astype(np.int64), read("sums", np.int64).reshape(parts, -1, width),
    )


def shortlists(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> np.ndarray:
    """(blocks, entries): whether an entry may be nearest to a point in the block's box."""
    under, over = low[:, None, :] - book[None], book[None] - high[:, None, :]
    least = (np.maximum(np.maximum(under, over), 0) ** 2).sum(2)
    largest = (np.maximum(np.abs(under), np.abs(over)) ** 2).sum(2)
    return least <= largest.min(axis=1, keepdims=True)


def _nearest(points: np.ndarray, some: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) for each point of a block, from its shortlist in rising order."""
    d = ((points[:, None, :] - book[some][None]) ** 2).sum(2)
    best = d.argmin(axis=1)  # the first of equal ones
    return some[best], d[np.arange(len(d)), best]


def _sums(chunks: DataFrame, books: np.ndarray) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """For each part and entry with parts nearest to it: their number and sum."""
    parts, entries, width = books.shape
    shared = chunks.sparkSession.sparkContext.broadcast(books)  # fixed size

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for b in batches:
            for i in range(b.num_rows):
                points, _, low, high, sums = _chunk(b, i, parts, width)
                for p, book in enumerate(shared.value):
                    for k, mask in enumerate(shortlists(low[p], high[p], book)):
                        block, some = points[p, k * BLOCK : (k + 1) * BLOCK], np.flatnonzero(mask)
                        if len(some) == 1:
                            n[p, some[0]] += len(block)
                            total[p, some[0]] += sums[p, k]
                        else:
                            entry, _ = _nearest(block, some, book)
                            np.add.at(n[p], entry, 1)
                            np.add.at(total[p], entry, block)
        p, e = np.nonzero(n)
        dims = np.arange(width)
        for a, z in zip(p, e):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(width, v)) for v in (a, e.dtype.type(z))] + [pa.array(dims), pa.array(np.full(width, n[a, z])), pa.array(total[a, z])], names=["part", "entry", "dim", "n", "s"])

    rows = chunks.select("points", "place", "low", "high", "sums").mapInArrow(add, "part long, entry long, dim long, n long, s long")
    out: dict[tuple[int, int], tuple[int, list[int]]] = {}
    for r in rows.groupBy("part", "entry", "dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():  # parts x entries x dimensions of a part
        out.setdefault((r.part, r.entry), (r.n, [0] * width))[1][r.dim] = r.s
    return out


def train(vectors: DataFrame, chunks: DataFrame, length: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, length / parts) of whole numbers."""
    first = vectors.orderBy(F.asc_nulls_last("id"), "x").limit(entries).select("x").collect()
    books = np.array([r.x for r in first], np.int64).reshape(len(first), parts, length // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        for (p, e), (n, s) in _sums(chunks, books).items():
            books[p, e] = [v // n for v in s]
    return books


def assign(chunks: DataFrame, books: np.ndarray) -> DataFrame:
    """(id, label, code, error) of every packed vector."""
    parts, _, width = books.shape
    shared = chunks.sparkSession.sparkContext.broadcast(books)  # fixed size
    id_type, label_type = (chunks.schema[c].dataType.elementType.simpleString() for c in ("ids", "labels"))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                points, place, low, high, _ = _chunk(b, i, parts, width)
                codes, error = np.empty((points.shape[1], parts), np.uint8), np.zeros(points.shape[1], np.int64)
                for p, book in enumerate(shared.value):
                    for k, mask in enumerate(shortlists(low[p], high[p], book)):
                        at = place[p, k * BLOCK : (k + 1) * BLOCK]
                        codes[at, p], d = _nearest(points[p, k * BLOCK : (k + 1) * BLOCK], np.flatnonzero(mask), book)
                        error[at] += d
                text = codes.tobytes().hex()
                texts = [text[a : a + 2 * parts] for a in range(0, len(text), 2 * parts)]
                yield pa.RecordBatch.from_arrays([b.column("ids")[i].values, b.column("labels")[i].values, pa.array(texts, pa.string()), pa.array(error)], names=["id", "label", "code", "error"])

    return chunks.mapInArrow(code, f"id {id_type}, label {label_type}, code string, error long")


def codebooks_digest(books: np.ndarray) -> str:
    """sha256 of all components as decimal numbers by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """((id, label, code, error) of every usable row, codebooks). entries: at most 256."""
    small_batches(rows.sparkSession)
    vectors, length = integer_vectors(rows, vector_col, {id_col: "id", label_col: "label"}, parts)
    if not length:
        return vectors.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).limit(0), np.zeros((parts, 0, 1), np.int64)
    chunks = stored(pack_blocks(vectors, length, parts), "vector-blocks")
    books = train(vectors, chunks, length, parts, entries, rounds)
    return assign(chunks, books), books


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(table(spark, sf_dir, "embeddings"))
    codes = stored(codes, "vector-codes")
    totals = codes.groupBy("label").agg(F.sum("error").alias("label_error"))
    found = join_labels(codes, totals, "label")
    return found.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """The contract's steps as DuckDB SQL, for vectors of 64 dimensions and ids that don't repeat."""
    def distance(c: str) -> str:
        return " + ".join(f"(p.v[{i}] - {c}.v[{i}]) * (p.v[{i}] - {c}.v[{i}])" for i in range(1, 5))

    def nearest(c: str) -> str:
        return f"SELECT p.vec_id, p.part, p.v, arg_min({c}.entry, ({distance(c)}) * 64 + {c}.entry) AS entry, min({distance(c)}) AS d FROM p JOIN {c} ON p.part = {c}.part GROUP BY ALL"

    def moved(a: str, c: str) -> str:
        means = ", ".join(f"CAST(floor(sum(v[{i}]) / count(*)) AS BIGINT)" for i in range(1, 5))
        return f"SELECT {c}.part, {c}.entry, coalesce(m.v, {c}.v) AS v FROM {c} LEFT JOIN (SELECT part, entry, [{means}] AS v FROM {a} GROUP BY part, entry) m ON {c}.part = m.part AND {c}.entry = m.entry"

    return f"""WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
p AS (SELECT vec_id, t.part, list_slice(x, t.part * 4 + 1, t.part * 4 + 4) AS v FROM k, range(16) t(part)),
first_ids AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k ORDER BY vec_id LIMIT 64),
c0 AS (SELECT part, entry, v FROM p JOIN first_ids USING (vec_id)), a0 AS ({nearest("c0")}), c1 AS ({moved("a0", "c0")}), a1 AS ({nearest("c1")}), c2 AS ({moved("a1", "c1")}), a2 AS ({nearest("c2")}),
codes AS (SELECT vec_id, string_agg(printf('%02x', CAST(entry AS INT)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY vec_id),
books AS (SELECT sha256(string_agg(concat(v[1], ',', v[2], ',', v[3], ',', v[4]), ',' ORDER BY part, entry)) AS h FROM c2)
SELECT codes.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM codes JOIN k USING (vec_id), books"""


OP12_SQL = _sql()
