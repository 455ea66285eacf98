"""BPE encoding and decoding with a minimal acyclic transducer of frequent words.

1. Words are counted over all documents (map-side counts, then a sum); a word is frequent if its share of all words is
   at least `min_share`, so there are at most 1 / min_share of them.
2. The frequent words are compiled, in sorted order, into a minimal acyclic automaton: equal suffixes share states, and
   the numbers on the arcs of a word's path add up to its place in the table of token ids.
3. The compiled lexicon is written to the shared folder, shipped to the executors as a Spark file and memory-mapped.
   Words outside it are merged exactly. Either way the ids are those of the tokenizers library.

Decoding concatenates the bytes of the ids. Null text counts as empty (no ids, empty text); repeated rows and null
doc_ids give a row each; no rows give no rows; special strings inside a text become their single id.
"""

from __future__ import annotations

import mmap
import struct
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat

import pyarrow as pa
from pyspark import SparkFiles, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm.bpe_core import MergeTable, TwoAges, load_merges, merge_list, pieces, special_splitter
from tallyweave.llm.common import free_worker_memos, scratch_dir, small_batches, table, worker_memo

_letter = [bytes([b]) for b in range(256)]
_no_merge = 1 << 60
#: A word is compiled into the lexicon from this share of all words on.
MIN_SHARE = 1e-6
#: Words (of the lexicon or not) that a worker keeps the ids of, twice at most: bounds its memory, not the result.
MEMO_WORDS = 150_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def compile_lexicon(words: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """Sorted (word, ids) pairs -> the bytes of the transducer.

    States are numbered children first. Sections of unsigned 32-bit numbers: first arc of each state, arc targets, arc
    outputs, first id of each word, ids; then a byte for each arc (its letter) and for each state (1: a word ends).
    """
    # A state under construction: [final, letters, targets]; states that can change no more are shared by content.
    known: dict[tuple, int] = {}
    states: list[tuple] = []
    path: list[list] = [[False, [], []]]
    last, firsts, ids = b"", [0], []

    def freeze(state: list) -> int:
        key = (state[0], bytes(state[1]), tuple(state[2]))
        at = known.get(key)
        if at is None:
            at = known[key] = len(states)
            states.append(key)
        return at

    def cut(depth: int) -> None:
        while len(path) > depth + 1:
            at = freeze(path.pop())
            path[-1][2].append(at)

    for word, own in words:
        if word <= last:
            raise ValueError("words must be sorted and distinct")
        same = next((i for i, (a, b) in enumerate(zip(word, last)) if a != b), min(len(word), len(last)))
        cut(same)
        for letter in word[same:]:
            path[-1][1].append(letter)
            path.append([False, [], []])
        path[-1][0] = True
        last = word
        ids += own
        firsts.append(len(ids))
    cut(0)
    root = freeze(path[0])

    below = [0] * len(states)  # words that can be completed from a state
    arcs, targets, outputs, letters = [0], [], [], bytearray()
    for at, (final, own_letters, own_targets) in enumerate(states):
        passed = int(final)
        for letter, to in zip(own_letters, own_targets):
            letters.append(letter)
            targets.append(to)
            outputs.append(passed)
            passed += below[to]
        below[at] = passed
        arcs.append(len(targets))
    numbers = [root, len(states), len(targets), len(firsts), len(ids), *arcs, *targets, *outputs, *firsts, *ids]
    return struct.pack(f"<{len(numbers)}I", *numbers) + bytes(letters) + bytes(int(s[0]) for s in states)


class Lexicon:
    """Look-up in a compiled lexicon that lies in a buffer (a memory map on executors)."""

    def __init__(self, data):
        self.data = data
        self.root, n_states, n_arcs, n_firsts, n_ids = struct.unpack_from("<5I", data)
        numbers = memoryview(data)
        at = 20

        def part(n: int):
            nonlocal at
            at += 4 * n
            return numbers[at - 4 * n : at].cast("I")

        self.arcs, self.targets, self.outputs = part(n_states + 1), part(n_arcs), part(n_arcs)
        self.firsts, self.ids = part(n_firsts), part(n_ids)
        self.letters, self.finals = at, at + n_arcs
        self.find = data.find

    def get(self, word: bytes) -> bytes | None:
        """The word's ids as little-endian unsigned 32-bit numbers; None if it isn't in the lexicon."""
        arcs, targets, outputs, base, find = self.arcs, self.targets, self.outputs, self.letters, self.find
        state, total = self.root, 0
        for letter in word:
            at = find(_letter[letter], base + arcs[state], base + arcs[state + 1]) - base
            if at < 0:
                return None
            total += outputs[at]
            state = targets[at]
        return bytes(self.ids[self.firsts[total] : self.firsts[total + 1]]) if self.data[self.finals + state] else None


def merged_ids(word: bytes, table: MergeTable) -> list[int]:
    """The word's ids: short words by scanning the ranks of their pairs, long ones with a heap."""
    if len(word) > 40:
        symbols, right, _ = merge_list(word, table)
        out, i = [], 0
        while i < len(symbols):
            out.append(symbols[i])
            i = right[i]
        return out
    get, none = table.merges.get, _no_merge
    ids = list(map(table.first.__getitem__, word))
    ranks = list(map(get, zip(ids, ids[1:]), repeat(none)))
    while ranks:
        best = min(ranks)
        if best == none:
            break
        i = ranks.index(best)
        merged = best & 0xFFFFF
        ids[i : i + 2] = (merged,)
        del ranks[i]
        if i < len(ranks):
            ranks[i] = get((merged, ids[i + 1]), none)
        if i:
            ranks[i - 1] = get((ids[i - 1], merged), none)
    return ids


class Encoder:
    def __init__(self, merges: MergeTable, lexicon: Lexicon | None):
        self.merges, self.lexicon = merges, lexicon
        self.split = special_splitter(merges.special)
        self.special = {s: struct.pack("<I", i) for s, i in merges.special.items()}
        self.words = TwoAges(self.word, MEMO_WORDS)

    def word(self, word: str) -> bytes:
        data = word.encode()
        known = self.lexicon.get(data) if self.lexicon else None
        if known is not None:
            return known
        ids = merged_ids(data, self.merges)
        return struct.pack(f"<{len(ids)}I", *ids)

    def text(self, text: str) -> bytes:
        parts = self.split.split(text) if self.split else [text]
        return b"".join(self.special[p] if i % 2 else b"".join(map(self.words.__getitem__, pieces(p))) for i, p in enumerate(parts) if p)


def count_words(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """(word, n) over all documents; each task counts what it reads before anything is shuffled."""
    small_batches(docs.sparkSession)
    split = special_splitter(load_merges(tokenizer).special)

    def counted(counts: Counter) -> Iterator[pa.RecordBatch]:
        words, ns = list(counts), list(counts.values())
        for i in range(0, len(words), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(words[i : i + 50_000], pa.string()), pa.array(ns[i : i + 50_000], pa.int64())], names=["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker_memos()
        counts: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                for part in (split.split(text) if split else [text])[::2] if text else ():
                    counts.update(pieces(part))
                if len(counts) > 200_000:  # memory, not a cap: the sum is taken after the shuffle
                    yield from counted(counts)
                    counts.clear()
        yield from counted(counts)

    return docs.select(F.col(text_col).alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, tokenizer: str, min_share: float = MIN_SHARE, text_col: str = "text") -> bytes:
    """The compiled lexicon of the words that make up at least min_share of all words."""
    counts = count_words(docs, tokenizer, text_col).persist(StorageLevel.DISK_ONLY)
    try:
        total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        frequent = counts.where(F.col("n") >= max(2.0, min_share * total)).select("word").collect()  # at most 1 / min_share rows
    finally:
        counts.unpersist()
    merges = load_merges(tokenizer)
    words = sorted(r.word.encode() for r in frequent)
    return compile_lexicon((w, merged_ids(w, merges)) for w in words)


def share_file(spark: SparkSession, data: bytes, name: str) -> str:
    """Puts bytes into the shared folder and has Spark fetch them to every executor; returns the SparkFiles name."""
    name = f"{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch_dir(spark), name)
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(data))
    out.close()
    spark.sparkContext.addFile(path.toString())
    return name


_encoders: dict[str, Encoder] = worker_memo()


def _coded(docs: DataFrame, tokenizer: str | None, min_share: float, id_col: str, text_col: str, both: bool) -> DataFrame:
    """(doc_id, ids) of every whole text; with both also (text), decoded from the ids by the same worker."""
    spark = docs.sparkSession
    small_batches(spark, mb=4)
    tokenizer = tokenizer or default_tokenizer()
    lexicon = share_file(spark, build_lexicon(docs, tokenizer, min_share, text_col), "lexicon")
    shared = spark.sparkContext.broadcast(load_merges(tokenizer))  # a vocabulary file: its size is fixed

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if lexicon not in _encoders:
            free_worker_memos()
            with open(SparkFiles.get(lexicon), "rb") as f:
                _encoders[lexicon] = Encoder(shared.value, Lexicon(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)))
        encoder = _encoders[lexicon]
        for b in batches:
            ids = [encoder.text(t) if t else b"" for t in b.column(1).to_pylist()]
            columns = {"doc_id": b.column(0), "ids": pa.array(ids, pa.binary())}
            if both:
                columns["text"] = pa.array([decoded(x, encoder.merges.bytes_of) for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(coded, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary" + ", text string" * both)


def encode(docs: DataFrame, tokenizer: str | None = None, min_share: float = MIN_SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every whole text; ids are little-endian unsigned 32-bit numbers in a binary column."""
    return _coded(docs, tokenizer, min_share, id_col, text_col, both=False)


def round_trip(docs: DataFrame, tokenizer: str | None = None, min_share: float = MIN_SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, text): every whole text's ids, and the text decoded from them, in one pass of one worker."""
    return _coded(docs, tokenizer, min_share, id_col, text_col, both=True)


def decoded(ids: bytes, bytes_of: dict[int, bytes]) -> str:
    return b"".join(map(bytes_of.__getitem__, memoryview(ids).cast("I"))).decode(errors="replace")


def decode(coded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, ids, text): the text of each row's ids, special strings included."""
    small_batches(coded.sparkSession, mb=4)
    shared = coded.sparkSession.sparkContext.broadcast(load_merges(tokenizer or default_tokenizer()).bytes_of)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [decoded(ids, shared.value) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["doc_id", "ids", "text"])

    rows = coded.select("doc_id", "ids")
    return rows.mapInArrow(texts, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary, text string")


def digests(docs: DataFrame) -> DataFrame:
    """Encodes and decodes every row; lengths and digests of both results."""
    return round_trip(docs).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
