"""Token counts: heap-and-linked-list byte-pair merging, without ever emitting token ids.

Each distinct word of a worker's share is merged once by repeatedly popping the lowest-rank adjacent pair from a heap
over a linked list of symbols; its count is its bytes minus the merges done. A document's count is the sum over its
words. The work is one narrow pass over the documents: no shuffle, one bounded memo per Python worker.

Null text counts as empty (0 bytes, 0 tokens); repeated rows and null doc_ids give a row each; no rows give no rows;
special strings of the vocabulary file inside a text are one token each, as the tokenizers library has it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm.bpe_core import MergeTable, TwoAges, load_merges, merge_list, pieces, special_splitter
from tallyweave.llm.common import free_worker_memos, small_batches, table, worker_memo


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Counter:
    """Counts tokens of texts; one per Python worker, kept between batches and tasks."""

    def __init__(self, merges: MergeTable):
        self.merges = merges
        self.split = special_splitter(merges.special)
        self.words = TwoAges(self.word)

    def word(self, word: str) -> int:
        data = word.encode()
        return len(data) if len(data) < 2 else len(data) - merge_list(data, self.merges)[2]

    def text(self, text: str) -> int:
        parts = self.split.split(text) if self.split else [text]
        return len(parts) // 2 + sum(sum(map(self.words.__getitem__, pieces(p))) for p in parts[::2] if p)


_counters: dict[str, Counter] = worker_memo()


def count_tokens(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row's whole text."""
    small_batches(docs.sparkSession)
    tokenizer = tokenizer or default_tokenizer()
    shared = docs.sparkSession.sparkContext.broadcast(load_merges(tokenizer))  # a vocabulary file: its size is fixed

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _counters:
            free_worker_memos()
            _counters[tokenizer] = Counter(shared.value)
        counter = _counters[tokenizer]
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([counter.text(t) if t else 0 for t in texts], pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes")
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_tokens(table(spark, sf_dir, "documents"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)
