"""Language identification with a bit-sliced Bloom filter of character n-grams.

Model: for every language the n-grams (of folded characters, runs of non-letters read as one space) that are typical of
it. All languages share one filter: each slot holds a mask with a bit for each language, and the masks at an n-gram's
hash places, combined with AND, name all languages that contain it. Slots are `uint64`; beyond 64 languages a slot has
several.

Prediction: the filter is asked for every n-gram of the whole text. For each language the hits are counted and corrected
for the filter's false positives, (hits - n * f) / (1 - f); the language with the most corrected hits is predicted and
its share of the n-grams is the score. Ties go to the first language by name. Texts that are null or have no letter are
`und` with score 0.

Fitting uses at most about `sample_docs` labelled rows of each language (drawn by a hash of the row; whole texts); the
bound is on the classifier's training alone. Null languages and null texts teach nothing. With no labelled row at all
every text is `und`. Repeated rows and null doc_ids give a row each; no rows give no rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm.common import crc_mod, free_worker_memos, small_batches, table, unit_hash

#: Characters of an n-gram.
N = 4
#: Labelled rows of each language that the filter is fitted on, at most (in expectation).
SAMPLE_DOCS = 4000
#: An n-gram is kept for a language if it makes up at least this share of its n-grams (so at most 1 / share are kept) ...
MIN_SHARE = 4e-6
#: ... and at least this part of the largest share that it has in any language.
MIN_PART = 0.25
#: Hash places of an n-gram, and slots for each n-gram kept.
PLACES = 3
SLOTS_PER_NGRAM = 6

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_fold: np.ndarray | None = None


def fold_table() -> np.ndarray:
    """Code point -> its lower-case letter, or a space for what is not a letter."""
    global _fold
    if _fold is None:
        out = np.full(sys.maxunicode + 1, 32, np.uint32)
        for c in range(sys.maxunicode + 1):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _fold = out
    return _fold


def ngrams(text: str) -> np.ndarray:
    """The text's n-grams, each packed into 64 bits (16 for a character); empty if the text has no letter."""
    chars = fold_table()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    if not (chars != 32).any():
        return np.empty(0, np.uint64)
    chars = np.concatenate(([32], chars, [32]))
    chars = chars[np.append(True, (chars[1:] != 32) | (chars[:-1] != 32))].astype(np.uint64) & np.uint64(0xFFFF)
    if len(chars) < N:
        chars = np.append(chars, np.full(N - len(chars), 32, np.uint64))
    out = chars[: len(chars) - N + 1].copy()
    for i in range(1, N):
        out = out << np.uint64(16) | chars[i : len(chars) - N + 1 + i]
    return out


def slots_of(grams: np.ndarray, n_slots: int) -> Iterator[np.ndarray]:
    for m in _MULTIPLIERS[:PLACES]:
        h = grams * m
        h ^= h >> np.uint64(29)
        yield ((h * m) >> np.uint64(24)) % np.uint64(n_slots)


@dataclass(frozen=True)
class LanguageFilter:
    """masks: (slots, words) uint64; false_rate: chance that an n-gram in no filter hits a language."""

    languages: list[str]
    masks: np.ndarray
    false_rate: np.ndarray

    @staticmethod
    def build(languages: list[str], members: dict[str, np.ndarray]) -> LanguageFilter:
        n_slots = max(64, SLOTS_PER_NGRAM * max((len(x) for x in members.values()), default=1))
        masks = np.zeros((n_slots, max(1, -(-len(languages) // 64))), np.uint64)
        for i, name in enumerate(languages):
            for at in slots_of(members.get(name, np.empty(0, np.uint64)), n_slots):
                masks[at.astype(np.int64), i // 64] |= np.uint64(1 << i % 64)
        filled = np.array([(masks[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).mean() for i in range(len(languages))])
        return LanguageFilter(languages, masks, filled**PLACES)

    def hits(self, grams: np.ndarray) -> np.ndarray:
        """How many of the n-grams each language contains, as the filter has it."""
        found = None
        for at in slots_of(grams, len(self.masks)):
            m = self.masks[at.astype(np.int64)]
            found = m if found is None else found & m
        out = []
        for i in range(0, len(self.languages), 8):  # eight languages at a time: a count for each of their 256 masks
            part = (found[:, i // 64] >> np.uint64(i % 64)).astype(np.uint8)
            counts = np.bincount(part, minlength=256)
            bits = np.arange(256)[:, None] >> np.arange(8) & 1
            out.append(counts @ bits)
        return np.concatenate(out)[: len(self.languages)]

    def predict(self, text: str | None) -> tuple[str, float]:
        grams = ngrams(text) if text else np.empty(0, np.uint64)
        if not len(grams) or not self.languages:
            return "und", 0.0
        corrected = (self.hits(grams) - len(grams) * self.false_rate) / np.maximum(1e-9, 1 - self.false_rate)
        best = int(np.argmax(corrected))
        return self.languages[best], float(min(1.0, max(0.0, corrected[best] / len(grams))))


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, key: Column | None = None) -> LanguageFilter:
    """The filter for the languages of docs(text, lang); key: what the sample is drawn by."""
    small_batches(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    if not sizes:
        return LanguageFilter([], np.zeros((64, 1), np.uint64), np.zeros(0))
    share = F.create_map(*(F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, sample_docs / n))))
    sample = known.where(unit_hash(F.lit("language sample"), key if key is not None else F.col("text")) < share[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by.setdefault(lang, []).append(ngrams(text))
            for lang, parts in by.items():
                grams, times = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(times.astype(np.int64))],
                    names=["lang", "gram", "n"],
                )

    counts = sample.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = counts.persist()
    try:
        totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
        total = F.create_map(*(F.lit(x) for name, n in totals.items() for x in (name, float(max(1, n)))))
        shares = counts.where(F.col("n") > 1).withColumn("share", F.col("n") / total[F.col("lang")]).where(F.col("share") >= MIN_SHARE)
        top = shares.groupBy("gram").agg(F.max("share").alias("top"), F.collect_list(F.struct("lang", "share")).alias("own"))  # a row for each language at most
        kept = top.select("gram", F.explode("own").alias("o"), "top").where(F.col("o.share") >= MIN_PART * F.col("top"))
        rows = kept.select(F.col("o.lang").alias("lang"), "gram").toPandas()  # at most languages / MIN_SHARE rows
    finally:
        counts.unpersist()
    members = {name: part.to_numpy().view(np.uint64) for name, part in rows.groupby("lang")["gram"]}
    return LanguageFilter.build(sorted(sizes), members)


def identify(docs: DataFrame, model: LanguageFilter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # size bounded by languages / MIN_SHARE

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            got = [model.predict(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(predict, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


#: A document whose best language has less than this share of its n-grams is in none of the known languages.
MIN_SCORE = 0.1


def keep_identified(docs: DataFrame, model: LanguageFilter, min_score: float = MIN_SCORE) -> DataFrame:
    """docs, as they are, without texts that have no letter or are in none of the model's languages."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker_memos()
        for b in batches:
            got = [shared.value.predict(t) for t in b.column(at).to_pylist()]
            yield b.filter(pa.array([lang != "und" and score >= min_score for lang, score in got], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def labelled(docs: DataFrame) -> DataFrame:
    """The rows that the classifier may learn from."""
    return docs.where(F.coalesce(crc_mod(F.col("doc_id"), 4), F.lit(0)) != 2)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(labelled(docs).select("text", "lang", "doc_id"), key=F.col("doc_id"))
    return identify(docs, model).select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
