"""Toxicity by maximum-scoring segments.

1. Words are scored by their log-odds between toxic and other training documents under a Dirichlet prior (alpha words,
   spread as the words of both classes together). A word counts once for a document, and groups of near copies (equal
   least hash of their word triples) count as one document. Words whose z-score is under `min_z` in size score 0; every
   word pays `drift`, so that an ordinary passage loses.
2. One linear scan of a text finds all its maximal-scoring segments (Ruzzo and Tompa). A segment with score S in a text of
   n words is expected K n exp(-lambda S) times by chance (Karlin and Altschul): lambda solves sum p exp(lambda s) = 1 over
   the words of clean training texts, K is the maximum-likelihood fit to the best segments of clean texts.
3. The significances -ln E of a text's best segment and of all its significant segments together go through a logistic
   curve fitted to training documents that had no part in step 1; the outcome is the score.

Fitting uses at most about `sample_docs` labelled rows of each class (drawn by a hash; whole texts); the bound is on the
classifier's training alone. The curve weights each row by 1 / the drawn share of its class, so its intercept has the
proportion of all labelled rows whatever the size of a class. Rows without a label or text teach nothing. With one class only, the score is that class's
share, smoothed. Null and empty texts are scored as texts without words; repeated rows and null doc_ids give a row each;
no rows give no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm.common import crc_mod, small_batches, stored, table, unit_hash

SAMPLE_DOCS = 12_000
#: Words of the Dirichlet prior, in documents.
ALPHA = 0.5
MIN_Z = 2.2
DRIFT = 1.0
#: A segment is a significant passage if as good ones are expected less often than this in such a text by chance.
MAX_EXPECTED = 0.05

_word = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return _word.findall(text.lower()) if text else []


def maximal_segments(marks: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first word, last word, score), left to right, in linear time.

    marks: (place, score) of the words that score; all other words score -drift, and a mark's drift is in its score.
    Segments begin and end at marks with a positive score.
    """
    found: list[tuple[int, int, float, float]] = []  # first, last, sum before it, sum up to its end
    total, at = 0.0, 0
    for place, score in marks:
        total -= drift * (place - at)
        at = place + 1
        if score <= 0:
            total += score
            continue
        first, left, right = place, total, total + score
        total = right
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j -= 1
            if j < 0 or found[j][3] >= right:
                found.append((first, place, left, right))
                break
            first, left = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, right - left) for a, b, left, right in found]


@dataclass(frozen=True)
class ToxicityModel:
    """scores: word -> score, drift included; lam, k: chance statistics; curve: intercept and two slopes."""

    scores: dict[str, float]
    drift: float
    lam: float
    k: float
    curve: tuple[float, float, float]

    def marks(self, tokens: list[str]) -> list[tuple[int, float]]:
        scores = self.scores
        return [(i, scores[w]) for i, w in enumerate(tokens) if w in scores]

    def passages(self, tokens: list[str]) -> list[tuple[int, int, float, float]]:
        """Significant segments: first word, last word, score, times expected by chance."""
        n = max(1, len(tokens))
        expected = ((a, b, s, self.k * n * math.exp(-self.lam * s)) for a, b, s in maximal_segments(self.marks(tokens), self.drift))
        return [x for x in expected if x[3] <= MAX_EXPECTED]

    def features(self, tokens: list[str]) -> tuple[float, float]:
        n = max(1, len(tokens))
        segments = maximal_segments(self.marks(tokens), self.drift)
        evidence = [self.lam * s - math.log(self.k * n) for _, _, s in segments] or [-math.log(self.k * n)]
        least = -math.log(MAX_EXPECTED)
        return min(30.0, max(-10.0, max(evidence))), min(60.0, sum(x for x in evidence if x >= least))

    def score(self, tokens: list[str]) -> float:
        x, y = self.features(tokens)
        a, b, c = self.curve
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, a + b * x + c * y))))


def _training_rows(docs: DataFrame, labels: DataFrame, sample_docs: int) -> DataFrame:
    """(text, toxic, fold, weight): a bounded sample of the labelled documents, stored; weight is 1 / the drawn share."""
    own = labels.where(F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("toxic"))
    sizes = {r.toxic: r.n for r in own.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, min(1.0, sample_docs / max(1, sizes.get(1, 0)))).otherwise(min(1.0, sample_docs / max(1, sizes.get(0, 0))))
    drawn = own.withColumn("share", share).where(unit_hash(F.lit("toxicity sample"), "id") < F.col("share"))
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text")
    # The drawn ids are bounded (2 x sample_docs in expectation), so they may be sent to all tasks.
    return stored(texts.join(F.broadcast(drawn), F.col("doc_id") == F.col("id")).select("text", "toxic", unit_hash(F.lit("fold"), "doc_id").alias("fold"), (1 / F.col("share")).alias("weight")), "toxicity-sample")


def _document_counts(rows: DataFrame) -> DataFrame:
    """(word, toxic, docs, tokens): near copies, by the least hash of their word triples, are one document."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = []
            for text in b.column(0).to_pylist():
                w = words(text)
                keys.append(min((hash_of(" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2))), default=0))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.int64())], names=["text", "toxic", "near"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs: Counter = Counter()
            tokens: Counter = Counter()
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = Counter((toxic, w) for w in words(text))
                docs.update(own.keys())
                tokens.update(own)
            keys = list(docs)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[1] for k in keys], pa.string()), pa.array([k[0] for k in keys], pa.int32()), pa.array([docs[k] for k in keys], pa.int64()), pa.array([tokens[k] for k in keys], pa.int64())],
                names=["word", "toxic", "docs", "tokens"],
            )

    single = rows.mapInArrow(sketch, "text string, toxic int, near long").groupBy("near", "toxic").agg(F.max("text").alias("text")).select("text", "toxic")
    return single.mapInArrow(count, "word string, toxic int, docs long, tokens long").groupBy("word", "toxic").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text) >> 1


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, alpha: float = ALPHA, min_z: float = MIN_Z, drift: float = DRIFT) -> ToxicityModel:
    """docs(doc_id, text), labels(doc_id, toxic): only rows that may be learnt from."""
    small_batches(docs.sparkSession)
    rows = _training_rows(docs, labels, sample_docs).withColumn("toxic", F.col("toxic").cast("int"))
    counts = _document_counts(rows.where("fold < 0.6").select("text", "toxic"))
    wide = counts.groupBy("word").agg(*(F.sum(F.when(F.col("toxic") == t, F.col(c)).otherwise(0)).alias(f"{c}{t}") for t in (0, 1) for c in ("docs", "tokens")))
    wide = stored(wide, "toxicity-words")
    n = wide.agg(F.sum("docs0").alias("d0"), F.sum("docs1").alias("d1"), F.sum("tokens0").alias("t0")).first()
    n0, n1, tokens0 = float(n.d0 or 0), float(n.d1 or 0), float(n.t0 or 0)
    if n0 and n1:
        prior = alpha * (F.col("docs0") + F.col("docs1")) / (n0 + n1) * 2 + 1e-3
        a, b = F.col("docs1") + prior * n1 / (n0 + n1), F.col("docs0") + prior * n0 / (n0 + n1) + 0.4
        odds = F.log(a / (n1 - a + 1)) - F.log(b / (n0 - b + 1))
        scored = wide.select("word", "tokens0", odds.alias("odds"), (odds / F.sqrt(1 / a + 1 / b)).alias("z")).where(F.abs("z") >= min_z)
        kept = [r for r in scored.where(F.col("odds") != 0).collect()]  # words of the bounded sample
    else:
        kept = []
    scores = {r.word: max(-4.0, min(8.0, r.odds)) - drift for r in kept}
    positive = [(scores[r.word], (r.tokens0 + 0.05) / (tokens0 + 1)) for r in kept if scores[r.word] > 0]
    lam = _lambda(positive, drift)
    model = ToxicityModel(scores, drift, lam, 1.0, (0.0, 0.0, 0.0))

    shared = docs.sparkSession.sparkContext.broadcast(model)  # words of the bounded sample

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                tokens = words(text)
                segments = maximal_segments(shared.value.marks(tokens), drift)
                out.append((max(1, len(tokens)), [s for _, _, s in segments]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.float64()))],
                names=["toxic", "weight", "n", "best"],
            )

    seen = rows.where("fold >= 0.6").select("text", "toxic", "weight").mapInArrow(features, "toxic int, weight double, n long, best array<double>").collect()  # a few numbers of each row of the bounded sample
    clean = [r for r in seen if r.toxic == 0]
    k = len(clean) / max(1e-9, sum(r.n * math.exp(-lam * max(r.best, default=0.0)) for r in clean)) if clean else 1.0
    least = -math.log(MAX_EXPECTED)
    xs = []
    for r in seen:
        evidence = [lam * s - math.log(k * r.n) for s in r.best] or [-math.log(k * r.n)]
        xs.append((1.0, min(30.0, max(-10.0, max(evidence))), min(60.0, sum(x for x in evidence if x >= least))))
    curve = _logistic(np.array(xs).reshape(-1, 3), np.array([float(r.toxic) for r in seen]), np.array([r.weight for r in seen]))
    return ToxicityModel(scores, drift, lam, k, curve)


def _lambda(positive: list[tuple[float, float]], drift: float) -> float:
    """The positive root of sum p exp(lambda s) = 1; words without a score of their own have -drift."""
    if not positive:
        return 1.0
    s, p = (np.array(x) for x in zip(*positive))
    rest = max(0.0, 1 - p.sum())
    low, high = 1e-3, 10.0
    for _ in range(80):
        mid = (low + high) / 2
        if (p * np.exp(mid * s)).sum() + rest * math.exp(-mid * drift) < 1:
            low = mid
        else:
            high = mid
    return low


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> tuple[float, float, float]:
    """Newton's method with a small ridge on the slopes; a row counts weight times."""
    w = np.zeros(x.shape[1])
    if len(y):
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            penalty = ridge * np.r_[1e-3, np.ones(len(w) - 1)]
            step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-6), x.T @ (weight * (y - p)) - penalty * w)
            w = w + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
    return tuple(float(v) for v in w)


def score_documents(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, passages): passages are the significant segments by word places, with score and expected count."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # words of the bounded sample
    passage = pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = ("first_word", "last_word", "score", "expected")
        for b in batches:
            scores, found = [], []
            for text in b.column(1).to_pylist():
                tokens = words(text)
                scores.append(model.score(tokens))
                found.append([dict(zip(names, x)) for x in model.passages(tokens)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(found, pa.list_(passage))], names=["doc_id", "score", "passages"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(score, f"doc_id {kind}, score double, passages array<struct<first_word:long,last_word:long,score:double,expected:double>>")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    model = fit(docs.where(~held_out), labels.where(~held_out))
    scored = score_documents(docs, model)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages")
    )
