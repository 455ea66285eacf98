"""Mixing sources to target weights by cube-method balanced sampling.

Every source has a target in words. A document of a source with target / size = f is taken floor(f) times, and once more
with inclusion probability f - floor(f). Those probabilities are moved by the cube method: three documents at a time,
along the null space of two constraints (the source's words and its documents), until each is 0 or 1. The flight runs in
blocks of a source in parallel; what a block leaves undecided (two documents at most) goes on in larger groups. The last
group of a source keeps a dozen units of all sizes out of the flight; they and the two left open land together, on the
choice nearest to the expected words and documents. Large documents fly first.

A document's size is the number of its words, [^\\x20\\x09-\\x0D]+; null text has size 0. Rows that agree in doc_id, source
and size are one unit that is taken or left together. Null sources are a source of their own, the last. Documents
of size 0 fly too and take no words. Draws depend only on the seed and the units, so reruns agree. No rows give no rows.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweave.llm.common import stored, table

WEIGHTS = (5.0, 2.0, 1.0)
#: Most copies of a document, and most of a source, that a mix may take.
MAX_REPEATS = 3
#: Units that fly in one task group.
BLOCK = 4096
#: Units of each source that are kept for the landing.
LANDING = 12


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, units, target) from units (source, words): shares by weight, capped, the excess reshared.

    Closed form of the resharing: in order of cap / weight the capped sources come first; the rest share what is left
    by weight. One row for each source.
    """
    per = sizes.groupBy("source").agg(F.sum("words").alias("source_size"), F.count(F.lit(1)).alias("units"))
    order = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    w = F.lit(None).cast("double")
    for i, x in enumerate(weights):
        w = F.when((F.row_number().over(order) - 1) % len(weights) == i, F.lit(float(x))).otherwise(w)
    per = per.withColumn("weight", w).withColumn("cap", F.col("source_size") * float(max_repeats)).withColumn("ratio", F.col("cap") / F.col("weight"))
    asc = Window.orderBy("ratio", F.col("source").cast("binary").asc_nulls_last())
    before = asc.rowsBetween(Window.unboundedPreceding, -1)
    after = asc.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    per = per.withColumn(
        "level",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after),
    )
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"]
    return per.withColumn("free", level).select(
        "source", "source_size", "units", F.when(F.col("free").isNull() | (F.col("ratio") <= F.col("free")), F.col("cap")).otherwise(F.col("weight") * F.col("free")).alias("target")
    )


def flight(sizes: list[int], chances: list[float], draw) -> list[float]:
    """Moves chances through the null space of (words, documents) until two at most are strictly between 0 and 1.

    Units fly in the given order; draw() gives numbers in [0, 1).
    """
    p, edge = list(chances), 1e-9
    waiting = [i for i, x in enumerate(p) if edge < x < 1 - edge]
    waiting.reverse()
    active: list[int] = []
    while True:
        while len(active) < 3 and waiting:
            active.append(waiting.pop())
        if len(active) < 3:
            break
        a, b, c = (sizes[i] for i in active)
        u = (b - c, c - a, a - b)
        if not any(u):
            u = (1, -1, 0)
        top = max(map(abs, u))
        u = tuple(x / top for x in u)
        up = min((1 - p[i]) / x if x > 0 else p[i] / -x for i, x in zip(active, u) if x)
        down = min(p[i] / x if x > 0 else (1 - p[i]) / -x for i, x in zip(active, u) if x)
        step = up if draw() * (up + down) < down else -down
        for i, x in zip(active, u):
            p[i] += step * x
            if p[i] < edge or p[i] > 1 - edge:
                p[i] = float(round(p[i]))
        active = [i for i in active if 0 < p[i] < 1]
    return p


def land(sizes: list[int], chances: list[float], goal_words: float, goal_units: float) -> list[float]:
    """0 or 1 for the units still open, by trying all choices: nearest to the goal in words, less so in documents."""
    open_ = [i for i, x in enumerate(chances) if 0 < x < 1]
    words = sum(sizes[i] for i, x in enumerate(chances) if x == 1) - goal_words
    units = sum(x == 1 for x in chances) - goal_units
    words, units = np.array([words]), np.array([units])
    for i in open_:  # the second half of the choices takes the unit
        words, units = np.concatenate([words, words + sizes[i]]), np.concatenate([units, units + 1])
    mean = sum(sizes) / max(1, len(sizes))
    best = int(np.argmin(np.abs(words) + 0.05 * mean * np.abs(units)))
    out = list(chances)
    for j, i in enumerate(open_):
        out[i] = float(best >> j & 1)
    return out


def _fly(part: pd.DataFrame, seed: int, last: bool) -> pd.DataFrame:
    part = part.sort_values(["words", "unit", "block", "slot"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
    key = f"{seed}|{part['group'].iloc[0]}|{len(part)}|{part['unit'].iloc[0]}"
    draw = random.Random(int.from_bytes(hashlib.blake2b(key.encode(), digest_size=8).digest(), "big")).random
    sizes, p = part["words"].tolist(), part["p"].tolist()
    if not last:
        part["p"] = flight(sizes, p, draw)
        return part
    goal_words, goal_units = sum(a * b for a, b in zip(sizes, p)), sum(p)
    open_ = [i for i, x in enumerate(p) if 0 < x < 1]
    held = set(open_[:: max(1, len(open_) // LANDING)][:LANDING])  # of all sizes; these only land
    flown = flight([x for i, x in enumerate(sizes) if i not in held], [x for i, x in enumerate(p) if i not in held], draw)
    left = iter(flown)
    part["p"] = land(sizes, [x if i in held else next(left) for i, x in enumerate(p)], goal_words, goal_units)
    return part


def _flown(seed: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def fly(part: pd.DataFrame) -> pd.DataFrame:
        return _fly(part, seed, last)

    return fly


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    seed: int = 0,
    block: int = BLOCK,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """(doc_id, source, size, rows, source_size, target, copies): how often each unit is taken."""
    kind = docs.schema[id_col].dataType.simpleString()
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"))
    units = sizes.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows")).withColumn("words", F.col("size") * F.col("rows"))
    units = stored(units, "mix-units")
    targets = stored(source_targets(units, weights, max_repeats), "mix-targets")  # a row for each source
    largest = targets.agg(F.coalesce(F.max("units"), F.lit(0))).first()[0]

    f = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = units.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    whole = F.floor(f + 1e-12).cast("long")
    rows = rows.withColumn("whole", whole).withColumn("p", F.greatest(F.lit(0.0), f - F.col("whole")))
    unit = F.xxhash64(F.lit(seed), "doc_id", "source", "size")
    rows = rows.withColumn("unit", unit).withColumn("block", F.pmod(F.col("unit"), F.ceil(F.col("units") / block)).cast("long"))

    shape = f"doc_id {kind}, source string, size long, rows long, source_size long, target double, whole long, p double, words long, unit long, block long, `group` long, slot long"
    blocks = -(-largest // block) if largest else 1

    def first(part: pd.DataFrame) -> pd.DataFrame:
        part = _fly(part.assign(slot=0), seed, blocks == 1)
        return part.assign(slot=range(len(part)))

    rows = rows.withColumn("group", F.col("block")).withColumn("slot", F.lit(0).cast("long"))
    names = [c.split()[0].strip("`") for c in shape.split(", ")]
    flown = stored(rows.select(names).groupBy("source", "group").applyInPandas(first, shape), "mix-flight")
    result = flown
    if blocks > 1:
        # What blocks leave open: two units of a block at most, so each round has block / 2 times fewer groups.
        open_shape = "source string, words long, p double, unit long, block long, slot long, `group` long"
        left = flown.where("p > 0 AND p < 1").select("source", "words", "p", "unit", "block", "slot", "group")
        decided = None
        while blocks > 1:
            blocks = -(-blocks // (block // 2))
            left = left.withColumn("group", F.floor(F.col("group") / (block // 2)))
            last = blocks == 1
            left = stored(left.groupBy("source", "group").applyInPandas(_flown(seed, last), open_shape), "mix-rest")
            done = left.where("p = 0 OR p = 1")
            decided = done if decided is None else decided.unionByName(done)
            left = left.where("p > 0 AND p < 1")
        decided = decided.select(F.col("source").alias("s"), F.col("block").alias("b"), F.col("slot").alias("t"), F.col("p").alias("q"))
        same = F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")) & (F.col("slot") == F.col("t"))
        rest = flown.where("p > 0 AND p < 1").join(decided.hint("merge"), same).withColumn("p", F.col("q"))
        result = flown.where("p = 0 OR p = 1").unionByName(rest.select(flown.columns))
    copies = (F.col("whole") + F.round("p").cast("long")).alias("copies")
    return result.select("doc_id", "source", "size", "rows", "source_size", "target", copies)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs in the mix: a row for each time that a document is taken, its columns as they were."""
    taken = mix(docs, **options).where("copies > 0").select(
        F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), F.col("copies").alias("__copies")
    )
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").cast("string").eqNullSafe(F.col("__source")) & (n_words(F.col("text")) == F.col("__size"))
    joined = docs.join(taken.hint("merge"), same)
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(docs.columns)


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mix(docs)
    each = mixed.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return each.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
