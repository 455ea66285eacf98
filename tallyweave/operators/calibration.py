"""Confidence: reliability, calibration error, ranking quality, thresholds, isotonic maps.

Fields are counted by distinct score first. Running sums over the distinct scores go through SLICES slices of [0, 1]: sums of
the slices (a bounded number of rows) are accumulated, and windows run inside a slice, so no task sees all scores. Quantiles
are read off the running sums.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.operators.scans import before, in_ranges
from tallyweave.sources.readers import shared_path

EDGES = [i / 10 for i in range(1, 10)]
#: Slices of the scores' range; scores outside [0, 1] are in the outer ones.
SLICES = 1000
#: Ranges whose blocks are pooled in one step.
FAN = 32


def bin_of(score: Column) -> Column:
    """0 to 9: ten equal bins, the last closed; the edges are the doubles i / 10."""
    return sum(((score >= e).cast("int") for e in EDGES[1:]), (score >= EDGES[0]).cast("int"))


def score_counts(fields: DataFrame, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, s, c, n): for each distinct score how many fields are right, and how many there are."""
    return fields.groupBy(*keys, F.col(score).alias("s")).agg(F.sum("correct").alias("c"), F.count(F.lit(1)).alias("n"))


def running(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """score_counts with c_before and n_before (over lower scores), c_all and n_all."""
    rows = counts.withColumn("slice", F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), "s")) * SLICES).cast("int"))
    per = rows.groupBy(*keys, "slice").agg(F.sum("c").alias("c_s"), F.sum("n").alias("n_s"))
    whole = Window.partitionBy(*keys)  # SLICES + 1 rows at most
    lower = whole.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*keys, "slice", *(F.coalesce(F.sum(f"{x}_s").over(lower), F.lit(0)).alias(f"{x}_low") for x in "cn"), *(F.sum(f"{x}_s").over(whole).alias(f"{x}_all") for x in "cn"))
    inside = Window.partitionBy(*keys, "slice").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(per.hint("merge"), [*keys, "slice"])
    for x in "cn":
        joined = joined.withColumn(f"{x}_before", F.col(f"{x}_low") + F.coalesce(F.sum(x).over(inside), F.lit(0)))
    return joined.select(*keys, "s", "c", "n", "c_before", "n_before", "c_all", "n_all")


def _reliability(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    rows = counts.where(F.col("s").between(0, 1)).groupBy(*keys, bin_of(F.col("s")).alias("bin"))
    return rows.agg(F.sum("n").alias("n"), (F.sum(F.col("s") * F.col("n")) / F.sum("n")).alias("mean_conf"), (F.sum("c") / F.sum("n")).alias("accuracy"))


def _ece(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    return _reliability(counts, keys).groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("mean_conf") - F.col("accuracy"))) / F.sum("n")).alias("ece"))


def _auroc(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    neg, below = F.col("n") - F.col("c"), F.col("n_before") - F.col("c_before")
    a = sums.groupBy(*keys).agg(F.sum(F.col("c") * (below + neg / 2)).alias("u"), F.sum("c").alias("n_pos"), F.sum(neg).alias("n_neg"))
    return a.select(*keys, F.try_divide(F.col("u"), F.col("n_pos") * F.col("n_neg")).alias("auroc"), "n_pos", "n_neg")


def _quantile(share: float) -> Column:
    """Interpolated quantile, as an aggregate over running sums."""
    place = (F.max("n_all") - 1) * F.lit(share)
    at = lambda k: F.min(F.when(F.col("n_before") + F.col("n") > k, F.col("s")))
    spot = (F.col("n_all") - 1) * F.lit(share)
    low, high = at(F.floor(spot)), at(F.ceil(spot))
    return F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)


def reliability_table(fields: DataFrame, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, bin, n, mean_conf, accuracy); empty bins are left out."""
    return _reliability(score_counts(fields, score, keys), keys)


def ece(fields: DataFrame, score: str, keys: Sequence[str] = ()) -> DataFrame:
    return _ece(score_counts(fields, score, keys), keys)


def auroc(fields: DataFrame, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, auroc, n_pos, n_neg): rank-sum with ties averaged; null without both outcomes."""
    return _auroc(running(score_counts(fields, score, keys), keys), keys)


def threshold_for_precision(fields: DataFrame, score: str, target: float) -> DataFrame:
    """One row: the lowest score that keeps precision at the target when everything at or above it is accepted, else 1.01."""
    precision = (F.col("c_all") - F.col("c_before")) / (F.col("n_all") - F.col("n_before"))
    return running(score_counts(fields, score)).agg(F.coalesce(F.min(F.when(precision >= target, F.col("s"))), F.lit(1.01)).alias("threshold"))


def lowest_confidence(fields: DataFrame, score: str, share: float = 0.08) -> DataFrame:
    """Fields scored below the share's quantile (interpolated)."""
    cut = running(score_counts(fields, score)).agg(_quantile(share).alias("__cut"))
    return fields.join(F.broadcast(cut), F.col(score) < F.col("__cut")).drop("__cut")  # one row


def flag_tradeoff(fields: DataFrame, score: str, shares: Sequence[float], fields_per_bill: int = 20) -> DataFrame:
    """(share, threshold, errors_caught, unflagged_precision, flags_per_bill) for flagging the lowest shares."""
    counts = score_counts(fields, score)
    cuts = running(counts).agg(F.array(*map(_quantile, shares)).alias("cuts"))
    rows = counts.join(F.broadcast(cuts))  # one row
    line = []
    for i, share in enumerate(shares):
        cut = F.col("cuts")[i]
        flagged = lambda x, cut=cut: F.coalesce(F.sum(F.when(F.col("s") < cut, x)), F.lit(0))
        line.append(F.struct(F.lit(share).alias("share"), F.max(cut).alias("t"), flagged(F.col("n")).alias("f"), flagged(F.col("c")).alias("fc")))
    a = rows.agg(F.sum("n").alias("n"), F.sum("c").alias("c"), F.array(*line).alias("l")).select("n", "c", F.explode("l").alias("l")).select("n", "c", "l.*")
    r4 = lambda x, name: F.round(x, 4).alias(name)
    return a.where("n IS NOT NULL").select(
        "share", F.round("t", 6).alias("threshold"), r4(F.try_divide(F.col("f") - F.col("fc"), F.col("n") - F.col("c")), "errors_caught"), r4(F.try_divide(F.col("c") - F.col("fc"), F.col("n") - F.col("f")), "unflagged_precision"),
        r4(F.col("f") / F.col("n") * fields_per_bill, "flags_per_bill"),
    )


def calibration_by_field(fields: DataFrame, score: str, at_least: int = 20) -> DataFrame:
    """(field, n, accuracy, auroc) of field types with enough rows and both outcomes."""
    n = fields.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("correct"), 4).alias("accuracy"), F.min("correct").alias("lo"), F.max("correct").alias("hi")).where((F.col("n") >= at_least) & (F.col("lo") < F.col("hi")))
    return n.join(auroc(fields, score, ["field"]).hint("merge"), "field").select("field", "n", "accuracy", F.round("auroc", 4).alias("auroc"))


def _pool(blocks: Iterable[tuple]) -> list[list]:
    """Adjacent blocks (lo, hi, c, n) in order of lo, pooled until the shares c / n rise; whole numbers, so no rounding."""
    out: list[list] = []
    for lo, hi, c, n in blocks:
        while out and out[-1][2] * n >= c * out[-1][3]:
            lo, _, c0, n0 = out.pop()
            c, n = c + c0, n + n0
        out.append([lo, hi, c, n])
    return out


def isotonic_knots(counts: DataFrame, keys: Sequence[str], ranges: int | None = None) -> DataFrame:
    """(keys, x, v, x2, v2): isotonic regression of c / n on s for each key, as knots with the next knot; the first is at -inf.

    Scores are dealt out in ranges, each range is pooled by itself, and neighbouring ranges' blocks are pooled again, FAN at
    a time, until one list is left. That gives the blocks of the whole: pooling is associative. The shares of n rows' blocks
    are different fractions of rising value whose denominators sum to n, so there are O(n ** (2/3)) of them at most.
    """
    t = in_ranges(counts.where("s IS NOT NULL AND NOT isnan(s)").select(*keys, "s", "c", "n"), [*keys, "s"], ranges)
    blocks = t.select(*keys, "part", F.col("s").alias("lo"), F.col("s").alias("hi"), F.col("c").cast("long").alias("c"), F.col("n").cast("long").alias("n"))
    schema, own = blocks.schema, [*keys, "part"]

    def pool(rows):
        rows = rows.sort_values("lo")
        pooled = list(zip(*_pool(zip(*(rows[c].tolist() for c in ("lo", "hi", "c", "n"))))))
        return type(rows)({**{k: [rows[k].iloc[0]] * len(pooled[0]) for k in own}, **dict(zip(("lo", "hi", "c", "n"), pooled))})

    blocks = blocks.groupBy(*own).applyInPandas(pool, schema)
    left = (t.agg(F.max("part")).first()[0] or 0) + 1
    while left > 1:
        blocks = blocks.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy(*own).applyInPandas(pool, schema)
        left = -(-left // FAN)
    v = (F.col("c") / F.col("n")).alias("v")
    ends = blocks.select(*keys, v, F.explode(F.array_distinct(F.array("lo", "hi"))).alias("x"))
    w = Window.partitionBy(*keys).orderBy("x")  # a key's knots
    ends = ends.select(*keys, "x", "v", F.lead("x").over(w).alias("x2"), F.lead("v").over(w).alias("v2"), F.lag("x").over(w).isNull().alias("__first"))
    knot = F.struct("x", "v", "x2", "v2")
    low = F.struct(F.lit(float("-inf")).alias("x"), F.col("v"), F.lit(None).cast("double").alias("x2"), F.lit(None).cast("double").alias("v2"))
    return ends.select(*keys, F.explode(F.when(F.col("__first"), F.array(low, knot)).otherwise(F.array(knot))).alias("__knot")).select(*keys, "__knot.*")


def isotonic_values(rows: DataFrame, knots: DataFrame, keys: Sequence[str], ranges: int | None = None) -> DataFrame:
    """rows (keys, s, ...) with p: their key's map at s, linear between knots, clipped to [0, 1]; null where the key has no knots.

    Rows and knots are put in one order, and each row takes the last knot at or before it.
    """
    both = rows.withColumn("x", F.col("s")).withColumn("asks", F.lit(1)).withColumn("knot", F.lit(None).cast("struct<x:double,v:double,x2:double,v2:double>"))
    both = both.unionByName(knots.select(*keys, "x", F.lit(0).alias("asks"), F.struct("x", "v", "x2", "v2").alias("knot")), allowMissingColumns=True)
    t = before(in_ranges(both, [*keys, "x", "asks"], ranges), keys, ["x", "asks"], at=("last", "knot")).where("asks = 1")
    at = F.col("at")
    p = F.when((at["x"] == F.col("s")) | at["x2"].isNull(), at["v"]).otherwise(at["v"] + (at["v2"] - at["v"]) * (F.col("s") - at["x"]) / (at["x2"] - at["x"]))
    return t.select(*rows.columns, F.when(p.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))).alias("p"))


def isotonic_calibrate(fields: DataFrame, score: str, ranges: int | None = None) -> DataFrame:
    """(score, p): the monotone map from score to chance of being right, on a grid of 101 points, clipped and rounded."""
    one = F.lit(0).alias("of")
    grid = fields.sparkSession.range(101).select(one, (F.col("id") / 100).alias("s"))
    knots = isotonic_knots(score_counts(fields, score).withColumn("of", one), ["of"], ranges)
    return isotonic_values(grid, knots, ["of"], ranges).select(F.col("s").alias("score"), F.round("p", 4).alias("p"))


def _calibrated(folds: DataFrame, keys: Sequence[str], ranges: int | None = None) -> DataFrame:
    """Counts (keys, fold, s, c, n) with each fold's scores mapped by the isotonic regression of the other fold; all keys at once."""
    rows = folds.where("fold IS NOT NULL AND s IS NOT NULL AND NOT isnan(s)")
    knots = isotonic_knots(rows, [*keys, "fold"], ranges).withColumn("fold", 1 - F.col("fold"))
    return isotonic_values(rows, knots, [*keys, "fold"], ranges).groupBy(*keys, F.col("p").alias("s")).agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def calibrated_ece(fields: DataFrame, score: str) -> DataFrame:
    """One row: calibration error after two-fold isotonic regression, folds by bill; fields without a bill take no part."""
    return _ece(_calibrated(score_counts(fields.withColumn("fold", F.pmod("bill_id", F.lit(2))), score, ["fold"]), []), [])


def calibration_report(fields: DataFrame, scores: Sequence[str] = ("p_first", "p_mean", "p_min"), share: float = 0.08) -> DataFrame:
    """Per aggregator: AUROC, ECE raw and calibrated, threshold, flagged share, errors caught, precision of the rest, best.

    The fields are read once: counted by aggregator, fold and distinct score, and written; all measures start from that.
    """
    spark = fields.sparkSession
    long = fields.select(F.pmod("bill_id", F.lit(2)), "correct", F.explode(F.array(*(F.struct(F.lit(i).alias("o"), F.col(s).alias("x")) for i, s in enumerate(scores)))).alias("z"))
    long = long.toDF("fold", "correct", "z").select("fold", "correct", "z.o", "z.x")
    path = shared_path(spark, "score-counts")
    score_counts(long, "x", ["o", "fold"]).write.parquet(path)
    folds = spark.read.schema("o int, fold long, s double, c long, n long").parquet(path)
    counts = folds.groupBy("o", "s").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))
    sums = running(counts, ["o"])
    cut = sums.groupBy("o").agg(_quantile(share).alias("threshold"))
    below = F.col("s") < F.col("threshold")
    a = counts.join(cut.hint("merge"), "o").groupBy("o", "threshold").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") - F.col("c")).alias("w"), F.coalesce(F.sum(F.when(below, F.col("n"))), F.lit(0)).alias("f"), F.coalesce(F.sum(F.when(below, F.col("n") - F.col("c"))), F.lit(0)).alias("wf")
    )
    after = _ece(_calibrated(folds, ["o"]), ["o"]).withColumnRenamed("ece", "ece2")
    rows = a.join(_auroc(sums, ["o"]).hint("merge"), "o").join(_ece(counts, ["o"]).hint("merge"), "o").join(after.hint("merge"), "o")  # a row for each aggregator
    r4 = lambda x, name: F.round(x, 4).alias(name)
    out = rows.select(
        "o", F.array(*map(F.lit, scores))[F.col("o")].alias("score"), r4(F.col("auroc"), "auroc"), r4(F.col("ece"), "ece_raw"), r4(F.col("ece2"), "ece_calibrated"), F.round("threshold", 6).alias("threshold"), r4(F.col("f") / F.col("n"), "flagged"),
        r4(F.try_divide("wf", "w"), "errors_caught"), r4(1 - F.try_divide(F.col("w") - F.col("wf"), F.col("n") - F.col("f")), "unflagged_right"),
    )
    first = Window.orderBy(F.col("auroc").desc(), "o")  # a row for each aggregator
    return out.withColumn("best", F.row_number().over(first) == 1).drop("o")
