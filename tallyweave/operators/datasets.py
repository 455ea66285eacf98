"""Manifests: duplicates across splits, sampling, set operations, profiles. Draws are md5 orders, so they repeat anywhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.operators.hamming import hamming_pairs
from tallyweave.operators.quantiles import exact_quantiles
from tallyweave.sources.readers import shared_path

#: How protected a split is.
SPLIT_RANK = {"test": 0, "val": 1, "train": 2}


def split_rank(split: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in SPLIT_RANK.items() for x in kv))[split]


def exact_dup_across_splits(manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): of equal content in several splits the most protected split's records stay; copies within a split stay.

    Only hashes that several splits have (one row each) are joined back; they are written first, so that both sides of the
    join are shuffled and a hash that very many records share can be split by AQE. A null hash equals no other.
    """
    rank = split_rank(F.col("split"))
    best = manifest.where("content_hash IS NOT NULL").groupBy("content_hash").agg(F.min(rank).alias("__best"), F.max(rank).alias("__last")).where("__best < __last").drop("__last")
    path = shared_path(manifest.sparkSession, "best-splits")
    best.write.parquet(path)
    best = manifest.sparkSession.read.schema(best.schema).parquet(path)
    rows = manifest.join(best.hint("merge"), "content_hash", "left")
    keep = F.coalesce(rank == F.col("__best"), F.lit(True))
    return rows.where(keep).drop("__best"), rows.where(~keep).drop("__best")


def near_dup_across_splits(hashes: DataFrame, limit: int = 12, words: Sequence[str] = ("w0", "w1", "w2", "w3")) -> DataFrame:
    """(split_a, split_b, id_a, id_b, distance, pairs) for classes of records of different splits whose 256-bit hashes differ in
    `limit` bits at most. A class is what has one hash in one split; ids are the smallest of each, pairs its pairs of records.

    The join (hamming_pairs) runs on distinct hashes, so a blank input that very many records share is one row in it.
    """
    classes = hashes.groupBy(*words, "split").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    classes = classes.groupBy(*words).agg(F.min("id").alias("h"), F.collect_list(F.struct("split", "id", "n")).alias("own"))  # a few splits
    path = shared_path(hashes.sparkSession, "hash-classes")
    classes.write.parquet(path)
    classes = hashes.sparkSession.read.schema(classes.schema).parquet(path)
    pairs = hamming_pairs(classes, "h", words, limit).select(F.col("a").alias("h"), F.col("b").alias("h2"), "distance")
    pairs = pairs.unionByName(classes.select("h", F.col("h").alias("h2"), F.lit(0).alias("distance")))
    one, two = classes.select("h", F.col("own").alias("a")), classes.select(F.col("h").alias("h2"), F.col("own").alias("b"))
    met = pairs.join(one.hint("merge"), "h").join(two.hint("merge"), "h2").select("distance", F.explode("a").alias("a"), "b").select("distance", "a", F.explode("b").alias("b"))
    # Of two hashes both orders of splits count; of one hash each pair of splits comes in both orders, of which one is kept.
    x, y = F.when(F.col("a.split") < F.col("b.split"), F.col("a")).otherwise(F.col("b")), F.when(F.col("a.split") < F.col("b.split"), F.col("b")).otherwise(F.col("a"))
    met = met.where((F.col("a.split") < F.col("b.split")) | ((F.col("a.split") > F.col("b.split")) & (F.col("distance") > 0)))
    return met.select(x["split"].alias("split_a"), y["split"].alias("split_b"), x["id"].alias("id_a"), y["id"].alias("id_b"), "distance", (x["n"] * y["n"]).alias("pairs"))


def near_dup_examples(near: DataFrame, k: int = 5) -> DataFrame:
    """(split_a, split_b, pairs, rank, id_a, id_b, distance): how many pairs of records each two splits share, and the nearest k classes."""
    total = near.groupBy("split_a", "split_b").agg(F.sum("pairs").alias("pairs"))
    first = Window.partitionBy("split_a", "split_b").orderBy("distance", "id_a", "id_b")  # k rows of each task reach it
    top = near.drop("pairs").withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    return top.join(total.hint("merge"), ["split_a", "split_b"]).select("split_a", "split_b", "pairs", "rank", "id_a", "id_b", "distance")


def split_overlap(manifest: DataFrame, key: str) -> DataFrame:
    """(split_a, split_b, n): distinct keys in both of each pair of splits."""
    sets = manifest.groupBy(key).agg(F.array_sort(F.collect_set("split")).alias("s")).where(F.size("s") > 1)  # a few splits
    pairs = sets.select(F.explode(F.expr("flatten(transform(s, (a, i) -> transform(slice(s, i + 2, size(s)), b -> struct(a AS split_a, b AS split_b))))")).alias("p"))
    return pairs.groupBy("p.split_a", "p.split_b").agg(F.count(F.lit(1)).alias("n"))


def manifest_summary(kept: DataFrame, dropped: DataFrame) -> DataFrame:
    """(source, split, kept, dropped)."""
    rows = kept.select("source", "split", F.lit(1).alias("k"), F.lit(0).alias("d")).unionByName(dropped.select("source", "split", F.lit(0).alias("k"), F.lit(1).alias("d")))
    return rows.groupBy("source", "split").agg(F.sum("k").alias("kept"), F.sum("d").alias("dropped"))


def union_manifests(*parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all records, ids that occur more than once): a manifest with such ids is to be refused."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows, rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def drop_set(rows: DataFrame, dropped: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(dropped.select(key), key, "left_anti")


def md5_order(seed: int | str, key: str = "id") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def _quota(quotas: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for source, n in quotas.items():
        out = F.when(F.col("source") == source, n).otherwise(out)
    return out


def ranked_sample(rows: DataFrame, seed: int, top: int) -> DataFrame:
    """Adds rn, the place in its source's md5 order, for the first `top` of each source.

    A pre-selection by a hash prefix keeps a hot source from being sorted whole: the threshold comes from the source's count.
    """
    n = rows.groupBy("source").agg(F.count(F.lit(1)).alias("__n"))
    chance = F.conv(F.substring(md5_order(seed), 1, 8), 16, 10).cast("double") / 2**32
    wanted = chance * F.col("__n") <= top * 2 + 60  # the expected number below is that; far from ever too few
    w = Window.partitionBy("source").orderBy(md5_order(seed), "id")
    return rows.join(F.broadcast(n), "source").where(wanted).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= top).drop("__n")  # a row for each source


def sample_per_source(rows: DataFrame, seed: int, quotas: dict[str, int], default: int) -> DataFrame:
    """The first records of each source's md5 order: its quota, or `default` of a source without one."""
    top = max([default, *quotas.values()])
    return ranked_sample(rows, seed, top).where(F.col("rn") <= _quota(quotas, default))


def sample_round_robin(rows: DataFrame, seed: int, n: int) -> DataFrame:
    """n records: the first of every source, then the second, and so on."""
    return ranked_sample(rows, seed, n).orderBy("rn", "source").limit(n)


def cap_sample(rows: DataFrame, seed: int, n: int) -> DataFrame:
    return rows.orderBy(md5_order(seed), "id").limit(n)


def carve_validation(rows: DataFrame, seed: int, n: int) -> DataFrame:
    """Moves the first n training records of the md5 order to val."""
    moved = rows.where("split = 'train'").orderBy(md5_order(seed), "id").limit(n).select("id", F.lit(True).alias("__val"))
    return rows.join(moved, "id", "left").withColumn("split", F.when(F.col("__val"), "val").otherwise(F.col("split"))).drop("__val")


def oversample(rows: DataFrame, weights: dict[str, int]) -> DataFrame:
    """Each row as often as its source's weight; `copy` numbers the repeats."""
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), _quota(weights, 1))))


def profile_numeric(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n, min, p5 .. p95, max, mean), nulls left out, columns without values left out."""
    long = rows.select(*(F.col(c).cast("double").alias(c) for c in columns)).unpivot([], list(columns), "column", "v").where("v IS NOT NULL")
    a = long.groupBy("column").agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("m"))
    a = a.join(exact_quantiles(long, "column", "v", (0.05, 0.25, 0.5, 0.75, 0.95)).hint("merge"), "column", "left")
    r3 = lambda x, name: F.round(x, 3).alias(name)
    return a.select("column", "n", r3(F.col("lo"), "min"), *(r3(F.col("p")[i], name) for i, name in enumerate(("p5", "p25", "p50", "p75", "p95"))), r3(F.col("hi"), "max"), r3(F.col("m"), "mean"))


def profile_flags(rows: DataFrame) -> DataFrame:
    """(flag, share) for each problem, any problem, and a skew over 2."""
    marks = F.concat(F.col("problems"), F.when(F.size("problems") > 0, F.array(F.lit("any"))).otherwise(F.array().cast("array<string>")), F.when(F.abs("skew") > 2, F.array(F.lit("skewed"))).otherwise(F.array().cast("array<string>")))
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    hits = rows.select(F.explode(marks).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("k"))
    return hits.join(F.broadcast(n)).select("flag", F.round(F.col("k") / F.col("n"), 4).alias("share"))  # one row


def key_frequency(rows: DataFrame, text: str) -> DataFrame:
    """(level, key, n): how many objects at a level of the JSON texts have a key. The outermost level is '', others are paths
    such as `a.b` or `items[]` (objects in that list). Null and broken texts, and those that repeat a key, have no keys.

    The deepest nesting is one number, from the texts' brackets; then each level is one explode of the level above it.
    """
    spark = rows.sparkSession
    at = rows.select(F.try_parse_json(text).alias("v"), F.lit("").alias("level")).where("v IS NOT NULL")
    bare = F.regexp_replace(F.regexp_replace(F.to_json("v"), r"\\.", ""), '"[^"]*"', "")  # without escapes, then without strings
    marks = F.regexp_replace(bare, r"[^\[\]{}]", "")
    start = F.expr("named_struct('now', 0, 'most', 0)")

    def move(x: Column, c: Column) -> Column:
        now = x["now"] + F.when(c.isin("{", "["), 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(x["most"], now).alias("most"))

    deep = at.agg(F.max(F.aggregate(F.filter(F.split(marks, ""), lambda c: c != ""), start, move)["most"])).first()[0] or 0
    found = None
    for _ in range(deep):
        part = at.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("level", "key", "value")
        keys = part.where("key IS NOT NULL").select("level", "key")
        found = keys if found is None else found.unionByName(keys)
        name = F.when(F.col("key").isNull(), F.concat("level", F.lit("[]"))).when(F.col("level") == "", F.col("key")).otherwise(F.concat_ws(".", "level", "key"))
        at = part.where(F.schema_of_variant("value").rlike("^(OBJECT|ARRAY)")).select(F.col("value").alias("v"), name.alias("level"))
    if found is None:
        found = at.select("level", F.lit("").alias("key")).limit(0)
    return found.groupBy("level", "key").agg(F.count(F.lit(1)).alias("n"))


def charge_prevalence(bills: DataFrame, charges: DataFrame) -> DataFrame:
    """(type, share): share of bills that have a charge type."""
    n = bills.agg(F.count(F.lit(1)).alias("n"))
    has = charges.groupBy("bill_id", "type").agg(F.lit(1).alias("x")).groupBy("type").agg(F.count("x").alias("k"))
    return has.join(F.broadcast(n)).select("type", F.round(F.col("k") / F.col("n"), 4).alias("share"))  # one row


def dataset_profile(bills: DataFrame, items: DataFrame, consistent: DataFrame) -> DataFrame:
    """Per split: bills, items per bill, share with items, consistent share of those, mean quantity and share over 1.

    If items have a column `nested`, also the share of bills with an item that holds further items.
    """
    deep = "nested" in items.columns
    i = items.groupBy("bill_id").agg(F.bool_or("nested" if deep else F.lit(False)).alias("deep"), F.count(F.lit(1)).alias("k"), F.sum("qty").alias("q"), F.count_if(F.col("qty") > 1).alias("many"))
    rows = bills.join(i, "bill_id", "left").join(consistent.select("bill_id", F.lit(1).alias("ok")), "bill_id", "left")
    r4 = lambda x, name: F.round(x, 4).alias(name)
    return rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), r4(F.sum("k") / F.count(F.lit(1)), "items_per_bill"), r4(F.count("k") / F.count(F.lit(1)), "with_items"),
        r4(F.count_if(F.col("k").isNotNull() & F.col("ok").isNotNull()) / F.count("k"), "consistent"), r4(F.sum("q") / F.sum("k"), "mean_qty"), r4(F.sum("many") / F.sum("k"), "qty_over_one"),
        *([r4(F.count_if(F.coalesce("deep", F.lit(False))) / F.count(F.lit(1)), "nested")] if deep else []),
    )


def keyword_rates(docs: DataFrame, keywords: Sequence[str], first: int | None = None) -> DataFrame:
    """(keyword, share, lines_per_doc) over all documents, or the first so many by id."""
    rows = docs.orderBy("doc_id").limit(first) if first else docs
    upper = F.upper(F.coalesce("text", F.lit("")))
    lines = F.avg(F.size(F.split(F.coalesce("text", F.lit("")), "\n")))
    a = rows.agg(lines.alias("lines"), *(F.avg(upper.contains(k).cast("int")).alias(k) for k in keywords))
    long = a.unpivot(["lines"], [F.col(f"`{k}`") for k in keywords], "keyword", "share")
    return long.select("keyword", F.round("share", 4).alias("share"), F.round("lines", 4).alias("lines_per_doc"))
