"""Logs of runs and requests: token streams, guards, latency, throughput, curves, capacity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.operators.quantiles import exact_quantiles, index
from tallyweave.operators.scans import before, in_ranges


def exact_mean(x: str | Column, places: int = 6) -> Column:
    """The mean of numbers, rounded half up to so many places (9 at most): exact sums of billionths, so no order of adding shows.

    Nulls, NaN and numbers of 1e18 and more in size (infinities too) don't count; without others the mean is null.
    """
    x = F.col(x) if isinstance(x, str) else x
    x = F.when(F.abs(x) < 1e18, x)  # NaN is above every number
    unit = 10 ** (9 - places)
    s, n = F.sum(F.round(x * 1_000_000_000).cast("decimal(28,0)")), F.count(x)
    top, bottom = (2 * s + unit * n).cast("decimal(38,0)"), (2 * unit * n).cast("decimal(20,0)")
    return ((top - F.pmod(top, bottom)) / bottom).cast("double") / 10**places


def _kind(x: Column) -> Column:
    """1 for a tag that opens, -1 for one that closes, 0 for a separator, null for text."""
    tag = lambda head: x.startswith(head) & (F.length(x) > len(head) + 1)
    return F.when(x.startswith("<"), F.when(x == "<sep/>", 0).when(x.endswith(">"), F.when(tag("<s_"), 1).when(tag("</s_"), -1)))


def _leaf_places(t: Column, lists: Sequence[str]) -> Column:
    """The leaves among one record's tokens as arrays [first place from 1, number of tokens, list or -1, index in the list].

    One pass over the tags. What was found is carried as text, since an aggregate copies its state at each step.
    """
    start = [F.lit(0).alias(f"{x}{n}") for x in ("depth", "seps") for n in range(len(lists))]
    init = F.struct(F.lit(-1).alias("at"), F.lit(None).cast("string").alias("key"), *start, F.lit("").alias("found"))

    def named(m):
        head = F.when(m["kind"] == 1, 4).otherwise(5)
        return F.struct(m["at"].alias("at"), m["kind"].alias("kind"), F.when(m["kind"] != 0, F.substring(m["token"], head, F.length(m["token"]) - head)).alias("name"))

    def step(s, m):
        inside, idx = F.lit(-1), F.lit(0)
        for n in range(len(lists)):
            inside, idx = F.when(s[f"depth{n}"] > 0, n).otherwise(inside), F.when(s[f"depth{n}"] > 0, s[f"seps{n}"]).otherwise(idx)
        depths = [F.when(m["name"] == k, s[f"depth{n}"] + m["kind"]).otherwise(s[f"depth{n}"]).alias(f"depth{n}") for n, k in enumerate(lists)]
        seps = [F.when((m["kind"] == 0) & (inside == n), s[f"seps{n}"] + 1).otherwise(s[f"seps{n}"]).alias(f"seps{n}") for n in range(len(lists))]
        # A leaf counts only if its own tag closes right after it.
        leaf = (m["kind"] == -1) & (m["at"] - s["at"] > 1) & (m["name"] == s["key"])
        place = F.concat_ws(" ", *(x.cast("string") for x in (s["at"] + 2, m["at"] - s["at"] - 1, inside, idx)))
        found = F.when(leaf, F.concat(s["found"], place, F.lit(";"))).otherwise(s["found"])
        return F.struct(m["at"].alias("at"), F.when(m["kind"] == 1, m["name"]).otherwise(s["key"]).alias("key"), *depths, *seps, found.alias("found"))

    marks = F.transform(t, lambda x, at: F.struct(at.alias("at"), _kind(x["token"]).alias("kind"), x["token"].alias("token")))
    tags = F.transform(F.filter(marks, lambda m: m["kind"].isNotNull()), named)
    places = F.filter(F.split(F.aggregate(tags, init, step, lambda s: s["found"]), ";"), lambda x: x != "")
    return F.transform(places, lambda x: F.split(x, " ").cast("array<int>"))


def fields_from_tokens(tokens: DataFrame, lists: Sequence[str] = ("items", "charges"), stop: Sequence[str] = ("</s>", "<pad>")) -> DataFrame:
    """(bill_id, path, value, p_first, p_mean, p_min) from a tagged token stream.

    Takes a row a token (bill_id, pos, token, prob), which are gathered by bill, or a row a record (bill_id, tokens) with an
    array of (token, prob) in order, which needs no shuffle. A record is read inside its row: tags and separators part the
    tokens, the text between is a leaf. The index in a list is the number of separators seen in it. Leaves without text give
    no row; the stream ends at a stop token.
    """
    if "tokens" not in tokens.columns:
        tokens = tokens.groupBy("bill_id").agg(F.sort_array(F.collect_list(F.struct("pos", "token", "prob"))).alias("tokens"))  # one record's tokens
    t = tokens.where("bill_id IS NOT NULL").select("bill_id", F.filter("tokens", lambda x: x["token"].isNotNull()).alias("t"))
    end = F.array_position(F.transform("t", lambda x: x["token"].isin(list(stop))), F.lit(True)).cast("int")
    t = t.select("bill_id", F.slice("t", F.lit(1), F.coalesce(F.nullif(end, F.lit(0)) - 1, F.size("t"))).alias("t"))

    def leaf(x):
        close = F.col("t")[x[0] + x[1] - 1]["token"]
        name = F.substring(close, F.lit(5), F.length(close) - 5)
        path = F.when(x[2] < 0, name).otherwise(F.concat(F.array(*map(F.lit, lists))[x[2]], F.lit("["), x[3].cast("string"), F.lit("]."), name)) if lists else name
        return F.struct(path.alias("path"), F.transform(F.sequence(x[0], x[0] + x[1] - 1), lambda i: F.col("t")[i - 1]).alias("part"))  # a slice would read the whole array for each leaf

    t = t.select("bill_id", F.explode(F.transform(_leaf_places(F.col("t"), lists), leaf)).alias("leaf")).select("bill_id", "leaf.path", "leaf.part")
    value = F.trim(F.regexp_replace(F.array_join("part.token", ""), "^<(.*)/>$", "$1"))
    known = F.filter("part.prob", lambda p: p.isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda s, p: s + p.cast("double")) / F.nullif(F.size(known), F.lit(0))
    return t.select("bill_id", "path", value.alias("value"), F.round(F.col("part")[0]["prob"], 6).alias("p_first"), F.round(mean, 6).alias("p_mean"), F.round(F.array_min("part.prob"), 6).alias("p_min"))


def new_best(log: DataFrame, ranges: int | None = None) -> DataFrame:
    """Epochs whose score beats all earlier ones of the run. A run's epochs may lie over many ranges (`ranges`: how many in all)."""
    t = before(in_ranges(log.select("run", "epoch", "score"), ["run", "epoch"], ranges), ["run"], ["epoch"], best_before=("max", "score"))
    return t.where(F.col("best_before").isNull() | (F.col("score") > F.col("best_before"))).select("run", "epoch", "score")


def run_guards(log: DataFrame, streak: int = 3, factor: float = 3.0, jump: float = 5.0, by_epoch: int = 4, least: float = 0.2, ranges: int | None = None) -> DataFrame:
    """(run, epoch, rule): the epochs at which a rule is first broken in each stretch.

    non_finite: the loss is NaN or infinite; non_finite_streak: the k-th such epoch in a row; zero_loss: under 1e-5; diverged:
    from epoch 3 on over factor times the least finite loss before; jumped: over `jump` times the previous finite loss;
    not_learning: the first epoch from by_epoch on scores under `least`.

    What a rule needs of earlier epochs is carried from range to range of a run's epochs (`ranges`: how many in all). Records
    without a run are left out.
    """
    bad = F.isnan("loss") | (F.abs("loss") == float("inf")) | F.col("loss").isNull()
    t = log.select("run", "epoch", "score", bad.alias("bad"), F.when(~bad, F.col("loss")).alias("ok"), (F.col("epoch") >= by_epoch).cast("int").alias("late"))
    t = in_ranges(t, ["run", "epoch"], ranges)
    t = before(t, ["run"], ["epoch"], at=("sum", F.lit(1)), late_before=("sum", "late"), least_before=("min", "ok"), before=("last", "ok"))
    t = before(t, ["run"], ["epoch"], ok_at=("last", F.when(~F.col("bad"), F.col("at"))))
    in_row = F.when(F.col("bad"), F.col("at") - F.coalesce("ok_at", F.lit(-1)))
    rule = lambda test, name: F.when(F.coalesce(test, F.lit(False)), name)
    rules = F.array_compact(F.array(
        rule(F.col("bad"), "non_finite"), rule(in_row == streak, "non_finite_streak"), rule(F.col("ok") < 1e-5, "zero_loss"),
        rule((F.col("epoch") >= 3) & (F.col("ok") > factor * F.col("least_before")), "diverged"), rule(F.col("ok") > jump * F.col("before"), "jumped"),
        rule((F.col("late") == 1) & (F.col("late_before") == 0) & (F.col("score") < least), "not_learning"),
    ))
    return t.select("run", "epoch", F.explode(rules).alias("rule"))


def stall_gaps(beats: DataFrame, limit_s: int) -> DataFrame:
    """(run, stalled_at): heartbeats after which nothing came for longer than the limit, the last of a run included."""
    w = Window.partitionBy("run").orderBy("ts")
    gap = F.unix_micros(F.lead("ts").over(w)) - F.unix_micros("ts")
    return beats.withColumn("gap", gap).where(F.col("gap").isNull() | (F.col("gap") >= limit_s * 1_000_000)).select("run", F.col("ts").alias("stalled_at"))


def latency_stats(rows: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """(group, n, p50, p95, mean, longest) with percentiles by place floor(n q) in the sorted values.

    Nulls and NaN don't count, and a group without other values has no row. Places are found by ranges of all values, so a
    group may have more values than a task can take.
    """
    v = rows.select(F.struct(*group).alias("of"), F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    a = v.groupBy("of").agg(F.count(F.lit(1)).alias("n"), exact_mean("v", 4).alias("mean"), F.max("v").alias("longest"))
    p = exact_quantiles(v, "of", "v", (0.5, 0.95), index)
    a = a.join(p.hint("merge"), "of")
    return a.select("of.*", "n", F.round(F.col("p")[0], 4).alias("p50"), F.round(F.col("p")[1], 4).alias("p95"), "mean", F.round("longest", 4).alias("longest"))


def stage_breakdown(rows: DataFrame, warmup: int = 2) -> DataFrame:
    """(stage, n, p50, p95, mean, longest, ms_per_token): derived stages of requests (req, h2d, enc, gen, tokens), warm-up left out.

    decode = max(gen - enc, 0); the total leaves the second encoder pass out; ms per token is a ratio of sums.
    """
    t = rows.where(F.col("req") >= warmup).withColumn("decode", F.greatest(F.col("gen") - F.col("enc"), F.lit(0.0)))
    t = t.withColumn("total", F.col("h2d") + F.col("enc") + F.col("decode"))
    long = t.unpivot([], ["h2d", "enc", "decode", "total"], "stage", "v")
    per = t.agg(F.round(F.sum("decode") * 1000 / F.sum("tokens"), 4).alias("ms"))
    stats = latency_stats(long.withColumn("v", F.round("v", 6)), ["stage"], "v")
    return stats.join(F.broadcast(per)).withColumn("ms_per_token", F.when(F.col("stage") == "decode", F.col("ms"))).drop("ms")  # one row


def throughput(rows: DataFrame, group: str) -> DataFrame:
    """(group, n, errors, seconds, per_second, p50, p95, mean, longest) of requests with start, end (seconds) and ok.

    Latencies are those of requests that ended well, by place as in latency_stats; null where none did.
    """
    a = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("ok")).alias("errors"), (F.max("end") - F.min("start")).alias("s"))
    took = latency_stats(rows.where("ok").select(group, F.round(F.col("end") - F.col("start"), 4).alias("took")), [group], "took").drop("n")
    a = a.join(took.hint("merge"), group, "left")
    return a.select(group, "n", "errors", F.round("s", 3).alias("seconds"), F.round(F.try_divide(F.col("n") - F.col("errors"), F.col("s")), 4).alias("per_second"), "p50", "p95", "mean", "longest")


def curve_table(log: DataFrame, series: Sequence[str]) -> DataFrame:
    """(epoch, loss, <series>...): mean loss and one column for each validation series of log (epoch, loss, val map)."""
    base = log.groupBy("epoch").agg(exact_mean("loss").alias("loss"))
    long = log.select("epoch", F.explode("val").alias("series", "v"))
    wide = long.groupBy("epoch").agg(*(exact_mean(F.when(F.col("series") == s, F.col("v"))).alias(s) for s in series))
    return base.join(wide.hint("merge"), "epoch", "left")


def capacity_plan(rows: DataFrame, ts: str, seconds: float = 0.5, peak: float = 3.0, use: float = 0.6) -> DataFrame:
    """(hour, n, units): units to serve an hour's requests at `peak` times the average rate and `use` of full load."""
    a = rows.groupBy(F.date_trunc("hour", ts).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return a.select("hour", "n", F.ceil(F.round(F.col("n") / 3600 * peak * seconds / use, 9)).cast("long").alias("units"))
