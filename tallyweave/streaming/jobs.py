"""Structured Streaming jobs: validation after edits, repeated uploads, stalls, guards, load windows, drift.

Results don't depend on how the input falls into micro-batches: a gate (`admit`) holds each row against the newest event
time of the batches before it, lets through what is less than `delay` behind and puts the rest into a dead-letter table, so
that nothing is lost unseen; the jobs behind it use the same delay as their watermark and so never drop a row. What is not
yet final when the input ends (windows, sessions and records within the delay of its newest row) stays in the state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyweave.operators.runs import exact_mean
from tallyweave.operators.validate import check_arithmetic
from tallyweave.sources.readers import shared_path
from tallyweave.streaming.tables import KeyedLog, batches, ensure, publish, remove

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DELAY = "6 hours"


def stream_of(rows: DataFrame, name: str) -> DataFrame:
    """A batch table as a file stream: written to the shared folder, read with readStream."""
    path = shared_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).parquet(path)


def finish(stream: DataFrame, name: str, mode: str = "append", job: str | None = None) -> DataFrame:
    """Runs the stream over all that is there and returns its sink table.

    job: a lasting folder of the caller's for checkpoint and sink; a call with the same folder goes on where the last ended.
    """
    spark = stream.sparkSession
    job = job or shared_path(spark, name)
    path = f"{job}/out"
    _with_rocksdb(spark, lambda: stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", f"{job}/checkpoint").trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(stream.schema).parquet(path)


def _with_rocksdb(spark: SparkSession, run: Callable[[], None]) -> None:
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)
    try:
        run()
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def event_time(rows: DataFrame, column: str = "ts") -> DataFrame:
    """Watermarks need TIMESTAMP, not TIMESTAMP_NTZ."""
    return rows.withColumn(column, F.col(column).cast("timestamp"))


def admit(stream: DataFrame, job: str, delay: str = DELAY, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """(admitted rows as a stream, dead letters): runs the gate over all that is there.

    A row is admitted if its event time is less than `delay` behind the newest one of the batches before its own. Rows without
    an event time are dead letters too. job: a lasting folder, as for finish. Each batch is written once, also if it is tried
    again after a failure; dead letters carry the number of their batch.
    """
    spark, schema = stream.sparkSession, stream.schema

    def gate(batch: DataFrame, n: int) -> None:
        before = [k for k in batches(spark, f"{job}/newest") if k < n]
        newest = spark.read.parquet(f"{job}/newest/batch={before[-1]}").first()["newest"] if before else None  # one row
        micros = F.unix_micros(F.col(ts).cast("timestamp"))
        bound = F.unix_micros(F.timestamp_micros(F.lit(newest)) - F.expr(f"INTERVAL {delay}"))
        in_time = F.col(ts).isNotNull() if newest is None else F.coalesce(micros > bound, F.lit(False))
        publish(batch.where(~in_time), f"{job}/late", n)
        publish(batch.where(in_time), f"{job}/admitted", n)
        publish(batch.agg(F.greatest(F.max(micros), F.lit(newest).cast("long")).alias("newest")), f"{job}/newest", n)
        remove(spark, f"{job}/newest", before[:-1])

    stream.writeStream.foreachBatch(gate).option("checkpointLocation", f"{job}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    admitted = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(ensure(spark, f"{job}/admitted"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return admitted, spark.read.schema(f"{fields}, batch int").parquet(ensure(spark, f"{job}/late"))


def replay(rows: DataFrame, by: str, parts: int, build: Callable[[DataFrame], DataFrame], name: str, delay: str = DELAY) -> tuple[DataFrame, DataFrame]:
    """(result, dead letters) of a job over rows that arrive in so many parts, numbered in column `by`.

    Gate and job stop after each part and go on from their checkpoints with the next one.
    """
    spark, job = rows.sparkSession, shared_path(rows.sparkSession, name)
    plain = rows.drop(by)
    found = late = None
    for n in range(parts):
        rows.where(F.col(by) == n).drop(by).write.mode("append").parquet(f"{job}/in")
        admitted, late = admit(spark.readStream.schema(plain.schema).parquet(f"{job}/in"), f"{job}/gate", delay)
        found = finish(build(admitted), name, job=f"{job}/job")
    return found, late


EDITS = "bill_id long, path string, seq int, cents long"
ISSUES = "array<struct<path:string,severity:string,message:string,suggest_path:string,suggest_value:string>>"
CHECKED = f"bill_id long, issues {ISSUES}"
#: Rows of a batch's bills up to which they are broadcast to filter the bill tables.
SMALL = 200_000


def validate_edits(edits: DataFrame, bills: DataFrame, items: DataFrame, charges: DataFrame, job: str | None = None, every: int = 20) -> DataFrame:
    """Issues after a stream of edits (bill_id, path, seq, cents) to bill totals: of a path's edits the one with the largest
    seq wins, so stale edits change nothing; of equal seqs the later batch.

    All bills are checked when the job starts. From then on a micro-batch appends its last edits to a log, and checks only
    its own bills, whose issues replace those they had. The logs are merged every so many batches (KeyedLog).

    job: a lasting folder of the caller's for state and checkpoint; a call with the same folder goes on where the last one
    ended. Edits of unknown bills are kept and change nothing.
    """
    spark = edits.sparkSession
    job = job or shared_path(spark, "edit-job")
    log = KeyedLog(f"{job}/edits", EDITS, ["bill_id", "path"], order="seq", every=every)
    checked = KeyedLog(f"{job}/checked", CHECKED, ["bill_id"], every=every)

    def check(some: DataFrame, i: DataFrame, c: DataFrame) -> DataFrame:
        found = check_arithmetic(some, i, c)
        per = found.groupBy("bill_id").agg(F.collect_list(F.struct("path", "severity", "message", "suggest_path", "suggest_value")).alias("found"))  # one bill's issues
        return some.select("bill_id").join(per.hint("merge"), "bill_id", "left").select("bill_id", F.coalesce("found", F.array().cast(ISSUES)).alias("issues"))

    def step(batch: DataFrame, n: int) -> None:
        rows = batch.select("bill_id", "path", F.col("seq").cast("int").alias("seq"), F.col("cents").cast("long").alias("cents"))
        log.append(rows, n)
        touched = spark.read.parquet(f"{job}/edits/log/batch={n}").select("bill_id").distinct()
        n_touched = touched.count()
        if n_touched:
            how = "broadcast" if n_touched <= SMALL else "merge"
            buckets = [r.bucket for r in touched.select(log.bucket()).distinct().collect()]  # at most log.buckets
            only = lambda t: t.join(touched.hint(how), "bill_id", "left_semi")
            pick = lambda p: F.max(F.when(F.col("path") == p, F.col("cents"))).alias(p)
            now = only(log.current(spark, n, buckets)).groupBy("bill_id").agg(pick("subtotal"), pick("grand_total"))
            some = only(bills).join(now.hint("merge"), "bill_id", "left").withColumn("subtotal_cents", F.coalesce("subtotal", "subtotal_cents")).withColumn("grand_cents", F.coalesce("grand_total", "grand_cents")).drop("subtotal", "grand_total")
            checked.append(check(some, only(items), only(charges)), n)
        log.compact(spark, n)
        checked.compact(spark, n)

    checked.append(check(bills, items, charges), -1)
    edits.writeStream.foreachBatch(step).option("checkpointLocation", f"{job}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return checked.current(spark).select("bill_id", F.explode("issues").alias("x")).select("bill_id", "x.*")


def dedup_uploads(uploads: DataFrame, keep: str = "2 hours", delay: str = DELAY) -> DataFrame:
    """(content_hash, ts, uploads): the upload that had to be worked on, and how many it answers.

    An answer is kept as long as the same content comes again within `keep`, so it is the first upload of each session; it
    is final once the session is closed. One row of fixed size is held for an open session.
    """
    s = event_time(uploads).withWatermark("ts", delay).groupBy("content_hash", F.session_window("ts", keep)).agg(F.min("ts").alias("ts"), F.count(F.lit(1)).alias("uploads"))
    return s.select("content_hash", F.col("ts").cast("timestamp_ntz").alias("ts"), "uploads")


def stall_sessions(beats: DataFrame, limit: str = "12 hours", delay: str = DELAY) -> DataFrame:
    """(run, stalled_after, beats): sessions of heartbeats that ended because nothing came within the limit."""
    s = event_time(beats).withWatermark("ts", delay).groupBy("run", F.session_window("ts", limit)).agg(F.max("ts").alias("stalled_after"), F.count(F.lit(1)).alias("beats"))
    return s.select("run", F.col("stalled_after").cast("timestamp_ntz").alias("stalled_after"), "beats")


def load_windows(requests: DataFrame, size: str = "1 hour", slide: str | None = None, delay: str = DELAY) -> DataFrame:
    """(level, start, n, mean, p50, p95, longest) of closed windows, tumbling or sliding. Percentiles are approximate (state of
    fixed size): one of the window's values, exact up to some thousand of them."""
    w = event_time(requests).withWatermark("ts", delay).groupBy("level", F.window("ts", size, slide).alias("w"))
    p = F.percentile_approx("value", [0.5, 0.95], 10_000)
    a = w.agg(F.count(F.lit(1)).alias("n"), exact_mean("value", 4).alias("mean"), p.alias("p"), F.max("value").alias("longest"))
    return a.select("level", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "mean", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"), "longest")


def score_drift(readings: DataFrame, thresholds: DataFrame, size: str = "6 hours", delay: str = DELAY) -> DataFrame:
    """(kind, start, n, flagged): share of readings under their kind's threshold in closed windows.

    thresholds are static: broadcast where there are at most SMALL of them, merged otherwise.
    """
    how = "broadcast" if thresholds.count() <= SMALL else "merge"
    rows = event_time(readings).withWatermark("ts", delay).join(thresholds.hint(how), "kind")
    a = rows.groupBy("kind", F.window("ts", size).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("p") < F.col("threshold")).cast("int")).alias("f"))
    return a.select("kind", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", F.round("f", 4).alias("flagged"))


class _Guard(StatefulProcessor):
    """Holds back a run's records until the watermark has passed them, then applies the rules in order of epochs."""

    fresh = (0, float("inf"), float("nan"), 0, -1)  # bad epochs in a row, least and last finite loss, whether by_epoch came, last event time done

    def __init__(self, streak: int, factor: float, jump: float, by_epoch: int, least: float, forget_ms: int):
        self.rules = (streak, factor, jump, by_epoch, least)
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "epoch int, at long, loss double, score double")
        self.past = handle.getValueState("past", "in_row int, low double, before double, seen int, done long, last long, due long")

    def _wait(self, old: int, new: int) -> int:
        """One timer a run, at its earliest record held: when it expires all records that are due are taken."""
        if new != old:
            if old >= 0:
                self.handle.deleteTimer(old)
            if new >= 0:
                self.handle.registerTimer(new)
        return new

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: list[tuple] = []
        for frame in rows:
            at = frame["ts"].astype("datetime64[ms]").astype("int64").tolist()
            new += [(int(epoch), t, loss, score) for epoch, t, loss, score in zip(frame["epoch"].tolist(), at, frame["loss"].tolist(), frame["score"].tolist())]
        if new:
            past = self.past.get() if self.past.exists() else (*self.fresh, -1, -1)
            self.held.appendList(new)
            first, last = min(r[1] for r in new), max(past[5], *(r[1] for r in new))
            if last != past[5]:
                if past[5] >= 0:
                    self.handle.deleteTimer(past[5] + self.forget_ms + 2)
                self.handle.registerTimer(last + self.forget_ms + 2)
            due = self._wait(past[6], first if past[6] < 0 else min(past[6], first))  # after that, as the times may be the same
            self.past.update((*past[:5], last, due))
        yield pd.DataFrame({"run": pd.Series(dtype="int64"), "epoch": pd.Series(dtype="int32"), "rule": pd.Series(dtype="str")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        out = []
        if self.past.exists():
            in_row, low, before, seen, done, last, wait = self.past.get()
            held = {r[0]: tuple(r) for r in self.held.get()} if self.held.exists() else {}  # the later of an epoch's records
            due = sorted(r for r in held.values() if r[1] <= now)
            streak, factor, jump, by_epoch, least = self.rules
            for epoch, at, loss, score in due:
                if done >= 0 and at - done > self.forget_ms:  # whether or not the state was cleared in between
                    in_row, low, before, seen, done = self.fresh
                done, found = max(done, at), []
                if loss is None or loss != loss or abs(loss) == float("inf"):
                    in_row += 1
                    found += ["non_finite"] + ["non_finite_streak"] * (in_row == streak)
                else:
                    in_row = 0
                    found += ["zero_loss"] * (loss < 1e-5) + ["diverged"] * (epoch >= 3 and loss > factor * low) + ["jumped"] * (before == before and loss > jump * before)
                    low, before = min(low, loss), loss
                if epoch >= by_epoch:
                    found += ["not_learning"] * (not seen and score is not None and score < least)
                    seen = 1
                out += [(key[0], epoch, rule) for rule in found]
            left = [r for r in held.values() if r[1] > now]
            if due and left:
                self.held.put(left)
            elif due:
                self.held.clear()
            fired = expiredTimerInfo.getExpiryTimeInMs()
            wait = self._wait(-1 if wait == fired else wait, min((r[1] for r in left), default=-1))
            if last + self.forget_ms < now:
                self.past.clear()
            else:
                self.past.update((in_row, float(low), float(before), seen, done, last, wait))
        yield pd.DataFrame(out, columns=["run", "epoch", "rule"]).astype({"run": "int64", "epoch": "int32"})

    def close(self) -> None:
        pass


def stream_run_guards(log: DataFrame, streak: int = 3, factor: float = 3.0, jump: float = 5.0, by_epoch: int = 4, least: float = 0.2, delay: str = DELAY, forget_days: float = 30) -> DataFrame:
    """(run, epoch, rule) as run_guards has them, for records (run, epoch, loss, score, ts) in any order within the delay.

    A run's state is its records of the last `delay` and a few numbers; after more than forget_days without a record a run
    starts anew, and its state is removed. Of records that repeat an epoch within the delay the later one counts.
    """
    rows = event_time(log).withWatermark("ts", delay).select("run", "epoch", "loss", "score", "ts")
    guard = _Guard(streak, factor, jump, by_epoch, least, int(forget_days * 86_400_000))
    return rows.groupBy("run").transformWithStateInPandas(guard, "run long, epoch int, rule string", "Append", "EventTime")
