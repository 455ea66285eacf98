"""Streams give one answer however the input falls into micro-batches, and lose no row unseen."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import runs as R
from tallyweave.sources import readers as S
from tallyweave.streaming import jobs as J
from tallyweave.streaming.tables import KeyedLog, batches, publish

START = datetime.datetime(2024, 3, 1)
SCHEMA = "run long, epoch int, loss double, score double, ts timestamp_ntz, level string, value double, content_hash string"


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """A state store for each partition and batch costs more than these few rows."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def events(n=300, hours=30, seed=1):
    """Rows over 30 hours whose order of arrival is up to 5 hours off their event times."""
    r = random.Random(seed)
    at = sorted(r.random() * hours * 3600 for _ in range(n))
    rows, epochs = [], {}
    for i, s in enumerate(at):
        run = r.randrange(6)
        epochs[run] = epochs.get(run, 0) + 1
        loss = r.choice([float("nan"), 1e-6, None, 9.0, 1.0, 1.0, 2.0, 0.5])
        rows.append((run, epochs[run], loss, r.random(), START + datetime.timedelta(seconds=s), "ab"[i % 2], float(r.randrange(100)), str(r.randrange(40))))
    return rows, sorted(range(n), key=lambda i: at[i] + r.random() * 5 * 3600)


def run_in_files(spark, folder, rows, files, build):
    """The job's rows and the dead letters when the rows come in so many files, one to a micro-batch at the gate and in the job."""
    size = -(-len(rows) // files)
    for k in range(files):
        spark.createDataFrame(rows[k * size : (k + 1) * size], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    admitted, late = J.admit(stream, f"{folder}/gate", "6 hours")
    assert len(batches(spark, f"{folder}/gate/admitted")) == files
    again = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", max(1, -(-files // 3))).option("recursiveFileLookup", True).parquet(f"{folder}/gate/admitted")
    return sorted(map(repr, J.finish(build(again), "test", job=f"{folder}/job").collect())), late


JOBS = {
    "sessions": lambda s: J.stall_sessions(s, "1 hour"),
    "windows": J.load_windows,
    "sliding": lambda s: J.load_windows(s, "1 hour", "30 minutes"),
    "uploads": lambda s: J.dedup_uploads(s, "90 minutes"),
    "guards": J.stream_run_guards,
}


@pytest.mark.parametrize("name", JOBS)
def test_any_batching_gives_the_same_rows(spark, tmp_path, name):
    rows, order = events()
    arrived = [rows[i] for i in order]
    one, late_one = run_in_files(spark, f"{tmp_path}/1", arrived, 1, JOBS[name])
    eight, late_eight = run_in_files(spark, f"{tmp_path}/8", arrived, 8, JOBS[name])
    assert one and one == eight and late_one.count() == late_eight.count() == 0
    if name == "guards":  # and what the batch job says of the records that the watermark has passed
        upto = max(r[4] for r in rows) - datetime.timedelta(hours=6)
        log = spark.createDataFrame([r for r in rows if r[4] <= upto], SCHEMA)
        assert eight == sorted(map(repr, R.run_guards(log).collect()))


def test_late_rows_are_kept_apart_and_counted(spark, tmp_path):
    rows, _ = events(60)
    far = [(9, 1, 1.0, 0.5, START - datetime.timedelta(days=2), "a", 1.0, "z"), (9, 1, 1.0, 0.5, None, "a", 1.0, "z")]
    for part in (rows, far):
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        _, late = J.admit(stream, f"{tmp_path}/gate", "6 hours")
    assert sorted((r.run, r.batch) for r in late.collect()) == [(9, 1), (9, 1)]
    kept = spark.read.option("recursiveFileLookup", True).schema(SCHEMA).parquet(f"{tmp_path}/gate/admitted")
    assert kept.count() == len(rows) and kept.where("run = 9").count() == 0


def test_a_forgotten_run_starts_anew(spark, tmp_path):
    hour = lambda h: START + datetime.timedelta(hours=h)
    row = lambda run, epoch, loss, h: (run, epoch, loss, 0.9, hour(h), "a", 1.0, "z")
    rows = [row(1, 1, 1.0, 0), row(2, 1, 1.0, 0), row(2, 2, 1.0, 20), row(2, 3, 1.0, 40), row(2, 4, 1.0, 60), row(1, 2, 9.0, 70), row(2, 5, 9.0, 71), row(3, 1, 1.0, 90), row(3, 2, 1.0, 91)]
    found, _ = run_in_files(spark, f"{tmp_path}", rows, 9, lambda s: J.stream_run_guards(s, forget_days=1.5))
    assert found == ["Row(run=2, epoch=5, rule='diverged')", "Row(run=2, epoch=5, rule='jumped')"]  # run 1 was forgotten, its 9.0 is a first loss


def test_published_batches_are_written_once(spark, tmp_path):
    publish(spark.range(3), f"{tmp_path}/t", 0)
    publish(spark.range(5), f"{tmp_path}/t", 0)
    assert batches(spark, f"{tmp_path}/t") == [0] and spark.read.parquet(f"{tmp_path}/t").count() == 3


def test_keyed_log(spark, tmp_path):
    """Last row by order, then batch; a batch run again changes nothing; merging keeps the rows and drops the files."""
    log = KeyedLog(f"{tmp_path}/log", "k long, seq int, v int", ["k"], order="seq", every=3, buckets=4)
    plain = {}
    r = random.Random(2)
    for n in range(8):
        rows = [(r.randrange(20), r.randrange(6), n * 100 + i) for i in range(10)]
        one = {}
        for k, seq, v in rows:
            if k not in one or (seq, v) >= one[k]:
                one[k] = (seq, v)
        for k, e in one.items():
            if k not in plain or e[0] >= plain[k][0]:
                plain[k] = e
        for _ in range(2):  # as after a failure
            log.append(spark.createDataFrame([(k, s, v) for k, (s, v) in one.items()], "k long, seq int, v int"), n)
            log.compact(spark, n)
        assert {x.k: (x.seq, x.v) for x in log.current(spark).collect()} == plain
    assert len(batches(spark, f"{tmp_path}/log/log")) <= 4 and len(batches(spark, f"{tmp_path}/log/merged")) == 1
    some = log.current(spark, buckets=[1, 2])
    assert {x.bucket for x in some.select(log.bucket()).distinct().collect()} <= {1, 2} and 0 < some.count() < len(plain)


def test_edit_stream_checks_only_its_bills_and_resumes(spark, tmp_path):
    schema = "bill_id long, path string, seq int, cents long"
    bills = spark.createDataFrame([(1, 40, 40), (2, 60, 60), (3, 50, 70)], "bill_id long, subtotal_cents long, grand_cents long")
    items = spark.createDataFrame([(1, 0, 1, 40, 40), (2, 0, 1, 60, 60), (3, 0, 1, 50, 50)], "bill_id long, item_idx int, qty int, unit_cents long, total_cents long")
    charges = spark.createDataFrame([], "bill_id long, charge_idx int, type string, amount_cents long")
    job = f"{tmp_path}/job"
    steps = [
        ([], set()),
        ([(1, "grand_total", 5, 5000), (9, "subtotal", 1, 1)], {1}),
        ([(1, "grand_total", 3, 40)], {1}),  # stale
        ([(1, "grand_total", 6, 40), (2, "subtotal", 1, 9000), (2, "subtotal", 2, 9000)], {2}),
        ([(2, "grand_total", 7, 9000)], {2}),
    ]
    touched = []
    for rows, want in steps:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/edits")
        found = J.validate_edits(spark.readStream.schema(schema).parquet(f"{tmp_path}/edits"), bills, items, charges, job, every=2)
        assert {r.bill_id for r in found.where("severity = 'error'").collect()} == want
        touched.append(batches(spark, f"{job}/checked/log"))
    log = KeyedLog(f"{job}/checked", J.CHECKED, ["bill_id"])
    newest = max(touched[-1])
    assert {r.bill_id for r in spark.read.parquet(f"{job}/checked/log/batch={newest}").collect()} == {2}  # the last batch checked its own bill only
    assert {r.bill_id for r in log.current(spark).collect()} == {1, 2, 3} and len(batches(spark, f"{job}/edits/log")) <= 3


def test_run_logs_follow_files_and_lines(spark, tmp_path):
    """The last record of the last file, whichever file is larger and however files are cut into blocks."""
    folder = tmp_path / "log"
    folder.mkdir()
    line = lambda e, x: f'{{"epoch": {e}, "train_loss": {x}}}\n'
    (folder / "part-0.txt").write_text(line(1, 1.0))
    (folder / "part-1.txt").write_text("noise\n" * 400 + line(1, 5.0) + line(2, 7.0) + line(1, 2.0))
    assert {(r.epoch, r.train_loss) for r in S.merge_run_logs(spark, [str(folder)]).collect()} == {(1, 2.0), (2, 7.0)}
    assert {(r.epoch, r.train_loss) for r in S.merge_run_logs(spark, [f"{folder}/part-1.txt", f"{folder}/part-0.txt"]).collect()} == {(1, 1.0), (2, 7.0)}
    (folder / "part-2.txt").write_text("".join(line(i % 7, float(i)) for i in range(20_000)))  # hot epochs over many blocks
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        rows = S.merge_run_logs(spark, [str(folder)])
        assert rows.select("epoch").count() == 7 and {(r.epoch, r.train_loss) for r in rows.collect()} == {(i % 7, float(i)) for i in range(19_993, 20_000)}
        assert S.numbered_lines(spark, str(folder)).select("file", "block").distinct().count() > 20
        assert "Window" not in rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_means_of_odd_numbers(spark):
    nan, inf = float("nan"), float("inf")
    mean = lambda *xs: spark.createDataFrame([(x,) for x in xs], "x double").agg(R.exact_mean("x").alias("m")).first().m
    assert mean(1.0, nan) == 1.0 and mean(1.0, None, inf, -inf) == 1.0 and mean(nan, None) is None
    assert mean(1e12, 3e12) == 2e12 and mean(9e17, 9e17, 9e17) == 9e17 and mean(-1.5, -2.5) == -2.0 and mean(1e18, 2.0) == 2.0
