"""Queries on streams; the SQL is each job's batch twin, with the watermark in it.

Events come in three deliveries, out of order and some of them far too late; after each one gate and job stop and go on from
their checkpoints. The twins say which rows the gate admits and up to when the last watermark closes.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.plans.fixtures import mean_sql, view
from tallyweave.plans.q_datasets import GUARDS
from tallyweave.plans.q_records import EDITS, ISSUES, edits
from tallyweave.registry import query
from tallyweave.sources.readers import shared_path
from tallyweave.streaming import jobs as J

_EDITED = f"""{EDITS}, lastedit AS (SELECT bill_id, path, max_by(value, seq) AS v FROM edits GROUP BY 1, 2), edited AS (SELECT b.bill_id, coalesce(CAST(s.v AS BIGINT) * 100, subtotal_cents) AS subtotal_cents, coalesce(CAST(g.v AS BIGINT) * 100, grand_cents) AS grand_cents
  FROM pred_bills b LEFT JOIN lastedit s ON b.bill_id = s.bill_id AND s.path = 'subtotal' LEFT JOIN lastedit g ON b.bill_id = g.bill_id AND g.path = 'grand_total')"""

#: admitted: what the gate lets through; late: the rest; wm: the watermark at the end.
_GATE = """before AS (SELECT p.part, max(q.newest) AS newest FROM (SELECT DISTINCT part FROM arrivals) p LEFT JOIN (SELECT part, max(ts) AS newest FROM arrivals GROUP BY part) q ON q.part < p.part GROUP BY p.part),
  marked AS (SELECT a.*, newest IS NULL OR ts > newest - INTERVAL 6 HOUR AS in_time FROM arrivals a JOIN before ON a.part = before.part),
  admitted AS (SELECT * FROM marked WHERE in_time), wm AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 6 HOUR AS w FROM admitted)"""


def _sessions(key: str, gap: str) -> str:
    """s(key, ts, n): admitted rows with the number of their session."""
    return f"""e AS (SELECT {key} AS k, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL {gap} THEN 1 ELSE 0 END AS fresh FROM admitted WINDOW w AS (PARTITION BY {key} ORDER BY ts)),
  s AS (SELECT k, ts, sum(fresh) OVER (PARTITION BY k ORDER BY ts) AS n FROM e)"""


def _replay(spark, d, rows, build, name):
    return J.replay(rows, "part", 3, build, name)[0]


@query("stream_validate", f"WITH {_EDITED}, {ISSUES.replace('FROM pred_bills b LEFT JOIN si', 'FROM edited b LEFT JOIN si')} SELECT bill_id, path, severity, message FROM issues")
def stream_validate(spark, d):
    """Two deliveries; some stale edits come after newer ones."""
    rows = edits(spark, d).select("bill_id", "path", "seq", (F.col("value").cast("long") * 100).alias("cents"))
    folder, found = shared_path(spark, "edits"), None
    for n in range(2):
        rows.where((F.col("bill_id") + F.col("seq")) % 2 == n).write.mode("append").parquet(folder)
        found = J.validate_edits(spark.readStream.schema(rows.schema).parquet(folder), view(spark, d, "pred_bills"), view(spark, d, "read_items"), view(spark, d, "read_charges"), f"{folder}-job")
    return found.select("bill_id", "path", "severity", "message")


_HASH = "md5(CAST(user_id AS VARCHAR) || '|' || event_type)"


@query("stream_dedup_uploads", f"WITH {_GATE}, {_sessions(_HASH, '2 HOUR')} SELECT k AS content_hash, min(ts) AS ts, count(*) AS uploads FROM s GROUP BY k, n HAVING max(ts) + INTERVAL 2 HOUR <= (SELECT w FROM wm)")
def stream_dedup_uploads(spark, d):
    rows = view(spark, d, "arrivals").select(F.md5(F.concat_ws("|", F.col("user_id").cast("string"), "event_type")).alias("content_hash"), "ts", "part")
    return _replay(spark, d, rows, J.dedup_uploads, "unique-uploads")


@query("stream_stall_sessions", f"WITH {_GATE}, {_sessions('user_id', '12 HOUR')} SELECT k AS run, max(ts) AS stalled_after, count(*) AS beats FROM s GROUP BY k, n HAVING max(ts) + INTERVAL 12 HOUR <= (SELECT w FROM wm)")
def stream_stall_sessions(spark, d):
    return _replay(spark, d, view(spark, d, "arrivals").select(F.col("user_id").alias("run"), "ts", "part"), J.stall_sessions, "stalls")


_LOAD = f"count(*) AS n, {mean_sql('value', 4)} AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS longest"


def _requests(spark, d):
    return view(spark, d, "arrivals").select(F.col("event_type").alias("level"), "ts", "value", "part")


@query("stream_load_windows", f"WITH {_GATE} SELECT event_type AS level, date_trunc('hour', ts) AS start, {_LOAD} FROM admitted GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT w FROM wm)")
def stream_load_windows(spark, d):
    return _replay(spark, d, _requests(spark, d), J.load_windows, "load")


@query("stream_load_sliding", f"""WITH {_GATE}, b AS (SELECT *, time_bucket(INTERVAL 30 MINUTE, ts) AS start FROM admitted), w AS (SELECT * FROM b UNION ALL SELECT * REPLACE (start - INTERVAL 30 MINUTE AS start) FROM b)
  SELECT event_type AS level, start, {_LOAD} FROM w GROUP BY 1, 2 HAVING start + INTERVAL 1 HOUR <= (SELECT w FROM wm)""")
def stream_load_sliding(spark, d):
    return _replay(spark, d, _requests(spark, d), lambda rows: J.load_windows(rows, "1 hour", "30 minutes"), "load")


@query("stream_score_drift", f"""WITH {_GATE}, w AS (SELECT event_type AS kind, time_bucket(INTERVAL 6 HOUR, ts) AS start, CASE WHEN value < length(event_type) * 3 THEN 1 ELSE 0 END AS f FROM admitted)
  SELECT kind, start, count(*) AS n, round(avg(f), 4) AS flagged FROM w GROUP BY 1, 2 HAVING start + INTERVAL 6 HOUR <= (SELECT w FROM wm)""")
def stream_score_drift(spark, d):
    events = view(spark, d, "arrivals")
    thresholds = events.select(F.col("event_type").alias("kind")).distinct().withColumn("threshold", F.length("kind") * 3)
    rows = events.select(F.col("event_type").alias("kind"), "ts", F.col("value").alias("p"), "part")
    return _replay(spark, d, rows, lambda r: J.score_drift(r, thresholds), "drift")


@query("stream_late_rows", f"WITH {_GATE} SELECT event_id, ts, part AS batch FROM marked WHERE NOT in_time")
def stream_late_rows(spark, d):
    """The dead letters: rows that came too late for any job."""
    rows, folder, late = view(spark, d, "arrivals").select("event_id", "ts", "part"), shared_path(spark, "gate"), None
    for n in range(3):
        rows.where(F.col("part") == n).drop("part").write.mode("append").parquet(f"{folder}/in")
        _, late = J.admit(spark.readStream.schema(rows.drop("part").schema).parquet(f"{folder}/in"), f"{folder}/job")
    return late


@query("stream_run_guards", f"WITH {_GATE}, {GUARDS.replace('FROM run_log)', 'FROM run_log WHERE event_id IN (SELECT event_id FROM admitted) AND ts <= (SELECT w FROM wm))')} SELECT * FROM guards")
def stream_run_guards(spark, d):
    rows = view(spark, d, "run_log").join(view(spark, d, "arrivals").select("event_id", "part").hint("merge"), "event_id")
    return _replay(spark, d, rows.select("run", "epoch", "loss", "score", "ts", "part"), J.stream_run_guards, "guards")
