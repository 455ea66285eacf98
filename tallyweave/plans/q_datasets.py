"""Queries on manifests, samples, profiles, token streams and run logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.operators import datasets as D
from tallyweave.operators import runs as R
from tallyweave.operators import validate as V
from tallyweave.operators.normalise import RECORD, tagged_text
from tallyweave.plans.fixtures import mean_sql, view
from tallyweave.plans.q_records import _PROBLEMS, ISSUES, canon, predicted
from tallyweave.registry import query

_rank = "CASE split WHEN 'test' THEN 0 WHEN 'val' THEN 1 ELSE 2 END"
BEST = f"best AS (SELECT *, {_rank} AS r, min({_rank}) OVER (PARTITION BY content_hash) AS b FROM manifest)"


@query("exact_dup_across_splits", f"WITH {BEST} SELECT id, source, split FROM best WHERE r = b")
def exact_dup_across_splits(spark, d):
    return D.exact_dup_across_splits(view(spark, d, "manifest"))[0].select("id", "source", "split")


@query("manifest_summary", f"WITH {BEST} SELECT source, split, count(*) FILTER (WHERE r = b) AS kept, count(*) FILTER (WHERE r > b) AS dropped FROM best GROUP BY source, split")
def manifest_summary(spark, d):
    return D.manifest_summary(*D.exact_dup_across_splits(view(spark, d, "manifest")))


@query("split_overlap", "WITH h AS (SELECT DISTINCT content_hash, split FROM manifest) SELECT a.split AS split_a, b.split AS split_b, count(*) AS n FROM h a JOIN h b ON a.content_hash = b.content_hash AND a.split < b.split GROUP BY 1, 2")
def split_overlap(spark, d):
    return D.split_overlap(view(spark, d, "manifest"), "content_hash")


def hashes(spark, d):
    """256 bits of each embedding by four cut points, and a test copy with the lowest vec_id % 20 bits of w0 flipped."""
    cuts = (-0.1, -0.03, 0.03, 0.1)
    word = lambda cut: F.conv(F.array_join(F.transform("embedding", lambda x: F.when(x > cut, "1").otherwise("0")), ""), 2, -10).cast("long")
    rows = view(spark, d, "embeddings").select("vec_id", *(word(F.lit(c).cast("float")).alias(f"w{i}") for i, c in enumerate(cuts)))
    split = F.when(F.col("vec_id") % 10 < 8, "train").otherwise("val")
    flip = F.expr("cast(shiftleft(1L, cast(vec_id % 20 AS INT)) - 1 AS BIGINT)")
    w = ["w0", "w1", "w2", "w3"]
    own = rows.select(F.col("vec_id").alias("id"), split.alias("split"), *w)
    return own.unionByName(rows.select((F.col("vec_id") + 1_000_000).alias("id"), F.lit("test").alias("split"), F.col("w0").bitwiseXOR(flip).alias("w0"), *w[1:]))


def _word(cut: float) -> str:
    return f"list_aggregate(list_transform(embedding, lambda x: CASE WHEN x > {cut}::FLOAT THEN '1' ELSE '0' END), 'string_agg', '')"


HASHES = f"""hb AS (SELECT vec_id AS id, CASE WHEN vec_id % 10 < 8 THEN 'train' ELSE 'val' END AS split, {_word(-0.1)} || {_word(-0.03)} || {_word(0.03)} || {_word(0.1)} AS bits FROM embeddings),
  hf AS (SELECT id + 1000000 AS id, 'test' AS split, substr(bits, 1, 64 - CAST(id % 20 AS INT)) || translate(substr(bits, 65 - CAST(id % 20 AS INT), CAST(id % 20 AS INT)), '01', '10') || substr(bits, 65) AS bits FROM hb),
  hx AS (SELECT * FROM hb UNION ALL SELECT * FROM hf)"""


NEAR = f"""{HASHES}, hg AS (SELECT split, bits, min(id) AS id, count(*) AS n FROM hx GROUP BY split, bits),
  near AS (SELECT a.split AS split_a, b.split AS split_b, a.id AS id_a, b.id AS id_b, CAST(hamming(a.bits, b.bits) AS INT) AS distance, a.n * b.n AS pairs FROM hg a JOIN hg b ON a.split < b.split WHERE hamming(a.bits, b.bits) <= 12)"""


@query("near_dup_across_splits", f"WITH {NEAR} SELECT * FROM near")
def near_dup_across_splits(spark, d):
    return D.near_dup_across_splits(hashes(spark, d))


@query("near_dup_examples", f"""WITH {NEAR}, t AS (SELECT split_a, split_b, CAST(sum(pairs) AS BIGINT) AS pairs FROM near GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY split_a, split_b ORDER BY distance, id_a, id_b) AS rank FROM near)
  SELECT r.split_a, r.split_b, t.pairs, CAST(rank AS INT) AS rank, id_a, id_b, distance FROM r JOIN t ON r.split_a = t.split_a AND r.split_b = t.split_b WHERE rank <= 5""")
def near_dup_examples(spark, d):
    return D.near_dup_examples(D.near_dup_across_splits(hashes(spark, d)))


@query("union_manifests", "SELECT id, count(*) AS n FROM (SELECT id FROM manifest WHERE split = 'train' UNION ALL SELECT id FROM manifest WHERE id % 7 = 0) GROUP BY id HAVING count(*) > 1")
def union_manifests(spark, d):
    m = view(spark, d, "manifest").select("id", "split")
    return D.union_manifests(m.where("split = 'train'"), m.where("id % 7 = 0"))[1]


@query("drop_set", "SELECT id FROM manifest WHERE id % 7 <> 0")
def drop_set(spark, d):
    m = view(spark, d, "manifest").select("id")
    return D.drop_set(m, m.where("id % 7 = 0"))


_ord = "md5('7:' || CAST(id AS VARCHAR))"
RANKED = f"rk AS (SELECT id, source, row_number() OVER (PARTITION BY source ORDER BY {_ord}, id) AS rn FROM manifest)"


@query("sample_per_source", f"WITH {RANKED} SELECT id, source, CAST(rn AS INT) AS rn FROM rk WHERE rn <= CASE source WHEN 'src0' THEN 20 WHEN 'src1' THEN 25 ELSE 10 END")
def sample_per_source(spark, d):
    return D.sample_per_source(view(spark, d, "manifest").select("id", "source"), 7, {"src0": 20, "src1": 25}, 10).select("id", "source", "rn")


@query("sample_round_robin", f"WITH {RANKED} SELECT id, source, CAST(rn AS INT) AS rn FROM rk ORDER BY rn, source LIMIT 30")
def sample_round_robin(spark, d):
    return D.sample_round_robin(view(spark, d, "manifest").select("id", "source"), 7, 30).select("id", "source", "rn")


@query("cap_sample", f"SELECT id FROM manifest ORDER BY {_ord}, id LIMIT 40")
def cap_sample(spark, d):
    return D.cap_sample(view(spark, d, "manifest").select("id"), 7, 40)


@query("carve_validation", f"WITH t AS (SELECT id FROM manifest WHERE split = 'train' ORDER BY {_ord}, id LIMIT 25) SELECT id, CASE WHEN id IN (SELECT id FROM t) THEN 'val' ELSE split END AS split FROM manifest")
def carve_validation(spark, d):
    return D.carve_validation(view(spark, d, "manifest").select("id", "split"), 7, 25)


@query("oversample", "SELECT id, source, c AS copy FROM manifest, (VALUES (1), (2), (3)) v(c) WHERE c <= CASE source WHEN 'src0' THEN 3 WHEN 'src1' THEN 2 ELSE 1 END")
def oversample(spark, d):
    return D.oversample(view(spark, d, "manifest").select("id", "source"), {"src0": 3, "src1": 2})


_q = lambda p: f"round(quantile_cont(v, {p}), 3)"


@query("profile_numeric", "WITH l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS v FROM image_stats" for c in ("w", "h", "blur", "mean", "skew")) + f""")
  SELECT "column", count(*) AS n, round(min(v), 3) AS min, {_q(0.05)} AS p5, {_q(0.25)} AS p25, {_q(0.5)} AS p50, {_q(0.75)} AS p75, {_q(0.95)} AS p95, round(max(v), 3) AS max, round(avg(v), 3) AS mean FROM l GROUP BY 1""")
def profile_numeric(spark, d):
    return D.profile_numeric(view(spark, d, "image_stats"), ["w", "h", "blur", "mean", "skew"])


@query("profile_flags", f"""WITH p AS ({_PROBLEMS}), f AS (SELECT unnest(problems) AS flag FROM p UNION ALL SELECT 'any' FROM p WHERE len(problems) > 0 UNION ALL SELECT 'skewed' FROM p WHERE abs(skew) > 2)
  SELECT flag, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM p), 4) AS share FROM f GROUP BY flag""")
def profile_flags(spark, d):
    stats = view(spark, d, "image_stats")
    return D.profile_flags(V.quality_gate(stats).join(stats.select("id", "skew"), "id"))


@query("key_frequency", r"""SELECT regexp_replace(substr(j.path, 3), '\[[0-9]+\]', '[]', 'g') AS level, j.key AS key, count(*) AS n FROM nested_events, json_tree(nested_events.body) j WHERE j.key IS NOT NULL AND j.fullkey NOT LIKE '%]' GROUP BY 1, 2""")
def key_frequency(spark, d):
    return D.key_frequency(view(spark, d, "nested_events"), "body")


@query("charge_prevalence", "SELECT type, round(CAST(count(DISTINCT bill_id) AS DOUBLE) / (SELECT count(*) FROM bills), 4) AS share FROM bill_charges GROUP BY type")
def charge_prevalence(spark, d):
    return D.charge_prevalence(view(spark, d, "bills"), view(spark, d, "bill_charges"))


@query("dataset_profile", f"""WITH {ISSUES}, i AS (SELECT bill_id, count(*) AS k, sum(qty) AS q, count(*) FILTER (WHERE qty > 1) AS m, bool_or(part % 50 = 0) AS deep FROM bill_items GROUP BY bill_id)
  SELECT split, count(*) AS n, round(CAST(sum(k) AS DOUBLE) / count(*), 4) AS items_per_bill, round(CAST(count(k) AS DOUBLE) / count(*), 4) AS with_items,
    round(CAST(count(k) FILTER (WHERE b.bill_id NOT IN (SELECT bill_id FROM issues WHERE severity = 'error')) AS DOUBLE) / count(k), 4) AS consistent, round(CAST(sum(q) AS DOUBLE) / CAST(sum(k) AS DOUBLE), 4) AS mean_qty, round(CAST(sum(m) AS DOUBLE) / CAST(sum(k) AS DOUBLE), 4) AS qty_over_one, round(CAST(count(*) FILTER (WHERE deep) AS DOUBLE) / count(*), 4) AS nested
  FROM bills b LEFT JOIN i ON b.bill_id = i.bill_id GROUP BY split""")
def dataset_profile(spark, d):
    ok = V.is_consistent(view(spark, d, "pred_bills"), V.check_arithmetic(view(spark, d, "pred_bills"), view(spark, d, "read_items"), view(spark, d, "read_charges")))
    return D.dataset_profile(view(spark, d, "bills"), view(spark, d, "bill_items").withColumn("nested", F.col("part") % 50 == 0), ok)


KEYWORDS = ("THE", "DER", "LA", "TOTAL", "COPYRIGHT", "LICENSED", "TOKEN", "RIGHTS", "IDIOT")


@query("keyword_rates", "WITH f AS (SELECT upper(coalesce(text, '')) AS u, len(string_split(coalesce(text, ''), chr(10))) AS l FROM documents) " + " UNION ALL ".join(f"SELECT '{k}' AS keyword, round(avg(CAST(contains(u, '{k}') AS INT)), 4) AS share, round(avg(l), 4) AS lines_per_doc FROM f" for k in KEYWORDS))
def keyword_rates(spark, d):
    return D.keyword_rates(view(spark, d, "documents"), KEYWORDS)


def token_lists(spark, d):
    """Predicted records as token streams, one row a bill: tags, separators and characters' words in order, with probabilities."""
    text = tagged_text(predicted(spark, d).withColumn("bill", F.col("bill").cast(RECORD)))
    parts = F.filter(F.split(F.regexp_replace("text", "(<[^>]+>)", "\u0001$1\u0001"), "\u0001"), lambda x: x != "")
    stream = F.concat(parts, F.array(F.lit("</s>"), F.lit("<s_name>"), F.lit("late"), F.lit("</s_name>")))
    prob = lambda pos: F.lit(1.0) - ((F.col("bill_id") * 7919 + pos * 104729) % 1000) / 2000
    return text.select("bill_id", F.transform(stream, lambda x, pos: F.struct(x.alias("token"), prob(pos).alias("prob"))).alias("tokens"))


def _leaf(sql_items: str) -> str:
    i, c = "'items[' || item_idx || '].", "'charges[' || charge_idx || ']."
    return f"""SELECT bill_id, {i}name' AS path, name AS value FROM pred_items UNION ALL SELECT bill_id, {i}qty', CAST(qty AS VARCHAR) FROM pred_items UNION ALL SELECT bill_id, {i}unit_price', {canon('unit_cents')} FROM pred_items
      UNION ALL SELECT bill_id, {i}total', {canon('total_cents')} FROM pred_items UNION ALL SELECT bill_id, {c}type', type FROM pred_charges UNION ALL SELECT bill_id, {c}amount', {canon('amount_cents')} FROM pred_charges
      UNION ALL SELECT bill_id, 'subtotal', {canon('subtotal_cents')} FROM pred_bills WHERE subtotal_cents IS NOT NULL UNION ALL SELECT bill_id, 'grand_total', {canon('grand_cents')} FROM pred_bills WHERE grand_cents IS NOT NULL"""


@query("fields_from_tokens", f"WITH l AS ({_leaf('')}) SELECT bill_id, path, value FROM l")
def fields_from_tokens(spark, d):
    return R.fields_from_tokens(token_lists(spark, d)).select("bill_id", "path", "value")


@query("new_best", "SELECT run, epoch, score FROM (SELECT *, max(score) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM run_log) WHERE b IS NULL OR score > b")
def new_best(spark, d):
    return R.new_best(view(spark, d, "run_log"))


GUARDS = """g0 AS (SELECT *, isnan(loss) AS bad, CASE WHEN NOT isnan(loss) THEN loss END AS ok, sum(CASE WHEN isnan(loss) THEN 0 ELSE 1 END) OVER (PARTITION BY run ORDER BY epoch) AS island FROM run_log),
  g1 AS (SELECT *, row_number() OVER (PARTITION BY run, island, bad ORDER BY epoch) AS in_row, min(ok) OVER p AS lb, last_value(ok IGNORE NULLS) OVER p AS pv, row_number() OVER (PARTITION BY run, epoch >= 4 ORDER BY epoch) AS late
    FROM g0 WINDOW p AS (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  guards AS (SELECT run, epoch, 'non_finite' AS rule FROM g1 WHERE bad UNION ALL SELECT run, epoch, 'non_finite_streak' FROM g1 WHERE bad AND in_row = 3 UNION ALL SELECT run, epoch, 'zero_loss' FROM g1 WHERE ok < 1e-5
    UNION ALL SELECT run, epoch, 'diverged' FROM g1 WHERE epoch >= 3 AND ok > 3 * lb UNION ALL SELECT run, epoch, 'jumped' FROM g1 WHERE ok > 5 * pv UNION ALL SELECT run, epoch, 'not_learning' FROM g1 WHERE epoch >= 4 AND late = 1 AND score < 0.2)"""


@query("run_guards", f"WITH {GUARDS} SELECT * FROM guards")
def run_guards(spark, d):
    return R.run_guards(view(spark, d, "run_log"))


@query("latency_stats", f"""WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
  SELECT event_type, count(*) AS n, round(max(value) FILTER (WHERE i = least(floor(n * 0.5), n - 1)), 4) AS p50, round(max(value) FILTER (WHERE i = least(floor(n * 0.95), n - 1)), 4) AS p95, {mean_sql('value', 4)} AS mean, round(max(value), 4) AS longest FROM s GROUP BY event_type""")
def latency_stats(spark, d):
    return R.latency_stats(view(spark, d, "events"), ["event_type"], "value")


STAGES = """st AS (SELECT event_id AS req, value * 0.1 AS h2d, value * 0.3 AS enc, value * (CASE WHEN event_id % 5 = 0 THEN 0.2 ELSE 0.9 END) AS gen, 10 + event_id % 50 AS tokens FROM events),
  sd AS (SELECT *, greatest(gen - enc, 0) AS decode FROM st WHERE req >= 2), sl AS (SELECT 'h2d' AS stage, h2d AS v FROM sd UNION ALL SELECT 'enc', enc FROM sd UNION ALL SELECT 'decode', decode FROM sd UNION ALL SELECT 'total', h2d + enc + decode FROM sd),
  sr AS (SELECT stage, round(v, 6) AS v, row_number() OVER (PARTITION BY stage ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY stage) AS n FROM sl)"""


@query("stage_breakdown", f"""WITH {STAGES.replace('0.1 AS', '0.1::DOUBLE AS').replace('0.3 AS', '0.3::DOUBLE AS').replace('THEN 0.2 ELSE 0.9', 'THEN 0.2::DOUBLE ELSE 0.9::DOUBLE')} SELECT stage, count(*) AS n, round(max(v) FILTER (WHERE i = least(floor(n * 0.5), n - 1)), 4) AS p50, round(max(v) FILTER (WHERE i = least(floor(n * 0.95), n - 1)), 4) AS p95, {mean_sql('v', 4)} AS mean, round(max(v), 4) AS longest,
  CASE WHEN stage = 'decode' THEN (SELECT round(sum(decode) * 1000 / sum(tokens), 4) FROM sd) END AS ms_per_token FROM sr GROUP BY stage""")
def stage_breakdown(spark, d):
    e = view(spark, d, "events")
    gen = F.when(F.col("event_id") % 5 == 0, 0.2).otherwise(0.9)
    return R.stage_breakdown(e.select(F.col("event_id").alias("req"), (F.col("value") * 0.1).alias("h2d"), (F.col("value") * 0.3).alias("enc"), (F.col("value") * gen).alias("gen"), (10 + F.col("event_id") % 50).alias("tokens")))


@query("throughput", f"""WITH e AS (SELECT user_id, event_type, value, CAST(epoch_us(ts) AS DOUBLE) / 1000000 AS s FROM events),
  l AS (SELECT user_id, round((s + value) - s, 4) AS v, row_number() OVER (PARTITION BY user_id ORDER BY round((s + value) - s, 4)) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS k FROM e WHERE event_type <> 'error'),
  q AS (SELECT user_id, max(v) FILTER (WHERE i = least(floor(k * 0.5), k - 1)) AS p50, max(v) FILTER (WHERE i = least(floor(k * 0.95), k - 1)) AS p95, {mean_sql('v', 4)} AS mean, max(v) AS longest FROM l GROUP BY user_id),
  t AS (SELECT user_id AS level, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, round(max(s + value) - min(s), 3) AS seconds, round(count(*) FILTER (WHERE event_type <> 'error') / (max(s + value) - min(s)), 4) AS per_second FROM e GROUP BY user_id)
  SELECT t.*, p50, p95, mean, longest FROM t LEFT JOIN q ON t.level = q.user_id""")
def throughput(spark, d):
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    return R.throughput(view(spark, d, "events").select(F.col("user_id").alias("level"), start.alias("start"), (start + F.col("value")).alias("end"), (F.col("event_type") != "error").alias("ok")), "level")


@query("curve_table", f"WITH c AS (SELECT epoch, CASE WHEN NOT isnan(loss) THEN loss END AS l, score AS s, CASE WHEN run % 2 = 0 THEN score END AS h FROM run_log) SELECT epoch, {mean_sql('l')} AS loss, {mean_sql('s')} AS bill, {mean_sql('h')} AS header FROM c GROUP BY epoch")
def curve_table(spark, d):
    log = view(spark, d, "run_log").withColumn("loss", F.when(~F.isnan("loss"), F.col("loss")))
    val = F.when(F.col("run") % 2 == 0, F.create_map(F.lit("bill"), "score", F.lit("header"), "score")).otherwise(F.create_map(F.lit("bill"), "score"))
    return R.curve_table(log.select("epoch", "loss", val.alias("val")), ["bill", "header"])


@query("capacity_plan", "SELECT date_trunc('hour', ts) AS hour, count(*) AS n, CAST(ceil(round(count(*) / 3600.0::DOUBLE * 3 * 0.5 / 0.6, 9)) AS BIGINT) AS units FROM events GROUP BY 1")
def capacity_plan(spark, d):
    return R.capacity_plan(view(spark, d, "events"), "ts").withColumn("hour", F.col("hour").cast("timestamp_ntz"))
