"""Queries on scoring and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.operators import calibration as C
from tallyweave.operators import scoring as S
from tallyweave.operators import validate as V
from tallyweave.plans.fixtures import view
from tallyweave.plans.q_records import _PROBLEMS, ISSUES, LEAVES, predicted, truth
from tallyweave.registry import query

FLAT = f"""{LEAVES}, tf AS (SELECT bill_id, regexp_replace(path, '\\[[0-9]+\\]', '') AS path, value, count(*) AS n FROM truth_leaves GROUP BY 1, 2, 3), pf AS (SELECT bill_id, regexp_replace(path, '\\[[0-9]+\\]', '') AS path, value, count(*) AS n FROM pred_leaves GROUP BY 1, 2, 3),
  ff AS (SELECT coalesce(t.bill_id, p.bill_id) AS bill_id, sum(least(coalesce(t.n, 0), coalesce(p.n, 0))) AS tp, sum(coalesce(p.n, 0)) AS np, sum(coalesce(t.n, 0)) AS nt FROM tf t FULL JOIN pf p ON t.bill_id = p.bill_id AND t.path = p.path AND t.value = p.value GROUP BY 1)"""
CHARGES = """cf AS (SELECT bill_id, sum(tp) AS tp, sum(np) AS np, sum(nt) AS nt FROM (SELECT bill_id, type, amount_cents, least(sum(p), sum(t)) AS tp, sum(p) AS np, sum(t) AS nt FROM
  (SELECT bill_id, type, amount_cents, 1 AS p, 0 AS t FROM pred_charges UNION ALL SELECT bill_id, type, amount_cents, 0, 1 FROM bill_charges) GROUP BY 1, 2, 3) GROUP BY 1)"""
_nn = lambda c: f"regexp_replace(lower({c}), '[^a-z0-9]+', '', 'g')"
ITEMS = f"""im AS (SELECT t.bill_id AS bill_id, count(*) AS nt, count(p.bill_id) AS np, count(*) FILTER (WHERE p.qty = t.qty AND p.total_cents = t.total_cents
  AND 1 - CAST(levenshtein({_nn('p.name')}, {_nn('t.name')}) AS DOUBLE) / greatest(length({_nn('p.name')}), length({_nn('t.name')})) >= 0.8) AS tp
  FROM bill_items t LEFT JOIN pred_items p ON t.bill_id = p.bill_id AND t.item_idx = p.item_idx GROUP BY 1)"""
_f1 = lambda tp, np_, nt: f"coalesce(round(2.0::DOUBLE * CAST({tp} AS DOUBLE) / nullif(CAST({np_} + {nt} AS DOUBLE), 0), 4), 0)"
_div = lambda a, b: f"coalesce(round(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 4), 0)"


@query("field_f1", f"WITH {FLAT} SELECT {_div('sum(tp)', 'sum(np)')} AS precision, {_div('sum(tp)', 'sum(nt)')} AS recall, {_f1('sum(tp)', 'sum(np)', 'sum(nt)')} AS f1 FROM ff")
def field_f1(spark, d):
    return S.field_f1(predicted(spark, d), truth(spark, d))


@query("charge_f1", f"WITH {CHARGES} SELECT {_f1('sum(tp)', 'sum(np)', 'sum(nt)')} AS f1 FROM cf")
def charge_f1(spark, d):
    c = S.multiset_counts(view(spark, d, "pred_charges"), view(spark, d, "bill_charges"), ["bill_id", "type", "amount_cents"], ["bill_id"]).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    return c.select(F.round(S.prf(F.col("tp"), F.col("fp"), F.col("fn"))[2], 4).alias("f1"))


def matched(spark, d):
    return S.match_items(view(spark, d, "pred_items"), view(spark, d, "bill_items"))


@query("match_items", f"WITH {ITEMS} SELECT bill_id, CAST(tp AS INT) AS tp, CAST(np - tp AS INT) AS fp, CAST(nt - tp AS INT) AS fn FROM im")
def match_items(spark, d):
    return matched(spark, d)


@query("item_f1", f"WITH {ITEMS} SELECT {_f1('sum(tp)', 'sum(np)', 'sum(nt)')} AS f1 FROM im")
def item_f1(spark, d):
    c = matched(spark, d).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    return c.select(F.round(S.prf(F.col("tp"), F.col("fp"), F.col("fn"))[2], 4).alias("f1"))


@query("total_accuracy", f"SELECT {_div('count(*) FILTER (WHERE p.grand_cents = t.grand_cents)', 'count(*)')} AS grand_total_acc, {_div('count(*) FILTER (WHERE p.subtotal_cents = t.subtotal_cents)', 'count(*)')} AS subtotal_acc FROM bills t JOIN pred_bills p ON t.bill_id = p.bill_id")
def total_accuracy(spark, d):
    p = view(spark, d, "pred_bills").select("bill_id", F.col("grand_cents").alias("pg"), F.col("subtotal_cents").alias("ps"))
    ok = lambda a, b, name: F.round(F.avg(F.coalesce((F.col(a) == F.col(b)).cast("int"), F.lit(0))), 4).alias(name)
    return view(spark, d, "bills").join(p, "bill_id").agg(ok("pg", "grand_cents", "grand_total_acc"), ok("ps", "subtotal_cents", "subtotal_acc"))


@query("evaluate_records", f"""WITH {FLAT}, {CHARGES}, {ITEMS}, {ISSUES.replace('read_items', 'pred_items').replace('read_charges', 'pred_charges')},
  r AS (SELECT b.source AS source, ff.tp AS ftp, ff.np AS fnp, ff.nt AS fnt, coalesce(cf.tp, 0) AS ctp, coalesce(cf.np, 0) AS cnp, coalesce(cf.nt, 0) AS cnt, coalesce(im.tp, 0) AS itp, coalesce(im.np, 0) AS inp, coalesce(im.nt, 0) AS int_,
    CASE WHEN p.grand_cents = b.grand_cents THEN 1 ELSE 0 END AS g, CASE WHEN p.subtotal_cents = b.subtotal_cents THEN 1 ELSE 0 END AS s, CASE WHEN b.bill_id IN (SELECT bill_id FROM issues WHERE severity = 'error') THEN 0 ELSE 1 END AS ok
    FROM bills b JOIN pred_bills p ON b.bill_id = p.bill_id LEFT JOIN ff ON b.bill_id = ff.bill_id LEFT JOIN cf ON b.bill_id = cf.bill_id LEFT JOIN im ON b.bill_id = im.bill_id)
  SELECT coalesce(source, 'all') AS source, count(*) AS n, {_div('sum(ftp)', 'sum(fnp)')} AS field_precision, {_div('sum(ftp)', 'sum(fnt)')} AS field_recall, {_f1('sum(ftp)', 'sum(fnp)', 'sum(fnt)')} AS field_f1, {_f1('sum(itp)', 'sum(inp)', 'sum(int_)')} AS item_f1,
    {_f1('sum(ctp)', 'sum(cnp)', 'sum(cnt)')} AS charge_f1, {_div('sum(g)', 'count(*)')} AS grand_total_acc, {_div('sum(s)', 'count(*)')} AS subtotal_acc, {_div('sum(ok)', 'count(*)')} AS consistent FROM r GROUP BY ROLLUP(source)""")
def evaluate_records(spark, d):
    v = lambda n: view(spark, d, n)
    ok = V.is_consistent(v("pred_bills"), V.check_arithmetic(v("pred_bills"), v("pred_items"), v("pred_charges")))
    return S.evaluate_records(v("bills"), v("pred_bills"), truth(spark, d), predicted(spark, d), v("bill_items"), v("pred_items"), v("bill_charges"), v("pred_charges"), ok)


@query("leaf_edit_similarity", f"""WITH {LEAVES} SELECT count(*) AS leaves, round(avg(CASE WHEN p.value IS NULL OR t.value IS NULL THEN 0.0::DOUBLE WHEN greatest(length(p.value), length(t.value)) = 0 THEN 1.0::DOUBLE
  ELSE 1.0::DOUBLE - CAST(levenshtein(p.value, t.value) AS DOUBLE) / greatest(length(p.value), length(t.value)) END), 4) AS similarity FROM pred_leaves p FULL JOIN truth_leaves t ON p.bill_id = t.bill_id AND p.path = t.path""")
def leaf_edit_similarity(spark, d):
    return S.leaf_edit_similarity(predicted(spark, d), truth(spark, d))


@query("tree_edit_accuracy")
def tree_edit_accuracy(spark, d):
    return S.tree_edit_accuracy(predicted(spark, d), truth(spark, d)).select("bill_id", F.round("accuracy", 6).alias("accuracy"))


@query("match_fields", f"""WITH {LEAVES}, p AS (SELECT bill_id, path, regexp_replace(path, '\\[[0-9]+\\]', '') AS k, CASE WHEN path LIKE '%name' THEN {_nn('value')} ELSE value END AS v, row_number() OVER (PARTITION BY bill_id ORDER BY path) AS ord FROM pred_leaves),
  q AS (SELECT *, row_number() OVER (PARTITION BY bill_id, k, v ORDER BY ord) AS rn FROM p), t AS (SELECT bill_id, k, v, count(*) AS c FROM (SELECT bill_id, regexp_replace(path, '\\[[0-9]+\\]', '') AS k, CASE WHEN path LIKE '%name' THEN {_nn('value')} ELSE value END AS v FROM truth_leaves) GROUP BY 1, 2, 3)
  SELECT q.bill_id, q.path, CASE WHEN rn <= c THEN 1 ELSE 0 END AS correct FROM q LEFT JOIN t ON q.bill_id = t.bill_id AND q.k = t.k AND q.v = t.v""")
def match_fields(spark, d):
    return S.match_fields(predicted(spark, d), truth(spark, d))


@query("multiset_intersect", "SELECT bill_id, type, amount_cents FROM bill_charges INTERSECT ALL SELECT bill_id, type, amount_cents FROM pred_charges")
def multiset_intersect(spark, d):
    return S.multiset_intersect(view(spark, d, "bill_charges").select("bill_id", "type", "amount_cents"), view(spark, d, "pred_charges").select("bill_id", "type", "amount_cents"))


TAX = """e0 AS (SELECT coalesce(p.bill_id, t.bill_id) AS bill_id, coalesce(p.item_idx, t.item_idx) AS i, p.bill_id IS NULL AS miss, t.bill_id IS NULL AS extra, lower(p.name) <> lower(t.name) AS n, p.qty <> t.qty AS q, p.unit_cents <> t.unit_cents AS u, p.total_cents <> t.total_cents AS tt
    FROM pred_items p FULL JOIN bill_items t ON p.bill_id = t.bill_id AND p.item_idx = t.item_idx),
  e1 AS (SELECT bill_id, 'item missed' AS category, 'items[' || i || '].name' AS path FROM e0 WHERE miss UNION ALL SELECT bill_id, 'item added', 'items[' || i || '].name' FROM e0 WHERE extra UNION ALL SELECT bill_id, 'name misread', 'items[' || i || '].name' FROM e0 WHERE n
    UNION ALL SELECT bill_id, 'qty misread', 'items[' || i || '].qty' FROM e0 WHERE q UNION ALL SELECT bill_id, 'rate misread', 'items[' || i || '].unit_price' FROM e0 WHERE u UNION ALL SELECT bill_id, 'total misread', 'items[' || i || '].total' FROM e0 WHERE tt
    UNION ALL SELECT p.bill_id, 'charge type', 'charges[' || p.charge_idx || '].type' FROM pred_charges p JOIN bill_charges t ON p.bill_id = t.bill_id AND p.charge_idx = t.charge_idx WHERE p.type <> t.type
    UNION ALL SELECT p.bill_id, 'grand total', 'grand_total' FROM pred_bills p JOIN bills t ON p.bill_id = t.bill_id WHERE p.grand_cents IS DISTINCT FROM t.grand_cents)"""


@query("error_taxonomy", f"WITH {TAX} SELECT category, count(*) AS n, count(DISTINCT e.bill_id) AS bills, count(f.path) AS highlighted FROM e1 e LEFT JOIN (SELECT bill_id, path FROM field_conf WHERE p_min < 0.7) f ON e.bill_id = f.bill_id AND e.path = f.path GROUP BY category")
def error_taxonomy(spark, d):
    v = lambda n: view(spark, d, n)
    return S.error_taxonomy(v("bill_items"), v("pred_items"), v("bill_charges"), v("pred_charges"), v("bills"), v("pred_bills"), V.low_confidence_fields(v("field_conf"), 0.7))


def _auroc_sql(where: str = "", group: str = "") -> str:
    g = f"{group}, " if group else ""
    part = f"PARTITION BY {group} " if group else ""
    return f"""SELECT {g}round(sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)), 4) AS auroc FROM (SELECT *, coalesce(sum(neg) OVER ({part}ORDER BY p_min ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
      FROM (SELECT {g}p_min, CAST(sum(correct) AS DOUBLE) AS pos, CAST(sum(1 - correct) AS DOUBLE) AS neg FROM field_conf {where} GROUP BY {g}p_min)) {'GROUP BY ' + group if group else ''}"""


LEVELS = "lf AS (SELECT *, bill_id % 3 AS level FROM field_conf)"


@query("condition_report", f"""WITH {FLAT}, {CHARGES}, {ITEMS}, {LEVELS}, p AS (SELECT level, bill_id, count(*) AS n, count(*) FILTER (WHERE correct = 0) AS w, count(*) FILTER (WHERE p_min < 0.7) AS f, count(*) FILTER (WHERE correct = 0 AND p_min < 0.7) AS wf FROM lf GROUP BY 1, 2),
  ra AS ({_auroc_sql(group='level').replace('field_conf', 'lf')}),
  rr AS (SELECT b.bill_id % 3 AS level, {_f1('sum(coalesce(ff.tp, 0))', 'sum(coalesce(ff.np, 0))', 'sum(coalesce(ff.nt, 0))')} AS field_f1, {_f1('sum(coalesce(im.tp, 0))', 'sum(coalesce(im.np, 0))', 'sum(coalesce(im.nt, 0))')} AS item_f1, {_f1('sum(coalesce(cf.tp, 0))', 'sum(coalesce(cf.np, 0))', 'sum(coalesce(cf.nt, 0))')} AS charge_f1,
    {_div('count(*) FILTER (WHERE q.grand_cents = b.grand_cents)', 'count(*)')} AS grand_total_acc, {_div('count(*) FILTER (WHERE len(g.problems) > 0)', 'count(*)')} AS retake_share
    FROM bills b JOIN pred_bills q ON b.bill_id = q.bill_id LEFT JOIN ff ON b.bill_id = ff.bill_id LEFT JOIN cf ON b.bill_id = cf.bill_id LEFT JOIN im ON b.bill_id = im.bill_id LEFT JOIN ({_PROBLEMS}) g ON g.id = b.bill_id GROUP BY 1),
  rc AS (SELECT level, count(*) AS bills, CAST(sum(n) AS BIGINT) AS fields, CAST(sum(w) AS BIGINT) AS wrong, {_div('sum(f)', 'sum(n)')} AS flagged, round(CAST(sum(wf) AS DOUBLE) / nullif(CAST(sum(w) AS DOUBLE), 0), 4) AS errors_caught,
    round(1 - CAST(sum(w) - sum(wf) AS DOUBLE) / CAST(sum(n) - sum(f) AS DOUBLE), 4) AS unflagged_right, count(*) FILTER (WHERE w > 0) AS bills_wrong, count(*) FILTER (WHERE w > wf) AS bills_wrong_unflagged, {_div('sum(f)', 'count(*)')} AS flags_per_bill FROM p GROUP BY level)
  SELECT rc.*, auroc, field_f1, item_f1, charge_f1, grand_total_acc, retake_share FROM rc LEFT JOIN ra ON rc.level = ra.level LEFT JOIN rr ON rc.level = rr.level""")
def condition_report(spark, d):
    v = lambda n: view(spark, d, n)
    level = (F.col("bill_id") % 3).alias("level")
    again = V.quality_gate(v("image_stats")).select(F.col("id").alias("bill_id"), "retake")
    records = S.record_counts(v("bills"), v("pred_bills"), truth(spark, d), predicted(spark, d), v("bill_items"), v("pred_items"), v("bill_charges"), v("pred_charges")).join(again, "bill_id", "left")
    return S.condition_report(v("field_conf").select("*", level), ["level"], 0.7, records.select("*", level))


@query("before_after", "WITH m AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'old' ELSE 'new' END AS run, event_type AS metric, value FROM events), q AS (SELECT metric, quantile_cont(value, 0.5) FILTER (WHERE run = 'old') AS b, quantile_cont(value, 0.5) FILTER (WHERE run = 'new') AS a FROM m GROUP BY metric) SELECT metric, round(b, 4) AS before, round(a, 4) AS after, round(a - b, 4) AS delta FROM q")
def before_after(spark, d):
    rows = view(spark, d, "events").select(F.when(F.col("user_id") % 2 == 0, "old").otherwise("new").alias("run"), F.col("event_type").alias("metric"), "value")
    return S.before_after(rows, "old", "new")


RESULTS = "res AS (SELECT 'm' || CAST(user_id % 7 AS VARCHAR) AS model, event_type AS source, avg(value) AS field_f1 FROM events GROUP BY 1, 2)"


@query("leaderboard", f"WITH {RESULTS} SELECT model, round(avg(field_f1), 4) AS score FROM res GROUP BY model")
def leaderboard(spark, d):
    rows = view(spark, d, "events").groupBy(F.concat(F.lit("m"), (F.col("user_id") % 7).cast("string")).alias("model"), F.col("event_type").alias("source")).agg(F.avg("value").alias("field_f1"))
    return S.leaderboard(rows)


@query("selection_score", "WITH s AS (SELECT user_id AS run, event_type AS source, avg(value) AS score FROM events GROUP BY 1, 2), t AS (SELECT run, CASE source WHEN 'click' THEN 'synthetic' WHEN 'error' THEN 'all' ELSE source END AS source, score FROM s) SELECT run, round(coalesce(avg(CASE WHEN source NOT IN ('synthetic', 'all') THEN score END), max(CASE WHEN source = 'all' THEN score END), 0.0), 4) AS selection FROM t GROUP BY run")
def selection_score(spark, d):
    source = F.when(F.col("event_type") == "click", "synthetic").when(F.col("event_type") == "error", "all").otherwise(F.col("event_type"))
    rows = view(spark, d, "events").groupBy(F.col("user_id").alias("run"), source.alias("source")).agg(F.avg("value").alias("score"))
    return S.selection_score(rows, ["synthetic"])


VARIANTS = "vr AS (SELECT id, variant, (id + variant) % 5 <> 0 AS has_items, (id * variant) % 3 <> 1 AS total_right FROM (SELECT o_orderkey AS id FROM orders), (VALUES (1), (2), (3)) v(variant))"


@query("variant_matrix", f"""WITH {VARIANTS} SELECT 'v' || CAST(variant AS VARCHAR) AS variant, count(*) AS records, count(*) FILTER (WHERE has_items) AS with_items, count(*) FILTER (WHERE total_right) AS total_right, NULL::BIGINT AS company_exact, NULL::BIGINT AS address_exact, NULL::BIGINT AS date_exact, NULL::BIGINT AS total_exact FROM vr GROUP BY variant
  UNION ALL SELECT 'any', count(*), count(*) FILTER (WHERE i), count(*) FILTER (WHERE t), NULL, NULL, NULL, NULL FROM (SELECT id, bool_or(has_items) AS i, bool_or(total_right) AS t FROM vr GROUP BY id)
  UNION ALL SELECT 'auxiliary', count(*), NULL, NULL, count(*), count(*) FILTER (WHERE id % 7 <> 0), count(*) FILTER (WHERE id % 10 <> 0 OR date = ''), count(*) FILTER (WHERE id % 6 <> 0 OR total = '1000.00') FROM headers""")
def variant_matrix(spark, d):
    rows = view(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("v"))
    h = view(spark, d, "headers")
    every = lambda n, x, other: F.when(F.col("id") % n == 0, x).otherwise(other)
    read = h.select("id", every(5, F.upper("company"), F.concat("company", F.lit(" !"))).alias("company"), every(7, F.expr("substr(address, 2)"), F.col("address")).alias("address"), every(10, None, F.col("date")).alias("date"), every(6, F.lit("1,000"), F.concat(F.lit("Rs "), "total")).alias("total"))
    aux = S.exact_fields(read, h, ["company", "address", "date"], ["total"])
    return S.variant_matrix(rows.select("id", F.concat(F.lit("v"), F.col("v").cast("string")).alias("variant"), ((F.col("id") + F.col("v")) % 5 != 0).alias("has_items"), ((F.col("id") * F.col("v")) % 3 != 1).alias("total_right")), aux)


@query("run_parity", f"WITH {LEAVES} SELECT (SELECT count(*) FROM bills) AS n, (SELECT count(*) FROM bills WHERE bill_id NOT IN (SELECT coalesce(p.bill_id, t.bill_id) FROM pred_leaves p FULL JOIN truth_leaves t ON p.bill_id = t.bill_id AND p.path = t.path WHERE p.value IS DISTINCT FROM t.value)) AS identical")
def run_parity(spark, d):
    return S.run_parity(predicted(spark, d).withColumnRenamed("bill_id", "id"), truth(spark, d).withColumnRenamed("bill_id", "id"))


_bin = "CAST(least(floor(p_min * 10 + 1e-9), 9) AS INT)"


@query("reliability_table", f"SELECT {_bin} AS bin, count(*) AS n, round(avg(p_min), 6) AS mean_conf, round(avg(correct), 6) AS accuracy FROM field_conf GROUP BY 1")
def reliability_table(spark, d):
    return C.reliability_table(view(spark, d, "field_conf"), "p_min").select("bin", "n", F.round("mean_conf", 6).alias("mean_conf"), F.round("accuracy", 6).alias("accuracy"))


ECE = "WITH b AS (SELECT " + _bin + " AS bin, count(*) AS n, avg(p_min) AS c, avg(correct) AS a FROM field_conf GROUP BY 1)"


@query("ece", f"{ECE} SELECT round(sum(n * abs(c - a)) / sum(n), 6) AS ece FROM b")
def ece(spark, d):
    return C.ece(view(spark, d, "field_conf"), "p_min").select(F.round("ece", 6).alias("ece"))


@query("auroc", _auroc_sql())
def auroc(spark, d):
    return C.auroc(view(spark, d, "field_conf"), "p_min").select(F.round("auroc", 4).alias("auroc"))


@query("threshold_for_precision", """WITH b AS (SELECT p_min, sum(correct) AS c, count(*) AS n FROM field_conf GROUP BY 1), w AS (SELECT p_min, CAST(sum(c) OVER (ORDER BY p_min DESC) AS DOUBLE) / sum(n) OVER (ORDER BY p_min DESC) AS p FROM b)
  SELECT coalesce(min(p_min) FILTER (WHERE p >= 0.98), 1.01) AS threshold FROM w""")
def threshold_for_precision(spark, d):
    return C.threshold_for_precision(view(spark, d, "field_conf"), "p_min", 0.98)


@query("lowest_confidence_k", "SELECT bill_id, path, p_min FROM field_conf WHERE p_min < (SELECT quantile_cont(p_min, 0.08) FROM field_conf)")
def lowest_confidence_k(spark, d):
    return C.lowest_confidence(view(spark, d, "field_conf"), "p_min").select("bill_id", "path", "p_min")


SHARES = (0.01, 0.02, 0.05, 0.08, 0.10, 0.15, 0.20)


@query("flag_tradeoff", "WITH c AS (" + " UNION ALL ".join(f"SELECT {s}::DOUBLE AS share, quantile_cont(p_min, {s}) AS t FROM field_conf" for s in SHARES) + """)
  SELECT share, round(t, 6) AS threshold, round(CAST(count(*) FILTER (WHERE p_min < t AND correct = 0) AS DOUBLE) / count(*) FILTER (WHERE correct = 0), 4) AS errors_caught,
    round(CAST(count(*) FILTER (WHERE p_min >= t AND correct = 1) AS DOUBLE) / count(*) FILTER (WHERE p_min >= t), 4) AS unflagged_precision, round(CAST(count(*) FILTER (WHERE p_min < t) AS DOUBLE) / count(*) * 20, 4) AS flags_per_bill FROM field_conf, c GROUP BY share, t""")
def flag_tradeoff(spark, d):
    return C.flag_tradeoff(view(spark, d, "field_conf"), "p_min", SHARES)


@query("calibration_by_field", f"WITH a AS ({_auroc_sql(group='field')}), n AS (SELECT field, count(*) AS n, round(avg(correct), 4) AS accuracy FROM field_conf GROUP BY field HAVING count(*) >= 20 AND min(correct) < max(correct)) SELECT n.field, n, accuracy, auroc FROM n JOIN a ON n.field = a.field")
def calibration_by_field(spark, d):
    return C.calibration_by_field(view(spark, d, "field_conf"), "p_min")


def isotonic_sql(points: str, keys: str, name: str = "fit") -> str:
    """CTEs that end in name (keys, s, v): the fit at each score of points (keys, s, c, n) as the largest least mean of runs around it."""
    k, on = keys, " AND ".join(f"a.{x.strip()} = b.{x.strip()}" for x in keys.split(","))
    ak = ", ".join(f"a.{x.strip()}" for x in keys.split(","))
    return f"""{name}_i AS (SELECT *, row_number() OVER w AS i, sum(c) OVER w AS cc, sum(n) OVER w AS cn FROM {points} WINDOW w AS (PARTITION BY {k} ORDER BY s)),
  {name}_m AS (SELECT {ak}, a.i AS a, b.i AS b, b.s, CAST(b.cc - a.cc + a.c AS DOUBLE) / CAST(b.cn - a.cn + a.n AS DOUBLE) AS m FROM {name}_i a JOIN {name}_i b ON {on} AND a.i <= b.i),
  {name}_l AS (SELECT {k}, s, min(m) OVER (PARTITION BY {k}, a ORDER BY b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS m FROM {name}_m), {name} AS (SELECT {k}, s, max(m) AS v FROM {name}_l GROUP BY {k}, s)"""


#: The map at x between its neighbours lo and hi (s, v).
AT = "least(1, greatest(0, CASE WHEN lo.s IS NULL THEN hi.v WHEN hi.s IS NULL OR hi.s = lo.s THEN lo.v ELSE lo.v + (hi.v - lo.v) * (x - lo.s) / (hi.s - lo.s) END))"


@query("isotonic_calibrate", f"""WITH pts AS (SELECT 0 AS o, p_min AS s, sum(correct) AS c, count(*) AS n FROM field_conf GROUP BY p_min), {isotonic_sql('pts', 'o')}, grid AS (SELECT 0 AS o, CAST(i AS DOUBLE) / 100 AS x FROM range(101) t(i))
  SELECT x AS score, round({AT}, 4) AS p FROM grid ASOF LEFT JOIN fit lo ON grid.o = lo.o AND grid.x >= lo.s ASOF LEFT JOIN fit hi ON grid.o = hi.o AND grid.x <= hi.s""")
def isotonic_calibrate(spark, d):
    return C.isotonic_calibrate(view(spark, d, "field_conf"), "p_min")


SCORES = "long AS (" + " UNION ALL ".join(f"SELECT {i} AS o, '{c}' AS score, bill_id % 2 AS fold, correct, {c} AS x FROM field_conf" for i, c in enumerate(("p_first", "p_mean", "p_min"))) + ")"
MAPPED = f"""{SCORES}, pts AS (SELECT o, fold, x AS s, sum(correct) AS c, count(*) AS n FROM long GROUP BY ALL), {isotonic_sql('pts', 'o, fold')},
  mapped AS (SELECT p.o, {AT} AS s, p.c, p.n FROM (SELECT o, 1 - fold AS other, s AS x, c, n FROM pts) p ASOF LEFT JOIN fit lo ON p.o = lo.o AND p.other = lo.fold AND p.x >= lo.s ASOF LEFT JOIN fit hi ON p.o = hi.o AND p.other = hi.fold AND p.x <= hi.s)"""
_bins = lambda s: " + ".join(f"CAST({s} >= {i / 10}::DOUBLE AS INT)" for i in range(1, 10))
_gap = lambda rows: f"(SELECT o, sum(n * abs(sc / n - c / n)) / sum(n) AS e FROM (SELECT o, {_bins('s')} AS bin, CAST(sum(c) AS DOUBLE) AS c, CAST(sum(n) AS DOUBLE) AS n, sum(s * n) AS sc FROM {rows} GROUP BY ALL) GROUP BY o)"


@query("calibration_report", f"""WITH {MAPPED}, whole AS (SELECT o, s, CAST(sum(c) AS DOUBLE) AS c, CAST(sum(n) AS DOUBLE) AS n FROM pts GROUP BY ALL),
  ranks AS (SELECT *, coalesce(sum(n - c) OVER (PARTITION BY o ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM whole), au AS (SELECT o, sum(c * (below + (n - c) / 2)) / (sum(c) * sum(n - c)) AS a FROM ranks GROUP BY o),
  cut AS (SELECT o, score, quantile_cont(x, 0.08) AS t FROM long GROUP BY ALL), f AS (SELECT l.o, l.score, t, count(*) AS n, count(*) FILTER (WHERE correct = 0) AS w, count(*) FILTER (WHERE x < t) AS f, count(*) FILTER (WHERE x < t AND correct = 0) AS wf FROM long l JOIN cut ON l.o = cut.o GROUP BY ALL)
  SELECT score, round(a, 4) AS auroc, round(g.e, 4) AS ece_raw, round(h.e, 4) AS ece_calibrated, round(t, 6) AS threshold, round(CAST(f AS DOUBLE) / n, 4) AS flagged, round(CAST(wf AS DOUBLE) / nullif(w, 0), 4) AS errors_caught,
    round(1 - CAST(w - wf AS DOUBLE) / nullif(n - f, 0), 4) AS unflagged_right, row_number() OVER (ORDER BY round(a, 4) DESC, f.o) = 1 AS best
  FROM f JOIN au ON f.o = au.o JOIN {_gap('whole')} g ON f.o = g.o JOIN {_gap('mapped')} h ON f.o = h.o""")
def calibration_report(spark, d):
    return C.calibration_report(view(spark, d, "field_conf"))
