"""Queries on normalising and checking records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.functions.money import extract_json, parse_money
from tallyweave.operators import normalise as N
from tallyweave.operators import validate as V
from tallyweave.operators.quantiles import exact_quantiles
from tallyweave.plans.fixtures import view
from tallyweave.registry import query


def canon(c: str) -> str:
    """DuckDB text of cents, trailing zeros stripped."""
    return f"regexp_replace((CASE WHEN {c} < 0 THEN '-' ELSE '' END || CAST(abs({c}) // 100 AS VARCHAR) || '.' || lpad(CAST(abs({c}) % 100 AS VARCHAR), 2, '0')), '\\.?0+$', '')"


def plain(c: str) -> str:
    return f"(CASE WHEN {c} < 0 THEN '-' ELSE '' END || CAST(abs({c}) // 100 AS VARCHAR) || '.' || lpad(CAST(abs({c}) % 100 AS VARCHAR), 2, '0'))"


def leaves_sql(items: str, charges: str, bills: str) -> str:
    i, c = "'items[' || item_idx || '].", "'charges[' || charge_idx || ']."
    return f"""SELECT bill_id, {i}name' AS path, name AS value FROM {items} UNION ALL SELECT bill_id, {i}qty', CAST(qty AS VARCHAR) FROM {items}
      UNION ALL SELECT bill_id, {i}unit_price', {canon('unit_cents')} FROM {items} UNION ALL SELECT bill_id, {i}total', {canon('total_cents')} FROM {items}
      UNION ALL SELECT bill_id, {c}type', type FROM {charges} UNION ALL SELECT bill_id, {c}amount', {canon('amount_cents')} FROM {charges}
      UNION ALL SELECT bill_id, 'subtotal', coalesce({canon('subtotal_cents')}, '') FROM {bills} UNION ALL SELECT bill_id, 'grand_total', coalesce({canon('grand_cents')}, '') FROM {bills}"""


LEAVES = f"truth_leaves AS ({leaves_sql('bill_items', 'bill_charges', 'bills')}), pred_leaves AS ({leaves_sql('pred_items', 'pred_charges', 'pred_bills')})"


def truth(spark, d):
    return N.records(view(spark, d, "bills"), view(spark, d, "bill_items"), view(spark, d, "bill_charges"))


def predicted(spark, d):
    return N.records(view(spark, d, "pred_bills"), view(spark, d, "pred_items"), view(spark, d, "pred_charges"))


def raw_bills(spark, d):
    """Records as JSON text: every 29th broken, bills with one item with a bare object for the list, every 13th without charges' types."""
    rows = truth(spark, d)
    one = F.concat(F.lit('{"items":'), F.to_json(F.element_at("bill.items", 1)), F.lit(',"grand_total":"'), F.col("bill.grand_total"), F.lit('"}'))
    text = F.when(F.col("bill_id") % 29 == 0, "no bill here").when((F.col("bill_id") % 13 == 0) & (F.size("bill.items") == 1), one).otherwise(F.to_json("bill"))
    return rows.select("bill_id", text.alias("raw"))


def chatter(spark, d):
    """Model output: predictions in fences and talk, every 29th without an object."""
    rows = predicted(spark, d)
    text = F.when(F.col("bill_id") % 29 == 0, "I can't read this {").when(F.col("bill_id") % 3 == 0, F.concat(F.lit("Sure:\n```json\n"), F.to_json("bill"), F.lit("\n```\nDone."))).otherwise(F.to_json("bill"))
    return rows.select("bill_id", text.alias("raw"))


@query("normalize_bills", """WITH i AS (SELECT bill_id, count(*) AS n, sum(total_cents) AS t FROM bill_items GROUP BY bill_id), c AS (SELECT bill_id, count(*) AS n FROM bill_charges GROUP BY bill_id)
  SELECT b.bill_id, CAST(CASE WHEN b.bill_id % 29 = 0 THEN 0 ELSE coalesce(i.n, 0) END AS INT) AS n_items,
    CAST(CASE WHEN b.bill_id % 29 = 0 OR (b.bill_id % 13 = 0 AND i.n = 1) THEN 0 ELSE coalesce(c.n, 0) END AS INT) AS n_charges,
    CAST(CASE WHEN b.bill_id % 29 = 0 THEN 0 ELSE coalesce(t, 0) END / 100.0 AS DECIMAL(18,2)) AS items_total,
    CASE WHEN b.bill_id % 29 <> 0 AND NOT (b.bill_id % 13 = 0 AND coalesce(i.n, 0) = 1) THEN CAST(subtotal_cents / 100.0 AS DECIMAL(18,2)) END AS subtotal,
    CASE WHEN b.bill_id % 29 <> 0 THEN CAST(grand_cents / 100.0 AS DECIMAL(18,2)) END AS grand_total, 0 AS n_unreadable
  FROM bills b LEFT JOIN i ON b.bill_id = i.bill_id LEFT JOIN c ON b.bill_id = c.bill_id""")
def normalize_bills(spark, d):
    return N.normalize_bills(raw_bills(spark, d))


@query("normalize_predictions", f"""WITH {LEAVES} SELECT b.bill_id, b.bill_id % 29 <> 0 AS parsed, CASE WHEN b.bill_id % 29 = 0 THEN 0 ELSE (SELECT count(*) FROM pred_items i WHERE i.bill_id = b.bill_id) END AS n_items,
  CASE WHEN b.bill_id % 29 = 0 THEN '' ELSE coalesce({canon('grand_cents')}, '') END AS grand_total FROM pred_bills b""")
def normalize_predictions(spark, d):
    return N.normalize_predictions(chatter(spark, d)).select("bill_id", "parsed", F.size("bill.items").cast("long").alias("n_items"), F.col("bill.grand_total").alias("grand_total"))


@query("parse_failures", "SELECT source AS model, count(*) FILTER (WHERE bill_id % 29 = 0) AS failures, count(*) AS n FROM bills GROUP BY source")
def parse_failures(spark, d):
    rows = chatter(spark, d).join(view(spark, d, "bills").select("bill_id", "source"), "bill_id")
    return rows.groupBy(F.col("source").alias("model")).agg(F.count_if(extract_json(F.col("raw")).isNull()).alias("failures"), F.count(F.lit(1)).alias("n"))


@query("flatten_leaves", f"WITH {LEAVES} SELECT bill_id, regexp_replace(path, '\\[[0-9]+\\]', '') AS path, value FROM truth_leaves")
def flatten_leaves(spark, d):
    return N.flatten_leaves(truth(spark, d))


@query("leaf_paths", f"WITH {LEAVES} SELECT bill_id, path, value FROM truth_leaves")
def leaf_paths(spark, d):
    return N.leaf_paths(truth(spark, d))


TAGGED = f"""it AS (SELECT bill_id, string_agg('<s_name>' || name || '</s_name><s_qty>' || qty || '</s_qty><s_unit_price>' || {canon('unit_cents')} || '</s_unit_price><s_total>' || {canon('total_cents')} || '</s_total>', '<sep/>' ORDER BY item_idx) AS t FROM bill_items GROUP BY bill_id),
  ct AS (SELECT bill_id, string_agg('<s_type><' || type || '/></s_type><s_amount>' || {canon('amount_cents')} || '</s_amount>', '<sep/>' ORDER BY charge_idx) AS t FROM bill_charges GROUP BY bill_id),
  tagged AS (SELECT b.bill_id, '<s_items>' || coalesce(it.t, '') || '</s_items><s_charges>' || coalesce(ct.t, '') || '</s_charges><s_subtotal>' || coalesce({canon('subtotal_cents')}, '') || '</s_subtotal><s_grand_total>' || coalesce({canon('grand_cents')}, '') || '</s_grand_total>' AS text
    FROM bills b LEFT JOIN it ON b.bill_id = it.bill_id LEFT JOIN ct ON b.bill_id = ct.bill_id)"""


@query("tagged_text", f"WITH {TAGGED} SELECT * FROM tagged")
def tagged_text(spark, d):
    return N.tagged_text(truth(spark, d))


@query("target_length_profile", f"""WITH {TAGGED} SELECT round(quantile_cont(length(text), 0.5), 3) AS p50, round(quantile_cont(length(text), 0.9), 3) AS p90, round(quantile_cont(length(text), 0.95), 3) AS p95,
  round(quantile_cont(length(text), 0.99), 3) AS p99, max(length(text)) AS longest, round(avg(CASE WHEN length(text) > 768 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS over_limit FROM tagged""")
def target_length_profile(spark, d):
    n = N.tagged_text(truth(spark, d)).select(F.lit("all").alias("of"), F.length("text").alias("n"))
    whole = n.agg(F.max("n").cast("long").alias("longest"), F.round(F.avg((F.col("n") > 768).cast("int")), 4).alias("over_limit"))
    return whole.join(quantile_columns(n, "n", {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}).hint("broadcast"), F.lit(True), "left")  # one row each


def quantile_columns(rows, value, at):
    """One row with the quantiles of all values."""
    found = exact_quantiles(rows, "of", value, list(at.values()))
    return found.select(*(F.round(F.col("p")[i], 3).alias(name) for i, name in enumerate(at)))


@query("date_format_report", """SELECT CASE WHEN date = '' THEN 'empty' WHEN regexp_full_match(date, '[0-9][0-9]?/[0-9][0-9]?/[0-9]{4}') THEN 'dd/mm/yyyy' WHEN regexp_full_match(date, '[0-9][0-9]?-[0-9][0-9]?-[0-9]{4}') THEN 'dd-mm-yyyy'
  WHEN regexp_full_match(date, '[0-9][0-9]?/[0-9][0-9]?/[0-9]{2}') THEN 'dd/mm/yy' WHEN regexp_full_match(date, '[0-9][0-9]?-[0-9][0-9]?-[0-9]{2}') THEN 'dd-mm-yy' WHEN regexp_full_match(date, '[0-9]{4}-[0-9][0-9]?-[0-9][0-9]?') THEN 'yyyy-mm-dd'
  WHEN regexp_full_match(date, '[0-9][0-9]? *[A-Za-z]{3,9} *[0-9]{2,4}') THEN 'dd Mon yyyy' WHEN regexp_full_match(date, '[0-9][0-9]?[.][0-9][0-9]?[.][0-9]{2,4}') THEN 'dd.mm.yyyy' ELSE 'other' END AS layout, count(*) AS n FROM headers GROUP BY 1""")
def date_format_report(spark, d):
    return N.date_format_report(view(spark, d, "headers"))


POLICY = """pol AS (SELECT o_orderkey AS bill_id, o_orderkey % 3 * 5 AS service_pct, o_orderkey % 4 * 1000 AS packaging, CASE WHEN o_orderkey % 2 = 0 THEN 10 ELSE 0 END AS discount_pct, o_orderkey % 7 * 10000 AS discount_flat,
  CASE WHEN o_orderkey % 5 < 3 THEN 'CGST+SGST' ELSE 'GST' END AS tax_mode, CASE WHEN o_orderkey % 5 < 3 THEN 9 ELSE 5 END AS rate, o_orderkey % 2 = 1 AS whole FROM orders)"""


@query("compute_charges", f"""WITH {POLICY}, s AS (SELECT bill_id, CAST(sum(total_cents) AS BIGINT) AS subtotal FROM bill_items GROUP BY bill_id),
  a AS (SELECT p.*, subtotal, (subtotal * service_pct + 50) // 100 AS service, least(subtotal, CASE WHEN discount_pct > 0 THEN (subtotal * discount_pct + 50) // 100 ELSE discount_flat END) AS discount FROM pol p JOIN s ON p.bill_id = s.bill_id),
  t AS (SELECT *, ((subtotal - discount) * rate + 50) // 100 AS tax FROM a),
  u AS (SELECT *, subtotal + service + packaging - discount + tax * CASE WHEN tax_mode = 'GST' THEN 1 ELSE 2 END AS total FROM t),
  w AS (SELECT *, CASE WHEN NOT whole THEN 0 WHEN total % 100 > 50 OR (total % 100 = 50 AND (total // 100) % 2 = 1) THEN 100 - total % 100 ELSE -(total % 100) END AS off FROM u),
  l AS (SELECT bill_id, subtotal, 'SERVICE_CHARGE' AS type, service AS amount FROM w UNION ALL SELECT bill_id, subtotal, 'PACKAGING', packaging FROM w UNION ALL SELECT bill_id, subtotal, 'DISCOUNT', -discount FROM w
    UNION ALL SELECT bill_id, subtotal, 'CGST', tax FROM w WHERE tax_mode <> 'GST' UNION ALL SELECT bill_id, subtotal, 'SGST', tax FROM w WHERE tax_mode <> 'GST' UNION ALL SELECT bill_id, subtotal, 'GST', tax FROM w WHERE tax_mode = 'GST'
    UNION ALL SELECT bill_id, subtotal, 'ROUND_OFF', off FROM w) SELECT * FROM l WHERE amount <> 0""")
def compute_charges(spark, d):
    k = F.col("o_orderkey")
    policies = view(spark, d, "orders").select(
        k.alias("bill_id"), (k % 3 * 5).alias("service_pct"), (k % 4 * 1000).alias("packaging"), F.when(k % 2 == 0, 10).otherwise(0).alias("discount_pct"), (k % 7 * 10000).alias("discount_flat"),
        F.when(k % 5 < 3, "CGST+SGST").otherwise("GST").alias("tax_mode"), F.when(k % 5 < 3, 9).otherwise(5).alias("rate"), (k % 2 == 1).alias("whole"),
    )
    return N.compute_charges(view(spark, d, "bill_items"), policies)


_SUGGEST = "CASE WHEN qty > 0 AND total_cents % qty = 0 THEN total_cents // qty END"
ISSUES = f"""bad AS (SELECT *, {_SUGGEST} AS fix FROM read_items WHERE total_cents IS NULL OR abs(qty * unit_cents - total_cents) > 50),
  si AS (SELECT bill_id, sum(total_cents) AS s FROM read_items GROUP BY bill_id), sc AS (SELECT bill_id, sum(amount_cents) AS c, bool_or(type = 'ROUND_OFF') AS r FROM read_charges GROUP BY bill_id),
  pb AS (SELECT b.bill_id AS bill_id, subtotal_cents AS sub, grand_cents AS g, CAST(coalesce(s, 0) AS BIGINT) AS s, CAST(coalesce(subtotal_cents, s, 0) + coalesce(c, 0) AS BIGINT) AS want, coalesce(r, false) AS r FROM pred_bills b LEFT JOIN si ON b.bill_id = si.bill_id LEFT JOIN sc ON b.bill_id = sc.bill_id),
  issues AS (SELECT bill_id, 'items[' || item_idx || '].total' AS path, 'error' AS severity, 'missing/unreadable line total' AS message, NULL AS suggest_path, NULL AS suggest_value FROM bad WHERE total_cents IS NULL
    UNION ALL SELECT bill_id, 'items[' || item_idx || '].total', 'warn', 'qty x unit_price = ' || {plain('(qty * unit_cents)')} || ' but line total is ' || {plain('total_cents')}, CASE WHEN fix IS NOT NULL THEN 'items[' || item_idx || '].unit_price' END, {canon('fix')} FROM bad WHERE total_cents IS NOT NULL
    UNION ALL SELECT bill_id, 'charges[' || charge_idx || '].amount', 'error', 'unreadable charge amount', NULL, NULL FROM read_charges WHERE amount_cents IS NULL
    UNION ALL SELECT bill_id, 'subtotal', 'warn', 'subtotal missing; using sum of items', NULL, NULL FROM pb WHERE sub IS NULL
    UNION ALL SELECT bill_id, 'subtotal', 'error', 'items sum to ' || {plain('s')} || ' but subtotal is ' || {plain('sub')}, NULL, NULL FROM pb WHERE abs(s - sub) > 50
    UNION ALL SELECT bill_id, 'grand_total', 'error', 'grand total missing/unreadable', NULL, NULL FROM pb WHERE g IS NULL
    UNION ALL SELECT bill_id, 'grand_total', 'error', 'subtotal + charges = ' || {plain('want')} || ' but grand total is ' || {plain('g')} || CASE WHEN abs(g - want) < 100 AND NOT r THEN ' (looks like a missing ROUND_OFF line)' ELSE '' END, NULL, NULL FROM pb WHERE abs(g - want) > 50)"""


def issues(spark, d):
    return V.check_arithmetic(view(spark, d, "pred_bills"), view(spark, d, "read_items"), view(spark, d, "read_charges"))


@query("check_arithmetic", f"WITH {ISSUES} SELECT * FROM issues")
def check_arithmetic(spark, d):
    return issues(spark, d)


@query("is_consistent", f"WITH {ISSUES} SELECT bill_id FROM pred_bills WHERE bill_id NOT IN (SELECT bill_id FROM issues WHERE severity = 'error')")
def is_consistent(spark, d):
    return V.is_consistent(view(spark, d, "pred_bills"), issues(spark, d)).select("bill_id")


@query("repair_rates", f"""SELECT bill_id, item_idx, CASE WHEN abs(qty * unit_cents - total_cents) > 50 THEN coalesce({_SUGGEST}, unit_cents) ELSE unit_cents END AS unit_cents,
  abs(qty * unit_cents - total_cents) > 50 AND ({_SUGGEST}) IS NOT NULL AS repaired FROM (SELECT * FROM read_items WHERE qty IS NOT NULL AND total_cents IS NOT NULL)""")
def repair_rates(spark, d):
    return V.repair_rates(view(spark, d, "read_items").where("qty IS NOT NULL AND total_cents IS NOT NULL")).select("bill_id", "item_idx", "unit_cents", "repaired")


@query("repair_effect", f"""WITH r AS (SELECT p.bill_id AS bill_id, p.unit_cents AS u0, t.unit_cents AS u, CASE WHEN abs(p.qty * p.unit_cents - p.total_cents) > 50 AND p.qty > 0 AND p.total_cents % p.qty = 0 THEN p.total_cents // p.qty END AS fix
  FROM pred_items p JOIN bill_items t ON p.bill_id = t.bill_id AND p.item_idx = t.item_idx),
  s AS (SELECT bill_id, fix IS NOT NULL AS rep, u0 = u AS ok0, coalesce(fix, u0) = u AS ok1 FROM r), b AS (SELECT bill_id, bool_and(ok0) AS a0, bool_and(ok1) AS a1 FROM s GROUP BY bill_id)
  SELECT count(*) FILTER (WHERE rep) AS made, count(*) FILTER (WHERE rep AND NOT ok0 AND ok1) AS fixing, count(*) FILTER (WHERE rep AND ok0 AND NOT ok1) AS breaking,
    round(count(*) FILTER (WHERE ok0) / count(*), 4) AS right_before, round(count(*) FILTER (WHERE ok1) / count(*), 4) AS right_after,
    (SELECT count(*) FROM b WHERE a0) AS bills_right_before, (SELECT count(*) FROM b WHERE a1) AS bills_right_after FROM s""")
def repair_effect(spark, d):
    return V.repair_effect(view(spark, d, "bill_items"), view(spark, d, "pred_items"))


@query("filter_split_source", "SELECT id, source, split FROM manifest WHERE split = 'train' AND source IN ('src0', 'src3') ORDER BY id LIMIT 50")
def filter_split_source(spark, d):
    return V.filter_split_source(view(spark, d, "manifest").select("id", "source", "split"), "train", ["src0", "src3"], 50)


@query("drop_unusable", "SELECT bill_id FROM bills b WHERE grand_cents IS NOT NULL AND EXISTS (SELECT 1 FROM bill_items i WHERE i.bill_id = b.bill_id)")
def drop_unusable(spark, d):
    return V.drop_unusable(truth(spark, d)).select("bill_id")


@query("train_outliers", """SELECT b.bill_id FROM bills b LEFT JOIN (SELECT bill_id, max(qty) AS q, max(greatest(unit_cents, total_cents)) AS p FROM bill_items GROUP BY bill_id) i ON b.bill_id = i.bill_id
  WHERE split = 'train' AND coalesce(grand_cents > 60000000 OR grand_cents <= 0 OR q > 45 OR p > 60000000, false)""")
def train_outliers(spark, d):
    return V.train_outliers(view(spark, d, "bills"), view(spark, d, "bill_items"), 60_000_000, 45)


@query("validate_bill_limits", """WITH i AS (SELECT bill_id, count(*) AS n FROM bill_items GROUP BY bill_id), c AS (SELECT bill_id, count(*) AS n FROM bill_charges GROUP BY bill_id),
  r AS (SELECT b.bill_id, coalesce(i.n, 0) AS n_items, coalesce(c.n, 0) AS n_charges FROM bills b LEFT JOIN i ON b.bill_id = i.bill_id LEFT JOIN c ON b.bill_id = c.bill_id)
  SELECT bill_id, n_items, n_charges, n_items <= 6 AND n_charges <= 6 AS accepted, CASE WHEN n_items > 6 THEN 'too many items' WHEN n_charges > 6 THEN 'too many charges' END AS reason FROM r""")
def validate_bill_limits(spark, d):
    return V.validate_bill_limits(view(spark, d, "bills"), view(spark, d, "bill_items"), view(spark, d, "bill_charges"), 6)


_PARTY = "SELECT bill_id, CASE WHEN (bill_id + person_ord) % 31 = 0 THEN '  ' WHEN bill_id % 37 = 0 THEN CASE WHEN person_ord % 2 = 0 THEN ' Ann' ELSE 'ANN ' END ELSE person END AS person FROM people"


@query("validate_party", f"""WITH p AS ({_PARTY}), q AS (SELECT bill_id, lower(trim(person)) AS k FROM p WHERE trim(person) <> ''), c AS (SELECT bill_id, count(*) AS n, count(DISTINCT k) AS u FROM q GROUP BY bill_id)
  SELECT b.bill_id, coalesce(n, 0) AS n, coalesce(n > 0 AND n = u AND n <= 12, false) AS accepted, CASE WHEN coalesce(n, 0) = 0 THEN 'nobody' WHEN n <> u THEN 'duplicate name' WHEN n > 12 THEN 'too many people' END AS reason
  FROM (SELECT DISTINCT bill_id FROM p) b LEFT JOIN c ON b.bill_id = c.bill_id""")
def validate_party(spark, d):
    view(spark, d, "people").createOrReplaceTempView("people")
    return V.validate_party(spark.sql(_PARTY), 12)


@query("low_confidence_fields", "SELECT bill_id, path, p_min FROM field_conf WHERE p_min < 0.7")
def low_confidence_fields(spark, d):
    return V.low_confidence_fields(view(spark, d, "field_conf"), 0.7).select("bill_id", "path", "p_min")


@query("flag_join", f"WITH {LEAVES} SELECT l.bill_id, l.path, value, coalesce(p_min < 0.7, false) AS flagged FROM pred_leaves l LEFT JOIN field_conf f ON l.bill_id = f.bill_id AND l.path = f.path")
def flag_join(spark, d):
    return V.flag_join(predicted(spark, d), view(spark, d, "field_conf"), 0.7)


_PROBLEMS = """SELECT id, list_filter([CASE WHEN greatest(w, h) < 640 THEN 'low resolution' END, CASE WHEN blur < 15 THEN 'blurred' END, CASE WHEN mean < 60 THEN 'too dark' END,
  CASE WHEN paper > 225 AND contrast < 60 THEN 'washed out' WHEN contrast < 40 THEN 'low contrast' END], lambda x: x IS NOT NULL) AS problems, skew FROM image_stats"""


@query("quality_gate", f"SELECT id, problems, len(problems) > 0 AS retake FROM ({_PROBLEMS})")
def quality_gate(spark, d):
    return V.quality_gate(view(spark, d, "image_stats"))


@query("pick_showcase", """WITH n AS (SELECT bill_id FROM bill_items GROUP BY bill_id HAVING count(*) BETWEEN 3 AND 6), t AS (SELECT c.bill_id AS bill_id, bool_or(type = 'SERVICE_CHARGE') AS s, bool_or(type = 'DISCOUNT') AS d, bool_or(type = 'TAX') AS x, bool_or(type = 'ROUND_OFF') AS r
    FROM bill_charges c JOIN n ON c.bill_id = n.bill_id GROUP BY c.bill_id),
  a AS (SELECT min(bill_id) AS a FROM t WHERE s AND d), b AS (SELECT min(bill_id) AS b FROM t, a WHERE d AND NOT s AND bill_id <> a), c AS (SELECT min(bill_id) AS c FROM t, a, b WHERE x AND r AND bill_id <> a AND bill_id <> b)
  SELECT 'service and discount' AS kind, a AS bill_id FROM a UNION ALL SELECT 'discount only', b FROM b UNION ALL SELECT 'tax and rounding', c FROM c""")
def pick_showcase(spark, d):
    return V.pick_showcase(view(spark, d, "bills"), view(spark, d, "bill_items"), view(spark, d, "bill_charges"))


@query("corrections_diff", f"""WITH {LEAVES} SELECT coalesce(p.bill_id, t.bill_id) AS bill_id, coalesce(p.path, t.path) AS path, p.value AS was, t.value AS now FROM pred_leaves p FULL JOIN truth_leaves t ON p.bill_id = t.bill_id AND p.path = t.path
  WHERE lower(p.value) IS DISTINCT FROM lower(t.value)""")
def corrections_diff(spark, d):
    return V.corrections_diff(predicted(spark, d), truth(spark, d))


EDITS = """edits AS (SELECT bill_id, CASE WHEN s = 2 THEN 'subtotal' WHEN bill_id % 6 = 0 THEN 'no_such_field' ELSE 'grand_total' END AS path, s AS seq, CAST(bill_id % 1000 + s AS VARCHAR) AS value FROM pred_bills, (VALUES (0), (1), (2)) v(s) WHERE bill_id % 3 = 0)"""


def edits(spark, d):
    rows = view(spark, d, "pred_bills").where("bill_id % 3 = 0").select("bill_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("seq"))
    path = F.when(F.col("seq") == 2, "subtotal").when(F.col("bill_id") % 6 == 0, "no_such_field").otherwise("grand_total")
    return rows.select("bill_id", path.alias("path"), "seq", (F.col("bill_id") % 1000 + F.col("seq")).cast("string").alias("value"))


@query("apply_corrections", f"WITH {LEAVES}, {EDITS} SELECT l.bill_id, l.path, coalesce(e.value, l.value) AS value FROM pred_leaves l LEFT JOIN (SELECT bill_id, path, max_by(value, seq) AS value FROM edits GROUP BY bill_id, path) e ON l.bill_id = e.bill_id AND l.path = e.path")
def apply_corrections(spark, d):
    return N.leaf_paths(V.apply_corrections(predicted(spark, d), edits(spark, d)))


@query("top_examples", f"WITH {ISSUES} SELECT bill_id, path, message FROM issues WHERE severity = 'error' ORDER BY bill_id, path, message LIMIT 10")
def top_examples(spark, d):
    return V.first_k(issues(spark, d).where("severity = 'error'").select("bill_id", "path", "message"), ["bill_id", "path", "message"], 10)


PARSED = r"""parsed AS (SELECT id, raw, CASE id_kind WHEN 0 THEN 1250.5 WHEN 1 THEN k * 1000 WHEN 2 THEN -k WHEN 3 THEN -5000 WHEN 4 THEN k WHEN 5 THEN -k WHEN 6 THEN 1234567 END AS v
  FROM (SELECT id, raw, (id // 100 + id % 100) % 8 AS id_kind, TRY_CAST(regexp_extract(raw, '([0-9]+)', 1) AS DOUBLE) AS k FROM money_text))"""


@query("parse_rate", f"WITH {PARSED} SELECT round(count(v) / count(*), 4) AS parse_rate, round(quantile_cont(v, 0.5), 3) AS p50, round(quantile_cont(v, 0.95), 3) AS p95, round(CAST(min(v) AS DOUBLE), 3) AS lowest FROM parsed")
def parse_rate(spark, d):
    v = parse_money(F.col("raw")).cast("double")
    rows = view(spark, d, "money_text").select(F.lit("all").alias("of"), v.alias("v"))
    whole = rows.agg(F.round(F.count("v") / F.count(F.lit(1)), 4).alias("parse_rate"), F.round(F.min("v"), 3).alias("lowest"))
    return whole.join(quantile_columns(rows, "v", {"p50": 0.5, "p95": 0.95}).hint("broadcast"), F.lit(True), "left")  # one row each


HEADER_READ = "hread AS (SELECT id, CASE WHEN id % 11 = 0 THEN '' ELSE company END AS company, CASE WHEN id % 13 = 0 THEN '01/01/2000' ELSE date END AS date, CASE WHEN id % 7 = 0 THEN substr(address, 2) ELSE address END AS address, CASE WHEN id % 17 = 0 THEN '1.00' ELSE total END AS total FROM headers)"


def header_read(spark, d):
    view(spark, d, "headers").createOrReplaceTempView("headers")
    return spark.sql(HEADER_READ[len("hread AS ("):-1])


_n = lambda c: f"regexp_replace(lower({c}), '[^a-z0-9]+', '', 'g')"
_sim = lambda a, b: f"CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - CAST(levenshtein({a}, {b}) AS DOUBLE) / greatest(length({a}), length({b})) END"


@query("evaluate_headers", f"""WITH {HEADER_READ}, j AS (SELECT {_n('p.company')} AS pc, {_n('t.company')} AS tc, {_n('p.date')} AS pd, {_n('t.date')} AS td, {_n('p.address')} AS pa, {_n('t.address')} AS ta, p.total AS pt, t.total AS tt FROM hread p JOIN headers t ON p.id = t.id),
  k AS (SELECT *, pc = tc AS ec, pd = td AS ed, pa = ta AS ea, CAST(pt AS DECIMAL(18,2)) = CAST(tt AS DECIMAL(18,2)) AS et, {_sim('pc', 'tc')} AS sc, {_sim('pa', 'ta')} AS sa FROM j),
  m AS (SELECT count(*) AS n, avg(CAST(ec AS INT)) AS company_em, avg(CAST(ed AS INT)) AS date_em, avg(CAST(ea AS INT)) AS address_em, avg(CAST(et AS INT)) AS total_em, avg(sc) AS company_sim, avg(sa) AS address_sim,
    sum(CAST(ec AND pc <> '' AS INT) + CAST(ed AND pd <> '' AS INT) + CAST(ea AND pa <> '' AS INT) + CAST(et AS INT)) AS tp,
    sum(CAST(pc <> '' AS INT) + CAST(pd <> '' AS INT) + CAST(pa <> '' AS INT) + 1) AS np, sum(CAST(tc <> '' AS INT) + CAST(td <> '' AS INT) + CAST(ta <> '' AS INT) + 1) AS nt FROM k)
  SELECT n, round(company_em, 4) AS company_em, round(date_em, 4) AS date_em, round(address_em, 4) AS address_em, round(total_em, 4) AS total_em, round(company_sim, 4) AS company_sim, round(address_sim, 4) AS address_sim,
    round(2.0::DOUBLE * CAST(tp AS DOUBLE) / CAST(np + nt AS DOUBLE), 4) AS f1, round((company_sim + date_em + address_sim + total_em) / 4, 4) AS score FROM m""")
def evaluate_headers(spark, d):
    from tallyweave.operators.scoring import evaluate_headers as ev

    return ev(header_read(spark, d), view(spark, d, "headers"))


@query("field_presence", "SELECT field, round(avg(CAST(trim(v) <> '' AS INT)), 4) AS present FROM (SELECT 'company' AS field, company AS v FROM headers UNION ALL SELECT 'date', date FROM headers UNION ALL SELECT 'address', address FROM headers UNION ALL SELECT 'total', total FROM headers) GROUP BY field")
def field_presence(spark, d):
    names = ("company", "date", "address", "total")
    rows = view(spark, d, "headers").unpivot([], list(names), "field", "v")
    return rows.groupBy("field").agg(F.round(F.avg((F.trim(F.coalesce("v", F.lit(""))) != "").cast("int")), 4).alias("present"))


