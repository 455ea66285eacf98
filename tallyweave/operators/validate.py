"""Record checks: arithmetic, repairs, limits, parties, corrections, image quality. Money in cents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.money import canon_num, format_money, money_from_cents


def _rate_is_off(tol: int) -> Column:
    return F.abs(F.col("qty") * F.col("unit_cents") - F.col("total_cents")) > tol


def _suggestion() -> Column:
    """Line total / quantity if it is a whole number of cents."""
    whole = (F.col("qty") > 0) & (F.try_mod(F.col("total_cents"), F.col("qty").cast("long")) == 0)
    return F.when(whole, (F.expr("total_cents div nullif(qty, 0)")).cast("long"))


def check_arithmetic(bills: DataFrame, items: DataFrame, charges: DataFrame, tol: int = 50) -> DataFrame:
    """Issues (bill_id, path, severity, message, suggest_path, suggest_value).

    One pass over the lines and one aggregate for each bill; all exchanges are on bill_id. Paths and message texts are fixed
    values that users of the checks match on.
    """
    text = F.lit(None).cast("string")
    path = F.format_string("items[%d].total", "item_idx")
    lines = items.where(F.col("total_cents").isNull() | F.coalesce(_rate_is_off(tol), F.lit(False)))
    unreadable = F.col("total_cents").isNull()
    fix = F.when(~unreadable, canon_num(money_from_cents(_suggestion())))
    line_issues = lines.select(
        "bill_id", path.alias("path"), F.when(unreadable, "error").otherwise("warn").alias("severity"),
        F.when(unreadable, "missing/unreadable line total").otherwise(F.concat(F.lit("qty x unit_price = "), format_money(F.col("qty") * F.col("unit_cents")), F.lit(" but line total is "), format_money(F.col("total_cents")))).alias("message"),
        F.when(fix.isNotNull(), F.format_string("items[%d].unit_price", "item_idx")).alias("suggest_path"), fix.alias("suggest_value"),
    )
    charge_issues = charges.where("amount_cents IS NULL").select(
        "bill_id", F.format_string("charges[%d].amount", "charge_idx").alias("path"), F.lit("error").alias("severity"), F.lit("unreadable charge amount").alias("message"), text.alias("suggest_path"), text.alias("suggest_value")
    )
    i = items.groupBy("bill_id").agg(F.sum("total_cents").alias("item_sum"))
    c = charges.groupBy("bill_id").agg(F.sum("amount_cents").alias("charge_sum"), F.bool_or(F.col("type") == "ROUND_OFF").alias("has_round"))
    b = bills.join(i, "bill_id", "left").join(c, "bill_id", "left").select(
        "bill_id", "subtotal_cents", "grand_cents", F.coalesce("item_sum", F.lit(0)).alias("s"), F.coalesce("charge_sum", F.lit(0)).alias("cs"), F.coalesce("has_round", F.lit(False)).alias("r")
    )
    want = F.coalesce("subtotal_cents", "s") + F.col("cs")
    gap = F.abs(F.col("grand_cents") - want)
    issue = lambda when, p, sev, msg: F.when(when, F.struct(F.lit(p).alias("path"), F.lit(sev).alias("severity"), msg.alias("message")))
    found = F.array_compact(F.array(
        issue(F.col("subtotal_cents").isNull(), "subtotal", "warn", F.lit("subtotal missing; using sum of items")),
        issue(F.abs(F.col("s") - F.col("subtotal_cents")) > tol, "subtotal", "error", F.concat(F.lit("items sum to "), format_money(F.col("s")), F.lit(" but subtotal is "), format_money(F.col("subtotal_cents")))),
        issue(F.col("grand_cents").isNull(), "grand_total", "error", F.lit("grand total missing/unreadable")),
        issue(gap > tol, "grand_total", "error", F.concat(F.lit("subtotal + charges = "), format_money(want), F.lit(" but grand total is "), format_money(F.col("grand_cents")), F.when((gap < 100) & ~F.col("r"), " (looks like a missing ROUND_OFF line)").otherwise(""))),
    ))
    bill_issues = b.select("bill_id", F.explode(found).alias("x")).select("bill_id", "x.path", "x.severity", "x.message", text.alias("suggest_path"), text.alias("suggest_value"))
    return line_issues.unionByName(bill_issues).unionByName(charge_issues)


def is_consistent(bills: DataFrame, issues: DataFrame) -> DataFrame:
    """Bills without an error."""
    return bills.join(issues.where("severity = 'error'").select("bill_id").hint("merge"), "bill_id", "left_anti")


def repair_rates(items: DataFrame, tol: int = 50) -> DataFrame:
    """Items with every suggested rate put in; `repaired` marks them."""
    fix = F.when(F.coalesce(_rate_is_off(tol), F.lit(False)), _suggestion())
    return items.withColumn("__fix", fix).withColumn("unit_cents", F.coalesce("__fix", "unit_cents")).withColumn("repaired", F.col("__fix").isNotNull()).drop("__fix")


def repair_effect(truth: DataFrame, read: DataFrame) -> DataFrame:
    """One row: suggestions made, fixing and breaking; share of items right before and after; bills with all rates right."""
    rows = repair_rates(read).select("bill_id", "item_idx", F.col("unit_cents").alias("after"), "repaired").join(read.select("bill_id", "item_idx", F.col("unit_cents").alias("before")), ["bill_id", "item_idx"])
    rows = rows.join(truth.select("bill_id", "item_idx", F.col("unit_cents").alias("true")), ["bill_id", "item_idx"]).withColumn("ok0", F.col("before") == F.col("true")).withColumn("ok1", F.col("after") == F.col("true"))
    per = rows.groupBy("bill_id").agg(
        F.count_if("repaired").alias("made"), F.count_if(F.col("repaired") & ~F.col("ok0") & F.col("ok1")).alias("fixing"), F.count_if(F.col("repaired") & F.col("ok0") & ~F.col("ok1")).alias("breaking"),
        F.count(F.lit(1)).alias("n"), F.count_if("ok0").alias("right0"), F.count_if("ok1").alias("right1"), F.bool_and("ok0").alias("all0"), F.bool_and("ok1").alias("all1"),
    )
    return per.agg(
        F.sum("made").alias("made"), F.sum("fixing").alias("fixing"), F.sum("breaking").alias("breaking"), F.round(F.sum("right0") / F.sum("n"), 4).alias("right_before"), F.round(F.sum("right1") / F.sum("n"), 4).alias("right_after"),
        F.count_if("all0").alias("bills_right_before"), F.count_if("all1").alias("bills_right_after"),
    )


def filter_split_source(manifest: DataFrame, split: str, sources: list[str] | None = None, n: int | None = None) -> DataFrame:
    """Records of a split and, if given, sources; the first n by id."""
    rows = manifest.where(F.col("split") == split)
    rows = rows.where(F.col("source").isin(sources)) if sources else rows
    return rows.orderBy("id").limit(n) if n else rows


def drop_unusable(records: DataFrame) -> DataFrame:
    """Records with items and a readable grand total."""
    from tallyweave.functions.money import parse_money

    return records.where((F.size("bill.items") > 0) & parse_money(F.col("bill.grand_total")).isNotNull())


def train_outliers(bills: DataFrame, items: DataFrame, most: int = 10_000_000_000, most_qty: int = 50) -> DataFrame:
    """Training bills with a total over the limit or not positive, a quantity over its limit or a price over the limit."""
    per = items.groupBy("bill_id").agg(F.max("qty").alias("q"), F.max(F.greatest("unit_cents", "total_cents")).alias("p"))
    rows = bills.where("split = 'train'").join(per, "bill_id", "left")
    bad = (F.col("grand_cents") > most) | (F.col("grand_cents") <= 0) | (F.col("q") > most_qty) | (F.col("p") > most)
    return rows.where(F.coalesce(bad, F.lit(False))).select("bill_id")


def validate_bill_limits(bills: DataFrame, items: DataFrame, charges: DataFrame, most: int = 200) -> DataFrame:
    """(bill_id, n_items, n_charges, accepted, reason)."""
    n = lambda t, name: t.groupBy("bill_id").agg(F.count(F.lit(1)).alias(name))
    rows = bills.select("bill_id").join(n(items, "i"), "bill_id", "left").join(n(charges, "c"), "bill_id", "left").select("bill_id", F.coalesce("i", F.lit(0)).alias("n_items"), F.coalesce("c", F.lit(0)).alias("n_charges"))
    reason = F.when(F.col("n_items") > most, "too many items").when(F.col("n_charges") > most, "too many charges")
    return rows.select("*", reason.isNull().alias("accepted"), reason.alias("reason"))


def validate_party(people: DataFrame, most: int = 40, longest: int = 40) -> DataFrame:
    """(bill_id, n, accepted, reason) of each bill's party: names trimmed and cut, blank ones dropped."""
    names = people.select("bill_id", F.left(F.trim("person"), F.lit(longest)).alias("p")).where("p <> ''")
    twice = names.groupBy("bill_id", F.lower("p").alias("k")).agg(F.count(F.lit(1)).alias("k_n")).groupBy("bill_id").agg(F.max("k_n").alias("top"), F.sum("k_n").alias("n"))
    rows = people.select("bill_id").distinct().join(twice, "bill_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    reason = F.when(F.col("n") == 0, "nobody").when(F.col("top") > 1, "duplicate name").when(F.col("n") > most, "too many people")
    return rows.select("bill_id", "n", reason.isNull().alias("accepted"), reason.alias("reason"))


def low_confidence_fields(conf: DataFrame, threshold: float, score: str = "p_min") -> DataFrame:
    return conf.where(F.col(score) < threshold)


def flag_join(records: DataFrame, conf: DataFrame, threshold: float) -> DataFrame:
    """Every leaf of the records (bill_id, bill) with its flag: (bill_id, path, value, flagged). Joined by bill: only flagged paths are listed."""
    from tallyweave.operators.normalise import leaf_list

    low = conf.where(F.col("p_min") < threshold).groupBy("bill_id").agg(F.collect_set("path").alias("low"))  # one bill's paths
    rows = records.select("bill_id", "bill").join(low.hint("merge"), "bill_id", "left")
    rows = rows.select("bill_id", "low", F.explode(leaf_list(F.col("bill"))).alias("l"))
    return rows.select("bill_id", "l.path", "l.value", F.coalesce(F.array_contains("low", F.col("l.path")), F.lit(False)).alias("flagged"))


def quality_gate(stats: DataFrame) -> DataFrame:
    """(id, problems, retake) from image statistics."""
    when = lambda c, text: F.when(c, text)
    washed = (F.col("paper") > 225) & (F.col("contrast") < 60)
    problems = F.array_compact(F.array(
        when(F.greatest("w", "h") < 640, "low resolution"), when(F.col("blur") < 15, "blurred"), when(F.col("mean") < 60, "too dark"),
        F.when(washed, "washed out").when(F.col("contrast") < 40, "low contrast"),
    ))
    return stats.select("id", problems.alias("problems"), (F.size(problems) > 0).alias("retake"))


def pick_showcase(bills: DataFrame, items: DataFrame, charges: DataFrame) -> DataFrame:
    """(kind, bill_id): for each of three kinds of bill the first unused one with 3 to 6 items."""
    n = items.groupBy("bill_id").agg(F.count(F.lit(1)).alias("n"))
    kinds = charges.groupBy("bill_id").agg(F.collect_set("type").alias("types"))
    rows = bills.select("bill_id").join(n.where("n BETWEEN 3 AND 6"), "bill_id").join(kinds, "bill_id")
    has = lambda t: F.array_contains("types", t)
    wanted = [("service and discount", has("SERVICE_CHARGE") & has("DISCOUNT")), ("discount only", has("DISCOUNT") & ~has("SERVICE_CHARGE")), ("tax and rounding", has("TAX") & has("ROUND_OFF"))]
    # The three first bills of each kind are enough to leave out those picked before.
    firsts = None
    for order, (kind, test) in enumerate(wanted):
        part = rows.where(test).orderBy("bill_id").limit(3).select(F.lit(order).alias("o"), F.lit(kind).alias("kind"), "bill_id")
        firsts = part if firsts is None else firsts.unionByName(part)
    found = firsts.groupBy().agg(F.sort_array(F.collect_list(F.struct("o", "bill_id", "kind"))).alias("l"))  # at most nine rows
    pick = F.aggregate(
        "l", F.expr("cast(array() as array<struct<o:int,kind:string,bill_id:bigint>>)"),
        lambda got, x: F.when(F.exists(got, lambda g: (g["o"] == x["o"]) | (g["bill_id"] == x["bill_id"])), got).otherwise(F.concat(got, F.array(F.struct(x["o"].alias("o"), x["kind"].alias("kind"), x["bill_id"].alias("bill_id"))))),
    )
    return found.select(F.explode(pick).alias("p")).select("p.kind", "p.bill_id")


def corrections_diff(read: DataFrame, truth: DataFrame) -> DataFrame:
    """(bill_id, path, was, now) of leaves that differ between records (bill_id, bill): names without case, numbers by value."""
    from tallyweave.functions.money import parse_money
    from tallyweave.operators.normalise import leaves_apart

    rows = leaves_apart(read, truth).where("size(was) > 0 OR size(now) > 0")
    paths = F.array_union(F.col("was.path"), F.col("now.path"))
    value = lambda side, x: F.get(F.filter(side, lambda l: l["path"] == x), F.lit(0))["value"]
    rows = rows.select("bill_id", F.explode(F.transform(paths, lambda x: F.struct(x.alias("path"), value("was", x).alias("was"), value("now", x).alias("now")))).alias("l")).select("bill_id", "l.*")
    name = F.col("path").endswith(".name") | F.col("path").endswith(".type")
    same = F.when(name, F.lower("was").eqNullSafe(F.lower("now"))).otherwise(parse_money(F.col("was")).eqNullSafe(parse_money(F.col("now"))) & F.col("was").isNotNull().eqNullSafe(F.col("now").isNotNull()))
    return rows.where(~same)


def apply_corrections(records: DataFrame, edits: DataFrame) -> DataFrame:
    """Records (bill_id, bill) with edits (bill_id, path, seq, value) put in: the last edit of a path wins, unknown paths are ignored."""
    from tallyweave.operators.normalise import corrected

    own = edits.groupBy("bill_id").agg(F.collect_list(F.struct("path", "seq", "value")).alias("edits"))  # one bill's edits
    rows = records.select("bill_id", "bill").where("bill.items IS NOT NULL AND bill.charges IS NOT NULL").join(own.hint("merge"), "bill_id", "left")
    return rows.select("bill_id", corrected(F.col("bill"), F.col("edits")).alias("bill"))


def correct_leaves(leaves: DataFrame, edits: DataFrame) -> DataFrame:
    """Leaves (bill_id, path, value) after the edits."""
    last = edits.groupBy("bill_id", "path").agg(F.max_by("value", "seq").alias("new"))
    return leaves.join(last.hint("merge"), ["bill_id", "path"], "left").select("bill_id", "path", F.coalesce("new", "value").alias("value"))


def first_k(rows: DataFrame, order: list[str], k: int) -> DataFrame:
    return rows.orderBy(*order).limit(k)


def changed_since(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Adds whether value differs from the previous row of the key."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("changed", F.coalesce(F.col(value) != F.lag(value).over(w), F.lit(True)))
