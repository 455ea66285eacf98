import pytest
from pyspark.sql import functions as F

from tallyweave.functions import money as M

MONEY = [
    ("2,345.75", "2345.7500"), ("EUR 7.125", "7125.0000"), ("(310.5)", "-310.5000"), ("-9,100", "-9100.0000"), ("$ 3,070.20", "3070.2000"), ("61,40", "61.4000"), ("88-", "-88.0000"),
    ("9.876.543", "9876543.0000"), ("", None), (None, None), ("n/a", None), ("6.543,21", "6543.2100"), ("٧٣", "73.0000"), (",.", None), ("0", "0.0000"),
]


def test_parse_money(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(MONEY)], "i int, t string")
    got = {r.i: r.v for r in rows.select("i", M.parse_money(F.col("t")).alias("v")).collect()}
    assert [None if got[i] is None else str(got[i]) for i in range(len(MONEY))] == [v for _, v in MONEY]


@pytest.mark.parametrize("value,text", [("73.00", "73"), ("2.30", "2.3"), ("-0.004", "0"), ("600", "600"), ("0.015", "0.02"), ("8020.90", "8020.9"), ("-5.125", "-5.13")])
def test_canon_num(spark, value, text):
    assert spark.range(1).select(M.canon_num(F.lit(value).cast("decimal(38,4)")).alias("v")).first().v == text


@pytest.mark.parametrize("label,kind", [("sgst @ 2.5", "SGST"), ("Rounding off", "ROUND_OFF"), ("Service Chg", "SERVICE_CHARGE"), ("Packaging fee", "PACKAGING"), ("Zebra", "OTHER"), (None, "OTHER"), ("gst 5%", "GST")])
def test_charge_type(spark, label, kind):
    assert spark.range(1).select(M.charge_type(F.lit(label).cast("string")).alias("v")).first().v == kind


def test_rates_shares_and_text(spark):
    one = spark.range(1)
    rate = lambda q, t: one.select(M.suggest_unit_price(F.lit(q).cast("decimal(10,2)"), F.lit(t).cast("decimal(20,2)")).alias("v")).first().v
    assert rate("4", "90") == "22.5" and rate("7", "20") is None and rate("0", "8") is None and rate(None, "8") is None
    assert one.select(M.share_label(F.lit(6), F.lit(8)).alias("v")).first().v == "3/4 share"
    assert one.select(M.share_label(F.lit(6), F.lit(6)).alias("v")).first().v == "full"
    assert one.select(M.format_money(F.lit(-70309), "₹").alias("v")).first().v == "-₹703.09"
    assert one.select(M.extract_json(F.lit('Here you go ```json\n{"k": {"n": [2]}}\n``` end')).alias("v")).first().v == '{"k": {"n": [2]}}'
    assert one.select(M.extract_json(F.lit("no object {")).alias("v")).first().v is None


def test_sql_functions(spark):
    M.register_sql_functions(spark)
    got = spark.sql("SELECT norm_name('Mint & Lime 2') AS a, canon_num(7.80) AS b, to_cents(3.215) AS c, format_cents(-409) AS d, charge_type('Discount 10%') AS e").first()
    assert tuple(got) == ("mintlime2", "7.8", 322, "-4.09", "DISCOUNT")
