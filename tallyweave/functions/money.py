"""Column expressions for money text, labels and shares, and the same as SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: The closed list of charge types, and those that are taxes.
CHARGE_TYPES = ["CGST", "SGST", "IGST", "GST", "VAT", "TAX", "SERVICE_CHARGE", "PACKAGING", "DISCOUNT", "ROUND_OFF", "OTHER"]
TAX_TYPES = ["CGST", "SGST", "IGST", "GST", "VAT", "TAX"]

#: Patterns of a lower-cased label without dots, the first that matches decides.
CHARGE_RULES = [
    (r"\bcgst\b|central\s*gst", "CGST"),
    (r"\bsgst\b|\butgst\b|state\s*gst", "SGST"),
    (r"\bigst\b", "IGST"),
    (r"service|svc|\bs\s*(charge|chg)", "SERVICE_CHARGE"),
    (r"packag|parcel|\bpkg\b|container", "PACKAGING"),
    (r"discount|\bdisc\b|\boffer\b|coupon|promo", "DISCOUNT"),
    (r"round|\br/?off\b", "ROUND_OFF"),
    (r"\bvat\b", "VAT"),
    (r"\bgst\b", "GST"),
    (r"tax|pb1|ppn", "TAX"),
]

#: Names of charge types in exports; the others keep their codes.
EXPORT_NAMES = {"SERVICE_CHARGE": "Service Charge", "ROUND_OFF": "Round Off", "PACKAGING": "Packaging", "DISCOUNT": "Discount", "OTHER": "Other"}

_DIGITS = "".join(chr(start + i) for start in (0x660, 0x6F0, 0x966, 0xFF10) for i in range(10))


def parse_money(text: Column) -> Column:
    """Money text as DECIMAL(38,4); null where there is no number.

    Negative with a leading or trailing minus or in brackets. Of two kinds of separator the last is decimal; one kind
    separates thousands if it occurs more than once or has exactly three digits after it.
    """
    simple = text.cast("string").rlike(r"^-?[0-9]+(\.[0-9]{1,2})?$")  # most texts; they need none of the steps below
    t = F.trim(F.translate(text.cast("string"), _DIGITS, "0123456789" * 4))
    negative = t.startswith("-") | t.endswith("-") | (t.startswith("(") & t.endswith(")"))
    d = F.regexp_replace(F.regexp_replace(t, "[^0-9.,]", ""), "^[.,]+|[.,]+$", "")
    marks = F.length(d) - F.length(F.translate(d, ".,", ""))
    both = d.contains(",") & d.contains(".")
    comma_last = d.rlike(",[^.]*$")
    thousands = (marks > 1) | (F.length(F.regexp_extract(d, "([^.,]*)$", 1)) == 3)
    plain = (
        F.when(both & comma_last, F.translate(d, ",.", "."))
        .when(both, F.translate(d, ",", ""))
        .when(thousands, F.translate(d, ".,", ""))
        .otherwise(F.translate(d, ",", "."))
    )
    value = plain.try_cast("decimal(38,4)")
    none = F.coalesce(text.cast("string"), F.lit("")) == ""  # spares the steps below, which all lead to null
    return F.when(none, F.lit(None).cast("decimal(38,4)")).when(simple, text.try_cast("decimal(38,4)")).when(negative, -value).otherwise(value)


def canon_num(value: Column) -> Column:
    """Two places at most, half up, without trailing zeros."""
    return F.regexp_replace(F.round(value.cast("decimal(38,4)"), 2).cast("decimal(38,2)").cast("string"), r"\.?0+$", "")


def to_cents(value: Column) -> Column:
    """Minor units, half up; null counts as 0."""
    return F.coalesce(F.round(value * 100, 0).cast("long"), F.lit(0).cast("long"))


def money_from_cents(cents: Column) -> Column:
    return (cents.cast("decimal(18,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(20,2)")


def _div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def format_money(cents: Column, symbol: str = "") -> Column:
    sign = F.when(cents < 0, f"-{symbol}").otherwise(symbol)
    return F.concat(sign, _div(F.abs(cents), 100).cast("string"), F.lit("."), F.lpad((F.abs(cents) % 100).cast("string"), 2, "0"))


def canon_cents(cents: Column) -> Column:
    """canon_num of whole cents, by whole numbers alone."""
    rest = F.abs(cents) % 100
    end = F.when(rest == 0, "").when(rest % 10 == 0, F.concat(F.lit("."), _div(rest, 10).cast("string"))).otherwise(F.concat(F.lit("."), F.lpad(rest.cast("string"), 2, "0")))
    return F.concat(F.when(cents < 0, "-").otherwise(""), _div(F.abs(cents), 100).cast("string"), end)


def parse_int(text: Column, default: int | None = None) -> Column:
    """The first run of digits."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"(\d+)", 1), F.lit("")).try_cast("int"), F.lit(default).cast("int"))


def charge_type(label: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), r"\.", "")
    out = F.lit("OTHER")
    for pattern, kind in reversed(CHARGE_RULES):
        out = F.when(plain.rlike(pattern), kind).otherwise(out)
    return out


def norm_name(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "")


def extract_json(text: Column) -> Column:
    """The text from the first { to the last }, code fences removed; null if that is no JSON object."""
    plain = F.regexp_replace(text, "```(json)?", "")
    body = F.regexp_extract(plain, r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(body).isNotNull() & (body != ""), body)


def gcd(a: Column, b: Column) -> Column:
    """Of two positive numbers: Euclid's steps, of which a pair with a least number n needs 2 log2(n) + 2 at most."""
    steps = F.sequence(F.lit(1), (F.log2(F.least(a, b).cast("double")) * 2).cast("int") + 2)
    start = F.struct(a.cast("long").alias("x"), b.cast("long").alias("y"))
    return F.aggregate(steps, start, lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] % F.nullif(s["y"], F.lit(0))).alias("y"))))["x"]


def share_label(units: Column, total: Column) -> Column:
    reduced = F.transform(F.array(gcd(units, total)), lambda g: F.concat(_div(units.cast("long"), g).cast("string"), F.lit("/"), _div(total.cast("long"), g).cast("string"), F.lit(" share")))[0]
    return F.when(units == total, "full").otherwise(reduced)


def charge_label(kind: Column) -> Column:
    return F.when(kind.isin(TAX_TYPES), kind).otherwise(F.initcap(F.regexp_replace(kind, "_", " ")))


def percent_text(part: Column, whole: Column, plus: bool = False) -> Column:
    """part / whole in percent with one place, half away from zero: whole numbers only, so a tie doesn't hang on a double. 0 if
    whole is 0. plus: with a sign, + for zero too."""
    big = lambda c: F.abs(c).cast("decimal(33,0)")
    top, bottom = (big(part) * 2000 + big(whole)).cast("decimal(38,0)"), (big(whole) * 2).cast("decimal(38,0)")
    small = (F.abs(part) < 10**15) & (F.abs(whole) < 10**15)  # fits in longs
    tenths = F.when(small, _div(F.abs(part) * 2000 + F.abs(whole), F.nullif(F.abs(whole) * 2, F.lit(0)))).otherwise(F.try_divide(top - F.try_mod(top, bottom), bottom).cast("long"))
    return F.transform(F.array(F.coalesce(tenths, F.lit(0))), lambda t: F.concat(
        F.when(((part < 0) != (whole < 0)) & (t > 0), "-").otherwise("+" if plus else ""), _div(t, 10).cast("string"), F.lit("."), (t % 10).cast("string"),
    ))[0]


def suggest_unit_price(qty: Column, total: Column) -> Column:
    """total / qty as canonical text if it is a whole number of cents."""
    rate = F.round(F.try_divide(total.cast("decimal(20,4)"), F.when(qty > 0, qty.cast("decimal(10,4)"))), 2).cast("decimal(20,2)")
    return F.when((qty > 0) & (rate * qty.cast("decimal(10,4)") == total), canon_num(rate))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longest)


def register_sql_functions(spark: SparkSession) -> None:
    """The scalars as temporary SQL functions, so that SQL users have them without a Python UDF."""
    rules = " ".join(f"WHEN p RLIKE r'{pattern}' THEN '{kind}'" for pattern, kind in CHARGE_RULES)
    for body in (
        "norm_name(s STRING) RETURNS STRING RETURN regexp_replace(lower(coalesce(s, '')), '[^a-z0-9]+', '')",
        r"canon_num(x DECIMAL(38,4)) RETURNS STRING RETURN regexp_replace(cast(cast(round(x, 2) AS DECIMAL(38,2)) AS STRING), r'\.?0+$', '')",
        "to_cents(x DECIMAL(38,4)) RETURNS BIGINT RETURN coalesce(cast(round(x * 100, 0) AS BIGINT), 0)",
        "format_cents(c BIGINT) RETURNS STRING RETURN format_string('%s%d.%02d', if(c < 0, '-', ''), abs(c) div 100, abs(c) % 100)",
        f"charge_type(s STRING) RETURNS STRING RETURN (SELECT CASE {rules} ELSE 'OTHER' END FROM (SELECT regexp_replace(lower(coalesce(s, '')), '[.]', '') AS p))",
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {body}")
