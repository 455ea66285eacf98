"""Figures that doubles would round to the wrong side."""

import pytest

from tallyweave.operators import ledger as L


@pytest.mark.parametrize("pre, charge, net", [(50_292_000, 26_378_154, "+52.5%"), (9_296_000, -711_144, "-7.7%"), (1_000_000, -499, "+0.0%"), (0, 0, "+0.0%")])
def test_percentages_at_a_tie_are_rounded_away_from_zero(spark, pre, charge, net):
    totals = spark.createDataFrame([(1, 0, "A", pre, charge, pre + charge, pre + charge, False, False, 0, 0), (1, 1, "B", 1_000, 0, 1_000, 1_000, False, False, 0, 0)],
        "bill_id long, person_ord int, person string, pre_tax long, charge_total long, computed_final long, final long, manual boolean, rebalanced boolean, unreconciled long, diff_vs_printed long")
    shares = spark.createDataFrame([(1, 0, "tea", "A", 0, 1, 1, pre)], "bill_id long, item_idx int, name string, person string, ord int, units int, total_units long, amount long")
    charges = spark.createDataFrame([(1, 0, "TAX", 0, "A", charge or 1)], "bill_id long, charge_idx int, type string, person_ord int, person string, amount long")
    summary = spark.createDataFrame([(1, "Items", pre + 1_000)], "bill_id long, line string, cents long")
    text = {r.line_no: r.text for r in L.explain_split(totals, shares, charges, summary).collect()}
    assert f"({net} of A's subtotal)" in text[1]
    if pre == 9_296_000:
        assert "is 100.0% of" in text[1]


def _records(spark, rows):
    return spark.createDataFrame(rows, "bill_id long, bill struct<items:array<struct<name:string,qty:string,unit_price:string,total:string>>,charges:array<struct<type:string,amount:string>>,subtotal:string,grand_total:string>")


@pytest.mark.parametrize("name", ["corrections_diff", "match_fields", "flag_join", "remove_person", "largest_remainder"])
def test_leaves_of_two_readings_are_compared_without_shuffling_them(spark, sf_dir, name):
    from tallyweave import plans  # noqa: F401
    from tallyweave.registry import QUERIES

    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    found = [x.strip() for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert not found


def test_leaves_match_as_multisets_and_earlier_paths_consume_first(spark):
    from tallyweave.operators import scoring as S
    from tallyweave.operators import validate as V

    item = lambda name, qty: (name, qty, "5", "5")
    want = [(1, ([item("Tea", "1")] + [item("Cake", "2")] * 11, [("TAX", "1.0")], "", "9")), (2, ([], [], "1", "1"))]
    read = [(1, ([item("TEA!", "1")] + [item("Tea", "3")] * 11, [], "", "10")), (3, ([item("x", "1")], [], "", ""))]
    p, t = _records(spark, read), _records(spark, want)
    got = {(r.bill_id, r.path): r.correct for r in S.match_fields(p, t).collect()}
    assert got[1, "items[0].name"] == 1 and sum(v for (b, k), v in got.items() if b == 1 and k.endswith("name")) == 1
    assert got[1, "items[0].qty"] == 1 and got[1, "items[10].qty"] == 0 and got[1, "items[11].total"] == 1 and got[1, "subtotal"] == 1 and got[1, "grand_total"] == 0
    assert not any(v for (b, _), v in got.items() if b == 3)
    counts = {r.bill_id: (r.tp, r.fp, r.fn) for r in S.field_counts(p, t).collect()}
    assert counts[1] == (27, 23, 25) and counts[2] == (0, 0, 2) and counts[3] == (0, 6, 0)
    diff = {(r.bill_id, r.path): (r.was, r.now) for r in V.corrections_diff(p, t).collect()}
    assert diff[1, "items[0].name"] == ("TEA!", "Tea") and diff[1, "charges[0].amount"] == (None, "1.0") and (1, "items[0].qty") not in diff and diff[3, "subtotal"] == ("", None)


def test_tree_distance_by_bounds_is_the_tables_and_needs_few_of_them(monkeypatch):
    import random

    from tallyweave.functions import trees as T

    rnd = random.Random(5)
    value = lambda depth: rnd.choice(["a", "ab", "b", ""]) if depth == 0 or rnd.random() < 0.3 else [value(depth - 1) for _ in range(rnd.randrange(4))] if rnd.random() < 0.5 else {k: value(depth - 1) for k in rnd.sample("xyz", rnd.randrange(4))}
    for _ in range(600):
        a, b = value(3), value(3)
        if rnd.random() < 0.5 and isinstance(a, list):
            b = [x if rnd.random() < 0.8 else value(1) for x in a]
        assert T.forest_distance((T.node_of(a),), (T.node_of(b),), {}) == pytest.approx(T.tree_distance(T.tree_of(a), T.tree_of(b)), abs=1e-9)
    calls = []
    monkeypatch.setattr(T, "tree_distance", lambda *x: calls.append(1) or 0.0)
    bill = lambda name, price, n: {"items": [{"name": name if i == 3 else f"n{i}", "qty": "1", "unit_price": price if i == 60 else "2", "total": "2"} for i in range(n)], "grand_total": name}
    assert T.forest_distance((T.node_of(bill("tea", "5", 200)),), (T.node_of(bill("sea", "6", 200)),), {}) == pytest.approx(2 / 3 + 1)
    assert not calls


@pytest.mark.parametrize("name", ["split_message", "explain_split", "charge_matrix"])
def test_a_split_is_told_without_shuffling_it(spark, sf_dir, name):
    """Texts and lines of a bill are made inside its row, from tables in buckets of bill_id."""
    from tallyweave import plans  # noqa: F401
    from tallyweave.registry import QUERIES

    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]


@pytest.mark.parametrize("name, scans", [("apply_corrections", 2), ("field_f1", 3)])
def test_records_are_read_once_and_stay_in_their_buckets(spark, sf_dir, name, scans):
    """Each side's items once, and the predicted ones' last places; no record is shuffled."""
    from tallyweave import plans  # noqa: F401
    from tallyweave.registry import QUERIES

    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and plan.count("FileScan parquet spark_catalog.default.item_base") <= scans


def test_the_last_edit_of_a_path_wins_and_unread_leaves_are_empty(spark):
    from tallyweave.operators import validate as V

    rows = _records(spark, [(1, ([("Tea", "1", "5", None)], [("TAX", "1")], "6", "6")), (2, ([], [], None, "9"))])
    edits = spark.createDataFrame([(1, "items[0].name", 0, "Cha"), (1, "items[0].name", 2, "Chai"), (1, "items[0].name", 1, "x"), (1, "items[7].name", 5, "y"), (1, "subtotal", None, "z"), (1, "charges[0].amount", 0, None)], "bill_id long, path string, seq int, value string")
    got = {r.bill_id: r.bill.asDict(True) for r in V.apply_corrections(rows, edits).collect()}
    assert got[1] == {"items": [{"name": "Chai", "qty": "1", "unit_price": "5", "total": ""}], "charges": [{"type": "TAX", "amount": "1"}], "subtotal": "6", "grand_total": "6"}
    assert got[2] == {"items": [], "charges": [], "subtotal": "", "grand_total": "9"}


def test_cents_as_text_are_those_of_decimals(spark):
    from pyspark.sql import functions as F

    from tallyweave.functions.money import canon_cents, canon_num

    c = F.explode(F.array(*(F.lit(x).cast("long") for x in (0, 5, -5, 50, -50, 100, -100, 105, 110, 12345, 100000, -999999999999))))
    rows = spark.range(1).select(c.alias("c")).select(canon_cents(F.col("c")).alias("a"), canon_num(F.col("c").cast("decimal(20,0)") / F.lit(100)).alias("b")).collect()
    assert all(r.a == r.b for r in rows) and [r.a for r in rows][:4] == ["0", "0.05", "-0.05", "0.5"]


def test_equal_names_do_not_go_to_python(spark):
    from pyspark.sql import functions as F

    from tallyweave.operators.scoring import block_ratio, match_items

    one = spark.createDataFrame([(None, None), ("abcd", "abcd")], "a string, b string")
    assert [r.s for r in one.select(block_ratio("a", "b").alias("s")).collect()] == [None, 1.0]
    rows = spark.createDataFrame([(1, 0, "Iced Tea", 1, 500), (1, 1, "Iced-tea", 1, 500), (1, 2, "", 1, 500)], "bill_id long, item_idx int, name string, qty int, total_cents long")
    got = match_items(rows, rows.withColumn("name", F.lower("name"))).first()
    assert (got.tp, got.fp, got.fn) == (3, 0, 0)


def test_shares_of_many_units_are_reduced(spark):
    from pyspark.sql import functions as F

    from tallyweave.functions.money import share_label

    rows = spark.createDataFrame([(200, 400), (121, 1331), (1_000_003, 3_000_009), (34, 89), (1, 4)], "u int, t long").select(share_label(F.col("u"), F.col("t")).alias("s"))
    assert [r.s for r in rows.collect()] == ["1/2 share", "1/11 share", "1/3 share", "34/89 share", "1/4 share"]


@pytest.mark.parametrize("total, weights", [(10**15, [10**6, 3, 10**9]), (-(10**16), [10**14, 7 * 10**14, 1]), (5, [0, 0]), (100, [5, -1]), (-7, [3, 5, 9])])
def test_shares_in_a_row_are_those_of_the_window(spark, total, weights):
    """In whole longs and, where a product doesn't fit in one, in decimals."""
    rows = spark.createDataFrame([(1, total, [(w, i) for i, w in enumerate(weights)])], "b int, total long, parts array<struct<w:long,ord:int>>")
    got = rows.selectExpr("array(struct(total, parts)) AS g").select(L._shared("g")[0].alias("v")).first().v
    flat = spark.createDataFrame([(1, i, total, w) for i, w in enumerate(weights)], "b int, i int, t long, w long")
    assert got == [r.part for r in L.largest_remainder(flat, ["b"], "t", "w", "i", "part").orderBy("i").collect()] and sum(got) == total


def test_confidences_read_the_predicted_items_once(spark, sf_dir):
    """Not once for each of a line's four fields: their items and their last places."""
    from tallyweave.plans.fixtures import view

    plan = view(spark, sf_dir, "field_conf")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet spark_catalog.default.item_base") <= 2


def test_a_dump_of_predictions_is_written_compressed(spark, sf_dir, monkeypatch):
    import os

    from tallyweave.plans import q_sources
    from tallyweave.registry import QUERIES

    paths, own = [], q_sources.S.shared_path
    monkeypatch.setattr(q_sources.S, "shared_path", lambda spark, name: paths.append(own(spark, name)) or paths[-1])
    QUERIES["src_predictions"](spark, sf_dir)
    dump = next(p for p in paths if "/dump-" in p).removeprefix("file://")
    assert all(f.endswith(".json.gz") for f in os.listdir(dump) if f.startswith("part-"))


def test_texts_without_a_number_are_null(spark):
    from pyspark.sql import functions as F

    from tallyweave.functions.money import parse_money

    rows = spark.createDataFrame([("",), (None,), ("  ",), ("x",), ("5",), ("(1,250.50)",)], "t string").select(parse_money(F.col("t")).alias("v")).collect()
    assert [None if r.v is None else float(r.v) for r in rows] == [None, None, None, None, 5.0, -1250.5]


@pytest.mark.parametrize("name", ["calibration_report", "src_predictions", "threshold_for_precision"])
def test_a_first_query_finds_the_tables_it_has_just_stored(spark, sf_dir, monkeypatch, name):
    """In a new session a view stores several tables; storing one drops the names of others, in whatever order they come."""
    from tallyweave.plans import fixtures
    from tallyweave.registry import QUERIES

    own = fixtures._store

    def store(*args):
        table = own(*args)
        for n in fixtures.STORED:
            spark.catalog.dropTempView(n)
        return table

    monkeypatch.setattr(fixtures, "_stored", {})
    monkeypatch.setattr(fixtures, "_store", store)
    assert QUERIES[name](spark, sf_dir).limit(1).count() == 1
