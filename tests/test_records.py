import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.operators import calibration as C
from tallyweave.operators import datasets as D
from tallyweave.operators import normalise as N
from tallyweave.operators import runs as R
from tallyweave.operators import scoring as S
from tallyweave.operators import validate as V
from tallyweave.sources import readers as S2
from tallyweave.sources.readers import nested_receipt, parse_entities


@pytest.mark.parametrize("raw", ["[1, 2]", '"text"', "null", "3", "garbage", "", None, '{"items": 5}'])
def test_garbage_is_an_empty_bill(spark, raw):
    b = N.ensure_schema(spark.createDataFrame([(1, raw)], "bill_id long, raw string")).first().bill
    assert b["items"] == [] and b["charges"] == [] and b["subtotal"] == "" and b["grand_total"] == ""


def test_single_objects_and_nulls(spark):
    raw = '{"items": {"name": " Tea ", "qty": 2, "total": null}, "charges": [{"amount": "5"}, 7], "grand_total": 10.5}'
    b = N.ensure_schema(spark.createDataFrame([(1, raw)], "bill_id long, raw string")).first().bill
    assert [tuple(i) for i in b["items"]] == [("Tea", "2", "", "")] and [tuple(c) for c in b["charges"]] == [("OTHER", "5")] and b["grand_total"] == "10.5"


def test_arithmetic_and_idempotent_repair(spark):
    items = spark.createDataFrame([(1, 0, 2, 31000, 61000), (1, 1, 3, 100, 1000), (1, 2, 0, 5, 90), (1, 3, None, 5, 700), (1, 4, 1, 5, None)], "bill_id long, item_idx int, qty int, unit_cents long, total_cents long")
    bills = spark.createDataFrame([(1, None, None), (2, 0, 40)], "bill_id long, subtotal_cents long, grand_cents long")
    charges = spark.createDataFrame([(1, 0, "TAX", None)], "bill_id long, charge_idx int, type string, amount_cents long")
    got = {(r.bill_id, r.path): r for r in V.check_arithmetic(bills, items, charges).collect()}
    assert got[1, "items[0].total"].suggest_value == "305" and got[1, "items[1].total"].suggest_value is None and got[1, "items[4].total"].severity == "error"
    assert got[1, "charges[0].amount"].severity == "error" and got[1, "subtotal"].severity == "warn" and got[1, "grand_total"].severity == "error" and (2, "grand_total") not in got
    once = V.repair_rates(items).drop("repaired")
    assert V.repair_rates(once).where("repaired").count() == 0


def test_match_items_is_greedy_in_truth_order(spark):
    schema = "bill_id long, item_idx int, name string, qty int, total_cents long"
    truth = spark.createDataFrame([(1, 0, "dal tadka", 1, 100), (1, 1, "dal tadke", 1, 100), (1, 2, "rice", 1, 50)], schema)
    pred = spark.createDataFrame([(1, 0, "dal tadkb", 1, 100), (1, 1, "dal tadka", 1, 100), (1, 2, "rice", 2, 50)], schema)
    assert tuple(S.match_items(pred, truth).first()) == (1, 2, 1, 1)
    assert tuple(S.match_items(truth, truth).first()) == (1, 3, 0, 0)
    assert tuple(S.match_items(pred.limit(0), truth).first()) == (1, 0, 0, 3)


def test_isotonic_is_monotone_and_calibrates(spark):
    rows = spark.range(2000).select((F.col("id") % 500).alias("bill_id"), ((F.col("id") * 7919 % 1000) / 1000).alias("s"))
    rows = rows.withColumn("correct", (((F.xxhash64("bill_id", "s") % 1000 + 1000) % 1000) / 1000 < F.col("s") * F.col("s")).cast("int"))
    p = [r.p for r in C.isotonic_calibrate(rows, "s").orderBy("score").collect()]
    assert len(p) == 101 and p == sorted(p) and 0 <= p[0] and p[-1] <= 1
    assert C.calibrated_ece(rows, "s").first().ece < C.ece(rows, "s").first().ece


def pooled(points):
    """Pool adjacent violators over distinct scores (s, right, n): (scores, fitted values)."""
    blocks = []
    for s, c, n in sorted(points):
        blocks.append([c, n, [s]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            c, n, ss = blocks.pop()
            blocks[-1] = [blocks[-1][0] + c, blocks[-1][1] + n, blocks[-1][2] + ss]
    return [s for b in blocks for s in b[2]], [b[0] / b[1] for b in blocks for _ in b[2]]


def counted(rows):
    by = {}
    for s, right in rows:
        c, n = by.get(s, (0, 0))
        by[s] = (c + right, n + 1)
    return [(s, c, n) for s, (c, n) in by.items()]


def error(rows):
    bins = {}
    for s, right in rows:
        b = bins.setdefault(sum(s >= i / 10 for i in range(1, 10)), [])
        b.append((s, right))
    return sum(abs(sum(s for s, _ in b) - sum(r for _, r in b)) for b in bins.values()) / len(rows)


def test_calibration_matches_brute_force(spark):
    r = random.Random(9)
    rows = []
    for i in range(900):
        x = round(r.random() ** 0.4, 2)
        rows.append((i % 90, x, round((1 + x) / 2, 3), round(r.random(), 3), int(r.random() < x * x)))
    fields = spark.createDataFrame(rows, "bill_id long, p_min double, p_mean double, p_first double, correct int").repartition(4)
    at, fitted = pooled(counted([(x[1], x[4]) for x in rows]))
    want = np.interp(np.arange(101) / 100, at, fitted)
    got = [x.p for x in C.isotonic_calibrate(fields, "p_min").orderBy("score").collect()]
    assert np.abs(np.array(got) - np.clip(want, 0, 1)).max() < 1e-4
    report = {x.score: x for x in C.calibration_report(fields).collect()}
    for col, name in ((3, "p_first"), (2, "p_mean"), (1, "p_min")):
        pairs, row = [(x[col], x[4]) for x in rows], report[name]
        pos, neg = [s for s, c in pairs if c], [s for s, c in pairs if not c]
        auroc = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg)
        mapped = []
        for fold in (0, 1):
            xs, ys = pooled(counted([(x[col], x[4]) for x in rows if x[0] % 2 != fold]))
            mapped += [(float(np.clip(np.interp(x[col], xs, ys), 0, 1)), x[4]) for x in rows if x[0] % 2 == fold]
        cut = float(np.quantile([s for s, _ in pairs], 0.08))
        flagged, wrong = [c for s, c in pairs if s < cut], sum(1 - c for _, c in pairs)
        caught = sum(1 - c for c in flagged)
        want = (auroc, error(pairs), error(mapped), cut, len(flagged) / 900, caught / wrong, 1 - (wrong - caught) / (900 - len(flagged)))
        assert tuple(row)[1:8] == pytest.approx(want, abs=1e-4), name
    assert [n for n, x in report.items() if x.best] == [max(report, key=lambda n: report[n].auroc)]
    assert C.auroc(fields.limit(0), "p_min").count() in (0, 1) and C.threshold_for_precision(fields.limit(0), "p_min", 0.9).first().threshold == 1.01


def test_corrected_leaves_make_records_again(spark):
    raw = '{"items": [{"name": "Tea", "qty": "2", "unit_price": "5", "total": "10"}, {"name": "Pie"}], "charges": [{"type": "TAX", "amount": "1"}], "subtotal": "10", "grand_total": "11"}'
    bills = N.ensure_schema(spark.createDataFrame([(1, raw), (2, "{}")], "bill_id long, raw string")).select("bill_id", "bill")
    assert {r.bill_id: r.bill for r in N.nest_leaves(N.leaf_paths(bills)).collect()} == {r.bill_id: r.bill for r in bills.collect()}
    edits = spark.createDataFrame([(1, "items[1].name", 0, "Pi"), (1, "items[1].name", 1, "Big pie"), (1, "items[7].name", 2, "x"), (2, "grand_total", 0, "3")], "bill_id long, path string, seq int, value string")
    got = {r.bill_id: r.bill for r in V.apply_corrections(bills, edits).collect()}
    assert [i["name"] for i in got[1]["items"]] == ["Tea", "Big pie"] and got[1]["charges"][0]["amount"] == "1" and got[2]["grand_total"] == "3" and got[2]["items"] == []


def test_guards(spark):
    nan = float("nan")
    runs = {1: [1.0, nan, 0.9, nan, 0.8], 2: [1.0, nan, nan, nan], 3: [1.0, 0.8, 4.0], 4: [0.5, 0.000001]}
    log = spark.createDataFrame([(r, e, x, 0.5) for r, xs in runs.items() for e, x in enumerate(xs, 1)], "run long, epoch int, loss double, score double")
    got = {(r.run, r.rule) for r in R.run_guards(log).collect()}
    assert (1, "non_finite_streak") not in got and (2, "non_finite_streak") in got and (3, "diverged") in got and (4, "zero_loss") in got


def test_manifest_keeps_the_protected_split(spark):
    m = spark.createDataFrame([("a", "train", "h1"), ("b", "test", "h1"), ("c", "train", "h2"), ("d", "train", "h2")], "id string, split string, content_hash string")
    kept, dropped = D.exact_dup_across_splits(m)
    assert {r.id for r in kept.collect()} == {"b", "c", "d"} and {r.id for r in dropped.collect()} == {"a"}


def test_near_dup_with_hot_hash(spark):
    rows = [(i, "train" if i % 2 else "test", 0, 0, 0, 0) for i in range(60)] + [(100, "val", 4095, 0, 0, 0), (101, "val", 8191, 0, 0, 0), (102, "val", -1, -1, 0, 0)]
    hashes = spark.createDataFrame(rows, "id long, split string, w0 long, w1 long, w2 long, w3 long")
    got = D.near_dup_across_splits(hashes).collect()
    assert {(r.split_a, r.split_b, r.id_a, r.id_b, r.distance, r.pairs) for r in got} == {("test", "train", 0, 1, 0, 900), ("test", "val", 0, 100, 12, 30), ("train", "val", 1, 100, 12, 30)} and len(got) == 3
    assert [(r.pairs, r["rank"]) for r in D.near_dup_examples(D.near_dup_across_splits(hashes)).orderBy("split_a", "split_b").collect()] == [(900, 1), (30, 1), (30, 1)]


def test_files_of_small_documents(spark, tmp_path):
    for name, text in {"a/1.json": '{"items": [{"name": "Tea", "total": "5"}], "grand_total": "5"}', "a/2.json": "broken", "b/1.txt": "Company: X", "b/3.txt": '{"company": "Y"}'}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r.stem: r.bill for r in S2.read_bill_files(spark, f"file://{tmp_path}/a").collect()}
    assert got["1"]["items"][0]["name"] == "Tea" and got["1"]["grand_total"] == "5" and (got["2"] is None or got["2"]["grand_total"] is None)
    assert {r.stem: r.entities["company"] for r in S2.read_entities(spark, f"file://{tmp_path}/b").collect()} == {"1": "X", "3": "Y"}
    whole, part = S2.pair_files(spark, {"json": f"file://{tmp_path}/a", "text": f"file://{tmp_path}/b"})
    assert [r.stem for r in whole.collect()] == ["1"] and sorted(r.stem for r in part.collect()) == ["2", "3"]


def test_documents_as_files_and_bundles(spark, tmp_path):
    """Every document comes back once, whatever its name, as a file of its own or in a bundle; siblings and folders are found."""
    names = ["a/1.json", "a/my bill.json", "a/50%.json", "a/x+y.json", "a/2.json", "a/2.json", "a/k=v.json"]
    rows = spark.createDataFrame([(n, f"line {i}\n\nend" if i else None, i) for i, n in enumerate(names)], "path string, value string, i int")
    for k, single in enumerate([F.lit(True), F.lit(False), F.col("i") % 2 == 0, F.lit(None).cast("boolean")]):
        at = S2.write_documents(rows, f"file://{tmp_path}/w{k}", single)
        got = sorted((r.s, r.value.rstrip("\n")) for r in S2.read_documents(spark, at).select(S2.stem(F.col("path")).alias("s"), "value").collect())
        assert got == sorted((n[2:].rsplit(".", 1)[0], f"line {i}\n\nend" if i else "") for i, n in enumerate(names))
        assert sorted(r.s for r in S2.list_documents(spark, at).select(S2.stem(F.col("path")).alias("s")).collect()) == [s for s, _ in got]
    none = S2.write_documents(rows.limit(0), f"file://{tmp_path}/none", F.lit(True))
    assert S2.read_documents(spark, none).collect() == [] and S2.list_documents(spark, none).collect() == []

    listing = spark.createDataFrame([("img/2.jpg",), ("img/1.png",), ("img/1.jpg",), ("img/9.jpg",)], "path string")
    have = S2.with_sibling(spark.createDataFrame([("1",), ("2",), ("3",), (None,)], "stem string"), listing, "image")
    assert {r.stem: r.image for r in have.collect()} == {"1": "img/1.jpg", "2": "img/2.jpg", "3": None, None: None}
    assert S2.first_folder(spark, f"file://{tmp_path}", ["absent", "w1", "w0"]) == f"file://{tmp_path}/w1" and S2.first_folder(spark, f"file://{tmp_path}", ["absent"]) is None

    (tmp_path / "named").mkdir()
    for name in ("my bill.txt", "50%.txt", "x+y.txt", "ü.txt"):
        (tmp_path / "named" / name).write_text("Company: X")
    want = {"my bill", "50%", "x+y", "ü"}
    assert {r.stem for r in S2.read_entities(spark, f"file://{tmp_path}/named").collect()} == want
    assert {r.stem for r in S2.pair_files(spark, {"a": f"file://{tmp_path}/named"})[0].collect()} == want


def test_manifest_sink_prunes_by_folder(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"s{i % 3}", ("train", "val", "test")[i % 3 - i % 2]) for i in range(30)], "id long, source string, split string")
    back = spark.read.schema("id BIGINT, split STRING, source STRING").json(S2.write_manifest(rows, f"file://{tmp_path}/m"))
    val = back.where("split = 'val' AND source = 's1'")
    assert sorted(r.id for r in val.collect()) == sorted(r.id for r in rows.where("split = 'val' AND source = 's1'").collect()) and back.count() == 30
    filters = val._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("], PushedFilters")[0]
    assert "= val" in filters and "= s1" in filters and val.count() > 0


def test_latency_places_match_sorted_lists(spark):
    """Percentiles are the values at floor(n q) of the sorted list, also for a group that lies over many ranges."""
    r = random.Random(5)
    rows = [("hot", r.random() * 100) for _ in range(2000)] + [("even", float(i % 4)) for i in range(40)] + [("one", 7.0), ("odd", None), ("odd", float("nan")), ("odd", 2.5), ("none", None), (None, 3.0), (None, 1.0)]
    got = {x.g: x for x in R.latency_stats(spark.createDataFrame(rows, "g string, v double").repartition(7), ["g"], "v").collect()}
    want = {}
    for g, v in rows:
        if v is not None and v == v:
            want.setdefault(g, []).append(v)
    assert set(got) == set(want)
    for g, v in want.items():
        v, n = sorted(v), len(v)
        at = lambda q: round(v[min(int(n * q), n - 1)], 4)  # noqa: E731, B023
        assert (got[g].n, got[g].p50, got[g].p95, got[g].longest) == (n, at(0.5), at(0.95), round(v[-1], 4)), g
        assert abs(got[g]["mean"] - sum(v) / n) < 1e-4
    assert R.latency_stats(spark.createDataFrame([], "g string, v double"), ["g"], "v").collect() == []


def test_means_do_not_depend_on_the_order_of_adding(spark):
    rows = spark.createDataFrame([(x,) for x in [0.4197, 0.4196, 0.4197, 0.4196, 0.4198, 0.4195, 0.4197, 0.4197]], "x double")
    assert rows.agg(R.exact_mean("x").alias("m")).first().m == 0.419663 and rows.limit(0).agg(R.exact_mean("x").alias("m")).first().m is None


def test_entities_and_receipts(spark):
    one = spark.createDataFrame([('"Company": "A",\nnote\nTOTAL: RM 0.50\ncompany: B:C',), ('{"company": "X", "total": "3"}',), ("nothing",)], "t string")
    got = [r.e for r in one.select(parse_entities(F.col("t")).alias("e")).collect()]
    assert got[0] == {"total": "RM 0.50", "company": "B:C"} and got[1] == {"company": "X", "total": "3"} and got[2] is None
    raw = '{"menu": {"nm": ["Es", "Teh"], "cnt": "2x", "price": "40.000"}, "sub_total": [{"discount_price": "2.000", "tax_price": "0"}], "total": {"total_price": "38.000"}}'
    b = nested_receipt(spark.createDataFrame([(1, raw), (2, "{}")], "bill_id long, raw string")).collect()
    assert len(b) == 1 and [tuple(i) for i in b[0].bill["items"]] == [("Es Teh", "2", "20000", "40000")] and [tuple(c) for c in b[0].bill["charges"]] == [("DISCOUNT", "-2000")] and b[0].bill["subtotal"] == "40000"


def test_match_items_by_blocks_matches_difflib(spark):
    """Greedy matches in truth's order, as the standard library's ratio decides; pairs it accepts pass the edit filter."""
    from difflib import SequenceMatcher

    r = random.Random(12)
    words = ["tea", "masala", "paneer", "tikka", "rice", "", "x", "butter naan", "abcdefghij" * 30]
    def name():
        s = list(" ".join(r.choices(words, k=r.randrange(1, 4))))
        for _ in range(r.randrange(4)):
            if s:
                s[r.randrange(len(s))] = r.choice("abcxyz")
        return "".join(s)

    truth, pred = [], []
    for b in range(60):
        t = [(b, i, name(), r.randrange(1, 3), r.choice([100, 200, None])) for i in range(r.randrange(0, 7))]
        p = [(b, i, x[2][r.randrange(2):] + r.choice(["", "s", "!"]), x[3], x[4]) for i, x in enumerate(r.sample(t, len(t)) + t[:1])]
        truth, pred = truth + t, pred + p + ([(b, 90, None, 1, 100)] if b % 5 == 0 else [])
    schema = "bill_id long, item_idx int, name string, qty int, total_cents long"
    got = {x.bill_id: (x.tp, x.fp, x.fn) for x in S.match_items(spark.createDataFrame(pred, schema), spark.createDataFrame(truth, schema)).collect()}
    norm = lambda s: "".join(c for c in (s or "").lower() if c.isascii() and c.isalnum())
    want = {}
    for b in {x[0] for x in truth} | {x[0] for x in pred}:
        t, p, used = [x for x in truth if x[0] == b], [x for x in pred if x[0] == b], set()
        for g in t:
            best, s = None, 0.0
            for x in p:
                ratio = SequenceMatcher(None, norm(x[2]), norm(g[2])).ratio() if x[2] is not None else 0
                if x[1] not in used and ratio >= 0.8 and ratio > s and x[3] == g[3] and x[4] is not None and x[4] == g[4]:
                    best, s = x[1], ratio
            used |= {best} - {None}
        want[b] = (len(used), len(p) - len(used), len(t) - len(used))
    assert got == want and sum(x[0] for x in want.values()) > 30


def test_keys_by_level_match_a_walk(spark):
    texts = [
        '{"a": {"b": [1, {"c": null, "d": {}}, [{"e": 1}, []]]}, "x": "{[{[\\" \\\\"}', '{"a": 5, "x": [[[[{"deep": {"er": "]}"}}]]]]}', "[1, 2]", "[]", "{}", "3", "null", '"{"', "garbage", "", None,
        '{"q\\"{": {"`<": [{"z": true}]}}', '{"a": {"b": {"c": 1}}}',
    ]
    want = {}

    def walk(v, level):
        if isinstance(v, dict):
            for k, x in v.items():
                want[level, k] = want.get((level, k), 0) + 1
                walk(x, f"{level}.{k}" if level else k)
        elif isinstance(v, list):
            for x in v:
                walk(x, f"{level}[]")

    for t in texts:
        try:
            walk(json.loads(t), "")
        except (TypeError, ValueError):
            pass
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {(x.level, x.key): x.n for x in D.key_frequency(df, "t").collect()} == want
    assert D.key_frequency(df.limit(0), "t").collect() == [] and D.key_frequency(df.where("t = '3'"), "t").collect() == []


def test_exact_fields_and_latencies(spark):
    read = spark.createDataFrame([(1, "A.B. Co", "1,200.00"), (2, None, "x"), (3, "a", "5"), (4, "a", "5")], "id long, company string, total string")
    truth = spark.createDataFrame([(1, "ab co", "1200"), (2, "", "y"), (3, "b", "6")], "id long, company string, total string")
    assert tuple(S.exact_fields(read, truth, ["company"], ["total"]).first()) == (3, 2, 2)
    rows = spark.createDataFrame([("a", 0.0, 1.0, True), ("a", 0.5, 3.5, True), ("a", 1.0, 9.0, False), ("b", 1.0, 1.0, False)], "g string, start double, end double, ok boolean")
    got = {x.g: tuple(x)[1:] for x in R.throughput(rows, "g").collect()}
    assert got == {"a": (3, 1, 9.0, 0.2222, 3.0, 3.0, 2.0, 3.0), "b": (1, 1, 0.0, None, None, None, None, None)}


def random_record(r, depth=0):
    kind = r.random()
    if depth < 3 and kind < 0.45:
        return {k: random_record(r, depth + 1) for k in r.sample(["a", "b", "items", "qty"], r.randrange(3))}
    if depth < 3 and kind < 0.7:
        return [random_record(r, depth + 1) for _ in range(r.randrange(3))]
    return r.choice(["tea", "team", "", "12", "12.50", None, 3])


def forest_distance(a, b):
    """The distance by its definition: the last trees of two forests are taken out, put in or matched."""
    from functools import lru_cache

    @lru_cache(None)
    def edits(x, y):
        return max(len(x), len(y)) if not x or not y else min(edits(x[:-1], y) + 1, edits(x, y[:-1]) + 1, edits(x[:-1], y[:-1]) + (x[-1] != y[-1]))

    @lru_cache(None)
    def size(f):
        return sum(1 + size(kids) for _, kids in f)

    @lru_cache(None)
    def go(f, g):
        if not f or not g:
            return size(f) + size(g)
        (x, fx), (y, gy) = f[-1], g[-1]
        same = edits(x, y) / max(len(x), len(y), 1)
        return min(go(f[:-1] + fx, g) + 1, go(f, g[:-1] + gy) + 1, go(f[:-1], g[:-1]) + go(fx, gy) + same)

    return go((a,), (b,))


def as_node(v, label="root"):
    kids = [as_node(v[k], k) for k in sorted(v)] if isinstance(v, dict) else [as_node(x, "[]") for x in v] if isinstance(v, list) else [(str(v), ())]
    return label, tuple(kids)


def test_tree_distance_matches_its_definition(spark):
    from tallyweave.functions.trees import tree_accuracy

    r = random.Random(3)
    pairs = [(random_record(r), random_record(r)) for _ in range(150)]
    pairs += [(p, p) for p, _ in pairs[:10]] + [({}, t) for _, t in pairs[:10]]
    want = []
    for p, t in pairs:
        empty = forest_distance(as_node({}), as_node(t))
        want.append(max(0.0, 1 - forest_distance(as_node(p), as_node(t)) / max(empty, 1e-9)))
    rows = [(i, json.dumps(p), json.dumps(t)) for i, (p, t) in enumerate(pairs)] + [(1000, None, '{"a": 1}'), (1001, "broken", '{"a": 1}'), (1002, None, None)]
    got = spark.createDataFrame(rows, "i int, p string, t string").repartition(3).select("i", tree_accuracy("p", "t").alias("x")).orderBy("i").collect()
    assert [x.x for x in got] == pytest.approx(want + [0.0, 0.0, 1.0], abs=1e-9)


def test_a_missing_prediction_is_no_accuracy(spark):
    bill = "bill_id long, bill struct<items:array<struct<name:string,qty:string>>,grand_total:string>"
    truth = spark.createDataFrame([(1, ([("tea", "2")], "10")), (2, ([], "5")), (3, None)], bill)
    pred = spark.createDataFrame([(1, ([("team", "2")], "10")), (9, ([], ""))], bill)
    got = {x.bill_id: x.accuracy for x in S.tree_edit_accuracy(pred, truth).collect()}
    assert got == pytest.approx({1: 1 - 0.25 / 8, 2: 0.0, 3: 1.0})
