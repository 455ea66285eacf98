"""Quantiles and near hashes against brute force, and their plans where a group is large."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.operators import hamming as H
from tallyweave.operators.quantiles import exact_quantiles


def test_quantiles_match_numpy(spark):
    r = random.Random(1)
    rows = [("hot", float(r.randrange(50))) for _ in range(3000)] + [("wide", r.gauss(0, 1e6)) for _ in range(500)] + [("one", 3.0), ("two", 1.0), ("two", 2.0), ("odd", None), ("odd", float("nan")), ("odd", -1.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    at = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 0.999, 1.0]
    got = {x.k: x.p for x in exact_quantiles(df, "k", "x", at).collect()}
    want = {}
    for k, v in rows:
        if v is not None and v == v:
            want.setdefault(k, []).append(v)
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(np.quantile(v, at).tolist(), rel=1e-12, abs=1e-12), k
    assert exact_quantiles(df.limit(0), "k", "x", at).collect() == []
    assert "percentile" not in exact_quantiles(df, "k", "x", at)._jdf.queryExecution().toString()


def hashes(n, seed, constant):
    """Rows (id, w0 .. w3), some of them near others; the first `constant` words are the same in all."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        if i % 3 == 2:
            w = list(rows[r.randrange(len(rows))][1:])
            for bit in r.sample(range(64 * constant, 256), r.choice([1, 5, 12, 13])):
                w[bit // 64] ^= 1 << (bit % 64)
        else:
            w = [0] * constant + [r.getrandbits(64) for _ in range(4 - constant)]
        rows.append((i, *w))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return list({w: (i, *map(signed, w)) for i, *w in rows for w in [tuple(w)]}.values())


WORDS = ["w0", "w1", "w2", "w3"]
SCHEMA = "id long, w0 long, w1 long, w2 long, w3 long"


def brute_pairs(rows, limit):
    x = np.unpackbits(np.array([r[1:] for r in rows], np.int64).view(np.uint8), axis=1)
    ids, out = [r[0] for r in rows], set()
    for i in range(len(rows)):
        d = (x[i] != x[i + 1 :]).sum(axis=1)
        for j in np.flatnonzero(d <= limit):
            a, b = ids[i], ids[i + 1 + j]
            out.add((min(a, b), max(a, b), int(d[j])))
    return out


@pytest.mark.parametrize("constant,crowd", [(0, 64), (1, 64), (3, 4), (2, 2)])
def test_near_hashes_match_brute_force(spark, constant, crowd):
    rows = hashes(300, constant, constant)
    got = H.hamming_pairs(spark.createDataFrame(rows, SCHEMA), "id", WORDS, 12, crowd).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute_pairs(rows, 12) and got


def test_paths_leave_disjoint_bits():
    order = np.random.RandomState(1).permutation(256)
    for a in range(13):
        left = H.left_after(order, a + 1, 13)
        assert len(left) + len(H.deal(order, 13)[a]) == 256 and not set(left) & set(H.deal(order, 13)[a])
        for b in range(13):
            assert set(H.left_after(order, (a + 1) * 14 + b + 1, 13)) == set(left) - set(H.deal(left, 13)[b])


def test_crowded_bands_are_split(spark):
    """Hashes that agree in three words: pairs compared grow with the rows, not with their square."""
    def largest(n):
        rows = hashes(n, 9, 2)
        df = spark.createDataFrame(rows, SCHEMA)
        return len(rows), H.hamming_pairs(df, "id", WORDS, 12).agg(F.count(F.lit(1)), F.max("distance")).first()

    n, (pairs, furthest) = largest(1500)
    assert furthest <= 12 and 0 < pairs < 4 * n


def test_a_split_shuffles_each_input_once(spark, sf_dir):
    """Five inputs by bill_id, and the overrides as the sixth; nothing is shuffled again."""
    from tallyweave.operators import ledger as L
    from tallyweave.plans.fixtures import view

    bills, items, charges, people, claims = (view(spark, sf_dir, n) for n in ("bills", "bill_items", "bill_charges", "people", "assignments"))
    overrides = spark.createDataFrame([(1, "A", 5)], "bill_id long, person string, new_final long")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        split = L.split_bills(bills, items, charges, people, claims)
        exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange ")
        assert exchanges(split) == 5 and exchanges(L.apply_overrides(split, overrides, rebalance=True)) == 6
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_scans_match_windows(spark):
    """A run over many ranges beside short ones: each kind of running value as a plain window has it."""
    from pyspark.sql import Window

    from tallyweave.operators.scans import before, in_ranges

    r = random.Random(4)
    rows = [("hot", i, r.choice([None, r.gauss(0, 1)])) for i in range(700)] + [(f"k{i % 40}", i // 40, r.choice([None, float(r.randrange(5))])) for i in range(200)] + [("one", 5, None)]
    df = spark.createDataFrame(rows, "run string, epoch int, x double").repartition(5)
    t = in_ranges(df, ["run", "epoch"], 9)
    assert t.where("run = 'hot'").select("part").distinct().count() > 3
    got = before(t, ["run"], ["epoch"], n=("sum", F.lit(1)), low=("min", "x"), high=("max", "x"), prev=("last", "x"))
    w = Window.partitionBy("run").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("*", F.coalesce(F.sum(F.lit(1)).over(w), F.lit(0)).alias("n"), F.min("x").over(w).alias("low"), F.max("x").over(w).alias("high"), F.last("x", ignorenulls=True).over(w).alias("prev"))
    cols = want.columns
    assert sorted(map(repr, got.select(cols).collect())) == sorted(map(repr, want.collect()))
    assert before(in_ranges(df.limit(0), ["run", "epoch"]), ["run"], ["epoch"], n=("sum", F.lit(1))).collect() == []


def guards_by_hand(log):
    out, low, last, bad, late = [], None, None, 0, False
    best, bests = None, []
    for epoch, loss, score in log:
        if best is None or score > best:
            best = score
            bests.append(epoch)
        if loss is None or loss != loss or abs(loss) == float("inf"):
            bad += 1
            out += [(epoch, "non_finite")] + [(epoch, "non_finite_streak")] * (bad == 3)
        else:
            bad = 0
            out += [(epoch, "zero_loss")] * (loss < 1e-5)
            out += [(epoch, "diverged")] * (epoch >= 3 and low is not None and loss > 3 * low) + [(epoch, "jumped")] * (last is not None and loss > 5 * last)
            low, last = loss if low is None else min(low, loss), loss
        if epoch >= 4 and not late:
            late = True
            out += [(epoch, "not_learning")] * (score < 0.2)
    return out, bests


def test_guards_of_a_run_over_many_ranges(spark):
    from tallyweave.operators import runs as R

    r = random.Random(8)
    loss = lambda: r.choice([None, float("nan"), float("inf"), float("nan"), 0.0, r.random(), r.random(), 10 ** r.uniform(-3, 3)])
    logs = {"hot": [(e, loss(), r.random() * e) for e in range(1, 600)], **{f"r{i}": [(e, loss(), r.random() / 3) for e in range(1, 12)] for i in range(30)}}
    rows = [(run, *x) for run, log in logs.items() for x in log]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "run string, epoch int, loss double, score double")
    want = {run: guards_by_hand(log) for run, log in logs.items()}
    for n in (1, 11):
        assert sorted(map(tuple, R.run_guards(df, ranges=n).collect())) == sorted((run, *x) for run, (out, _) in want.items() for x in out)
        assert sorted((x.run, x.epoch) for x in R.new_best(df, ranges=n).collect()) == sorted((run, e) for run, (_, b) in want.items() for e in b)
    assert R.run_guards(df.limit(0)).collect() == [] and R.new_best(df.limit(0)).collect() == []


@pytest.mark.parametrize("ranges", [1, 3, 70])
def test_isotonic_by_ranges_matches_pooling(spark, ranges):
    """Several keys and levels of pooling: knots and values between them as pooled adjacent violators over the whole give."""
    from tallyweave.operators import calibration as C
    from tests.test_records import pooled

    r = random.Random(5)
    points = {("noisy", i / 900): (lambda n: (sum(r.random() < i / 900 for _ in range(n)), n))(r.randrange(1, 6)) for i in range(900)}
    points |= {("falling", i / 50): (50 - i, 50) for i in range(50)} | {("steps", i / 60): (i // 6, 10) for i in range(60)} | {("one", 0.3): (1, 4)}
    counts = spark.createDataFrame([(k, s, c, n) for (k, s), (c, n) in points.items()] + [("noisy", None, 1, 1), ("noisy", float("nan"), 1, 1)], "k string, s double, c long, n long").repartition(4)
    knots = C.isotonic_knots(counts, ["k"], ranges)
    asked = sorted({s for _, s in points} | {r.uniform(-0.5, 1.5) for _ in range(200)})
    rows = spark.createDataFrame([(k, s) for k in ("noisy", "falling", "steps", "one", "none") for s in asked], "k string, s double")
    got = {}
    for x in C.isotonic_values(rows, knots, ["k"], ranges).collect():
        got.setdefault(x.k, {})[x.s] = x.p
    assert set(got["none"].values()) == {None}
    for k in ("noisy", "falling", "steps", "one"):
        at, fitted = pooled([(s, c, n) for (key, s), (c, n) in points.items() if key == k])
        assert [got[k][s] for s in asked] == pytest.approx(np.interp(asked, at, fitted).tolist(), abs=1e-12), k
    assert C.isotonic_values(rows, C.isotonic_knots(counts.limit(0), ["k"], ranges), ["k"], ranges).where("p IS NOT NULL").count() == 0


def leaves_by_hand(stream, lists=("items", "charges"), stop=("</s>", "<pad>")):
    """(path, value, first, mean, least) of (token, prob) pairs in order."""
    out, key, part, depth, seps = [], None, [], dict.fromkeys(lists, 0), dict.fromkeys(lists, 0)
    named = lambda t, head: t[len(head) : -1] if t.startswith(head) and t.endswith(">") and len(t) > len(head) + 1 else None
    for token, p in stream:
        if token is None:
            continue
        if token in stop:
            break
        opened, closed = named(token, "<s_"), named(token, "</s_")
        if opened is None and closed is None and token != "<sep/>":
            part.append((token, p))
            continue
        inside = [k for k in lists if depth[k] > 0][-1:]
        if closed is not None and closed == key and part:
            value, ps = "".join(t for t, _ in part), [p for _, p in part if p is not None]
            value = value[1:-2] if value.startswith("<") and value.endswith("/>") else value
            path = f"{inside[0]}[{seps[inside[0]]}].{key}" if inside else key
            out.append((path, value.strip(" "), part[0][1], sum(ps) / len(ps) if ps else None, min(ps, default=None)))
        if token == "<sep/>" and inside:
            seps[inside[0]] += 1
        key, part = opened or key, []
        for k in lists:
            depth[k] += (opened == k) - (closed == k)
    return out


def test_token_streams_match_a_walk_by_hand(spark):
    """Well and ill formed streams, as rows in any order and as arrays; a record of thousands of leaves."""
    from tallyweave.operators import runs as R

    r = random.Random(12)
    odd = ["<s_items>", "</s_items>", "<s_charges>", "</s_charges>", "<sep/>", "<s_name>", "</s_name>", "<s_qty>", "</s_qty>", "a", " b ", "<TAX/>", "<s_>", "</s_>", "", None, "<s_a>b>", "</s_a>b>", "</s>", "<pad>"]
    item = lambda i: ["<sep/>"] * (i > 0) + ["<s_name>", f"n{i}", " x", "</s_name>", "<s_qty>", "</s_qty>", "<s_total>", str(i), "</s_total>"]
    record = lambda n: ["<s_items>", *(t for i in range(n) for t in item(i)), "</s_items>", "<s_charges>", "<s_type>", "<", "TAX", "/>", "</s_type>", "</s_charges>", "<s_subtotal>", "9", "</s_subtotal>", "</s>", "<s_name>", "late", "</s_name>"]
    streams = [r.choices(odd, weights=[4] * 18 + [1, 1], k=r.randrange(0, 40)) for _ in range(400)] + [record(n) for n in (0, 1, 2, 33, 200, 2500)]
    streams = {i: [(t, r.choice([None, 1.0, r.randrange(9) / 8])) for t in s] for i, s in enumerate(streams)}
    want = {i: leaves_by_hand(s) for i, s in streams.items()}
    assert len(want[405]) == 5002 and want[405][-2][:2] == ("charges[0].type", "TAX") and sum(map(len, want.values())) > 5500
    rows = [(i, pos, t, p) for i, s in streams.items() for pos, (t, p) in enumerate(s)]
    r.shuffle(rows)
    rows = spark.createDataFrame([*rows, (None, 0, "<s_name>", 0.5), (None, 1, "x", 0.5), (None, 2, "</s_name>", 0.5)], "bill_id long, pos int, token string, prob double").repartition(5)
    arrays = spark.createDataFrame([*streams.items(), (-1, None)], "bill_id long, tokens array<struct<token:string,prob:double>>")
    six = lambda x: x if x is None else round(x, 6)
    expected = sorted(repr((i, path, value, *map(six, ps))) for i, x in want.items() for path, value, *ps in x)
    for form in (rows, arrays):
        assert sorted(repr(tuple(x)) for x in R.fields_from_tokens(form).collect()) == expected


def test_tokens_are_not_shuffled(spark, sf_dir):
    """A record's tokens stay in its row: no exchange and no sort by token in the query, one exchange for tokens in rows."""
    from tallyweave.operators import runs as R
    from tallyweave.plans.q_datasets import fields_from_tokens

    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(before, ("false", "-1")):
            spark.conf.set(k, v)
        plan = fields_from_tokens(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange " not in plan and "Window" not in plan and "pos#" not in plan
        rows = spark.createDataFrame([(1, 0, "a", 0.5)], "bill_id long, pos int, token string, prob double")
        assert R.fields_from_tokens(rows)._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
