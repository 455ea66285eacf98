import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import language_id as G
from tallyweave.llm import mixing as M
from tallyweave.llm import nearest_neighbours as K
from tallyweave.llm import toxicity as T
from tests.llm.conftest import make

# Language ID


def test_filter_names_all_languages_of_an_ngram():
    r = np.random.RandomState(1)
    own = {f"l{i:03d}": r.randint(0, 2**62, 500).astype(np.uint64) for i in range(70)}
    own["l001"] = np.concatenate([own["l001"], own["l000"][:100]])
    f = G.LanguageFilter.build(sorted(own), own)
    hits = f.hits(own["l000"][:100])
    assert hits[0] == 100 and hits[1] == 100 and hits[2:].max() <= 40
    for name in ("l065", "l069"):
        assert f.hits(own[name])[sorted(own).index(name)] == len(own[name])
    probe = r.randint(0, 2**62, 20_000).astype(np.uint64)
    assert np.allclose(f.hits(probe) / 20_000, f.false_rate, atol=0.02)


def test_held_out_accuracy(spark, sf_dir):
    got = G.op1_language_id(spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").toPandas().merge(got, on="doc_id")
    assert len(docs) == len(got) and got.score.between(0, 1).all()
    assert (docs[docs.held_out].lang == docs[docs.held_out].lang_pred).mean() > 0.95


def test_language_edges(spark, edge, empty):
    model = G.fit(edge.select("text", "lang"))
    got = {(r.doc_id, r.lang_pred) for r in G.identify(edge, model).collect()}
    assert {(3, "und"), (4, "und"), (7, "und"), (8, "fr"), (1, "en")} <= got
    kept = G.keep_identified(edge, model)
    assert kept.columns == edge.columns and {r.doc_id for r in kept.collect()} >= {1, 2, 6, 8, 9, None} and not {3, 4, 7} & {r.doc_id for r in kept.collect()}
    none = G.fit(empty.select("text", "lang"))
    assert {r.lang_pred for r in G.identify(edge, none).collect()} == {"und"} and G.identify(empty, model).count() == 0


# Mixing


def test_targets_match_resharing(spark):
    sizes = {"a": 100, "b": 1000, "c": 10, "d": 5000, "Z": 3, "é": 700, None: 900}
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, words long")
    got = {r.source: r.target for r in M.source_targets(rows).collect()}
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(sizes), float(sum(sizes.values()))
    while True:
        w = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / w > 3 * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / w for s in free}
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        free -= over
    assert all(got[s] == pytest.approx(target[s]) for s in sizes) and sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_flight_moves_in_the_null_space():
    r = random.Random(5)
    sizes = [r.randint(1, 900) for _ in range(300)]
    p = [r.random() for _ in sizes]
    q = M.flight(sizes, p, r.random)
    assert sum(0 < x < 1 for x in q) <= 2
    assert sum(a * b for a, b in zip(sizes, q)) == pytest.approx(sum(a * b for a, b in zip(sizes, p)), rel=1e-6) and sum(q) == pytest.approx(sum(p), rel=1e-6)


def test_inclusion_probabilities_are_kept():
    sizes, p, times = [3, 5, 8, 13, 21, 34, 2, 7], [0.3] * 8, np.zeros(8)
    r = random.Random(9)
    for _ in range(4000):
        times += np.array(M.flight(sizes, p, r.random))
    assert np.allclose(times / 4000, 0.3, atol=0.03)


@pytest.mark.parametrize("block", [4096, 8])
def test_mix_reaches_targets_and_repeats(spark, sf_dir, block):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = M.mix(docs, block=block).toPandas()
    again = M.mix(docs.repartition(5), block=block).toPandas()
    key = ["doc_id", "source", "size"]
    assert rows.sort_values(key).copies.tolist() == again.sort_values(key).copies.tolist()
    assert (rows.copies <= 3).all() and len(rows) == docs.count()
    rows["taken"] = rows.copies * rows["size"]
    per = rows.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), largest=("size", "max"))
    assert ((per.taken - per.target).abs() <= np.maximum(per.largest, 0.05 * per.target)).all()


def test_mix_edges(spark, edge, empty):
    rows = M.mix(edge)
    assert {r.source for r in rows.collect()} == {"s1", "s2", None} and sum(r.rows for r in rows.collect()) == edge.count()
    out = M.mixed_documents(edge)
    assert out.columns == edge.columns and out.count() == sum(r.copies * r.rows for r in rows.collect())
    assert M.mix(empty).count() == 0 and M.mixed_documents(empty).count() == 0


# Toxicity


def brute_segments(scores):
    """Ruzzo and Tompa's definition: the best segment, then what is left and right of it."""
    if not scores or max(scores) <= 0:
        return []
    best = None
    for i in range(len(scores)):
        for j in range(i, len(scores)):
            s = sum(scores[i : j + 1])
            if best is None or s > best[0] + 1e-12 or (s > best[0] - 1e-12 and j - i < best[2] - best[1]):
                best = (s, i, j)
    s, i, j = best
    return brute_segments(scores[:i]) + [(i, j, s)] + [(a + j + 1, b + j + 1, x) for a, b, x in brute_segments(scores[j + 1 :])]


def test_maximal_segments_match_definition():
    r = random.Random(6)
    for _ in range(300):
        scores = [r.choice([-1.0, -1.0, -2.5, 2.25, 3.5]) for _ in range(r.randint(0, 18))]
        marks = [(i, s) for i, s in enumerate(scores) if s != -1.0]
        got = T.maximal_segments(marks, 1.0)
        assert [x[:2] for x in got] == [x[:2] for x in brute_segments(scores)] and [x[2] for x in got] == pytest.approx([x[2] for x in brute_segments(scores)])


def test_lambda_solves_its_equation():
    positive = [(2.0, 0.01), (3.0, 0.002)]
    lam = T._lambda(positive, 1.0)
    assert sum(p * math.exp(lam * s) for s, p in positive) + (1 - 0.012) * math.exp(-lam) == pytest.approx(1, abs=1e-6)


def test_toxic_documents_are_found(spark, larger_sf):
    got = T.op7_toxicity(spark, larger_sf).toPandas()
    labels = spark.read.parquet(f"{larger_sf}/labels.parquet").toPandas().merge(got, on="doc_id")
    part = labels[labels.held_out]
    rank = part.score.rank().to_numpy()
    pos = int(part.toxic.sum())
    auc = (rank[part.toxic.to_numpy() == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(part) - pos))
    assert got.score.between(0, 1).all() and auc > 0.85 and (part.predicted == part.toxic).mean() > 0.85


def test_toxicity_edges(spark, edge, empty):
    labels = spark.createDataFrame([(1, 0), (2, 1), (5, 0), (6, None), (77, 1), (None, 1)], "doc_id long, toxic int")
    for some in (labels, labels.limit(0), labels.where("toxic = 1")):
        model = T.fit(edge, some)
        rows = T.score_documents(edge, model).collect()
        assert len(rows) == edge.count() and all(0 <= r.score <= 1 for r in rows)
    assert T.score_documents(empty, T.fit(edge, labels)).count() == 0


def test_curve_keeps_the_proportion_of_classes(spark):
    """A sample of the larger class alone must not move the 0.5 threshold: words of both classes, toxic ones likelier."""
    r = np.random.RandomState(5)
    clean = [(i, " ".join(r.choice([f"w{x}" for x in range(300)], 30))) for i in range(1600)]
    toxic = [(5000 + i, " ".join([*r.choice([f"w{x}" for x in range(300)], 27 + i % 3), *["vile"] * (i % 2)])) for i in range(200)]
    some = [(i, t + " vile") if i % 8 == 0 else (i, t) for i, t in clean]
    labels = spark.createDataFrame([(i, int(i >= 5000)) for i, _ in some + toxic], "doc_id long, toxic int")
    docs = make(spark, some + toxic)
    shares = []
    for sample_docs in (5000, 300):  # above and below the size of the clean class
        got = T.score_documents(docs, T.fit(docs, labels, sample_docs)).collect()
        shares.append((sum(x.score >= 0.5 for x in got) / len(got), float(np.mean([x.score for x in got]))))
    assert abs(shares[0][1] - 200 / 1800) < 0.05 and abs(shares[1][1] - shares[0][1]) < 0.05 and abs(shares[0][0] - shares[1][0]) < 0.02


# Nearest neighbours


def brute_neighbours(rows, queries, k):
    out = {}
    for q, v in queries:
        d = sorted((math.dist(v, w), i) for i, w in rows if i != q)
        best = {}
        for x, i in d:
            best.setdefault(i, x)
        out[q] = [(i, x) for i, x in sorted(best.items(), key=lambda t: (t[1], t[0]))[:k]]
    return out


def test_search_recall_and_exact_scores(spark, larger_sf):
    vectors = spark.read.parquet(f"{larger_sf}/embeddings.parquet")
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in vectors.collect()]
    queries = [r for r in rows if r[0] % 25 == 0]
    want = brute_neighbours(rows, queries, 10)
    got = K.search(vectors, F.col("vec_id") % 25 == 0).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, r.id, r.distance))
    by = dict(rows)
    hits = 0
    for q, l in found.items():
        l.sort()
        assert [x[0] for x in l] == list(range(1, len(l) + 1)) and [x[2] for x in l] == sorted(x[2] for x in l)
        assert all(x[2] == pytest.approx(math.dist(by[q], by[x[1]]), rel=1e-12, abs=1e-12) for x in l)
        hits += len({x[1] for x in l} & {i for i, _ in want[q]})
    assert hits / (10 * len(queries)) >= 0.9


def test_search_edges(spark):
    hot = [0.5, 0.5, 0.1]
    rows = [(i, hot) for i in range(0, 60)] + [(100, None), (101, [0.0, 0.0, 0.0]), (102, [1.0, float("nan"), 0.0]), (103, [1.0, None, 0.0]), (104, [0.5, 0.5, 0.2]), (104, [0.5, 0.5, 0.2]), (105, [1.0, 2.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit("clash")).withColumn("id", F.lit(3)).withColumn("bucket", F.lit(1))
    got = K.search(vectors, F.col("vec_id").isin(0, 100, 101, 104, 105), k=10).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append(r.id)
    assert by[0] == list(range(1, 11)) and by[104] == [104, 104, *(i for i in range(9) for _ in range(2))] and set(by) == {0, 104}  # 104 is two rows
    twins = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.5]), (1, [1.0, 0.0]), (2, [5.0, 0.0])], "vec_id long, embedding array<double>")
    lists = {}
    for r in K.search(twins, F.col("vec_id") == 1, k=2).collect():
        lists.setdefault(r.rank, []).append((r.distance, r.id))
    assert sorted(lists[1]) == [(0.0, 1), (0.0, 1), (0.5, 1)] and sorted(lists[2]) == [(0.5, 1)] * 3
    assert K.search(vectors.limit(0), F.lit(True)).count() == 0


def test_clustered_vectors_visit_less(spark):
    """Where neighbours are much nearer than the rest, few buckets are visited and the recall holds."""
    r = np.random.RandomState(4)
    centres = r.standard_normal((60, 32)) * 3
    rows = [(i, [float(x) for x in centres[i % 60] + r.standard_normal(32) * 0.1]) for i in range(3000)]
    queries = rows[::100]
    want = brute_neighbours(rows, queries, 10)
    hashing = K.fit(spark.createDataFrame(rows, "id long, v array<double>"), 10)
    x = np.array([v for _, v in rows])
    visited, hits = [], 0
    for t in range(hashing.tables):
        places = hashing.places(x, t)
        filed = hashing.bucket(np.floor(places), 32, t)
        visited += [np.isin(filed, hashing.bucket(hashing.probes(places[q]), 32, t)) for q, _ in queries]
    share = np.mean([np.any(visited[i :: len(queries)], axis=0).mean() for i in range(len(queries))])
    got = {}
    for n in K.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, hashing=hashing).collect():
        got.setdefault(n.query_id, set()).add(n.id)
    hits = sum(len(got[q] & {i for i, _ in want[q]}) for q, _ in queries)
    assert hits / (10 * len(queries)) >= 0.9 and share < 0.3, (hits, share)


# Pipeline


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        docs = P.stored(out, "test")
    done = P.STAGES[-1][1](spark, docs, sf_dir)
    assert done.count() == docs.count() > 50
    assert P.run(spark, sf_dir).count() == done.count()


def test_pipeline_on_edges(spark, edge):
    import corpus_pipeline as P

    docs = make(spark, [(r.doc_id, r.text, r.lang, r.source) for r in edge.collect()])
    for name, stage in P.STAGES[:-1]:
        docs = P.stored(stage(spark, docs, "/nowhere"), "test")
    assert {r.doc_id for r in docs.collect()} <= {5, 6, 8, 9, 2, 1}
    assert P.STAGES[-1][1](spark, docs, "/nowhere").count() == docs.count()
