"""Whitening and vector codes against plain computations on whole numbers."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from tallyweave.llm import vector_codes as C
from tallyweave.llm import whitening as W
from tallyweave.llm.common import table
from tests.compare import connect, rows_of, rows_of_sql

SCHEMA = "vec_id long, embedding array<float>, label int, id string, x int, code string, n long, component int"


def vectors(spark, rows):
    """(vec_id, vector, label) with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, v, lab, "i", 1, "c", 2, 3) for i, v, lab in rows], SCHEMA)


def odd_rows(dims=32, n=150, seed=3):
    r = np.random.RandomState(seed)
    some = [(int(i), [float(x) for x in np.float32(r.standard_normal(dims) * (1 + i % 3))], int(i % 5) if i % 7 else None) for i in range(n)]
    some += [(3, some[3][1], 1), (3, some[4][1], 1), (None, some[5][1], None)] * 2  # repeated ids and rows, a null id
    some += [(900, None, 1), (901, [], 1), (902, [float("nan")] * dims, 1), (903, [None] + [1.0] * (dims - 1), 1), (904, [float("inf")] * dims, 1), (905, [1.0] * (dims + 1), 1), (906, [1e30] * dims, 1), (907, [0.0] * dims, 2)]
    return some


def kept(rows, dims=32):
    good = lambda v: v is not None and len(v) == dims and all(c is not None and math.isfinite(c) and abs(c) < 2**19 for c in v)
    return [(i, [math.floor(256 * c) for c in np.float32(v).tolist()], lab) for i, v, lab in rows if good(v)]


def brute_codes(rows, parts, entries, rounds):
    first = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    width = len(rows[0][1]) // parts
    cut = lambda x: [tuple(x[p * width : (p + 1) * width]) for p in range(parts)]
    books = [list(b) for b in zip(*(cut(x) for _, x, _ in first))]
    distance = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    nearest = lambda v, book: min((distance(v, c), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for _, x, _ in rows:
                v = cut(x)[p]
                members.setdefault(nearest(v, books[p])[1], []).append(v)
            for e, vs in members.items():
                books[p][e] = tuple(sum(c) // len(vs) for c in zip(*vs))
    out = []
    for i, x, lab in rows:
        best = [nearest(v, b) for v, b in zip(cut(x), books)]
        out.append((i, lab, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best)))
    return out, hashlib.sha256(",".join(str(c) for b in books for v in b for c in v).encode()).hexdigest()


@pytest.mark.parametrize("parts,entries", [(16, 64), (4, 10), (16, 300 - 100)])
def test_codes_match_brute_force(spark, parts, entries, monkeypatch):
    monkeypatch.setattr(C, "CHUNK", 32 * 70)  # chunks of 70 vectors, blocks of 32
    rows = odd_rows()
    codes, books = C.compress(vectors(spark, rows).repartition(3), parts=parts, entries=entries)
    want, digest = brute_codes(kept(rows), parts, entries, C.ROUNDS)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in codes.select("id", "label", "code", "error").collect()), key=key) == sorted(want, key=key)
    assert C.codebooks_digest(books) == digest


def test_op12_matches_sql(spark, sf_dir):
    assert rows_of(C.op12_vector_codes(spark, sf_dir)) == rows_of_sql(connect(sf_dir), C.OP12_SQL)


def test_hilbert_order_visits_neighbours():
    """On a full grid each step of the curve moves by one along one axis; every point is visited once."""
    for dims, side in ((2, 8), (3, 4), (4, 4)):
        grid = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), axis=-1).reshape(-1, dims) - 3
        walk = grid[C.hilbert_order(grid)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all() and len({tuple(x) for x in walk}) == side**dims


def test_shortlists_lose_no_nearest_entry():
    r = np.random.RandomState(5)
    fewer = 0
    for _ in range(50):
        points, book = r.randint(-15, 15, (32, 4)) + r.randint(-30, 30, 4), r.randint(-60, 60, (64, 4))
        book[10] = book[20]
        mask = C.shortlists(points.min(axis=0)[None], points.max(axis=0)[None], book)[0]
        d = ((points[:, None] - book[None]) ** 2).sum(2)
        assert mask[d.argmin(axis=1)].all()
        fewer += mask.sum() < 48
        entry, error = C._nearest(points, np.flatnonzero(mask), book)
        assert (entry == d.argmin(axis=1)).all() and (error == d.min(axis=1)).all()
    assert fewer > 10


def exact_covariance(fit):
    n, total = len(fit), [sum(c) for c in zip(*fit)]
    centred = [[Fraction(n * x - s, n) for x, s in zip(v, total)] for v in fit]
    dims = range(len(total))
    return n, total, [[sum(v[i] * v[j] for v in centred) / n for j in dims] for i in dims]


def test_whitening_matches_exact_arithmetic(spark):
    rows = odd_rows(dims=8)
    rows_kept = kept(rows, 8)
    n, total, v = exact_covariance(sorted({tuple(x) for _, x, _ in rows_kept}))
    values, vecs = np.linalg.eigh(np.array([[float(x) for x in r] for r in v]))
    trace = float(sum(v[i][i] for i in range(8)))
    got = W.whiten(vectors(spark, rows).repartition(3)).collect()
    assert len(got) == 4 * len(rows_kept) and {r.n for r in got} == {n}
    want = {}
    for i, x, _ in rows_kept:
        for c in range(4):
            e, u = values[-1 - c], vecs[:, -1 - c]
            w = sum((a - s / n) * b for a, s, b in zip(x, total, u)) / math.sqrt(e)
            want.setdefault((i, c + 1, sum((n * a - s) ** 2 for a, s in zip(x, total))), []).append((w, e / trace))
    for c in range(1, 5):
        side = {np.sign(r.whitened) * np.sign(want[(r.id, c, r.deviation)][0][0]) for r in got if r.component == c and abs(r.whitened) > 1e-6 and r.id not in (None, 3)}
        assert len(side) == 1  # one sign for all rows
        for r in got:
            if r.component == c:
                assert any(abs(abs(r.whitened) - abs(w)) < 1e-9 and abs(r.explained / share - 1) < 1e-12 for w, share in want[(r.id, c, r.deviation)])
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-10


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1, 0.5], [1, 1 + 1e-9, 1 + 2e-9, 0.3, 0.3, 0.1], [2, 2, 2, 2, 2, 2], [1e6, 1, 1 - 1e-7, 1e-6, 0, 0], [3, 0, 0, 0, 0, 0]])
def test_refined_eigenvectors(values):
    """Residuals and orthogonality at double precision, also for clustered and equal eigenvalues."""
    q = np.linalg.qr(np.random.RandomState(7).standard_normal((6, 6)))[0].astype(np.longdouble)
    q = q + q @ (np.eye(6) - q.T @ q) / 2
    a = q @ np.diag(np.array(values, np.longdouble)) @ q.T
    e, x = W.eigen(a)
    size = max(values)
    assert np.abs(x.T @ x - np.eye(6)).max() < 5e-16 * 4
    assert np.abs(a @ x - x * e).max() < 1e-15 * size * 4 and np.abs(e - sorted(values, reverse=True)).max() < 1e-15 * size * 4
    if values[0] - values[1] == 1:  # well apart: the vectors themselves
        order = np.argsort(values)[::-1]
        assert np.abs(np.abs((q[:, order].T @ x)) - np.eye(6)).max() < 1e-15


def test_refined_vectors_of_a_close_pair():
    """A pair 1e-9 apart: float32 can't tell the two apart, the sub-solve must."""
    q = np.linalg.qr(np.random.RandomState(8).standard_normal((5, 5)))[0].astype(np.longdouble)
    for _ in range(3):
        q = q + q @ (np.eye(5) - q.T @ q) / 2
    _, x = W.eigen(q @ np.diag(np.array([1 + 1e-9, 1, 0.5, 0.2, 0.1], np.longdouble)) @ q.T)
    assert np.abs(np.abs(q.T @ x) - np.eye(5)).max() < 1e-9


def test_degenerate_whitening(spark):
    one = W.whiten(vectors(spark, [(1, [0.5, -0.25], 0), (2, [0.5, -0.25], 0)])).collect()
    assert [(r.id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(one)] == [(i, c, 1, 0, None, 0.0, None) for i in (1, 2) for c in (1, 2)]
    line = W.whiten(vectors(spark, [(i, [i / 256, 2 * i / 256, 0.0], 0) for i in range(5)])).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in line) and line[0].identity_error < 1e-12 and {round(r.explained, 12) for r in line} == {1.0, 0.0}
    far = W.whiten(vectors(spark, [(1, [524287.0], 0), (2, [-524287.0], 0), (3, [0.25], 0)])).collect()
    assert {r.deviation for r in far} == {(3 * x - 64) ** 2 for x in (256 * 524287, -256 * 524287, 64)}


def test_empty_tables(spark):
    nothing = vectors(spark, [(1, [1.0] * 16, 1)]).limit(0)
    assert W.whiten(nothing).collect() == [] and C.compress(nothing)[0].collect() == []
    assert C.compress(vectors(spark, [(1, [1.0] * 15, 1)]))[0].collect() == []  # 16 parts don't fit
    one = C.compress(vectors(spark, [(1, [1.0] * 16, None)]))[0].collect()
    assert [(r.id, r.code, r.error) for r in one] == [(1, "00" * 16, 0)]


def test_whole_table(spark, sf_dir):
    rows = W.op11_whitening(spark, sf_dir).collect()
    n = table(spark, sf_dir, "embeddings").count()
    assert len(rows) == 4 * n and max(r.identity_error for r in rows) < 1e-9
    w = np.array([[r.whitened for r in rows if r.component == c] for c in range(1, 5)])
    assert np.abs(w @ w.T / n - np.eye(4)).max() < 0.2  # repeated vectors weigh more here than in the fit
