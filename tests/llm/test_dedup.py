import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import exact_dedup as E
from tallyweave.llm import line_dedup as L
from tallyweave.llm import near_dedup as N
from tallyweave.llm import substring_dedup as S
from tests.compare import connect, rows_of, rows_of_sql
from tests.llm.conftest import make

VOCABULARY = [f"w{i}" for i in range(2000)]


def prose(r, n):
    return [r.choice(VOCABULARY) for _ in range(n)]


# Exact dedup


@pytest.mark.parametrize("n,width", [(1, 10), (5, 5), (200, 1 << 40), (1000, 1200)])
def test_golomb_round_trip(n, width):
    v = np.sort(np.random.RandomState(n).choice(min(width, 10**6), n, replace=False)).astype(np.int64)
    assert (E.golomb_decode(n, *E.golomb_encode(v, width)) == v.astype(np.uint64)).all()


def test_exact_matches_sql(spark, sf_dir):
    assert rows_of(E.op3_exact_dedup(spark, sf_dir)) == rows_of_sql(connect(sf_dir), E.OP3_SQL)


@pytest.mark.parametrize("bits", [26, 3])
def test_exact_edges(spark, edge, bits):
    """A tiny bit table lets everything through; the result is the same."""
    rows = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in E.exact_duplicates(edge, filter_bits=bits).collect()]
    by = {}
    for r in edge.collect():
        by.setdefault(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""), []).append(r.doc_id)
    want = [(i, (keep := max((x for x in ids if x is not None), default=None)), len(ids), i == keep) for ids in by.values() for i in ids]
    assert sorted(rows, key=str) == sorted(want, key=str)
    sha = {r.doc_id: r.text_sha256 for r in E.exact_duplicates(edge).collect()}
    assert sha[4] == hashlib.sha256(b"").hexdigest()


def test_exact_keeps_one_row_of_each_group(spark, edge, empty):
    kept = E.drop_exact_duplicates(edge)
    assert kept.columns == edge.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([4, 5, 6, 7, 8, 9], key=str)
    assert E.drop_exact_duplicates(empty).count() == 0 and E.exact_duplicates(empty).count() == 0


def test_exact_keeps_every_text_of_null_and_repeated_ids(spark):
    docs = [(None, "a"), (None, "b"), (None, "A"), (None, "c"), (1, "one"), (1, "two"), (1, "TWO"), (2, "x"), (2, "y"), (3, "X"), (None, "y")]
    kept = sorted(((r.doc_id, r.text.lower()) for r in E.drop_exact_duplicates(make(spark, docs).repartition(3)).collect()), key=str)
    assert kept == sorted([(None, "a"), (None, "b"), (None, "c"), (1, "one"), (1, "two"), (2, "y"), (3, "x")], key=str)


# Near-dedup


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def alike(a, b):
    m = lcs(a, b)
    return m / max(1, len(a) + len(b) - m)


def edited(r, words, times):
    words = list(words)
    for _ in range(times):
        i = r.randrange(len(words))
        kind = r.random()
        words[i : i + (kind < 0.7)] = [] if kind < 0.3 else [r.choice(VOCABULARY)]
    return words


def test_banded_alignment_is_exact():
    r = random.Random(3)
    for _ in range(800):
        a = [r.randrange(r.choice([3, 30, 1000])) for _ in range(r.randint(1, 60))]
        b = edited(r, a, r.randint(0, 8)) if len(a) > 9 else [r.randrange(5) for _ in range(r.randint(0, 9))]
        b = [hash(x) % 1000 if isinstance(x, str) else x for x in b]
        s = alike(a, b)
        assert N.aligned(np.array(a, np.uint64), np.array(b, np.uint64)) == pytest.approx(s if s >= 0.8 - 1e-12 else 0.0)


def brute_classes(docs):
    rows = {}
    for i, text in docs:
        if i is not None and N.words(text):
            rows[i] = N.words(text)
    root = {i: i for i, _ in docs if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(rows)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if min(len(rows[i]), len(rows[j])) >= 0.8 * max(len(rows[i]), len(rows[j])) and len(set(rows[i]) & set(rows[j])) and alike(rows[i], rows[j]) >= 0.8 - 1e-12:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in root}


def test_near_classes_match_brute_force(spark):
    """A crowd of variants around one base, chains, decoys that share a passage, and short texts."""
    r = random.Random(11)
    base, passage = prose(r, 120), prose(r, 60)
    docs = [(1, base)] + [(i, edited(r, base, r.randint(1, 9))) for i in range(2, 40)]
    docs += [(100 + i, prose(r, 50) + passage + prose(r, 40)) for i in range(30)]
    chain = prose(r, 100)
    for i in range(8):
        chain = edited(r, chain, 2)
        docs.append((200 + i, list(chain)))
    docs += [(300, prose(r, 3)), (301, ["one"]), (302, ["one"]), (303, ["One!"]), (304, prose(r, 4))]
    docs = [(i, " ".join(w)) for i, w in docs]
    got = {x.doc_id: x.class_id for x in N.near_duplicates(make(spark, docs)).collect()}
    assert got == brute_classes(docs)


def test_near_copies_with_a_tenth_of_their_words_edited_are_found(spark):
    r = random.Random(21)
    docs = []
    for i in range(0, 300, 2):
        a = prose(r, r.randint(80, 400))
        b = edited(r, a, len(a) * (2 + i % 9) // 100)
        docs += [(i, " ".join(a)), (i + 1, " ".join(b))]
    got = {x.doc_id: x.class_id for x in N.near_duplicates(make(spark, docs)).collect()}
    assert sum(got[i + 1] == i for i in range(0, 300, 2)) >= 0.98 * 150 and set(got.values()) <= set(range(300))
    assert all(got[i] == i for i in range(0, 300, 2))


@pytest.mark.parametrize("size", [10, 15, 20, 30, 40, 60])
def test_short_near_copies_are_found(spark, size):
    """One word in ten exchanged anywhere; among texts of the same length that have the words of a small vocabulary."""
    r = random.Random(size)
    docs = []
    for i in range(0, 300, 2):
        a, b = prose(r, size), None
        b = list(a)
        for at in r.sample(range(size), size // 10):
            b[at] = f"new{r.randrange(10**6)}"
        docs += [(i, " ".join(a)), (i + 1, " ".join(b))]
    got = {x.doc_id: x.class_id for x in N.near_duplicates(make(spark, docs)).collect()}
    assert sum(got[i + 1] == got[i] for i in range(0, 300, 2)) >= 0.95 * 150
    rows = {i: N.words(t) for i, t in docs}
    assert all(got[i] == i or alike(rows[i], rows[got[i]]) > 0.4 for i in got)


def test_one_doc_id_with_different_texts_is_one_document(spark):
    r = random.Random(22)
    a, b = " ".join(prose(r, 60)), " ".join(prose(r, 60))
    got = {x.doc_id: x.class_id for x in N.near_duplicates(make(spark, [(1, a), (2, a), (2, b), (3, b), (4, "x")])).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def test_alignment_of_long_texts_holds_its_band_only():
    import tracemalloc

    r = np.random.RandomState(1)
    a = r.zipf(1.3, 100_000).astype(np.uint32)
    b = np.delete(a, r.choice(len(a), 4000, replace=False))
    tracemalloc.start()
    s = N.aligned(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert s == pytest.approx(0.96) and peak < 150e6


def test_near_edges(spark, edge, empty):
    rows = {r.doc_id: r.class_id for r in N.near_duplicates(edge).collect()}
    assert rows[1] == rows[2] == rows[9] == rows[6] == 1 and rows[3] == 3 and rows[4] == 4 and rows[None] is None
    kept = N.drop_near_duplicates(edge)
    assert kept.columns == edge.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 3, 4, None, 5, 7, 8], key=str)
    assert N.near_duplicates(empty).count() == 0


# Line dedup


def test_patience_matches_are_common_and_ordered():
    r = random.Random(1)
    for _ in range(1500):
        a, b = ([r.randrange(r.choice([4, 50])) for _ in range(r.randint(0, 15))] for _ in range(2))
        m = L.patience_matches(a, b)
        assert all(a[i] == b[j] for i, j in m) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(m, m[1:]))
    assert L.patience_matches([1, 2, 3, 4], [9, 1, 2, 8, 4]) == [(0, 1), (1, 2), (3, 4)]


def test_lines_go_from_the_later_document(spark):
    block = ["a long shared line of six words", "another shared line of some more words"]
    docs = [(1, "\n".join(["first own line here now yes", *block])), (2, "\n".join([*block, "", "second own line"])), (3, "Yes.\nthird own line of this document"), (4, "Yes.\nno more")]
    docs += [(10 + i, f"own text number {i} of this one\nA LONG shared line of six words ") for i in range(200)]
    got = {r.doc_id: r for r in L.remove_repeated_lines(make(spark, docs)).collect()}
    assert got[1].deleted == [] and got[2].deleted == [0, 1] and got[2].text == "\nsecond own line"
    assert got[3].deleted == [] and got[4].deleted == []  # too few words
    assert all(got[10 + i].deleted == [1] for i in range(200))


def test_windows_are_the_fewest_adjoining_lines():
    r = random.Random(8)
    for _ in range(300):
        words = [r.randint(1, 7) for _ in range(r.randint(0, 12))]
        runs = set()
        for i in range(len(words)):
            end = next((e for e in range(i + 1, len(words) + 1) if sum(words[i:e]) >= 5), None)
            runs |= {(i, end)} if end else set()
        assert len(L.line_windows(list(range(len(words))), words, 5)) == len(runs)


def test_blocks_of_short_lines_are_found_although_each_line_is_common(spark):
    """The lines of a block also stand alone in earlier documents, before the first copy of the block and between the copies."""
    block = ["alpha one", "beta two", "gamma three"]
    docs = [(i, f"own words {i}\n{line}\nmore {i}") for at in (1, 20) for i, line in enumerate(block, at)]
    docs += [(10, "\n".join(["first holder", *block])), (30, "\n".join(["second holder", *block, "end"]))]
    docs += [(100 + i, f"own text {i}\n{block[i % 3]}") for i in range(180)] + [(400, "\n".join(["third", *block]))]
    got = {r.doc_id: r.deleted for r in L.remove_repeated_lines(make(spark, docs)).collect()}
    assert {i: d for i, d in got.items() if d} == {30: [1, 2, 3], 400: [1, 2, 3]}


def test_blocks_that_very_many_documents_hold(spark):
    """Document 1 has X before Y, all others Y before X: the diff with 1 aligns one block only, the one with a neighbour both."""
    x = ["first block line of several words here", "second line of that first block here"]
    y = ["other block line of several words here", "second line of that other block here"]
    docs = [(1, "\n".join(x + y))] + [(i, "\n".join(y + x + [f"own line {i} with quite a few words of it"])) for i in range(2, 80)]
    got = {r.doc_id: r.deleted for r in L.remove_repeated_lines(make(spark, docs)).collect()}
    assert got[1] == [] and len(got[2]) == 2 and all(got[i] == [0, 1, 2, 3] for i in range(3, 80))


@pytest.mark.parametrize("ranges", [1, 7])
def test_nearest_earlier_holders(spark, ranges):
    """A line that most documents hold lies over several ranges."""
    r = random.Random(ranges)
    held = {(line, k) for k in range(400) for line in ([5] if r.random() < 0.9 else []) + [r.randrange(40)]}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    try:
        df = spark.createDataFrame(sorted(held), "line long, n long").select("line", F.struct(F.col("n").alias("doc_id"), F.lit(0).cast("long").alias("h")).alias("k"))
        got = sorted((x.k.doc_id, x.e.doc_id) for x in L.nearest_earlier(df).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = []
    for line, k in held:
        below = [b for a, b in held if a == line and b < k]
        want += [(k, max(below))] if below else []
    assert got == sorted(want)


def test_line_edges(edge, empty):
    got = [(r.doc_id, r.n_lines, r.deleted, r.text) for r in L.remove_repeated_lines(edge).collect()]
    assert len(got) == edge.count()
    by = {i: (n, d, t) for i, n, d, t in got}
    assert by[4] == (0, [], None) and by[3] == (1, [], "") and by[None][1] == [] and by[2] == (1, [0], "") and by[9] == (1, [0], "") and by[1][1] == []
    assert L.remove_repeated_lines(empty).count() == 0


# Substring dedup


def words_of(text):
    return S.Words(np.frombuffer(text.encode(), np.uint8))


def test_cuts_depend_on_nearby_words_only():
    r = random.Random(2)
    text = " ".join(prose(r, 400))
    cuts = words_of(text).cuts(12)
    assert np.diff(cuts).max() <= 12 and 40 < len(cuts) < 100
    moved = words_of("some inserted words " + text).cuts(12) - 3
    assert {c for c in cuts.tolist() if c > 16} <= set(moved.tolist())
    assert len(set(words_of(text).chunks(12)) & set(words_of("some inserted words " + text).chunks(12))) > len(cuts) - 6
    assert len(words_of("a a " * 300).cuts(12)) > 500 and len(words_of("").chunks(12)) == len(words_of("one two").chunks(12)) == 0


def brute_passages(docs, min_words):
    """Documents with a passage of at least min_words words that an earlier one has."""
    out = set()
    for n, (i, t) in enumerate(docs):
        w = t.split()
        for j, u in docs[:n]:
            v = u.split()
            grams = {tuple(v[a : a + min_words]) for a in range(len(v) - min_words + 1)}
            if any(tuple(w[a : a + min_words]) in grams for a in range(len(w) - min_words + 1)):
                out.add(i)
    return out


def test_passages_match_brute_force(spark):
    r = random.Random(4)
    passage, short = prose(r, 56), prose(r, 25)
    docs = [(i, prose(r, r.randint(20, 300))) for i in range(40)]
    for i in (3, 7, 20, 31):
        at = r.randrange(len(docs[i][1]))
        docs[i][1][at:at] = passage
    for i in (5, 9):
        docs[i][1][4:4] = short
    docs = [(i, " ".join(w)) for i, w in docs]
    docs += [(50, docs[12][1]), (51, "é " + docs[13][1])]
    got = S.repeated_passages(make(spark, docs)).collect()
    assert {g.doc_id for g in got} == brute_passages(docs, 50) == {7, 20, 31, 50, 51}
    by = dict(docs)
    for g in got:
        a, b = by[g.doc_id].encode()[g.start : g.start + g.size], by[g.source_id].encode()[g.source_start : g.source_start + g.size]
        assert a == b and a.decode() and g.source_id < g.doc_id and g.words >= 50
    left = {x.doc_id: x.text for x in S.remove_repeated_passages(make(spark, docs), S.repeated_passages(make(spark, docs))).collect()}
    assert " ".join(passage[3:-3]) not in left[7] and " ".join(passage) in left[3] and left[50].strip() == "" and left[0] == by[0]


def test_every_passage_of_fifty_words_is_found_whatever_its_words():
    """The bound is in words: short ones, long ones, one letter only, other bytes on both sides."""
    r = random.Random(12)
    for longest in (1, 2, 3, 5, 40):
        for _ in range(60):
            passage = " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(1, longest))) for _ in range(50))
            a, b = (" ".join([*prose(r, r.randint(0, 40)), "|", passage, "|", *prose(r, r.randint(0, 40))]) for _ in range(2))
            a, b = a.replace("| ", f"{r.random()} ", 1), b.replace(" |", " Ω", 1)
            x, y = words_of(a), words_of(b)
            both = set(x.hashes(50).tolist()) & set(y.hashes(50).tolist())
            shared = np.zeros(1 << 17, np.uint8)  # chunks of both texts, as the bit table has them
            for h in set(x.chunks(12).tolist()) & set(y.chunks(12).tolist()):
                shared[(h & (1 << 20) - 1) >> 3] |= 1 << (h & 7)
            assert both and all(may for h, may in zip(x.hashes(50).tolist(), x.may_repeat(50, shared).tolist()) if h in both)
            assert not words_of(" ".join(prose(r, 60))).may_repeat(50, shared).any()
            at = b.encode().index(passage.encode())
            assert any(s <= at and s + n >= at + len(passage) and w >= 50 for s, n, w, _ in S.common_passages(b.encode(), a.encode(), 50))
    assert len(S.common_passages(b"ha " * 500, b"ha " * 400, 50)) <= 11


@pytest.mark.parametrize("bits", [S.FILTER_BITS, 3])
def test_passages_of_short_words_and_after_partial_copies(spark, bits):
    """One-letter words; and a passage whose earlier holders have only its beginning or its end."""
    r = random.Random(13)
    short, whole = [r.choice("abcdefgh") for _ in range(50)], prose(r, 60)
    parts = {1: whole[:45], 2: whole[15:], 3: whole, 4: whole, 5: whole, 10: short, 11: short}
    docs = [(i, " ".join(prose(r, 30) + w + prose(r, 30))) for i, w in parts.items()] + [(i, " ".join(prose(r, 60))) for i in range(20, 40)]
    got = {(g.doc_id, g.source_id) for g in S.repeated_passages(make(spark, docs), filter_bits=bits).collect()}
    assert got == {(4, 3), (5, 3), (11, 10)}


def test_substring_edges(edge, empty):
    got = {(r.doc_id, r.source_id) for r in S.repeated_passages(edge, min_words=10).collect()}
    assert got == {(6, 1), (9, 1)}  # upper case is other text
    assert S.repeated_passages(empty).count() == 0
