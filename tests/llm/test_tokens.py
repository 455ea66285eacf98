import hashlib
import random
import struct

import pytest
from tokenizers import Tokenizer

from tallyweave.llm import bpe_codec as B
from tallyweave.llm import token_count as T
from tallyweave.llm.bpe_core import load_merges, merge_list, pieces

ALPHABET = ["a", "é", "<|endoftext|>", "<|end", " ", "\n", "\x1c", " ", "'", "s", "ß", "日本", "1", "²", "_", "!", "😀", "\t", "  ", "\x85", "'ll", "A", "the", " and", "́"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(T.default_tokenizer())


@pytest.fixture(scope="module")
def merges():
    return load_merges(T.default_tokenizer())


def texts():
    r = random.Random(7)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 14))) for _ in range(3000)] + ["a" * 20_000, "日本" * 3000, " " * 9000]


def test_counts_and_ids_are_the_library_s(library, merges):
    counter, encoder = T.Counter(merges), B.Encoder(merges, None)
    for text in texts():
        ids = library.encode(text, add_special_tokens=False).ids
        assert counter.text(text) == len(ids), text[:80]
        assert encoder.text(text) == struct.pack(f"<{len(ids)}I", *ids), text[:80]
        assert "".join(pieces(text)) == text


def test_heap_and_scan_merge_alike(merges):
    r = random.Random(3)
    for _ in range(2000):
        word = bytes(r.choice(b"etaoin shrdlu") for _ in range(r.randint(1, 40)))
        symbols, right, done = merge_list(word, merges)
        assert [s for s in symbols if s >= 0] == B.merged_ids(word, merges) and len(word) - done == len(B.merged_ids(word, merges))


def test_transducer_round_trip_and_minimality():
    r = random.Random(5)
    words = sorted({bytes(r.choice(b"abcd") for _ in range(r.randint(1, 7))) for _ in range(2000)})
    lexicon = B.Lexicon(B.compile_lexicon((w, [i, i + 7][: 1 + i % 2]) for i, w in enumerate(words)))
    for i, w in enumerate(words):
        ids = [i, i + 7][: 1 + i % 2]
        assert lexicon.get(w) == struct.pack(f"<{len(ids)}I", *ids)
    known = set(words)
    assert all(lexicon.get(w) is None for w in (bytes(r.choice(b"abcde") for _ in range(r.randint(1, 8))) for _ in range(3000)) if w not in known)
    many = [bytes(f"{i:04d}ation", "ascii") for i in range(1000)]
    shared = B.compile_lexicon((w, [1]) for w in many)
    assert struct.unpack_from("<5I", shared)[1] < 30  # one chain of suffix states, not a thousand
    assert B.Lexicon(B.compile_lexicon([])).get(b"a") is None


def test_memo_forgets_but_recomputes():
    from tallyweave.llm.bpe_core import TwoAges

    seen = []
    memo = TwoAges(lambda w: seen.append(w) or len(w), limit=3)
    assert [memo[w] for w in ["a", "bb", "ccc", "dddd", "a", "ee", "ff", "gg", "bb"]] == [1, 2, 3, 4, 1, 2, 2, 2, 2] and len(memo) <= 3


def check(docs, library):
    coded = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in B.digests(docs).collect()}
    counts = {(r.doc_id, r.n_bytes, r.n_tokens) for r in T.count_tokens(docs).collect()}
    want, want_counts = set(), set()
    for r in docs.select("doc_id", "text").collect():
        text = r.text or ""
        ids = library.encode(text, add_special_tokens=False).ids
        packed = hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        want.add((r.doc_id, len(ids), packed, hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        want_counts.add((r.doc_id, len(text.encode()), len(ids)))
    assert coded == want and counts == want_counts


def test_edge_rows(edge, library):
    check(edge, library)
    assert T.count_tokens(edge).count() == edge.count() == B.digests(edge).count()


def test_empty_table(empty):
    assert B.digests(empty).count() == 0 and T.count_tokens(empty).count() == 0


def test_queries_on_documents(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(docs, library)
    assert all(r.over_limit == (r.n_tokens > 1024) for r in T.op8_token_counts(spark, sf_dir).collect())
