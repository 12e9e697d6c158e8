"""Operators 3, 6 and 9 against the libraries, and exact round trips."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from tests.llm.conftest import edge_rows, words
from tillroll.llm import automaton_bpe, elias_fano, heap_bpe, id_shards, pretokens

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def ranks_library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(n=1500):
    r = random.Random(5)
    alphabet = ["a", "b", " ", "  ", "\n", "\t", "\r", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", "\u200b", "\u3000", "é", "中", "9", "٣", "'s", "'", "<|endoftext|>", ".", "ing", "tion", "\U0001F600"]
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 30))) for _ in range(n)]


def test_heap_counts_equal_the_library(library):
    c = heap_bpe.HeapCounter(JSON)
    for t in odd_texts() + [r[1] or "" for r in edge_rows()]:
        assert c.count(t) == len(library.encode(t, add_special_tokens=False).ids), repr(t)[:80]


def test_automaton_equals_the_merges_and_decodes(ranks_library):
    e = automaton_bpe.Encoder(RANKS)
    for t in odd_texts() + [r[1] or "" for r in edge_rows()] + ["ab" * 3000, "a" * 3000]:
        ids = e.encode(t)
        assert ids == ranks_library.encode_ordinary(t), repr(t)[:80]
        assert e.decode(ids).decode() == t


def test_memo_is_bounded_and_starts_a_new_generation():
    seen = []
    memo = pretokens.Memo(lambda pieces: seen.append(len(pieces)) or [p.upper() for p in pieces], limit=50)
    for i in range(100):
        text = words(i, 20)
        assert "".join(memo.of(text)) == text.upper()
        assert len(memo.spaced) + len(memo.whole) <= 50 + 21


def test_long_pieces_are_not_remembered(library, ranks_library):
    """Texts without spaces: nothing of them stays, results are the libraries'."""
    texts = ["".join(random.Random(i).choice("abcdefgh") for _ in range(3000)) for i in range(40)] + ["ab " + "c" * 500 + " ab\n" + "d" * 500 + " \t " + "e" * 500] * 2
    c, e = heap_bpe.HeapCounter(JSON), automaton_bpe.Encoder(RANKS)
    for t in texts:
        assert c.count(t) == len(library.encode(t, add_special_tokens=False).ids)
        assert e.encode(t) == ranks_library.encode_ordinary(t)
    for held in (c.memo.spaced, c.memo.whole, c.pre, e.memo.spaced, e.memo.whole, e.words):
        assert all(len(k) <= pretokens.LONG + 1 for k in held)


def test_elias_fano_select_and_all():
    r = np.random.default_rng(1)
    for values in ([], [0], [0, 0, 0], [5, 5, 9, 1 << 40], np.cumsum(r.integers(0, 2000, 20_000)), np.arange(100_000), np.sort(r.integers(0, 1 << 62, 70_000))):
        values = np.asarray(values, np.uint64)
        ef = elias_fano.EliasFano(b"xyz" + elias_fano.encode(values), 3)
        assert len(ef) == len(values) and (ef.all() == values).all()
        if len(values):
            at = r.integers(0, len(values), 500)
            assert (ef.select(at) == values[at]).all()
    with pytest.raises(ValueError):
        elias_fano.encode(np.array([2, 1]))
    n, u = 20_000, 20_000 * 1000
    assert 8 * len(elias_fano.encode(np.sort(r.integers(0, u, n)))) < n * (2 + np.log2(u / n) + 1.5)   # near-minimal


def expected_store(rows, library):
    """(doc_id, start, n_tokens, crc) of rows in ascending order."""
    out, start = [], 0
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def key(r):
    return tuple((x is not None, x or 0) for x in r)


def test_store_round_trip(spark, small_docs, edge_docs, no_docs, library, monkeypatch):
    monkeypatch.setattr(id_shards, "SHARD_IDS", 5000)
    for docs in (small_docs, edge_docs):
        got = [tuple(r) for r in id_shards.encode_and_read(docs, JSON, 2).collect()]
        want = expected_store([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], library)
        assert sorted(got, key=key) == sorted(want, key=key)
    assert id_shards.encode_and_read(no_docs, JSON, 2).count() == 0


def test_shard_gives_single_documents():
    docs = [np.array(x, "<u2") for x in ([1, 2, 3], [], [9])]
    s = id_shards.Shard(id_shards.pack([4, None, 7], [d.tobytes() for d in docs], 2))
    assert [s.document(i).tolist() for i in range(3)] == [[1, 2, 3], [], [9]] and s.span(2) == (3, 4)
    assert s.null.tolist() == [False, True, False]


def test_count_and_encode_queries_on_edge_rows(edge_docs, no_docs, library, ranks_library):
    rows = edge_docs.select("doc_id", "text").collect()
    got = sorted((tuple(r) for r in heap_bpe.count_tokens(edge_docs, JSON, limit=100).collect()), key=key)
    want = []
    for d, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((d, len((t or "").encode()), n, n > 100))
    assert got == sorted(want, key=key)
    got = sorted((tuple(r) for r in automaton_bpe.encode_texts(edge_docs, RANKS).collect()), key=lambda r: (key(r[:2]), r[2:]))
    want = []
    for d, t in rows:
        ids = ranks_library.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=lambda r: (key(r[:2]), r[2:]))
    assert heap_bpe.count_tokens(no_docs, JSON).count() == automaton_bpe.encode_texts(no_docs, RANKS).count() == 0
