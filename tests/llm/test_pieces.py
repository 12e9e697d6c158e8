"""Operator 12 against the sentencepiece library."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from tests.llm.conftest import edge_rows, words
from tillroll.llm import prefix_table

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def encoder():
    return prefix_table.Encoder(MODEL)


def odd_texts(library, n=6000):
    r = random.Random(12)
    pieces = [library.id_to_piece(i) for i in range(3, library.get_piece_size())]
    alphabet = ["a", "b", " ", "  ", "   ", "\n", "\t", "\r", ";", "{", "▁", "\0", "​", "　", "é", "中", "9", "'s", "<s>", "<0x0A>", "ing", "\U0001F600", "\xa0", "=", "--"]
    for i in range(n):
        source = pieces if i % 2 else alphabet
        text = "".join(r.choice(source) for _ in range(r.randint(0, 14)))
        yield text.replace("▁", " ") if i % 4 < 2 else text


def test_equals_the_library(encoder, library):
    texts = [*odd_texts(library), *[r[1] or "" for r in edge_rows()]]
    texts += [" " * n for n in range(40)] + [" " * 5001, "x" * 20_000, "ab" * 5000, "=-" * 3000 + "=" * 3000, "\n" * 2000, " " * 14 + "a" + " " * 31 + "b", words(1, 3000)]
    for t in texts:
        ids = library.encode(t)
        assert encoder.encode(t) == ids, repr(t)[:80]
        assert encoder.decode(ids) == library.decode(ids)


def test_decodes_any_ids(encoder, library):
    r = random.Random(3)
    for _ in range(2000):
        ids = [r.randrange(library.get_piece_size()) for _ in range(r.randint(0, 6))]
        assert encoder.decode(ids) == library.decode(ids)


def test_table_holds_the_last_token_of_every_prefix(encoder, library):
    for text in ("▁" + words(7, 30).replace(" ", "▁"), "▁" * 40):
        last = encoder.last_tokens(text)
        for n in range(1, len(text) + 1):
            ids = library.encode(text[1:n].replace("▁", " ")) if n > 1 else None
            if ids:
                assert encoder.ids[last[n - 1][0]][-1] == ids[-1]


def test_uncut_texts_encode_alike(library, monkeypatch):
    """The cuts save work and change nothing."""
    e = prefix_table.Encoder(MODEL)
    e.cuts_lines = False
    e.segments = prefix_table.re.compile(r"(?s:.+)")
    for t in [*odd_texts(library, 600), words(2, 300)]:
        assert e.encode(t) == library.encode(t)


def test_memo_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(prefix_table, "MEMO_BYTES", 50_000)
    e = prefix_table.Encoder(MODEL)
    for i in range(200):
        e.encode(words(i, 30) + " " + "y" * 5000)
        assert e.held <= 50_000 + 31 * 2000   # the last text may pass the bound
        assert len(e.words) < 250 and len(e.old[1]) < 250
    assert all(len(k) <= prefix_table.LONG for k in [*e.memo, *e.words])


def test_other_models_are_refused(tmp_path):
    with open(MODEL, "rb") as f:
        data = f.read()
    flag = b"\x1a\x12\n\x08identity\x12\x00\x18\x01 \x002\x00"   # the normaliser's message
    assert data.count(flag) == 1
    other = tmp_path / "m.model"
    other.write_bytes(data.replace(flag, flag.replace(b" \x00", b" \x01")))
    with pytest.raises(ValueError, match="white space"):
        prefix_table.Encoder(str(other))


def test_query_on_edge_rows(spark, edge_docs, no_docs, library):
    rows = edge_docs.select("doc_id", "text").collect()
    want = []
    for d, t in rows:
        ids = library.encode(t or "")
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest(), ids))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    got = [tuple(r) for r in prefix_table.encode_texts(edge_docs, MODEL, with_ids=True).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert prefix_table.encode_texts(no_docs, MODEL).count() == 0
