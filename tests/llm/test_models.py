"""Operators 2 and 10: held-out accuracy, brute force, and the pipeline."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest

from tests.llm.conftest import SF
from tests.llm.test_dedup import brute_components, covered, repeated_words, split
from tillroll.llm import ngram_trie, weak_labels


def brute_scores(rows, mass):
    tokens = [(d, split(t) + ["end"], zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2) for d, t in rows]
    one, two, begins = collections.Counter(), collections.Counter(), 0
    for _, w, out in tokens:
        if not out:
            one.update(w)
            two.update(zip(["begin", *w[:-1]], w, strict=True))
            begins += 1
    n, v = sum(one.values()), len(one)
    result = []
    for d, w, out in tokens:
        single = [(one[x] + 1) / (n + v + 1) for x in w]
        past = [begins] + [one[x] for x in w[:-1]]
        p = [(two[(u, x)] + mass * s) / (c + mass) for u, x, s, c in zip(["begin", *w[:-1]], w, single, past, strict=True)]
        result.append((d, out, len(w), sum(one[x] > 0 for x in w), n, sum(map(math.log10, single)), sum(map(math.log10, p))))
    return sorted(result, key=str)


def check_scores(docs, mass=20.0):
    got = sorted((tuple(r) for r in ngram_trie.score(docs, mass).collect()), key=str)
    want = brute_scores([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], mass)
    assert len(got) == len(want)
    by = lambda r: (str(r[0]), r[2], round(r[5], 6))
    for g, w in zip(sorted(got, key=by), sorted(want, key=by), strict=True):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9)
        assert abs(g[6] - w[6]) <= 0.0004 * w[2]   # quantised to 1 / 2000 of a power of ten


def test_scores_equal_brute_force(small_docs, edge_docs, no_docs, monkeypatch):
    monkeypatch.setattr(ngram_trie, "BLOCK_BYTES", 50_000)
    check_scores(small_docs)
    check_scores(edge_docs)
    assert ngram_trie.score(no_docs).count() == 0


def test_bigrams_beat_the_base_on_held_out_documents(small_docs):
    rows = [r for r in ngram_trie.score(small_docs).collect() if r.held_out]
    assert rows and sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_trie_finds_each_pair_by_select_and_in_bulk():
    r = np.random.default_rng(3)
    contexts = np.sort(r.integers(0, 1 << 62, 400).astype(np.uint64)).repeat(r.integers(1, 30, 400))
    pairs = np.unique(np.stack([contexts, r.integers(0, 1 << 40, len(contexts)).astype(np.uint64)], axis=1), axis=0)
    p = r.random(len(pairs)) ** 4 + 1e-9
    trie = ngram_trie.Trie(ngram_trie.Trie.build(pairs[:, 0], pairs[:, 1], p))
    trie.load()
    codes = trie.find(pairs[:, 0], pairs[:, 1])
    assert np.abs(np.log10(ngram_trie.restored(codes)) - np.log10(p)).max() < 1 / ngram_trie.STEPS
    for i in range(0, len(pairs), 97):
        assert trie.find_one(int(pairs[i, 0]), int(pairs[i, 1])) == codes[i]
    assert (trie.find(pairs[:, 0], pairs[:, 1] ^ np.uint64(1)) == ngram_trie.UNSEEN).mean() > 0.99
    assert trie.find_one(5, 5) == ngram_trie.UNSEEN
    none = ngram_trie.Trie(ngram_trie.Trie.build(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0)))
    none.load()
    assert none.find(np.array([3], np.uint64), np.array([4], np.uint64)).tolist() == [ngram_trie.UNSEEN]


def test_labeller_accuracies_are_recovered():
    r = np.random.default_rng(7)
    truth = r.random(20_000) < 0.7
    right = (0.95, 0.9, 0.8, 0.7)
    votes = collections.Counter("".join("-" if r.random() < 0.2 else str(int(t if r.random() < a else not t)) for a in right) for t in truth)
    share, table = weak_labels.fit_labellers(dict(votes), 0.5)
    assert abs(share - 0.7) < 0.03
    for j, a in enumerate(right):
        assert abs(table[j, 1, 1] / table[j, 1, :2].sum() - a) < 0.04


def test_held_out_accuracy(spark):
    """Labels of half of the labelled documents vote; the other half judges."""
    sf = SF.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    known = {r.doc_id: r for r in labels.collect()}
    out = {r.doc_id: r for r in weak_labels.classify(docs, labels.where("doc_id % 2 = 0")).collect()}
    judged = [(out[d], k) for d, k in known.items() if d % 2]
    assert np.mean([(o.p_good >= 0.5) == (k.quality == 1) for o, k in judged]) >= 0.95
    clean = [o.kept for o, k in judged if k.quality == 1 and k.toxic == 0]
    assert np.mean(clean) >= 0.95
    bad = [o.kept for o, k in judged if k.quality == 0]
    assert np.mean(bad) <= 0.1
    unlabelled = {r.doc_id: r for r in weak_labels.classify(docs).collect()}   # the heuristic labellers alone
    assert np.mean([(unlabelled[d].p_good >= 0.5) == (k.quality == 1) for d, k in known.items()]) >= 0.9


def test_classifier_on_edge_rows(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(3, 1, 0), (3, 1, 0), (None, 0, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    rows = weak_labels.classify(edge_docs, labels).collect()
    assert len(rows) == edge_docs.count()
    assert all(not r.kept and r.p_good == 0 for r in rows if r.doc_id in (1, 2, 9))
    assert weak_labels.keep_good(edge_docs, labels).columns == edge_docs.columns
    assert weak_labels.classify(no_docs, labels).count() == 0 and weak_labels.keep_good(no_docs).count() == 0


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline

    from tillroll.llm.common import land

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, f in corpus_pipeline.STAGES:
        out.append(land(f(spark, out[-1], SF), f"test-{name}"))
    return out


def test_each_stage_does_its_work_on_its_own_input(spark, stages):
    docs, good, single, cut, mixed, encoded = stages
    assert all(d.columns == docs.columns for d in (good, single, cut, mixed))
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    clean = [d for d, r in labels.items() if r.quality == 1 and r.toxic == 0]
    assert np.mean([d in kept for d in clean]) >= 0.95 and np.mean([d in kept for d, r in labels.items() if r.quality == 0]) <= 0.1
    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert sorted(r.doc_id for r in single.collect()) == sorted({c for d, _, c in brute_components(rows) if d == c})
    rows = [(r.doc_id, r.text) for r in single.collect()]
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert set(texts) == {d for d, _ in rows}
    marks = repeated_words(rows)
    for d, t in rows:
        if not marks[d].any():
            continue
        left = [w for w, m in zip(split(t), marks[d], strict=True) if not m]
        assert len(split(texts[d])) <= len(left)
    after = repeated_words(list(texts.items()))
    assert not any(m.any() for m in after.values())
    times = collections.Counter(r.doc_id for r in mixed.collect())
    assert max(times.values()) <= 2
    assert encoded.count() == mixed.count()
    want = collections.Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in mixed.collect())
    assert collections.Counter((r.doc_id, r.decoded_sha256) for r in encoded.collect()) == want


def test_run_gives_the_last_stage(spark, stages):
    import corpus_pipeline

    got = sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == sorted((r.doc_id, r.ids_sha256) for r in stages[-1].collect())


def test_covered_helper_rejects_forward_links():
    Row = collections.namedtuple("Row", "doc_id start_word end_word other_id other_start other_end")
    with pytest.raises(AssertionError):
        covered([(1, "a " * 60)], [Row(1, 0, 50, 2, 0, 50)])
