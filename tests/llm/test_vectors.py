"""Operators 5 and 8 against brute force."""

import numpy as np

from tests.llm.conftest import SF
from tillroll.llm import itq_dups, nn_descent

SCHEMA = "vec_id long, embedding array<float>, label int, part int, n_links long, rows long, component_id string, t int"


def frame(spark, pairs):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 1, 2, 3, "c", 4) for i, v in pairs], SCHEMA)


def edge_vectors(n=300, dim=16):
    """Random vectors, groups of near and exact copies, and every kind that takes no part."""
    r = np.random.default_rng(4)
    x = list(r.normal(size=(n, dim)))
    x += [x[0] + r.normal(size=dim) * 0.02 for _ in range(60)] + [x[1]] * 5 + [x[2] * 7]
    rows = list(enumerate(x))
    odd = [None, [0.0] * dim, [None] + [1.0] * (dim - 1), [float("nan")] * dim, [float("inf")] * dim, [1.0, 2.0], []]
    rows += [(1000 + i, v) for i, v in enumerate(odd)] + [(None, x[3])]
    return rows, {i: np.asarray(v, np.float32).astype(float) for i, v in rows if i is not None and i < 1000}


def test_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(itq_dups, "BLOCK", 20)   # the group of copies is cut into blocks
    rows, good = edge_vectors()
    out = {r.vec_id: r for r in itq_dups.near_duplicates(frame(spark, rows)).collect()}
    assert len(out) == len(rows)
    ids = sorted(good)
    u = np.stack([good[i] / np.linalg.norm(good[i]) for i in ids])
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    label = np.arange(len(ids))
    for _ in range(50):
        label = np.minimum(label, np.where(link, label[None, :], len(ids)).min(axis=1))
    missed = 0
    for a, i in enumerate(ids):
        assert out[i].n_links <= link[a].sum()
        missed += link[a].sum() - out[i].n_links
        assert out[i].component_id == ids[label[a]] and out[i].kept == (out[i].component_id == i)
    assert missed <= 0.01 * link.sum()
    for i in range(1000, 1007):
        assert out[i].n_links == 0 and out[i].component_id == i and out[i].kept
    assert itq_dups.near_duplicates(frame(spark, [])).count() == 0
    assert itq_dups.near_duplicates(frame(spark, [(1, [0.0])])).first().kept


def test_links_of_a_large_table_are_found(spark, monkeypatch):
    monkeypatch.setattr(itq_dups, "BUCKET", 0.01)   # chunks as wide as for millions of rows
    r = np.random.default_rng(6)
    x = r.normal(size=(400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = r.normal(size=x.shape)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    y = 0.952 * x + np.sqrt(1 - 0.952**2) * side / np.linalg.norm(side, axis=1, keepdims=True)
    rows = list(enumerate(x)) + [(1000 + i, v) for i, v in enumerate(y)]
    out = {v.vec_id: v for v in itq_dups.near_duplicates(frame(spark, rows)).collect()}
    assert sum(out[i].n_links == 1 and out[1000 + i].component_id == i for i in range(400)) >= 396


def test_rotation_balances_and_keeps_angles():
    r = np.random.default_rng(1)
    x = r.normal(size=(2000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    mean, p = itq_dups.fit(x, 32)
    code = (x - mean) @ p >= 0
    assert abs(code.mean(axis=0) - 0.5).max() < 0.1
    assert np.allclose(p.T @ p, np.eye(32), atol=1e-8)


def brute(good, every, count):
    ids = np.array(sorted(good))
    x = np.stack([good[i] for i in ids])
    out = {}
    for i in ids[ids % every == 0]:
        s = x @ good[i]
        order = np.lexsort((ids, -s))
        out[i] = [int(ids[j]) for j in order if ids[j] != i][:count]
    return out


def test_search_recall_and_exact_scores(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    good = {r.vec_id: np.asarray(r.embedding, float) for r in df.collect()}
    want = brute(good, 20, 20)
    got = {}
    for r in nn_descent.nearest_rows(df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        assert abs(r.score - good[r.query_id] @ good[r.vec_id]) < 1e-12
    assert set(got) == set(want) and all(sorted(x[0] for x in v) == list(range(1, 21)) for v in got.values())
    assert np.mean([len({v for _, v, _ in got[q]} & set(want[q])) / 20 for q in want]) >= 0.9


def test_search_on_odd_vectors(spark):
    rows, good = edge_vectors(120)
    rows.append((40, rows[40][1]))   # an id repeated counts once
    want = brute(good, 20, 20)
    got = {}
    for r in nn_descent.nearest_rows(frame(spark, rows)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
        assert r.vec_id in good and r.vec_id != r.query_id
    assert set(got) == set(want) and np.mean([len(got[q] & set(want[q])) / 20 for q in want]) >= 0.9
    assert nn_descent.nearest_rows(frame(spark, [])).count() == 0
    assert nn_descent.nearest_rows(frame(spark, [(20, [1.0, 0.0])])).count() == 0
    few = nn_descent.nearest_rows(frame(spark, [(20, [1.0, 0.0]), (1, [0.5, 1.0]), (2, [0.5, 3.0])])).collect()
    assert [(r["rank"], r.vec_id) for r in sorted(few, key=lambda r: r["rank"])] == [(1, 1), (2, 2)]   # all candidates; ties by id


def test_search_among_copies_and_split_leaves(spark, monkeypatch):
    """A third of all rows are one vector, parts and blocks are small: ties go to the smallest ids, recall holds."""
    monkeypatch.setattr(nn_descent, "PART", 40)
    monkeypatch.setattr(nn_descent, "BLOCK", 50)
    r = np.random.default_rng(9)
    rows = [(i, v.astype(np.float32).astype(float)) for i, v in enumerate(r.normal(size=(600, 12)))]
    same = rows[7][1]
    rows += [(1000 + i, same) for i in range(300)] + [(2000 + i, same + r.normal(size=12) * 0.01) for i in range(150)]
    good = {i: np.asarray(v, np.float32).astype(float) for i, v in rows}
    want = brute(good, 20, 20)
    got = {}
    for row in nn_descent.nearest_rows(frame(spark, rows)).collect():
        got.setdefault(row.query_id, {})[row["rank"]] = (row.vec_id, row.score)
    assert set(got) == set(want) and all(sorted(v) == list(range(1, 21)) for v in got.values())
    assert np.mean([len({v for v, _ in got[q].values()} & set(want[q])) / 20 for q in want]) >= 0.95
    for found in got.values():
        order = [(-found[k][1], found[k][0]) for k in range(1, 21)]
        assert order == sorted(order)


def test_parts_are_bounded():
    home = nn_descent.parts_of({0: 10, 1: 5000, 2: 100, 3: 1900, 9: 2048})
    assert home[1][1] == 3 and home[2][0] == home[3][0] and home[9] == (home[3][0] + 1, 1)
    used = [p for first, n in home.values() for p in range(first, first + n)]
    assert sorted(set(used)) == list(range(max(used) + 1))


def test_copies_are_one_class_with_all_their_links(spark):
    """Half of the rows are one vector; ids are repeated, with the same vector and with another one."""
    r = np.random.default_rng(12)
    x = [v.astype(np.float32).astype(float) for v in r.normal(size=(60, 16))]
    rows = list(enumerate(x)) + [(100 + i, x[5]) for i in range(60)] + [(200, x[5] + 0.001)]
    rows += [(7, x[7]), (8, x[9])]   # a row repeated outright; an id with two vectors
    out = {}
    for v in itq_dups.near_duplicates(frame(spark, rows)).collect():
        out.setdefault(v.vec_id, []).append((v.n_links, v.component_id, v.kept))
    assert all(out[100 + i] == [(61, 5, False)] for i in range(60)) and out[5] == [(61, 5, True)] and out[200] == [(61, 5, False)]
    assert out[7] == [(2, 7, True)] * 2   # each of the two rows links with the other; both show the sum
    assert out[8] == [(1, 8, True)] * 2 and out[9] == [(1, 8, False)]
    assert all(out[i] == [(0, i, True)] for i in range(60) if i not in (5, 7, 8, 9))


def test_planted_pairs_pass_the_hamming_limit():
    x = np.random.default_rng(2).normal(size=(3000, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    mean, projections, cuts, _, missed = itq_dups.tables_for(x, 0.95, 48, 12)
    most = itq_dups.limits(x, 0.95, mean, projections)
    assert missed <= itq_dups.MISS and len(most) == len(projections) == cuts[-1][0] + 1
    assert most == sorted(most) and most[-1] < 48 * len(projections) / 2   # below what unrelated vectors have
