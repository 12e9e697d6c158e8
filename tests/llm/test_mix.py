"""Operator 1 against its SQL (ranking each source as a whole) and the contract."""

import math

import duckdb

from tests.llm.conftest import SF
from tillroll.llm import pareto_mix, queries


def waterfill(sizes, share=1.5, cap=2.0):
    """Targets by resharing the excess until none is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] >= cap * sizes[s]}
        if not full:
            return out | {s: level * w[s] for s in open_}
        out |= {s: cap * sizes[s] for s in full}
        left -= sum(cap * sizes[s] for s in full)
        open_ -= full
    return out


def test_equals_sql(spark, small_docs):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    res = con.execute(queries.ORACLE["op1_pareto_mix"])
    names = [d[0] for d in res.description]
    want = sorted(res.fetchall())
    got = sorted(tuple(r) for r in pareto_mix.mix(small_docs).select(*names).collect())
    assert got == want


def test_contract_on_edge_rows(edge_docs, no_docs):
    rows = pareto_mix.mix(edge_docs).collect()
    assert sorted(rows, key=str) == sorted(pareto_mix.mix(edge_docs).collect(), key=str)   # reruns agree
    assert len(rows) == edge_docs.count()
    sizes, targets = {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        targets[r.source] = r.target
        assert 0 <= r.taken <= 2 * r["size"]
    want = waterfill(sizes)
    for s in sizes:
        assert math.isclose(targets[s], want[s])
        largest = max(r["size"] for r in rows if r.source == s)
        assert abs(sum(r.taken for r in rows if r.source == s) - want[s]) <= 2 * largest   # a repeated row shares its fate
    assert pareto_mix.mix(no_docs).count() == 0


def test_order_sampling_rates(spark):
    """The share of each source's documents that get a further copy is the fraction of its rate."""
    rows = [(i, "w " * 10, f"s{i % 3}") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for r in pareto_mix.mix(df).groupBy("source", "target", "source_size").sum("taken").collect():
        assert abs(r["sum(taken)"] - r.target) <= 10


def test_weighted_odds_are_taken_more_often(spark):
    df = spark.createDataFrame([(i, "w " * 10, f"s{i % 3}", 9.0 if i % 2 else 1.0) for i in range(6000)], "doc_id long, text string, source string, odds double")
    got = {(r.source, r.odds): r.n for r in pareto_mix.mix(df, weight="odds").join(df.select("doc_id", "odds"), "doc_id").groupBy("source", "odds").avg("copies").toDF("source", "odds", "n").collect()}
    assert got[("s1", 9.0)] > got[("s1", 1.0)] + 0.2 and got[("s2", 9.0)] > got[("s2", 1.0)] + 0.1


def test_mixed_repeats_rows_with_all_columns(edge_docs, no_docs):
    out = pareto_mix.mixed(edge_docs)
    assert out.columns == edge_docs.columns
    assert out.count() == sum(r.copies for r in pareto_mix.mix(edge_docs).collect())
    assert pareto_mix.mixed(no_docs).count() == 0


def test_mixed_tells_clashing_documents_apart(spark):
    """Null, empty and '|' in sources and texts: exactly the copies of the mix, whatever the draws."""
    texts = ["a b c", "a b|c d", None, "", "w " * 9]
    rows = [(i, t, s) for i in range(30) for s in (None, "", "x|a b", "x") for t in texts] + [(1, "a b c", "x")] * 2 + [(None, "p q", None), (None, "p q", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = {}
    for r in pareto_mix._decided(df, 1.5, 2.0, "mix-1").collect():
        want[(r.doc_id, r.source, r.text_key)] = want.get((r.doc_id, r.source, r.text_key), 0) + r.copies
    import hashlib
    got = {}
    for r in pareto_mix.mixed(df).collect():
        k = (r.doc_id, r.source, None if r.text is None else hashlib.md5(r.text.encode()).hexdigest())
        got[k] = got.get(k, 0) + 1
    assert got == {k: n for k, n in want.items() if n}
