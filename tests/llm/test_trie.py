"""Operator 13 against sets of prefixes."""

import hashlib
import random
import zlib

import pytest

from tillroll.llm import turn_trie

SF = "/root/testdata/sf0.001"


def expected(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {}
    for c, turns in convs.items():
        key = lambda r: hashlib.md5(f"{len(r[2].encode())}:{r[2]}{r[3]}".encode()).digest()
        own[c] = [(r[2], r[3]) for r in sorted(turns, key=lambda r: (r[0], r[1], r[2].encode(), key(r)))]
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        whole[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = {}
    for c, path in whole.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    out = []
    for node, ids in members.items():
        below = [x for x in members if x[:len(node)] == node]
        kids = sum(len(x) == len(node) + 1 for x in below)
        parents = {x[:-1] for x in below if x}
        leaves = sum(x not in parents for x in below)
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        out.append((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), kids, leaves, saved, sha([c for c in ids if whole[c] == node])))
    return out


def made_up(seed=1, n=70):
    """Shared first turns, copies, turnless and long conversations, nulls, ties and repeated rows, gaps in the ids."""
    r = random.Random(seed)
    rows = []
    for c in [*range(n), -3, -5, -9, 1000, 1003]:
        if r.random() < 0.15:
            continue
        kind = r.random()
        length = r.choice([0, 1, 2, 4, 12]) if kind < 0.8 else 40
        for t in range(length):
            text = f"same {t}" if kind < 0.4 or (kind > 0.8 and t < 33) else r.choice(["é", "b", "", None, "long " * 30])
            rows.append((c, r.choice([t, t, t, None]) if kind < 0.1 else t, r.choice(["user", None]) if kind < 0.2 else "user", text))
    return rows + rows[3:6] + [(None, 0, "user", "nobody's")]


def check(df, rows):
    key = lambda r: tuple((x is not None, x or 0) if not isinstance(x, str) else x for x in r)
    got = [tuple(r) for r in turn_trie.prefix_trie(df).select(*turn_trie.RESULT).collect()]
    assert sorted(got, key=key) == sorted(expected(rows), key=key)


@pytest.mark.parametrize("block,shard", [(256, 2048), (4, 3), (7, 16)])
def test_trie_equals_sets_of_prefixes(spark, monkeypatch, block, shard):
    monkeypatch.setattr(turn_trie, "BLOCK", block)
    monkeypatch.setattr(turn_trie, "SHARD", shard)
    rows = made_up(seed=block)
    df = spark.createDataFrame([(*r, 1, b"x") for r in rows], "conv_id long, turn long, role string, text string, at int, key binary")
    check(df, rows)


def test_trie_of_the_table(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    check(df, [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_trie_of_copies(spark, monkeypatch):
    """A group of equal conversations over many shards: one list of ends in order."""
    monkeypatch.setattr(turn_trie, "SHARD", 8)
    rows = [(c, t, "user", f"t{t}") for c in range(0, 1000, 5) for t in range(3)]
    check(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5), rows)


def test_empty_trie(spark):
    assert turn_trie.prefix_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
