"""Operator 11 against an exhaustive row-by-row search."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from tillroll.llm import turn_repair

SF = "/root/testdata/sf0.001"


def cheapest(rows):
    """(cost, audit, lines) of (role, text, fault) rows: best-first over (cost, audit), one row at a time."""
    step = {"": "su", "s": "u", "u": "a", "a": "u"}
    name = {"s": "system", "u": "user", "a": "assistant"}
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, last, lines = heapq.heappop(heap)
        if at == len(rows) and last in ("", "a"):
            return cost, audit, lines
        if (at, last) in seen:
            continue
        seen.add((at, last))   # the least (cost, audit) to get here comes first
        for i in step[last].replace("s", ""):
            heapq.heappush(heap, (cost + 3, audit + "I", at, i, lines + (f"{name[i]}:",)))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, last, lines))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if role[:1] and role[0] in step[last]:
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, role[0], lines + (f"{role}:{text}",)))
                for i in step[last].replace("s", ""):
                    heapq.heappush(heap, (cost + 3 + more, audit + "R", at + 1, i, lines + (f"{name[i]}:{text}",)))


def expected(rows):
    """The contract, row by row, for (conv_id, turn, role, text) rows."""
    out = {}
    for c in {r[0] for r in rows}:
        kept = []
        for _, turn, role, text in (r for r in rows if r[0] == c):
            sp = lambda x: " " if x is None else str(x)
            kind, role, text = zlib.crc32(f"{sp(c)}:{sp(turn)}".encode()) % 20, sp(role), sp(text)
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faulty = set(), []
        for _, role, text in kept:
            shown = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            faulty.append((role, text, "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""))
            seen.add((role, text))
        turns = [t for t, _, _ in kept if t is not None]
        cost, audit, lines = cheapest(faulty)
        count = [sum(f == k for *_, f in faulty) for k in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faulty, faulty[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[c] = (gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def result(df):
    rows = df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()
    out = {r[0]: tuple(r[1:]) for r in rows}
    assert len(out) == len(rows)
    return out


def made_up(n, seed=3):
    r = random.Random(seed)
    texts = ["Yes.", "No", "  ", "", None, "Why?", "hm\n", "Well! ", "é…", "a.b", "\xa0"]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "U", "sys"]
    rows = []
    for c in range(n):
        for t in range(r.choice([0, 1, 2, 5, 9, 30])):
            rows += [(c if c else None, r.choice([t, t, t, t * 3, None, -t]), r.choice(roles), r.choice(texts))] * r.choice([1, 1, 1, 2])
    rows += [(n + 1, t, "user" if t % 400 else "assistant", f"t{t}.") for t in range(1500)]   # long runs
    return rows


@pytest.mark.parametrize("bound", [(4 << 20, 50_000), (60, 7)])
def test_repair_equals_search(spark, monkeypatch, bound):
    monkeypatch.setattr(turn_repair, "CHUNK", bound[0])
    monkeypatch.setattr(turn_repair, "CHUNK_ROWS", bound[1])
    rows = made_up(60)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, part int, audit string")
    assert result(turn_repair.repaired_conversations(df)) == expected(rows)


def test_repair_on_the_table(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert result(turn_repair.repaired_conversations(df.repartition(7))) == expected(rows)


def test_nothing_to_repair(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turn_repair.repaired_conversations(empty).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert result(turn_repair.repaired_conversations(df)) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_runs_equal_single_rows():
    r = random.Random(4)
    for _ in range(300):
        symbols = b"".join(bytes([r.choice([0, 1, 2, 4, 5, 6, 7, 9, 10])]) * r.choice([1, 1, 2, 3, 17, 64]) for _ in range(r.randint(0, 6)))
        role = {0: "s", 1: "u", 2: "a", 4: "t"}
        rows = [("x", "", "blank") if x == 10 else (role[x % 5], "t", "truncated" if x >= 5 else "") for x in symbols]
        cost, audit, _ = cheapest(rows)
        cut = r.randint(0, len(symbols))
        for blocks in ([symbols], [symbols[:cut], symbols[cut:]]):
            got, edits = turn_repair.plan(blocks)
            assert (got, "".join(edits)) == (cost, audit)
