"""Operator 11 - conversation structure repair by a dynamic program over runs.

``damaged`` breaks conversations by a fixed rule; ``repair`` finds, for each conversation, the cheapest edits after
which its role initials read ``(s?(ua)+)?``: Keep 0 (3 more for a truncated row), Rerole to user or assistant 3 (3 more
likewise), Delete 4 (the only way for blank and duplicate rows), Insert an empty row 3. Of equally cheap audits (the
initials of the edits in order) the ASCII-least is taken.

Equal consecutive symbols (role initial and fault) are collapsed into runs. The cost to go before a run is the
cost after it under the run's power of the symbol's min-plus transition, put together from cached binary powers. The
choices are then unrolled from the front; a run is halved by the same powers until single rows are left.

Scale: duplicates are found by a window over (conversation, role, text), so a huge conversation is spread. Rows are
range-partitioned by (conversation, turn) and sorted, and streamed; a conversation that lies within a partition
and below ``CHUNK`` bytes of text is finished there. The others, whatever their size, go on as chunks: their symbols
(one byte a row) decide the edits, and a stream over their chunks hashes the repaired text.

Nulls in conv_id, turn, role and text count as one space where the rule or a text needs them; rows of a null conv_id are
one conversation, null turns come first. Rows of the same turn are ordered by role, then text. Roles of other
initials than s, u and a (the empty role too) can't be kept. A conversation whose rows are all dropped has zeros, an empty
audit and the hash of nothing. Extra columns go no further; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tillroll.llm.common import fresh, land

#: Bytes of text, and rows, of one conversation that a task holds.
CHUNK = 4 << 20
CHUNK_ROWS = 50_000

#: Costs of the edits, and the roles that Rerole and Insert give.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROLE = {"u": "user", "a": "assistant"}
SPACES = " \t\n\x0b\x0c\r"

# States: nothing kept yet, after s, after u, after a. STEP: what an initial makes of them.
START, SYS, USER, ASSISTANT = range(4)
STEP = {START: {"s": SYS, "u": USER}, SYS: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
GIVEN = {s: next(i for i in "ua" if i in STEP[s]) for s in range(4)}   # the initial that Insert or Rerole must give
NEVER = 1 << 50

#: A row's symbol: its initial's place here (4: another), 5 more if truncated; ``FORCED`` if it must go.
INITIALS = "sua"
FORCED = 10
Vector = tuple[int, int, int, int]


def symbol(initial: str, fault: str) -> int:
    if fault in ("blank", "duplicate"):
        return FORCED
    return (INITIALS.find(initial) if initial and initial in INITIALS else 4) + (5 if fault == "truncated" else 0)


@lru_cache(maxsize=None)
def choices(x: int, state: int) -> tuple[tuple[str, int, int], ...]:
    """(edit, next state, cost) of the edits that use up a row, in order of their initials."""
    out = [("D", state, DELETE)]
    if x != FORCED:
        more = TRUNCATED if x >= 5 else 0
        kept = STEP[state].get(INITIALS[x % 5]) if x % 5 < 3 else None
        if kept is not None:
            out.append(("K", kept, more))
        out.append(("R", STEP[state][GIVEN[state]], REROLE + more))
    return tuple(out)


def _inserted(best: list[int]) -> Vector:
    """The least cost from each state if rows may be inserted first."""
    for _ in range(3):
        best = [min(best[s], INSERT + best[STEP[s][GIVEN[s]]]) for s in range(4)]
    return tuple(best)


#: Cost to go after the last row.
END: Vector = _inserted([0, NEVER, NEVER, 0])


def _times(a: list[Vector], b: list[Vector]) -> list[Vector]:
    return [tuple(min(a[s][m] + b[m][t] for m in range(4)) for t in range(4)) for s in range(4)]


@lru_cache(maxsize=None)
def power(x: int, doublings: int) -> list[Vector]:
    """The min-plus transition of 2**doublings rows of a symbol."""
    if doublings:
        half = power(x, doublings - 1)
        return _times(half, half)
    columns = [_inserted([min((c for _, n, c in choices(x, s) if n == t), default=NEVER) for s in range(4)]) for t in range(4)]
    return [tuple(min(columns[t][s], NEVER) for t in range(4)) for s in range(4)]


@lru_cache(maxsize=1 << 14)
def before(x: int, n: int, after: Vector) -> Vector:
    """Cost to go before n rows of a symbol."""
    for j in range(n.bit_length()):
        if n >> j & 1:
            m = power(x, j)
            after = tuple(min(m[s][t] + after[t] for t in range(4)) for s in range(4))
    return after


@lru_cache(maxsize=1 << 14)
def _row(x: int, state: int, after: Vector) -> tuple[str, int]:
    """The edits of one row (inserts before it included) and the state after it."""
    edits, togo = "", before(x, 1, after)
    while True:
        options = [(e, n, c + after[n]) for e, n, c in choices(x, state)]
        insert = STEP[state][GIVEN[state]]
        options.insert(1, ("I", insert, INSERT + togo[insert]))
        edit, state_after, _ = next(o for o in options if o[2] == togo[state])
        edits += edit
        state = state_after
        if edit != "I":
            return edits, state


def unroll(x: int, n: int, state: int, after: Vector) -> tuple[list[str], int]:
    """The edits of a run, as pieces of the audit, and the state after it."""
    least = min(after)
    after = tuple(min(v - least, NEVER) for v in after)   # only differences matter
    if n == 1:
        edits, state = _row(x, state, after)
        return [edits], state
    first, state = unroll(x, n // 2, state, before(x, n - n // 2, after))
    rest, state = unroll(x, n - n // 2, state, after)
    return first + rest, state


def runs(symbols: bytes) -> list[tuple[int, int]]:
    return [(x, sum(1 for _ in same)) for x, same in groupby(symbols)]


def plan(blocks: list[bytes]) -> tuple[int, list[str]]:
    """(cost, the part of the audit for each block) of a conversation whose symbols come in blocks."""
    todo = [(i, x, n) for i, b in enumerate(blocks) for x, n in runs(b)]
    after, costs = [END], 0
    for _, x, n in reversed(todo):
        v = before(x, n, after[-1])
        least = min(v)
        costs += least
        after.append(tuple(min(c - least, NEVER) for c in v))
    cost = costs + after[-1][START]
    after.pop()   # what is left: the vectors after each run, the last run's first
    out: list[list[str]] = [[] for _ in blocks] or [[]]
    state = START
    for i, x, n in todo:
        edits, state = unroll(x, n, state, after.pop())
        out[i] += edits
    out[-1].append("I" * (END[state] // INSERT))
    return cost, ["".join(x) for x in out]


def repaired(edits: str, roles: list[str], texts: list[str], state: int = START) -> tuple[list[str], int]:
    """The ``role:text`` lines that the edits leave of the rows, and the state after them."""
    out, at = [], 0
    for e in edits:
        if e == "D":
            at += 1
            continue
        if e == "K":
            out.append(f"{roles[at]}:{texts[at]}")
            state = STEP[state][roles[at][0]]
        else:
            given = GIVEN[state]
            out.append(f"{ROLE[given]}:{texts[at] if e == 'R' else ''}")
            state = STEP[state][given]
        at += e != "I"
    return out, state


class Chunk:
    """Consecutive rows of one conversation."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.roles, self.texts, self.symbols = [], [], bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = self.size = 0
        self.low = self.high = None

    def add(self, turn, role: str, text: str, repeated: bool) -> None:
        shown = text.rstrip(SPACES)
        fault = "blank" if not shown else "duplicate" if repeated else "truncated" if shown[-1] not in ".!?" else ""
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        if self.roles and self.roles[-1][:1] + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        self.symbols.append(symbol(role[:1], fault))
        self.roles.append(role)
        self.texts.append(text)
        self.size += len(role) + len(text)

    def finished(self) -> dict:
        cost, (audit,) = plan([bytes(self.symbols)])
        lines, _ = repaired(audit, self.roles, self.texts)
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return {"conv_id": self.conv_id, "gaps": gaps, "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
                **{k: getattr(self, k) for k in ("blank", "duplicate", "truncated", "illegal")}}

    def carried(self, part: int, no: int) -> dict:
        return {"part": part, "no": no, "symbols": bytes(self.symbols), "first_initial": self.roles[0][:1] if self.roles else None,
                "last_initial": self.roles[-1][:1] if self.roles else None,
                **{k: getattr(self, k) for k in ("conv_id", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "roles", "texts")}}


COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy, dropped): the rows after damage by crc32(`conv_id:turn`) % 20 (0 drops the row,
    1 empties its text, 2 takes out its sentence ends, 3 repeats it, 4 makes it the user's). Dropped rows stay as marks
    of their conversation, without role and text."""
    def spaced(c: str):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    d = fresh(conversations, conv_id="conv_id", turn="turn", role="role", text="text").withColumn("kind", kind)
    gone = F.col("kind") == 0
    return d.select(
        "conv_id", F.when(~gone, F.col("turn")).alias("turn"),
        F.when(gone, F.lit(None)).when(F.col("kind") == 4, F.lit("user")).otherwise(spaced("role")).alias("role"),
        F.when(gone, F.lit(None)).when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"), gone.alias("dropped"))


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation of ``damaged`` rows."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    same = Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first(), "copy")
    flagged = rows.withColumn("repeated", F.row_number().over(same) > 1)
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first()]
    ordered = flagged.repartitionByRange(*keys).sortWithinPartitions(*keys, "role", "text", "copy")
    done, open_ = f"conv_id {kind}, {COUNTS}, audit string, repaired_sha256 string", "part int, no int, symbols binary, first_initial string, last_initial string, turns long, low long, high long, roles array<string>, texts array<string>"
    schema = f"{done}, {open_}"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    names, most, most_rows = arrow.names, CHUNK, CHUNK_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no, first, chunk, cut = TaskContext.get().partitionId(), 0, True, None, False
        out: list[dict] = []

        def close(whole: bool) -> None:
            nonlocal no
            if whole:
                out.append(chunk.finished())
            else:
                out.append(chunk.carried(part, no))
                no += 1

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "dropped", "repeated")]
            for conv_id, turn, role, text, dropped, repeated in zip(*columns, strict=True):
                if chunk is None or conv_id != chunk.conv_id:
                    if chunk is not None:
                        close(whole=not first and not cut)
                        first = False
                    chunk, cut = Chunk(conv_id), False
                if not dropped:
                    if chunk.size >= most or len(chunk.roles) >= most_rows:
                        close(whole=False)
                        chunk, cut = Chunk(conv_id), True
                    chunk.add(turn, role, text, repeated)
            if out:
                yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in out], arrow)
                out.clear()
        if chunk is not None:
            close(whole=False)   # the conversation may go on in the next partition
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in out], arrow)

    made = land(ordered.mapInArrow(run, schema), "repair")
    whole = made.where("part IS NULL").select(*[x.split()[0] for x in done.split(", ")])
    return whole.unionByName(_across(made.where("part IS NOT NULL"), kind))


def _across(chunks: DataFrame, kind: str) -> DataFrame:
    """The conversations that lie in several chunks."""
    decided_schema = f"conv_id {kind}, part int, no int, edits string, state int, head boolean, {COUNTS}, audit string"
    decided = to_arrow_schema(StructType.fromDDL(decided_schema))

    def decide(table: pa.Table) -> pa.Table:
        """Symbols and counts of one conversation's chunks, no texts."""
        parts = sorted(table.to_pylist(), key=lambda r: (r["part"], r["no"]))
        cost, edits = plan([r["symbols"] for r in parts])
        total = {k: sum(r[k] for r in parts) for k in ("blank", "duplicate", "truncated", "illegal", "turns")}
        filled = [r for r in parts if r["first_initial"] is not None]
        for a, b in zip(filled, filled[1:]):
            total["illegal"] += a["last_initial"] + b["first_initial"] not in ("su", "ua", "au")
        dated = [r for r in filled if r["turns"]]
        total["turns"] -= sum(a["high"] == b["low"] for a, b in zip(dated, dated[1:]))
        gaps = dated[-1]["high"] - dated[0]["low"] + 1 - total.pop("turns") if dated else 0
        out, state = [], START
        for i, (r, e) in enumerate(zip(parts, edits, strict=True)):
            mark = {"conv_id": r["conv_id"], "part": r["part"], "no": r["no"], "edits": e, "state": state, "head": i == 0}
            out.append(mark | ({"gaps": gaps, "cost": cost, "audit": "".join(edits), **total} if i == 0 else {}))
            state = _state_after(e, r["symbols"], state)
        return pa.Table.from_pylist([{f.name: r.get(f.name) for f in decided} for r in out], decided)

    facts = chunks.select("conv_id", "part", "no", "symbols", "first_initial", "last_initial", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high")
    edits = land(facts.groupBy("conv_id").applyInArrow(decide, decided_schema), "repair-edits")
    texts = chunks.select("conv_id", "part", "no", "roles", "texts").join(edits.select("part", "no", "edits", "state"), ["part", "no"])
    hashed = texts.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "part", "no").mapInArrow(_hashes, f"h_conv {kind}, repaired_sha256 string")
    stats = edits.where("head").drop("part", "no", "edits", "state", "head")
    return stats.join(hashed, stats["conv_id"].eqNullSafe(hashed["h_conv"])).drop("h_conv")


def _state_after(edits: str, symbols: bytes, state: int) -> int:
    at = 0
    for e in edits:
        if e != "D":
            state = STEP[state][INITIALS[symbols[at] % 5] if e == "K" else GIVEN[state]]
        at += e != "I"
    return state


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash a conversation, over its chunks in order; a chunk is held at a time."""
    current, digest, begun = None, None, False

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([current], kind), pa.array([digest.hexdigest()])], ["h_conv", "repaired_sha256"])

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            if digest is None or r["conv_id"] != current:
                if digest is not None:
                    yield made()
                current, digest, begun = r["conv_id"], hashlib.sha256(), False
            for line in repaired(r["edits"], r["roles"], r["texts"], r["state"])[0]:
                digest.update((f"\n{line}" if begun else line).encode())
                begun = True
    if digest is not None:
        yield made()


def repaired_conversations(conversations: DataFrame) -> DataFrame:
    """The repair of the damaged table."""
    return repair(damaged(conversations))
