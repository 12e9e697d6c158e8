"""Operator 13 - prefix trie of conversations by vertical bitmaps.

``rebuilt`` branches the table: conversation c begins with the first turns of conversation c - c % 5 and goes on with
its own. ``trie`` returns a row for every distinct prefix.

A conversation's turns are 16-byte keys (md5 of role and text), cut into pieces of ``BLOCK`` turns; a piece knows
its entry, the name of the node it starts from. Pieces are range-partitioned and sorted by (entry, keys), so that a
subtree is a contiguous range, and every ``SHARD`` pieces of a partition are indexed by vertical bitmaps: for each
(position, turn) the set of pieces, numbered by conversation id, that have it. A depth-first search intersects the
parent's bitset with the postings: the results are the children, their popcounts the members, their lowest bits
the smallest members, and the bits of the conversations that stop there the list of ends.

Only nodes that hold a shard's first or last piece, or a piece that goes on, can reach beyond the shard: about two
paths a shard. Their counts are merged by name (a chain of md5); sums over subtrees are added up by pointer
doubling, in as many rounds as the depth has binary digits. All other nodes are complete in their shard.

So neither a first turn that a third of the conversations share, nor a group of copies, nor one huge conversation
is held in one place; lists of ends of many copies are hashed as a stream.

Null role and text count as empty; null turns come first, turns of the same number are ordered by role, then by their
key. Rows without conv_id belong to no conversation and are left out. ``%`` is SQL's. Extra columns go no further;
an empty table gives an empty result (no root).
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tillroll.llm.common import fresh, land

#: Turns of a piece, and pieces of a shard.
BLOCK = 256
SHARD = 2048

#: Conversations in a family, and the remainder that says how many turns are shared.
FAMILY, HEADS = 5, 9

#: The root's name.
ROOT = bytes(16)

NODES = ("node binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
         "saved_tokens long, size long, ends binary, first_end long, ends_sha256 string")
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, key, size): the turns of each conversation by their place (from 1).

    Rows are sorted over all tasks; a place is the row's within its task plus those of the conversation in the
    tasks before, which only conversations at a task's edge have.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    d = fresh(conversations, conv_id="conv_id", turn="turn", role="role", text="text").where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"),
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))).alias("key"), F.octet_length(text).cast("long").alias("size"))
    keys = [F.col("conv_id"), F.col("turn").asc_nulls_first()]
    ordered = d.repartitionByRange(*keys).sortWithinPartitions(*keys, "role", "key").select("conv_id", "key", "size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, current, held = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            conv = batch.column("conv_id").to_numpy()
            if not len(conv):
                continue
            starts = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
            at = np.arange(len(conv)) - np.repeat(starts, np.diff([*starts, len(conv)])) + 1
            if conv[0] == current:
                at[: starts[1] if len(starts) > 1 else len(conv)] += held
            current, held = conv[-1], int(at[-1])
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(np.full(len(conv), part), pa.int32()), pa.array(at, pa.int64()), batch.column("key"), batch.column("size")],
                                             ["conv_id", "part", "at", "key", "size"])

    d = land(ordered.mapInArrow(run, "conv_id long, part int, at long, key binary, size long"), "trie-turns")
    parts = d.groupBy("conv_id", "part").agg(F.max("at").alias("n"))
    several = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "n"))).alias("p")).where(F.size("p") > 1)
    several = several.select("conv_id", F.posexplode("p").alias("i", "x"), "p").select(
        "conv_id", F.col("x.part").alias("part"), F.aggregate(F.slice("p", 1, F.col("i")), F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("earlier"))
    return d.join(several, ["conv_id", "part"], "left").select("conv_id", (F.col("at") + F.coalesce("earlier", F.lit(0))).alias("at"), "key", "size")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, key, size, total) of the rebuilt conversations' turns, ``total`` of them a conversation, and a row with
    ``at`` 0 for every conversation, turnless ones included."""
    turns = numbered(conversations)
    heads = F.crc32(F.col("conv_id").cast("string")) % HEADS
    convs = land(turns.groupBy("conv_id").agg(F.max("at").alias("own")).withColumn("first", heads).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY), "trie-convs")
    bases = convs.where("conv_id = base").select("base", F.least("own", F.lit(HEADS - 1)).alias("lent"))
    itself = F.col("conv_id") == F.col("base")
    taken = F.when(itself, F.least("first", "own")).otherwise(F.least("first", F.coalesce("lent", F.lit(0))))
    convs = convs.join(bases, "base", "left").select(
        "conv_id", F.col("base").alias("c_base"), F.col("first").alias("c_first"), taken.alias("taken"),
        (taken + F.greatest(F.col("own") - F.col("first"), F.lit(0))).alias("total"))
    own = turns.join(convs, "conv_id").where((F.col("conv_id") == F.col("c_base")) | (F.col("at") > F.col("c_first")))
    own = own.select("conv_id", F.when(F.col("conv_id") == F.col("c_base"), F.col("at")).otherwise(F.col("at") - F.col("c_first") + F.col("taken")).alias("at"), "key", "size", "total")
    family = F.sequence(F.lit(1 - FAMILY), F.lit(FAMILY - 1))   # a negative id's remainder leads up
    lent = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("at") < HEADS)).select(
        F.col("conv_id").alias("base"), F.explode(F.transform(family, lambda i: F.try_add("conv_id", i))).alias("conv_id"), "at", "key", "size")
    lent = lent.where((F.col("at") <= heads) & (F.col("conv_id") - F.col("conv_id") % FAMILY == F.col("base")))
    lent = lent.join(convs.where("conv_id <> c_base").select("conv_id", "total"), "conv_id").select("conv_id", "at", "key", "size", "total")
    marks = convs.select("conv_id", F.lit(0).cast("long").alias("at"), F.lit(b"").alias("key"), F.lit(0).cast("long").alias("size"), "total")
    return own.unionByName(lent).unionByName(marks)


def pieces(rows: DataFrame) -> DataFrame:
    """(conv_id, part, entry, keys, sizes, more) of every ``BLOCK`` turns of a conversation."""
    part = F.when(F.col("at") == 0, F.lit(0)).otherwise(F.floor((F.col("at") - 1) / BLOCK)).cast("long")
    p = rows.groupBy("conv_id", part.alias("part")).agg(F.sort_array(F.collect_list(F.struct("at", "key", "size"))).alias("path"), F.max("total").alias("total"))
    p = p.withColumn("path", F.filter("path", lambda x: x["at"] > 0))
    p = land(p.select("conv_id", "part", F.transform("path", lambda x: x["key"]).alias("keys"), F.transform("path", lambda x: x["size"]).alias("sizes"),
                      (F.col("total") > (F.col("part") + 1) * BLOCK).alias("more")), "trie-pieces")
    # The entries of later pieces: names are chained over the conversation's earlier pieces, one digest each.
    chained = p.where("more").select("conv_id", "part", "keys").mapInArrow(_digests, "conv_id long, part long, digest binary")
    chained = chained.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "digest"))).alias("d"))
    entries = chained.mapInArrow(_entries, "conv_id long, part long, entry binary")
    return p.join(entries, ["conv_id", "part"], "left").withColumn("entry", F.coalesce("entry", F.lit(ROOT)))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = [hashlib.md5(b"".join(k)).digest() for k in b.column("keys").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("part"), pa.array(made, pa.binary())], ["conv_id", "part", "digest"])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for conv_id, digests in zip(b.column("conv_id").to_pylist(), b.column("d").to_pylist(), strict=True):
            names, name = [], ROOT
            for d in digests:
                name = hashlib.md5(name + d["digest"]).digest()
                names.append((conv_id, d["part"] + 1, name))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*names), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["conv_id", "part", "entry"])


def _decimal(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


class Shard:
    """The nodes of some pieces, given in order of (entry, keys, conversation)."""

    def __init__(self, rows: list[dict], block: int):
        self.block = block
        self.out: list[tuple] = []
        edge = {id(rows[0]), id(rows[-1])} | {id(r) for r in rows if r["more"]}
        rows = sorted(rows, key=lambda r: r["conv_id"])   # a bitset's lowest bit is then its smallest conversation
        self.convs = [r["conv_id"] for r in rows]
        self.keys = [r["keys"] for r in rows]
        self.sizes = [r["sizes"] for r in rows]
        self.open = sum(1 << i for i, r in enumerate(rows) if id(r) in edge)
        self.postings: dict[tuple[int, bytes], int] = defaultdict(int)
        self.stops: dict[int, int] = defaultdict(int)   # by position: pieces that have no turn there
        self.going = sum(1 << i for i, r in enumerate(rows) if r["more"])
        entries: dict[tuple[bytes, int], int] = defaultdict(int)
        for i, r in enumerate(rows):
            bit = 1 << i
            entries[r["entry"], r["part"]] |= bit
            for at, key in enumerate(r["keys"]):
                self.postings[at, key] |= bit
            self.stops[len(r["keys"])] |= bit
        for (entry, part), bits in entries.items():
            self.entry = entry
            self.depth = part * block
            children, leaves, saved = self._children(bits, 0, entry, None, True)
            ended = bits & self.stops.get(0, 0)
            if part:   # the node itself is counted where its last turn is
                self.out.append((entry, None, None, self.depth, None, 0, children, leaves, saved, None, None, None, None))
            else:
                self.out.append((entry, None, self._first(bits), 0, None, bits.bit_count(), children, leaves, saved, 0, *self._ends(ended)))

    def _first(self, bits: int) -> int:
        return self.convs[(bits & -bits).bit_length() - 1]

    def _ids(self, bits: int) -> list[int]:
        out = []
        while bits:
            low = bits & -bits
            out.append(self.convs[low.bit_length() - 1])
            bits ^= low
        return out

    def _ends(self, bits: int) -> tuple[bytes | None, int | None, None]:
        """An open node's part of its list of ends, packed, and the first of them."""
        return (np.array(self._ids(bits), "<i8").tobytes(), self._first(bits), None) if bits else (None, None, None)

    def _children(self, bits: int, at: int, name: bytes, parent_conv: int | None, open_: bool) -> tuple[int, int, int]:
        """Visits the children of the node that holds ``bits`` after ``at`` turns; (children, leaves, saved) of the complete ones."""
        rest = bits & ~self.stops.get(at, 0)
        children = leaves = saved = 0
        while rest:
            i = (rest & -rest).bit_length() - 1
            key = self.keys[i][at]
            child = bits & self.postings[at, key]
            rest &= ~child
            more_leaves, more_saved = self._visit(child, i, at + 1, key, name, parent_conv, open_)
            if more_leaves:   # else it is open itself and counted where all its parts meet
                children, leaves, saved = children + 1, leaves + more_leaves, saved + more_saved
        return children, leaves, saved

    def _visit(self, bits: int, i: int, at: int, key: bytes, parent: bytes, parent_conv: int | None, parent_open: bool) -> tuple[int, int]:
        """The node reached by turn ``at`` of piece i; (leaves, saved) of its subtree, zeros if it is open."""
        open_ = bool(bits & self.open)
        name = b""
        if open_:
            name = hashlib.md5(self.entry + hashlib.md5(b"".join(self.keys[i])).digest()).digest() if at == self.block else hashlib.md5(parent + key).digest()
        conv, n, size = self.convs[i], bits.bit_count(), self.sizes[i][at - 1]
        ended = bits & self.stops.get(at, 0) & ~self.going
        children, leaves, saved = self._children(bits, at, name, conv, open_)
        if open_:
            self.out.append((name, parent, conv, self.depth + at, None, n, children, leaves, saved, size, *self._ends(ended)))
            return 0, 0
        leaves, saved = leaves or 1, saved + (n - 1) * size
        self.out.append((None, parent if parent_open else None, conv, self.depth + at, None if parent_open else parent_conv, n, children, leaves, saved, None, None, None, _decimal(self._ids(ended))))
        return leaves, saved


def _shards(schema: pa.Schema, block: int, shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def made(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*Shard(rows, block).out), schema, strict=True)], schema=schema)

        for b in batches:
            for at in range(0, b.num_rows, shard):
                held += b.slice(at, shard).to_pylist()
                while len(held) >= shard:
                    yield made(held[:shard])
                    held = held[shard:]
        if held:
            yield made(held)

    return run


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash a node over its lists of ends, which come in order."""
    current, digest = None, None
    names = ["e_node", "ends_sha256"]
    for b in batches:
        for node, ends in zip(b.column("node").to_pylist(), b.column("ends").to_pylist(), strict=True):
            if node != current:
                if digest:
                    yield pa.RecordBatch.from_arrays([pa.array([current], pa.binary()), pa.array([digest.hexdigest()])], names)
                current, digest, comma = node, hashlib.sha256(), ""
            digest.update((comma + ",".join(map(str, np.frombuffer(ends, "<i8").tolist()))).encode())
            comma = ","
    if digest:
        yield pa.RecordBatch.from_arrays([pa.array([current], pa.binary()), pa.array([digest.hexdigest()])], names)


def _subtrees(nodes: DataFrame) -> DataFrame:
    """(node, n_leaves, saved_tokens) summed over the nodes below each: after round k, over those nearer than 2**k."""
    t = land(nodes.select("node", F.col("parent").alias("up"), "n_leaves", "saved_tokens"), "trie-sums")
    while not t.where("up IS NOT NULL").isEmpty():
        above = t.select(F.col("node").alias("up"), F.col("up").alias("next"))
        more = t.where("up IS NOT NULL").groupBy(F.col("up").alias("node")).agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        t = land(t.join(above, "up", "left").join(more, "node", "left").select(
            "node", F.col("next").alias("up"), (F.col("n_leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"),
            (F.col("saved_tokens") + F.coalesce("s", F.lit(0))).alias("saved_tokens")), "trie-sums")
    return t.select("node", "n_leaves", "saved_tokens")


def trie(rows: DataFrame) -> DataFrame:
    """A row for every node of the trie of ``rebuilt`` rows (see ``RESULT``)."""
    p = pieces(rows)
    order = ["entry", "keys", "conv_id"]
    ordered = p.repartitionByRange(*order).sortWithinPartitions(*order)
    found = land(ordered.mapInArrow(_shards(to_arrow_schema(StructType.fromDDL(NODES)), BLOCK, SHARD), NODES), "trie-nodes")
    part = found.where("node IS NOT NULL")
    merged = part.groupBy("node").agg(*[f(c).alias(c) for f, c in (
        (F.max, "parent"), (F.min, "conv_id"), (F.max, "depth"), (F.sum, "n_convs"), (F.sum, "n_children"), (F.sum, "n_leaves"), (F.sum, "saved_tokens"), (F.max, "size"))])
    merged = land(merged, "trie-open")
    kids = merged.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("kids"))
    merged = merged.join(kids, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("kids", F.lit(0))).drop("kids")
    merged = merged.withColumn("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves"))).withColumn(
        "saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("size"))
    merged = land(merged, "trie-open")
    hashed = part.where("ends IS NOT NULL").select("node", "first_end", "ends").repartition("node").sortWithinPartitions("node", "first_end").mapInArrow(_ends, "e_node binary, ends_sha256 string")
    names = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("p_conv"))
    open_ = merged.drop("n_leaves", "saved_tokens").join(_subtrees(merged), "node").join(names, "parent", "left").join(hashed, F.col("node") == F.col("e_node"), "left")
    open_ = open_.withColumn("parent_conv_id", F.col("p_conv")).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
    closed = found.where("node IS NULL").join(names, "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "p_conv"))
    return open_.select(*RESULT).unionByName(closed.select(*RESULT))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    return trie(rebuilt(conversations))
