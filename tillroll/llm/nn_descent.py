"""Operator 5 - approximate nearest neighbours: NN-descent and greedy graph search.

Equal vectors are one node. Nodes are dealt in parts of about ``PART`` alike ones by a random-projection tree
(planes fitted on ``SAMPLE`` vectors; all vectors are dealt, leaves above a part are split by hash); a node's
number is its part and its place there. A neighbour graph starts from the leaves of ``TREES`` such trees and
improves by rounds of joins: every node introduces its neighbours, forwards and backwards, to each other where
one of the two is new to it, and those that come nearer than the ``K`` a node has are sent to it. Rounds go on
until fewer than ``SETTLED`` of all list entries change. Queries walk the finished graph greedily: each step
expands what is not expanded of the ``EF`` nearest seen, until no query has such a node.

All exchanges are rows (part, kind, src, a, b, c) of packed arrays: a part asks another once for the vectors or
links it needs, however many of its nodes need them. A round's lists are landed.

Nearness is the inner product; walking uses 32-bit copies, the beam's scores and order at the end are in double
precision on the original vectors; ties go to the smaller vec_id. Vectors null, zero, of another length than
most, or holding null or non-finite components take no part, nor do rows without vec_id; rows with the same
vec_id count once (the one of the smallest vector). Extra columns go no further; an empty table, or one with a
single vector, gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.common import land, partitions
from tillroll.llm.itq_dups import matrix, sound

SAMPLE, TREES, DEPTH, LEAF = 20_000, 6, 10, 200
#: Rows of a leaf compared with each other at once; nodes of a part.
BLOCK, PART = 256, 2048
#: Neighbours kept forwards and taken backwards, share of changed entries that ends the rounds, nodes kept by a search.
K, SETTLED, EF = 30, 0.004, 200

#: Bits of a node's number that are its place in its part.
BITS = 24
ROW = "part long, kind int, src long, a binary, b binary, c binary"
VECTORS, MEMBERS, LISTS, EDGES, LINKS, ASK, ANSWER, UPDATE, BEAM, CANDIDATES = range(10)


def plant(sample: np.ndarray, depth: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Planes and thresholds of one tree, breadth first: directions between two sample points, medians."""
    rng = np.random.default_rng(seed)
    planes, cuts = np.zeros((2**depth - 1, sample.shape[1])), np.zeros(2**depth - 1)
    at = np.zeros(len(sample), np.int64)
    for node in range(2**depth - 1):
        own = sample[at == node]
        if len(own) > 1:
            a, b = own[rng.choice(len(own), 2, replace=False)]
            planes[node] = a - b if (a != b).any() else rng.normal(size=len(a))
        else:
            planes[node] = rng.normal(size=sample.shape[1])
        cuts[node] = np.median(own @ planes[node]) if len(own) else 0.0
        here = at == node
        at[here] = 2 * node + 1 + (own @ planes[node] > cuts[node])
    return planes, cuts


def leaf_of(x: np.ndarray, planes: np.ndarray, cuts: np.ndarray, depth: int) -> np.ndarray:
    at = np.zeros(len(x), np.int64)
    for _ in range(depth):
        at = 2 * at + 1 + ((x * planes[at]).sum(axis=1) > cuts[at])
    return at - (2**depth - 1)


def parts_of(counts: dict[int, int]) -> dict[int, tuple[int, int]]:
    """(first part, parts) of each leaf: large leaves are split, small neighbours share a part."""
    out, part, room = {}, -1, 0
    for leaf in sorted(counts):
        n = counts[leaf]
        if n > PART:
            pieces = math.ceil(n / PART)
            out[leaf] = (part + 1, pieces)
            part, room = part + pieces, 0
        else:
            if n > room:
                part, room = part + 1, PART
            out[leaf] = (part, 1)
            room -= n
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 6
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["part", "kind", "src", "a", "b", "c"])


def _rows(table: pa.Table | pa.RecordBatch) -> list[tuple]:
    """(kind, src, a, b, c, part) of every row, by kind and source, so that results don't hang on arrival."""
    plain = [table.column(c).to_pylist() for c in ("kind", "src")]
    blobs = [[None if not v.is_valid else memoryview(v.as_buffer()) for v in table.column(c)] for c in ("a", "b", "c")]
    return sorted(zip(*plain, *blobs, table.column("part").to_pylist(), strict=True), key=lambda r: r[:2])


def _grouped(rows: DataFrame, group, width: int) -> DataFrame:
    """``group(part, rows)`` gives the rows that each part's rows lead to."""

    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_batch(group(table.column("part")[0].as_py(), _rows(table)))])

    return rows.repartition(width, "part").groupBy("part").applyInArrow(run, ROW)


def _mapped(rows: DataFrame, each) -> DataFrame:
    """``each(part, row)`` gives the rows that one row leads to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _rows(batch):
                yield _batch(each(r[-1], r))

    return rows.mapInArrow(run, ROW)


def _ints(blob) -> np.ndarray:
    return np.frombuffer(blob, np.int64)


def _cat(arrays: list[np.ndarray], dtype) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.zeros(0, dtype)


def _by_part(numbers: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each part with the places of its nodes."""
    part = numbers >> BITS
    order = np.argsort(part, kind="stable")
    cut = np.flatnonzero(np.diff(part[order])) + 1
    for places in np.split(order, cut):
        if len(places):
            yield int(part[places[0]]), places


def _best(to: np.ndarray, near: np.ndarray, score: np.ndarray, keep: int) -> np.ndarray:
    """Places of the ``keep`` best of each ``to``, ties to the smaller number; each pair once, the first given."""
    order = np.lexsort((np.arange(len(to)), near, to))
    new = np.ones(len(to), bool)
    new[1:] = (to[order][1:] != to[order][:-1]) | (near[order][1:] != near[order][:-1])
    order = order[new]
    order = order[np.lexsort((near[order], -score[order], to[order]))]
    sorted_to = to[order]
    starts = np.searchsorted(sorted_to, sorted_to)
    return order[np.arange(len(order)) - starts < keep]


def _pairs_rows(kind: int, src: int, to: np.ndarray, near: np.ndarray, score: np.ndarray, flag: np.ndarray | None = None) -> list[tuple]:
    return [(q, kind, src, np.stack([to[p], near[p]]).tobytes(), score[p].astype(np.float32).tobytes(), None if flag is None else flag[p].tobytes()) for q, p in _by_part(to)]


def _pairs(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    both = [_ints(r[2]).reshape(2, -1) for r in rows]
    return _cat([b[0] for b in both], np.int64), _cat([b[1] for b in both], np.int64), _cat([np.frombuffer(r[3], np.float32) for r in rows], np.float32)


def _ask(src: int, numbers: np.ndarray) -> list[tuple]:
    return [(q, ASK, src, numbers[p].tobytes(), None, None) for q, p in _by_part(numbers)]


def _one(rows: list[tuple], kind: int):
    return next((r for r in rows if r[0] == kind), None)


def _all(rows: list[tuple], kind: int) -> list[tuple]:
    return [r for r in rows if r[0] == kind]


def _lists(row, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _ints(row[2]).reshape(-1, k), np.frombuffer(row[3], np.float32).reshape(-1, k), np.frombuffer(row[4], bool).reshape(-1, k)


class Graph:
    """The neighbour graph of a table: ``nodes`` (VECTORS and MEMBERS rows) and ``lists`` (LISTS rows) by part.

    keep: how many of the vec_ids of equal vectors can be results (the smallest)."""

    def __init__(self, vectors: DataFrame, k: int = K, keep: int = 21):
        self.k, self.ready = k, False
        good = sound(vectors)
        shape = good.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
        self.empty = shape is None
        if self.empty:
            return
        self.dim = dim = shape["dim"]
        good = good.where(F.size("v") == dim).groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min("v").alias("v"))
        self.good = land(good, "vectors")
        place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
        classes = self.good.withColumn("place", place).where(F.col("place") <= keep).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))
        self.classes = land(classes.withColumn("vec_id", F.col("members")[0]), "classes")
        rows = self.classes.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()
        sample = matrix(rows.column("v").combine_chunks())
        self.n = n = self.classes.count()
        depth = max(0, min(DEPTH, math.ceil(math.log2(max(1, n / LEAF)))))
        trees = [plant(sample, depth, 50 + t) for t in range(TREES)]

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = matrix(batch.column("v"))
                    leaves = np.stack([leaf_of(x, *t, depth) for t in trees], axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("vec_id"), batch.column("members"), pa.array(leaves[:, 0]), pa.array([r.tobytes() for r in leaves], pa.binary()), pa.array([r.tobytes() for r in x], pa.binary())],
                        ["vec_id", "members", "leaf", "leaves", "x"])

        dealt = land(self.classes.mapInArrow(deal, "vec_id long, members array<long>, leaf long, leaves binary, x binary"), "dealt", "none")
        counts = {r["leaf"]: r["count"] for r in dealt.groupBy("leaf").count().collect()}   # 2^DEPTH at most
        home = parts_of(counts)
        self.parts = max(p + m for p, m in home.values())
        spark = vectors.sparkSession
        self.width = max(1, min(self.parts, max(partitions(spark), self.parts // 16)))
        table = spark.createDataFrame([(leaf, p, m) for leaf, (p, m) in home.items()], "leaf long, first long, pieces long")
        dealt = dealt.join(F.broadcast(table), "leaf").withColumn("part", F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("pieces")))

        def pack(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by("vec_id")
            part = rows.column("part")[0].as_py()
            members = rows.column("members").combine_chunks()
            sizes = np.diff(members.offsets.to_numpy())
            return pa.Table.from_batches([_batch([
                (part, VECTORS, part, rows.column("vec_id").to_numpy().tobytes(), b"".join(rows.column("x").to_pylist()), b"".join(rows.column("leaves").to_pylist())),
                (part, MEMBERS, part, members.flatten().to_numpy().tobytes(), sizes.astype(np.int64).tobytes(), None)])])

        packed = dealt.select("part", "vec_id", "members", "leaves", "x").repartition(self.width, "part").groupBy("part").applyInArrow(pack, ROW)
        self.nodes = land(packed, "nodes", "none")
        self.vectors = self.nodes.where(F.col("kind") == VECTORS)
        self._start(depth)
        while True:
            changed = self.lists.agg(F.sum("src")).first()[0]
            if changed <= SETTLED * n * k:
                break
            self._round()

    def _start(self, depth: int) -> None:
        """Nearest of each vector within its leaves."""
        k, dim = self.k, self.dim
        count = np.zeros((TREES, 2**depth), np.int64)

        def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(count)
            for batch in batches:
                for r in _rows(batch):
                    for t, leaves in enumerate(_ints(r[4]).reshape(-1, TREES).T):
                        total[t] += np.bincount(leaves, minlength=2**depth)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["at", "n"])

        for r in self.vectors.mapInArrow(tally, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():   # TREES * 2^DEPTH at most
            count.ravel()[r["at"]] = r["n"]
        blocks = -(-count // BLOCK)

        def spread(part: int, r: tuple) -> list[tuple]:
            x, leaves = np.frombuffer(r[3], np.float64).reshape(-1, dim), _ints(r[4]).reshape(-1, TREES)
            numbers = (part << BITS) + np.arange(len(x))
            out = []
            for t in range(TREES):
                block = (numbers * 2654435761 + t * 40503 >> 7) % blocks[t, leaves[:, t]]
                key = (t << depth | leaves[:, t]) << 32 | block
                order = np.argsort(key, kind="stable")
                for p in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
                    out.append((int(key[p[0]]), VECTORS, part, numbers[p].tobytes(), x[p].astype(np.float32).tobytes(), None))
            return out

        def within(part: int, rows: list[tuple]) -> list[tuple]:
            numbers = np.concatenate([_ints(r[2]) for r in rows])
            x = np.concatenate([np.frombuffer(r[3], np.float32).reshape(-1, dim) for r in rows])
            if len(x) < 2:
                return []
            s = x @ x.T
            np.fill_diagonal(s, -np.inf)
            m = min(k, len(x) - 1)
            near = np.argpartition(-s, m - 1, axis=1)[:, :m]
            return _pairs_rows(UPDATE, part, np.repeat(numbers, m), numbers[near].ravel(), np.take_along_axis(s, near, axis=1).ravel())

        found = _grouped(_mapped(self.vectors, spread), within, self.width)
        self.lists = land(_grouped(self.vectors.withColumn("b", F.lit(None).cast("binary")).unionByName(found), self._merge(), self.width), "lists")

    def _merge(self):
        """A part's lists with what was sent to its nodes; src: how many entries are new."""
        k = self.k

        def merge(part: int, rows: list[tuple]) -> list[tuple]:
            old, base = _one(rows, LISTS), part << BITS
            n = len(_ints(old[2])) // k if old else len(_ints(_one(rows, VECTORS)[2]))
            to, near, score = _pairs(_all(rows, UPDATE))
            to, new = to - base, np.ones(len(to), bool)
            if old:
                had, had_score, _ = _lists(old, k)
                at, column = np.nonzero(had >= 0)
                to, near, score, new = np.concatenate([at, to]), np.concatenate([had[at, column], near]), np.concatenate([had_score[at, column], score]), np.concatenate([np.zeros(len(at), bool), new])
            best = _best(to, near, score, k)
            to = to[best]
            column = np.arange(len(to)) - np.searchsorted(to, to)
            lists, scores, fresh = np.full((n, k), -1, np.int64), np.full((n, k), -np.inf, np.float32), np.zeros((n, k), bool)
            lists[to, column], scores[to, column], fresh[to, column] = near[best], score[best], new[best]
            return [(part, LISTS, int(fresh.sum()), lists.tobytes(), scores.tobytes(), fresh.tobytes())]

        return merge

    def _links(self, every: bool) -> DataFrame:
        """LINKS rows (own place, number, new) of the neighbours forwards and the ``k`` nearest backwards, of nodes
        that have new ones (or of every node)."""
        k = self.k

        def back(part: int, r: tuple) -> list[tuple]:
            near, score, fresh = _lists(r, k)
            at, column = np.nonzero(near >= 0)
            to, own, s, f = near[at, column], (part << BITS) + at, score[at, column], fresh[at, column]
            some = _best(to, own, s, k)
            return _pairs_rows(EDGES, part, to[some], own[some], s[some], f[some])

        def link(part: int, rows: list[tuple]) -> list[tuple]:
            near, _, fresh = _lists(_one(rows, LISTS), k)
            edges = _all(rows, EDGES)
            to, own, s = _pairs(edges)
            f = _cat([np.frombuffer(r[4], bool) for r in edges], bool)
            some = _best(to, own, s, k)
            at, column = np.nonzero(near >= 0)
            node = np.concatenate([at, to[some] - (part << BITS)])
            other, new = np.concatenate([near[at, column], own[some]]), np.concatenate([fresh[at, column], f[some]])
            order = np.lexsort((~new, other, node))   # a link both ways is new if one is
            node, other, new = node[order], other[order], new[order]
            first = np.ones(len(node), bool)
            first[1:] = (node[1:] != node[:-1]) | (other[1:] != other[:-1])
            if not every:
                first &= np.bincount(node, weights=new, minlength=len(near))[node] > 0
            return [(part, LINKS, part, node[first].tobytes(), other[first].tobytes(), new[first].tobytes())]

        return land(_grouped(self.lists.unionByName(_mapped(self.lists, back)), link, self.width), "links")

    def _round(self) -> None:
        """Every node introduces its links to each other; nearer ones are sent to the nodes they are nearer to."""
        k, dim = self.k, self.dim
        links = self._links(False)
        asked = _mapped(links, lambda part, r: _ask(part, np.unique(_ints(r[3]))))

        def answer(part: int, rows: list[tuple]) -> list[tuple]:
            x = np.frombuffer(_one(rows, VECTORS)[3], np.float64).reshape(-1, dim).astype(np.float32)
            least = _lists(_one(rows, LISTS), k)[1].min(axis=1)   # -inf while a list has room
            out = []
            for r in _all(rows, ASK):
                at = _ints(r[2]) - (part << BITS)
                out.append((r[1], ANSWER, part, r[2], x[at].tobytes(), least[at].tobytes()))
            return out

        def meet(part: int, rows: list[tuple]) -> list[tuple]:
            _, _, node, other, new, _ = _one(rows, LINKS)
            node, other, new = _ints(node), _ints(other), np.frombuffer(new, bool)
            answers = _all(rows, ANSWER)
            numbers = _cat([_ints(r[2]) for r in answers], np.int64)   # ascending: answers come by part
            if not len(numbers):
                return []
            x = np.concatenate([np.frombuffer(r[3], np.float32).reshape(-1, dim) for r in answers])
            least = np.concatenate([np.frombuffer(r[4], np.float32) for r in answers])
            at = np.searchsorted(numbers, other)
            held, size = [], 0

            def shrink() -> list:
                to, near, s = (np.concatenate(c) for c in zip(*held, strict=True))
                some = _best(to, near, s, k)
                return [(to[some], near[some], s[some])]

            for own in np.split(np.arange(len(node)), np.flatnonzero(np.diff(node)) + 1):
                a, b = at[own[new[own]]], at[own]
                s = x[a] @ x[b].T
                apart = a[:, None] != b[None, :]
                for to, near, good in ((a[:, None], b[None, :], (s > least[a][:, None]) & apart), (b[None, :], a[:, None], (s > least[b][None, :]) & apart)):
                    i, j = np.nonzero(good)
                    held.append((np.broadcast_to(to, s.shape)[i, j], np.broadcast_to(near, s.shape)[i, j], s[i, j]))
                    size += len(i)
                if size > 4_000_000:
                    held = shrink()
                    size = len(held[0][0])
            (to, near, s), = shrink()
            return _pairs_rows(UPDATE, part, numbers[to], numbers[near], s)

        answers = _grouped(asked.unionByName(self.vectors).unionByName(self.lists), answer, self.width)
        updates = _grouped(links.unionByName(answers), meet, self.width)
        self.lists = land(_grouped(self.lists.unionByName(updates), self._merge(), self.width), "lists")

    def search(self, chosen: Column, count: int, ef: int = EF) -> DataFrame:
        """(query_id, rank, vec_id, score): the ``count`` nearest found of the rows that ``chosen`` (on vec_id)
        picks as queries. A query starts at its own node."""
        k, dim, ef = self.k, self.dim, max(ef, 2 * count)
        queries = self.good.where(chosen).select(F.col("vec_id").alias("query_id"), "v")
        queries = land(queries.join(self.classes.select("v", F.col("vec_id").alias("node")), "v").select("query_id", "node"), "queries")
        wanted = queries.select("node").distinct()
        links = self._links(True)

        def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in _rows(batch):
                    ids = _ints(r[2])
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array((r[-1] << BITS) + np.arange(len(ids)))], ["node", "src"])

        numbers = self.vectors.mapInArrow(unfold, "node long, src long").join(wanted, "node", "left_semi")
        blank = F.lit(None).cast("binary")
        chosen_rows = numbers.select(F.shiftright("src", BITS).alias("part"), F.lit(ASK).alias("kind"), "src", blank.alias("a"), blank.alias("b"), blank.alias("c"))

        def begin(part: int, rows: list[tuple]) -> list[tuple]:
            own = np.array([r[1] for r in _all(rows, ASK)], np.int64)
            if not len(own):
                return []
            at = own - (part << BITS)
            x = np.frombuffer(_one(rows, VECTORS)[3], np.float64).reshape(-1, dim)[at]
            near, score, _ = _lists(_one(rows, LISTS), k)
            lists, scores = np.full((len(at), ef), -1, np.int64), np.full((len(at), ef), -np.inf, np.float32)
            lists[:, :min(k, ef)], scores[:, :min(k, ef)] = near[at, :ef], score[at, :ef]
            return [beam_row(part // 4, own, x, lists, scores, np.zeros(lists.shape, bool))]   # queries are fewer than nodes

        def beam_row(part: int, own, x, lists, scores, done) -> tuple:
            return part, BEAM, int(((lists >= 0) & ~done).sum()), np.concatenate([own[:, None], lists], axis=1).tobytes(), x.tobytes(), scores.tobytes() + done.tobytes()

        def beam_of(rows: list[tuple]) -> tuple:
            parts = []
            for r in rows:
                a = _ints(r[2]).reshape(-1, ef + 1)
                parts.append((a[:, 0], np.frombuffer(r[3], np.float64).reshape(-1, dim), a[:, 1:], np.frombuffer(r[4], np.float32, len(a) * ef).reshape(-1, ef),
                              np.frombuffer(r[4], bool, offset=4 * len(a) * ef).reshape(-1, ef)))
            order = np.argsort(np.concatenate([p[0] for p in parts]))   # rows of a beam come in any order
            return tuple(np.concatenate(c)[order] for c in zip(*parts, strict=True))

        def expand(part: int, r: tuple) -> list[tuple]:
            _, _, lists, _, done = beam_of([r])
            return _ask(part, np.unique(lists[(lists >= 0) & ~done]))

        def give_links(part: int, rows: list[tuple]) -> list[tuple]:
            row = _one(rows, LINKS)
            node, other = _ints(row[2]), _ints(row[3])
            out = []
            for r in _all(rows, ASK):
                at = _ints(r[2]) - (part << BITS)
                a, b = np.searchsorted(node, at), np.searchsorted(node, at, side="right")
                out.append((r[1], ANSWER, part, r[2], np.concatenate([other[i:j] for i, j in zip(a, b, strict=True)]).tobytes(), (b - a).tobytes()))
            return out

        def candidates(part: int, rows: list[tuple]) -> list[tuple]:
            own, _, lists, _, done = beam_of(_all(rows, BEAM))
            answers = _all(rows, ANSWER)
            asked = _cat([_ints(r[2]) for r in answers], np.int64)
            ends = np.concatenate([[0], np.cumsum(_cat([_ints(r[4]) for r in answers], np.int64))])
            flat = _cat([_ints(r[3]) for r in answers], np.int64)
            query, seen = [], []
            for i in range(len(own)):
                todo = np.searchsorted(asked, lists[i][(lists[i] >= 0) & ~done[i]])
                if len(todo):
                    new = np.setdiff1d(np.concatenate([flat[ends[t]:ends[t + 1]] for t in todo]), np.append(lists[i], own[i]))
                    query.append(np.full(len(new), i))
                    seen.append(new)
            return [(part, CANDIDATES, part, _cat(query, np.int64).astype(np.int64).tobytes(), _cat(seen, np.int64).tobytes(), None)]

        def give_vectors(part: int, rows: list[tuple]) -> list[tuple]:
            x = np.frombuffer(_one(rows, VECTORS)[3], np.float64).reshape(-1, dim).astype(np.float32)
            return [(r[1], ANSWER, part, r[2], x[_ints(r[2]) - (part << BITS)].tobytes(), None) for r in _all(rows, ASK)]

        def step(part: int, rows: list[tuple]) -> list[tuple]:
            own, x, lists, scores, _ = beam_of(_all(rows, BEAM))
            found, answers = _one(rows, CANDIDATES), _all(rows, ANSWER)
            query, new = _ints(found[2]), _ints(found[3])
            at = np.searchsorted(_cat([_ints(r[2]) for r in answers], np.int64), new)
            y = np.concatenate([np.frombuffer(r[3], np.float32).reshape(-1, dim) for r in answers]) if answers else np.zeros((0, dim), np.float32)
            s = _cat([(x[query[i:i + 65536]].astype(np.float32) * y[at[i:i + 65536]]).sum(axis=1) for i in range(0, len(new), 65536)], np.float32)   # the same for a pair whatever its company
            near_enough = s >= scores.min(axis=1)[query]   # -inf while a beam has room
            query, new, s = query[near_enough], new[near_enough], s[near_enough]
            i, j = np.nonzero(lists >= 0)
            to, near, score = np.concatenate([i, query]), np.concatenate([lists[i, j], new]), np.concatenate([scores[i, j], s])
            known = np.concatenate([np.ones(len(i), bool), np.zeros(len(new), bool)])   # all of the beam are expanded now
            best = _best(to, near, score, ef)
            to = to[best]
            column = np.arange(len(to)) - np.searchsorted(to, to)
            lists, scores, done = np.full(lists.shape, -1, np.int64), np.full(lists.shape, -np.inf, np.float32), np.zeros(lists.shape, bool)
            lists[to, column], scores[to, column], done[to, column] = near[best], score[best], known[best]
            return [beam_row(part, own, x, lists, scores, done)]

        begun = _grouped(self.vectors.unionByName(self.lists).unionByName(chosen_rows), begin, self.width)
        beam = land(_grouped(begun, lambda part, rows: [beam_row(part, *beam_of(rows))], self.width), "beam")   # one row a part
        while (beam.agg(F.sum("src")).first()[0] or 0) > 0:
            heard = _grouped(links.unionByName(_mapped(beam, expand)), give_links, self.width)
            some = land(_grouped(beam.unionByName(heard), candidates, self.width), "candidates")
            asked = _mapped(some, lambda part, r: _ask(part, np.unique(_ints(r[3]))))
            heard = _grouped(self.vectors.unionByName(asked), give_vectors, self.width)
            beam = land(_grouped(beam.unionByName(some).unionByName(heard), step, self.width), "beam")

        # the whole beam in double precision; equal vectors give their smallest vec_ids
        def give_exact(part: int, rows: list[tuple]) -> list[tuple]:
            vectors, members = _one(rows, VECTORS), _one(rows, MEMBERS)
            x, sizes = np.frombuffer(vectors[3], np.float64).reshape(-1, dim), _ints(members[3])
            flat, ends = _ints(members[2]), np.concatenate([[0], np.cumsum(sizes)])
            out = []
            for r in _all(rows, ASK):
                at = _ints(r[2]) - (part << BITS)
                ids = np.concatenate([flat[ends[i]:ends[i + 1]] for i in at])
                out.append((r[1], ANSWER, part, r[2], x[at].tobytes(), np.concatenate([sizes[at], ids]).tobytes()))
            return out

        def final(table: pa.Table) -> pa.Table:
            rows = _rows(table)
            own, x, lists, _, _ = beam_of(_all(rows, BEAM))
            numbers, y, sizes, flat = [], [], [], []
            for r in _all(rows, ANSWER):
                numbers.append(_ints(r[2]))
                y.append(np.frombuffer(r[3], np.float64).reshape(-1, dim))
                tail = _ints(r[4])
                sizes.append(tail[:len(numbers[-1])])
                flat.append(tail[len(numbers[-1]):])
            numbers, y, flat, ends = np.concatenate(numbers), np.concatenate(y), np.concatenate(flat), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            nodes, out_ids, out_scores = [], [], []
            for i in range(len(own)):
                at = np.searchsorted(numbers, np.append(lists[i][lists[i] >= 0], own[i]))
                s = (x[i] * y[at]).sum(axis=1)
                ids = np.concatenate([flat[ends[a]:ends[a + 1]] for a in at])
                s = np.repeat(s, ends[at + 1] - ends[at])
                best = np.lexsort((ids, -s))[:count + 1]   # one of them may be the query itself
                nodes.append(int(flat[ends[at[-1]]]))
                out_ids.append(ids[best])
                out_scores.append(s[best])
            return pa.table({"node": pa.array(nodes, pa.int64()), "ids": pa.array(out_ids, pa.list_(pa.int64())), "scores": pa.array(out_scores, pa.list_(pa.float64()))})

        def ask_all(part: int, r: tuple) -> list[tuple]:
            own, _, lists, _, _ = beam_of([r])
            return _ask(part, np.unique(np.concatenate([lists[lists >= 0], own])))

        heard = _grouped(self.nodes.unionByName(_mapped(beam, ask_all)), give_exact, self.width)
        ranked = beam.unionByName(heard).repartition(self.width, "part").groupBy("part").applyInArrow(final, "node long, ids array<long>, scores array<double>")
        found = queries.join(ranked, "node").select("query_id", F.arrays_zip("ids", "scores").alias("found"))
        other = F.slice(F.filter("found", lambda f: f["ids"] != F.col("query_id")), 1, count)
        out = found.select("query_id", F.posexplode(other).alias("place", "f"))
        return out.select("query_id", (F.col("place") + 1).alias("rank"), F.col("f.ids").alias("vec_id"), F.col("f.scores").alias("score"))


def nearest_rows(vectors: DataFrame, every: int = 20, count: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of each row whose vec_id is divisible by ``every``."""
    graph = Graph(vectors, keep=count + 1)
    if graph.empty:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return graph.search(F.col("vec_id") % every == 0, count)
